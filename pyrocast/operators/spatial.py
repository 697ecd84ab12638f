"""Nearest-grid lookups, radius joins over tiles, and nearest neighbours by growing rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import haversine_km
from ..session import written
from . import ordering

_KM_PER_DEGREE = 111.19
#: Places of a tile, in the mean, beyond which nearest begins with narrower tiles, and the width in km below which it doesn't.
_CROWD, _LEAST_KM = 16, 1e-3


def grid_index(value: Column, start: float, step: float, size: int) -> Column:
    """Index of the nearest point of a regular axis; of two equally near the first."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.ceil((value - start) / step - 0.5))).cast("int")


def sorted_axis(points: Column) -> Column:
    """An axis (array of doubles, in any order) as nearest_index takes it: its points in order with their places; of equal points the first, null ones left out."""
    placed = F.array_sort(F.transform(points, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i"))))
    # bound once by a transform: a lambda that names the sorted array itself would sort it again for each point
    kept = F.transform(F.array(placed), lambda all: F.filter(all, lambda p, k: p["v"].isNotNull() & ((k == 0) | ~p["v"].eqNullSafe(F.get(all, k - 1)["v"]))))
    return F.get(kept, F.lit(0))


def axes(points: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """key, axis: each key's axis as nearest_index takes it; a point's place is its row's among the key's, by order, from 0.

    Rows are numbered by ranges of key and order, whatever a key has of them; only distinct points are gathered,
    of equal points the first. Null points count as rows, but are in no axis.
    """
    placed = ordering.numbered(points.select(key, order, value.cast("double").alias("v")), [F.col(key), F.col(order)], "n")
    firsts = placed.groupBy(key, "v").agg(F.min("n").alias("n"))
    kept = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "n"))))
    return firsts.groupBy(key).agg(F.min("n").alias("first"), kept.alias("p")).select(key, F.transform("p", lambda p: F.struct(p["v"].alias("v"), (p["n"] - F.col("first")).cast("int").alias("i"))).alias("axis"))


def nearest_index(value: Column, axis: Column) -> Column:
    """Index of the axis' point nearest to value, of two equally near the first; axis: as of sorted_axis, its points need no regular steps.

    The first point not below the value is found by halving the axis: 32 steps at most, each of one comparison.
    Null for a null value or an empty axis.
    """
    n = F.size(axis)
    at = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n.cast("double"))).cast("int") + 1, F.lit(1))),
        F.struct(F.lit(0).alias("a"), n.alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s).otherwise(
            F.when(F.get(axis, F.floor((s["a"] + s["b"]) / 2).cast("int"))["v"] < value, F.struct((F.floor((s["a"] + s["b"]) / 2).cast("int") + 1).alias("a"), s["b"].alias("b"))).otherwise(
                F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b"))
            )
        ),
        lambda s: s["a"],
    )
    near = F.transform(F.array(at - 1, at), lambda k: F.when((k >= 0) & (k < n), F.struct(F.abs(F.get(axis, k)["v"] - value).alias("d"), F.get(axis, k)["i"].alias("i"))))
    return F.when(value.isNotNull() & (n > 0), F.array_min(near)["i"])


def _across(y: Column, degrees: float) -> Column:
    """Tiles around the globe in a band of latitude: none is narrower than what two rows at most so far apart may span, in this band or the next."""
    most = F.least(F.lit(90.0), F.greatest(F.abs(y - 1), F.abs(y + 2)) * degrees)
    span = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(degrees, 90.0)))) / F.greatest(F.cos(F.radians(most)), F.lit(1e-12)))))
    return F.when(most + degrees >= 90, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.floor(360 / (span * 1.0001)).cast("double")))


def _tiles(rows: DataFrame, lat: str, lon: str, degrees: float, around: bool) -> DataFrame:
    """rows with their tile (__y, __x), or once for each tile next to it; tiles meet at the date line."""
    y = F.floor(F.col(lat) / degrees)
    t = rows.withColumn("__y", F.explode(F.array(y - 1, y, y + 1)) if around else y)
    n = _across(F.col("__y"), degrees)
    x = F.floor((F.col(lon) + 180) / 360 * n)
    near = F.explode(F.array_distinct(F.array(*[F.pmod(x + i, n.cast("long")) for i in (-1, 0, 1)])))
    return t.withColumn("__x", near if around else F.pmod(x, n.cast("long")))


def within(left: DataFrame, right: DataFrame, km: float, residual: Column | None = None, how: str = "inner") -> DataFrame:
    """Join of rows at most km apart; both sides have lat and lon, the right one prefixed r_.

    Tiles are as wide as partners may be apart at their latitude, so these lie in the same or the next
    tile, over the date line and the poles too: an equi-join on tiles with the distance as its residual,
    inner, left_semi or left_anti. Only the left side is repeated (nine times at most) for an inner join,
    only the right one for the others.
    """
    degrees = km / _KM_PER_DEGREE * 1.001
    inner = how == "inner"
    a = _tiles(left, "lat", "lon", degrees, inner)
    b = _tiles(right, "r_lat", "r_lon", degrees, not inner).withColumnRenamed("__x", "__rx").withColumnRenamed("__y", "__ry")
    near = F.expr(haversine_km("lat", "lon", "r_lat", "r_lon")) <= km
    near = near & residual if residual is not None else near
    return a.join(b, (F.col("__x") == F.col("__rx")) & (F.col("__y") == F.col("__ry")) & near, how).drop("__x", "__y", "__rx", "__ry")


def _crowd(right: DataFrame, km: float) -> float:
    """How many rows, the row itself included, share a tile of km with a row, in the mean."""
    counted = _tiles(right, "r_lat", "r_lon", km / _KM_PER_DEGREE * 1.001, False).groupBy("__y", "__x").agg(F.count("*").cast("double").alias("n"))
    return counted.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float) -> DataFrame:
    """left_id, right_id, distance to the nearest right row, at any distance; ties go to the smaller right_id.

    Places are compared, not rows: each place of either side once, with the smallest right_id there.
    km: where most rows have a partner; a third of it, or a third of that and so on, is taken first where tiles of that
    width hold more than _CROWD right places. Places that have no partner there look in rings three times as wide, until
    all have one; one far from a crowd is held against all of it that its ring's tiles hold. Rows without a place have no
    partner; without right rows the result is empty.
    """
    left = left.filter("lat IS NOT NULL AND lon IS NOT NULL")
    right = written(right.filter("r_lat IS NOT NULL AND r_lon IS NOT NULL").groupBy("r_lat", "r_lon").agg(F.min(right_id).alias(right_id)))
    seeking = written(left.select("lat", "lon").distinct())
    while km > _LEAST_KM and _crowd(right, km) > _CROWD:
        km /= 3
    found = None
    while True:
        pairs = within(seeking, right, km).withColumn("d", F.expr(haversine_km("lat", "lon", "r_lat", "r_lon")))
        best = written(pairs.groupBy("lat", "lon").agg(F.min(F.struct("d", right_id)).alias("__best")))
        found = best if found is None else found.unionByName(best)
        if km >= 6371.0088 * math.pi:
            break
        seeking = written(seeking.join(best, ["lat", "lon"], "left_anti"))
        if seeking.isEmpty() or right.isEmpty():
            break
        km *= 3
    # a left_id at several places takes the nearest of them all
    best = left.select(left_id, "lat", "lon").join(found, ["lat", "lon"]).groupBy(left_id).agg(F.min("__best").alias("__best"))
    return best.select(left_id, F.col(f"__best.{right_id}").alias(right_id), F.col("__best.d").alias("distance_km"))
