"""Series for charts: visible windows, downsampling, axis extents, hourly points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible(points: DataFrame, series: str, pos: str, most: int, start: int | None = None) -> DataFrame:
    """`most` points from start, or the last ones."""
    if start is not None:
        return points.filter((F.col(pos) >= start) & (F.col(pos) < start + most))
    n = F.max(pos).over(Window.partitionBy(series))
    return points.withColumn("__last", n).filter(F.col(pos) > F.col("__last") - most).drop("__last")


def ordered(points: DataFrame, series: str, by: list[str]) -> DataFrame:
    """points with pos, their place in the order of their series, from 0, as the other functions take them."""
    return points.withColumn("pos", F.row_number().over(Window.partitionBy(series).orderBy(*by)) - 1)


def downsample(points: DataFrame, series: str, pos: str, a1: str, a2: str, size: int) -> DataFrame:
    """First and last point, and of each bucket between them that with the largest triangle area with its neighbours.

    Positions count from 0 without gaps. Of equal areas the first wins; series of at most `size`
    points stay as they are.
    """
    order = Window.partitionBy(series).orderBy(pos)
    n = F.count("*").over(Window.partitionBy(series))
    x0, y0, x2, y2 = (f(F.col(c)).over(order) for f in (F.lag, F.lead) for c in (a1, a2))
    area = F.abs((x0 - F.col(a1)) * (y2 - F.col(a2)) - (x2 - F.col(a1)) * (y0 - F.col(a2))) / 2
    rows = points.withColumn("__n", n).withColumn("__area", F.round(area, 6))
    ends = (F.col(pos) == 0) | (F.col(pos) == F.col("__n") - 1)
    bucket = F.when(F.col("__n") <= size, F.col(pos)).when(ends, -1 - F.col(pos)).otherwise(F.floor((F.col(pos) - 1) * (size - 2) / (F.col("__n") - 2)))
    best = rows.withColumn("__b", bucket).withColumn("__e", ends).groupBy(series, "__b", "__e").agg(F.min(F.struct((-F.coalesce("__area", F.lit(0.0))).alias("a"), pos, a1, a2)).alias("m"))
    return best.select(series, F.col(f"m.{pos}").alias(pos), F.col(f"m.{a1}").alias(a1), F.col(f"m.{a2}").alias(a2))


def grown(points: DataFrame, series: str, pos: str, a1: str, a2: str, most: int, grow: int, max_points: int | None = None) -> DataFrame:
    """Series with more than most - grow visible points: the first ones downsampled to that number, then the last (count % grow) as they are.

    So that points change only once in `grow` steps. max_points: only the last so many are visible and
    counted, yet the sample is taken from the beginning of all points.
    """
    n = F.count("*").over(Window.partitionBy(series))
    seen = n if max_points is None else F.least(n, F.lit(max_points))
    rows = points.withColumn("__all", n).withColumn("__seen", seen).withColumn("__tail", F.pmod("__seen", F.lit(grow)))
    long = F.col("__seen") > most - grow
    head = rows.filter(long & (F.col(pos) < F.col("__seen") - F.col("__tail"))).select(series, pos, a1, a2)
    rest = rows.filter(F.when(long, F.col(pos) >= F.col("__all") - F.col("__tail")).otherwise(F.col(pos) >= F.col("__all") - F.col("__seen")))
    return downsample(head, series, pos, a1, a2, most - grow).unionByName(rest.select(series, pos, a1, a2))


#: Columns of settings that a series may have; null where it has none.
AXIS_SETTINGS = ("max_points", "fixed_min_a1", "fixed_max_a1", "fixed_min_a2", "fixed_max_a2", "initial_max_a1", "expand_a2", "round_a2")
# Limits of axes without points.
EMPTY_MIN, EMPTY_MAX = 0.0, 100.0


def axis_limits(points: DataFrame, settings: DataFrame, series: str, pos: str, a1: str, a2: str) -> DataFrame:
    """series, min_a1, max_a1, min_a2, max_a2 of each row of settings (series and AXIS_SETTINGS).

    A fixed minimum holds. The first axis ends at its fixed maximum while there are no more points than
    that; at the initial one, or the number of visible points, while fewer are seen; else where the seen
    points do. The second axis ends where all points do if it expands (rounded up, and one step more, but not below its
    fixed maximum), at its fixed maximum if not, or where the seen points do.
    """
    s = {c: F.col(f"__{c}") for c in AXIS_SETTINGS}
    told = settings.select(series, *[F.col(c).alias(f"__{c}") for c in AXIS_SETTINGS])
    n = F.count("*").over(Window.partitionBy(series))
    cut = (s["max_points"] > 0) & (F.col("__n") >= s["max_points"])
    rows = points.withColumn("__n", n).join(told.select(series, "__max_points"), series)
    seen = ~F.coalesce(cut, F.lit(False)) | (F.col(pos) >= F.col("__n") - F.col("__max_points"))
    of_seen = lambda f, c: f(F.when(seen, F.col(c)))
    sums = rows.groupBy(series).agg(
        F.count("*").alias("__n"), F.count_if(seen).alias("__seen"), of_seen(F.min, a1).alias("__low1"), of_seen(F.max, a1).alias("__high1"), of_seen(F.min, a2).alias("__low2"), of_seen(F.max, a2).alias("__high2"), F.max(a2).alias("__all2")
    )
    r = told.join(sums, series, "left").na.fill(0, ["__n", "__seen"])
    # zero counts as not set where the number itself isn't asked for
    initial, points_told = F.nullif("__initial_max_a1", F.lit(0)), F.nullif("__max_points", F.lit(0))
    none = F.col("__seen") == 0
    few = F.coalesce(F.col("__seen") < points_told, F.lit(False))
    max_a1 = F.when(F.coalesce(F.col("__n") <= s["fixed_max_a1"], F.lit(False)), s["fixed_max_a1"]).when(none, F.coalesce(initial, points_told, F.lit(EMPTY_MAX))).when(few, F.coalesce(initial, points_told)).otherwise(F.col("__high1"))
    step = F.nullif("__round_a2", F.lit(0))
    stepped = F.coalesce(F.ceil(F.col("__all2") / step) * step + step, F.col("__all2"))
    expand = F.coalesce(s["expand_a2"], F.lit(True))
    max_a2 = (
        F.when(~expand & s["fixed_max_a2"].isNotNull(), s["fixed_max_a2"])
        .when(none, F.lit(EMPTY_MAX))
        .when(expand & (F.coalesce(s["fixed_max_a2"], F.lit(0)) != 0), F.greatest(s["fixed_max_a2"], stepped))
        .when(expand, F.col("__all2"))
        .otherwise(F.col("__high2"))
    )
    low = lambda fixed, c: F.coalesce(fixed, F.when(none, F.lit(EMPTY_MIN)).otherwise(F.col(c)))
    limits = {"min_a1": low(s["fixed_min_a1"], "__low1"), "max_a1": max_a1, "min_a2": low(s["fixed_min_a2"], "__low2"), "max_a2": max_a2}
    return r.select(series, *[x.cast("double").alias(k) for k, x in limits.items()])


def extents(points: DataFrame, series: str, a1: str, a2: str, initial_max_a1: float, fixed_min_a2: float, step: int = 10) -> DataFrame:
    """Axis limits of each series: at least the initial maximum; the second axis up to the next step."""
    return points.groupBy(series).agg(
        F.min(a1).alias("min_a1"),
        F.greatest(F.max(a1), F.lit(float(initial_max_a1))).alias("max_a1"),
        F.least(F.min(a2), F.lit(float(fixed_min_a2))).alias("min_a2"),
        (F.ceil(F.max(a2) / step) * step).cast("double").alias("max_a2"),
    )


def hourly(points: DataFrame, zone: str, at: str, tie: str, value: str) -> DataFrame:
    """The last value of each zone and hour."""
    return points.groupBy(zone, F.date_trunc("hour", at).alias("hour")).agg(F.max_by(value, F.struct(at, tie)).alias(value))
