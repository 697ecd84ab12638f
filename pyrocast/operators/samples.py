"""Sample coordinates: thinned positives and three kinds of negatives.

Positives and negatives have lat, lon, at (timestamp). Random choices come from hashes of the row's
values and a seed, so equal input gives equal samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics as P
from ..sources.readers import random_points
from . import folds, polygons, spatial, thinning
from .timeseries import first_by_priority


@dataclass(frozen=True)
class Settings:
    # Distances in km, times in hours or days, the span of dates.
    positive_km: float = 5
    positive_hours: float = 2
    far_count: int = 5000
    far_km: float = 100
    near_km: float = 100
    near_days: tuple[int, int] = (90, 120)
    spacing_km: float = 5
    spacing_days: int = 120
    start: str = "2014-03-01"
    end: str = "2025-03-31"
    seed: int = 42


def _uniform(seed: int, part: int, *columns: str) -> Column:
    return (F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _inside(ring) -> Column:
    box = F.expr(P.in_bbox("lat", "lon"))
    return box & F.expr(P.in_polygon("lon", "lat", ring)) if ring else box


def positives(incidents: DataFrame, ring=None, s: Settings = Settings(), borders: DataFrame | None = None) -> DataFrame:
    """Incidents inside box and ring, or inside the box and a country's borders (rows of polygons.geojson), thinned from the last one kept of the whole table."""
    rows = incidents.filter(_inside(ring) & F.col("discovered_at").isNotNull()).select("lat", "lon", F.col("discovered_at").alias("at"))
    if borders is not None:
        rows = polygons.inside(rows, borders, "lon", "lat").drop("name")
    return thinning.thin_all(rows, ["at", "lat", "lon"], "lat", "lon", "at", s.positive_km, s.positive_hours).select("lat", "lon", "at")


def _spaced(rows: DataFrame, s: Settings, degrees: float) -> DataFrame:
    """Rows that are far in place or time from those accepted before them."""
    order = rows.withColumn("order", F.xxhash64("lat", "lon", "at"))
    return folds.accept_far(order, "order", "lat", "lon", "at", s.spacing_km, s.spacing_days, degrees).select(*rows.columns)


def _prefixed(rows: DataFrame) -> DataFrame:
    return rows.select([F.col(c).alias(f"r_{c}") for c in rows.columns])


def far_negatives(spark: SparkSession, yes: DataFrame, ring=None, s: Settings = Settings(), draws: int | None = None, degrees: float = 5.0) -> DataFrame:
    """Random places and days at least far_km from every positive: the first far_count of the draws that pass.

    Where too few pass, four times as many are drawn, up to four times; fewer still is an error.
    """
    (lat, lon), days = (P.BBOX["lat"], P.BBOX["lon"]), (spark.sql(f"SELECT datediff('{s.end}', '{s.start}')").first()[0])
    draws = draws or 20 * s.far_count
    for _ in range(5):
        points = random_points(spark, draws, s.seed, lat, lon, s.start, days).withColumn("at", F.col("day").cast("timestamp"))
        free = spatial.within(points.filter(_inside(ring)), _prefixed(yes), s.far_km, how="left_anti")
        found = _spaced(free.select("id", "lat", "lon", "at"), s, degrees)
        if found.count() >= s.far_count:
            return found.orderBy("id").limit(s.far_count).drop("id")
        draws *= 4
    raise ValueError(f"of {draws // 4} places too few are {s.far_km} km from all positives")


def near_negatives(yes: DataFrame, ring=None, s: Settings = Settings(), parity: bool = False, degrees: float = 5.0) -> DataFrame:
    """For each positive a place within near_km, at a time 90 to 120 days before or after.

    A place goes if a positive within near_km of it is less than 90 days from the anchor. The anchor
    itself doesn't count, or nearly all places would go; with parity=True it does.
    """
    key = ["lat", "lon", "at"]
    km, bearing = 0.1 + _uniform(s.seed, 1, *key) * (s.near_km - 0.1), _uniform(s.seed, 2, *key) * 360
    low, high = s.near_days
    shift = F.floor(low + _uniform(s.seed, 3, *key) * (high - low + 1)) * F.when(_uniform(s.seed, 4, *key) < 0.5, -1).otherwise(1)
    new_lat, new_lon = P.geodesic_point("a_lat", "a_lon", "km", "bearing")
    rows = yes.withColumns({"km": km, "bearing": bearing, "shift": shift.cast("int")}).select(F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("at").alias("a_at"), "km", "bearing", "shift")
    rows = rows.withColumn("lat", F.expr(new_lat)).withColumn("lon", F.expr(new_lon)).filter(_inside(ring))
    soon = F.abs(F.floor((F.unix_timestamp("r_at") - F.unix_timestamp("a_at")) / 86400)) < low
    if not parity:
        soon = soon & ~((F.col("r_lat") == F.col("a_lat")) & (F.col("r_lon") == F.col("a_lon")) & (F.col("r_at") == F.col("a_at")))
    free = spatial.within(rows, _prefixed(yes), s.near_km, residual=soon, how="left_anti")
    moved = free.withColumn("at", F.col("a_at") + F.make_dt_interval(F.col("shift")))
    inside = moved.filter(F.col("at").between(F.lit(s.start).cast("timestamp"), F.lit(s.end).cast("timestamp")))
    return _spaced(inside.select("lat", "lon", "at"), s, degrees)


def year_negatives(yes: DataFrame, s: Settings = Settings(), degrees: float = 5.0) -> DataFrame:
    """Each positive's place, some whole spans of 365 days earlier, where that isn't a positive itself."""
    room = F.floor((F.unix_timestamp("at") - F.unix_timestamp(F.lit(s.start).cast("timestamp"))) / 86400 / 365)
    back = F.floor(1 + _uniform(s.seed, 5, "lat", "lon", "at") * room).cast("int")
    moved = yes.filter(room >= 1).withColumn("at", F.col("at") - F.make_dt_interval(F.least(back, room.cast("int")) * 365))
    return _spaced(moved.join(yes, ["lat", "lon", "at"], "left_anti").select("lat", "lon", "at"), s, degrees)


def counted(samples: DataFrame, kind: str) -> DataFrame:
    """How many samples there are of each kind, and of all (kind null)."""
    return samples.rollup(kind).agg(F.count("*").alias("n"))


def coordinates(spark: SparkSession, incidents: DataFrame, ring=None, s: Settings = Settings()) -> DataFrame:
    """latitude, longitude, datetime, Wildfire: positives and negatives; of equal places and times the first class stays."""
    yes = positives(incidents, ring, s)
    parts = [(yes, "Yes"), (far_negatives(spark, yes, ring, s), "No"), (near_negatives(yes, ring, s), "No"), (year_negatives(yes, s), "No")]
    union = None
    for i, (rows, label) in enumerate(parts):
        rows = rows.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("at").alias("datetime"), F.lit(label).alias("Wildfire"), F.lit(i).alias("class"))
        union = rows if union is None else union.unionByName(rows)
    return first_by_priority(union, ["latitude", "longitude", "datetime"], [F.col("class")]).drop("class")
