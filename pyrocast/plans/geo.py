"""Spatial queries: customers, suppliers and parts at places derived from their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import folds, raster, spatial
from ..session import table

# A ring around the middle of the country, as (lon, lat).
RING = [(-118.0, 33.0), (-100.0, 30.0), (-84.0, 33.5), (-88.0, 44.0), (-104.0, 47.0), (-120.0, 43.0)]
_LAT = "25 + ({} * 7919 % 2400) / 100"
_LON = "-124 + ({} * 104729 % 5700) / 100"


def _placed(rows, key: str, prefix: str = ""):
    return rows.select(key, F.expr(f"CAST({_LAT.format(key)} AS DOUBLE)").alias(f"{prefix}lat"), F.expr(f"CAST({_LON.format(key)} AS DOUBLE)").alias(f"{prefix}lon"))


def _customers(spark, sf):
    return _placed(table(spark, sf, "customer"), "c_custkey")


def _suppliers(spark, sf):
    return _placed(table(spark, sf, "supplier"), "s_suppkey", "r_")


def nearest_supplier(spark, sf):
    """The nearest supplier, at any distance."""
    out = spatial.nearest(_customers(spark, sf), _suppliers(spark, sf), "c_custkey", "s_suppkey", 100)
    return out.select("c_custkey", "s_suppkey", F.round("distance_km", 4).alias("distance_km"))


def radius_anti(spark, sf):
    """Customers without a supplier within 100 km."""
    return spatial.within(_customers(spark, sf), _suppliers(spark, sf), 100, how="left_anti").select("c_custkey")


def theta_anti(spark, sf):
    """Customers without a supplier within 150 km whose key is less than 30 away."""
    near = F.abs(F.col("c_custkey") - F.col("s_suppkey")) < 30
    return spatial.within(_customers(spark, sf), _suppliers(spark, sf), 150, residual=near, how="left_anti").select("c_custkey")


def bbox_polygon(spark, sf):
    rows = _placed(table(spark, sf, "part"), "p_partkey")
    return rows.select("p_partkey", F.expr(P.in_bbox("lat + 1", "lon")).alias("in_box"), F.expr(P.in_polygon("lon", "lat", RING)).alias("in_ring"))


def offset_points(spark, sf):
    lat, lon = P.offset_point("lat", "lon", "50 + c_custkey % 100", "c_custkey * 37 % 360")
    rows = _customers(spark, sf).select("*", F.expr(lat).alias("lat2"), F.expr(lon).alias("lon2"))
    return rows.select("c_custkey", F.round("lat2", 5).alias("lat2"), F.round("lon2", 5).alias("lon2"), F.expr(f"round({P.haversine_km('lat', 'lon', 'lat2', 'lon2')}, 3)").alias("km"))


def nearest_grid(spark, sf):
    """Cells of a 4 km grid (a twenty-fourth of a degree) for each customer."""
    rows = _customers(spark, sf)
    return rows.select("c_custkey", spatial.grid_index(F.col("lat") + 0.013, 25.0, 1 / 24, 1386).alias("row"), spatial.grid_index(F.col("lon") + 0.013, -124.0, 1 / 24, 1386).alias("col"))


def thin_positives(spark, sf):
    """Events of a station kept when 5 km and 2 hours away from the last one kept."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", F.expr("35 + (event_id * 7919 % 100) / 500.0D").alias("lat"), F.expr("-110 + (event_id * 104729 % 100) / 500.0D").alias("lon"))
    return folds.thin(rows, ["user_id"], ["ts", "event_id"], "lat", "lon", "ts", 5, 2).select("user_id", "event_id")


def grid_resample(spark, sf):
    """Each brand's parts as a raster of 10 rows and 7 columns, to 14 x 5, nearest and bilinear."""
    cells = table(spark, sf, "part").groupBy(F.col("p_brand").alias("image"), F.pmod("p_partkey", F.lit(10)).alias("row"), F.pmod(F.floor(F.col("p_partkey") / 10), F.lit(7)).alias("col")).agg(F.avg("p_size").alias("value"))
    images = cells.select("image").distinct()
    full = images.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(6)))).join(cells, ["image", "row", "col"], "left").na.fill(0.0, ["value"])
    a = raster.resample(full, "image", 14, 5, False).withColumn("mode", F.lit("nearest"))
    b = raster.resample(full, "image", 14, 5, True).withColumn("mode", F.lit("bilinear"))
    return a.unionByName(b).withColumn("value", F.round("value", 4)).select("image", "mode", F.col("x").cast("long"), F.col("y").cast("long"), "value")


def line_cells(spark, sf):
    """Cells of a line for each supplier, and whether they belong to its dashed form."""
    rows = table(spark, sf, "supplier").select("s_suppkey", *[F.expr(f"CAST(s_suppkey * {m} % {n} AS INT)").alias(c) for c, m, n in (("x0", 7, 40), ("y0", 11, 30), ("x1", 13, 37), ("y1", 17, 23))])
    cells = rows.select("s_suppkey", F.explode(raster.line_cells("x0", "y0", "x1", "y1")).alias("c"))
    return cells.select("s_suppkey", F.col("c.i").cast("long").alias("i"), F.col("c.x").cast("long").alias("x"), F.col("c.y").cast("long").alias("y"), (F.col("c.i") % 2 == 0).alias("dashed"))


def height_bytes(spark, sf):
    out = raster.two_bytes(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice")
    return out.select("p_partkey", F.col("high").cast("long"), F.col("low").cast("long"))


_C = f"(SELECT c_custkey, CAST({_LAT.format('c_custkey')} AS DOUBLE) AS lat, CAST({_LON.format('c_custkey')} AS DOUBLE) AS lon FROM customer)"
_S = f"(SELECT s_suppkey, CAST({_LAT.format('s_suppkey')} AS DOUBLE) AS r_lat, CAST({_LON.format('s_suppkey')} AS DOUBLE) AS r_lon FROM supplier)"
# the chord of the unit sphere
_KM = "2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(cos(radians({0})) * cos(radians({1})) - cos(radians({2})) * cos(radians({3})), 2) + pow(cos(radians({0})) * sin(radians({1})) - cos(radians({2})) * sin(radians({3})), 2) + pow(sin(radians({0})) - sin(radians({2})), 2)) / 2))"
_D = _KM.format("lat", "lon", "r_lat", "r_lon")
_GRID = "CAST(greatest(0, least(1385, ceil(({} - {}) / (1.0::DOUBLE / 24) - 0.5))) AS INT)"
_RASTER = """WITH cells AS (SELECT p_brand AS image, p_partkey % 10 AS row, (p_partkey // 10) % 7 AS col, avg(p_size) AS v FROM part GROUP BY ALL),
p AS (SELECT image, row, col, coalesce(v, 0.0) AS value FROM (SELECT image, row, col FROM (SELECT DISTINCT image FROM cells), (SELECT unnest(range(10)) AS row), (SELECT unnest(range(7)) AS col)) i LEFT JOIN cells USING (image, row, col)),
g AS (SELECT image, x, y FROM (SELECT DISTINCT image FROM cells), (SELECT unnest(range(14)) AS x), (SELECT unnest(range(5)) AS y)),
f AS (SELECT *, x * 6 / 13 AS fx, y * 9 / 4 AS fy FROM g)"""

QUERIES = {f.__name__: f for f in (nearest_supplier, radius_anti, theta_anti, bbox_polygon, offset_points, nearest_grid, thin_positives, grid_resample, line_cells, height_bytes)}
SQL = {
    "nearest_supplier": f"SELECT c_custkey, s_suppkey, round(d, 4) AS distance_km FROM (SELECT c_custkey, s_suppkey, {_D} AS d FROM {_C}, {_S}) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) = 1",
    "radius_anti": f"SELECT c_custkey FROM {_C} WHERE NOT EXISTS (SELECT 1 FROM {_S} WHERE {_D} <= 100)",
    "theta_anti": f"SELECT c_custkey FROM {_C} WHERE NOT EXISTS (SELECT 1 FROM {_S} WHERE {_D} <= 150 AND abs(c_custkey - s_suppkey) < 30)",
    "bbox_polygon": f"""WITH p AS (SELECT p_partkey, CAST({_LAT.format('p_partkey')} AS DOUBLE) AS lat, CAST({_LON.format('p_partkey')} AS DOUBLE) AS lon FROM part),
e AS (SELECT * FROM (VALUES (-118.0::DOUBLE, 33.0::DOUBLE, -100.0::DOUBLE, 30.0::DOUBLE), (-100.0, 30.0, -84.0, 33.5), (-84.0, 33.5, -88.0, 44.0), (-88.0, 44.0, -104.0, 47.0), (-104.0, 47.0, -120.0, 43.0), (-120.0, 43.0, -118.0, 33.0)) t(x1, y1, x2, y2))
SELECT p_partkey, any_value(lat + 1 >= 24.396308 AND lat + 1 <= 49.384358 AND lon >= -125.0 AND lon <= -66.93457) AS in_box, count(*) FILTER ((y1 < lat) <> (y2 < lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1 AS in_ring FROM p, e GROUP BY p_partkey""",
    "offset_points": f"""WITH c AS (SELECT c_custkey, radians(lat) AS a, radians(lon) AS b, (50 + c_custkey % 100) / 6371.0088::DOUBLE AS d, radians(c_custkey * 37 % 360) AS t FROM {_C}),
v AS (SELECT *, cos(a) * cos(b) * cos(d) + sin(d) * (-sin(a) * cos(b) * cos(t) - sin(b) * sin(t)) AS x, cos(a) * sin(b) * cos(d) + sin(d) * (-sin(a) * sin(b) * cos(t) + cos(b) * sin(t)) AS y, sin(a) * cos(d) + sin(d) * cos(a) * cos(t) AS z FROM c)
SELECT c_custkey, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS lat2, round(degrees(atan2(y, x)), 5) AS lon2, round(6371.0088::DOUBLE * d, 3) AS km FROM v""",
    "nearest_grid": f"SELECT c_custkey, {_GRID.format('lat + 0.013::DOUBLE', '25.0::DOUBLE')} AS row, {_GRID.format('lon + 0.013::DOUBLE', '(-124.0)::DOUBLE')} AS col FROM {_C}",
    "thin_positives": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, 35 + (event_id * 7919 % 100) / 500.0::DOUBLE AS lat, -110 + (event_id * 104729 % 100) / 500.0::DOUBLE AS lon, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, ts AS kt, lat AS klat, lon AS klon, true AS kept FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN k THEN ts ELSE kt END, CASE WHEN k THEN lat ELSE klat END, CASE WHEN k THEN lon ELSE klon END, k
  FROM (SELECT e.*, kt, klat, klon, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', kt)) >= 7200 AND {_KM.format('klat', 'klon', 'lat', 'lon')} >= 5 AS k FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, event_id FROM f WHERE kept""",
    "grid_resample": f"""{_RASTER}
SELECT g.image, 'nearest' AS mode, x, y, round(value, 4) AS value FROM g JOIN p ON p.image = g.image AND p.col = x * 7 // 14 AND p.row = 9 - y * 10 // 5
UNION ALL
SELECT f.image, 'bilinear' AS mode, x, y, round(sum((1 - abs(fx - floor(fx) - dx)) * (1 - abs(fy - floor(fy) - dy)) * value), 4) AS value
FROM (SELECT * FROM f, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)) f JOIN p ON p.image = f.image AND p.col = least(floor(fx) + dx, 6) AND p.row = 9 - least(floor(fy) + dy, 9)
GROUP BY f.image, x, y""",
    "line_cells": """WITH s AS (SELECT s_suppkey, s_suppkey * 7 % 40 AS x0, s_suppkey * 11 % 30 AS y0, s_suppkey * 13 % 37 AS x1, s_suppkey * 17 % 23 AS y1 FROM supplier),
n AS (SELECT *, abs(x1 - x0) AS dx, abs(y1 - y0) AS dy, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM s),
c AS (SELECT *, unnest(range(n + 1)) AS i FROM n),
m AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (2 * i * least(dx, dy) + n - 1) // (2 * n) END AS minor FROM c)
SELECT s_suppkey, i, CAST(x0 + sign(x1 - x0) * CASE WHEN dx >= dy THEN i ELSE minor END AS BIGINT) AS x, CAST(y0 + sign(y1 - y0) * CASE WHEN dx >= dy THEN minor ELSE i END AS BIGINT) AS y, i % 2 = 0 AS dashed FROM m""",
    "height_bytes": """WITH s AS (SELECT p_partkey, CASE WHEN b > a THEN CAST(floor((p_retailprice - a) / (b - a) * 65535) AS BIGINT) ELSE 0 END AS s
  FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS a, max(p_retailprice) OVER (PARTITION BY p_brand) AS b FROM part))
SELECT p_partkey, s // 256 AS high, s % 256 AS low FROM s""",
}
