"""Queries on chains, borders, irregular axes and geodesics."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import polygons, spatial, thinning
from ..session import shared_folder, table
from . import geo


def thin_events(spark, sf):
    """All events as one chain: kept when 5 km and 2 hours away from the last one kept of the whole table."""
    rows = table(spark, sf, "events").select("event_id", "ts", F.expr("35 + (event_id * 7919 % 100) / 500.0D").alias("lat"), F.expr("-110 + (event_id * 104729 % 100) / 500.0D").alias("lon"))
    return thinning.thin_all(rows, ["ts", "event_id"], "lat", "lon", "ts", 5, 2).select("event_id")


def thin_shipments(spark, sf):
    """Lines of each supplier as a chain: kept when 40 km and 3 days away from the last one kept of the supplier."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.expr("30 + (l_partkey * 7919 % 100) / 100.0D").alias("lat"), F.expr("-100 + (l_partkey * 104729 % 100) / 100.0D").alias("lon"))
    return thinning.thin_all(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "lat", "lon"], "lat", "lon", "l_shipdate", 40, 72, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber")


def _countries(spark, sf) -> str:
    """A GeoJSON file of a country for each nation: a ring of 360 corners at most whose distances are its customers' balances, with a hole; some have an island."""
    corners = table(spark, sf, "customer").groupBy("c_nationkey", F.pmod("c_custkey", F.lit(360)).alias("k")).agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    corners = corners.withColumn("r", 2.5 + F.expr("cents div n") / 800000.0)
    x, y = (lambda s: F.round(-118 + F.pmod(F.col("c_nationkey") * 5, F.lit(48)) + s * F.col("r") * F.cos(F.radians("k")), 6)), (lambda s: F.round(28 + F.pmod(F.col("c_nationkey") * 7, F.lit(18)) + s * F.col("r") * F.sin(F.radians("k")), 6))
    ring = lambda s: F.transform(F.sort_array(F.collect_list(F.struct("k", x(s).alias("x"), y(s).alias("y")))), lambda p: F.array(p["x"], p["y"]))
    rows = corners.groupBy("c_nationkey").agg(ring(F.lit(1.0)).alias("outer"), ring(F.lit(0.4)).alias("hole")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    at = F.col("n_nationkey").cast("double")
    island = F.array(F.array(-124 + at, F.lit(47.0)), F.array(-123 + at, F.lit(47.0)), F.array(-123.5 + at, F.lit(48.5)))
    polygon = F.array(F.col("outer"), F.col("hole"))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), polygon.alias("coordinates")))
    several = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(polygon, F.array(island)).alias("coordinates")))
    told = F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct(F.col("n_name").alias("NAME"))), F.lit(', "geometry": '), F.when(F.col("n_nationkey") % 2 == 1, several).otherwise(single), F.lit("}"))
    path = f"{shared_folder(spark)}/countries.geojson"
    # a collection of features is one document
    rows.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.sort_array(F.collect_list(told)), ", "), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return path


def country_points(spark, sf):
    """Places of parts in the countries of a GeoJSON file, but for one name."""
    rings = polygons.geojson(spark, _countries(spark, sf)).filter("name <> 'NATION_3'")
    return polygons.inside(geo._placed(table(spark, sf, "part"), "p_partkey"), rings, "lon", "lat").select("p_partkey", "name")


def nearest_axis(spark, sf):
    """The place of each customer's balance on an irregular axis: balances of the nation's suppliers, in order of their keys."""
    axes = spatial.axes(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", F.round("s_acctbal", -2))
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.round("c_acctbal", -2) + 50).alias("v"))
    # rounded balances repeat: each is searched for once on its nation's axis
    places = rows.select(F.col("c_nationkey").alias("s_nationkey"), F.col("v").alias("w")).distinct().join(axes, "s_nationkey").select("s_nationkey", "w", spatial.nearest_index(F.col("w"), F.col("axis")).cast("long").alias("place"))
    return rows.join(places, (F.col("c_nationkey") == F.col("s_nationkey")) & F.col("v").eqNullSafe(F.col("w"))).select("c_custkey", "place")


def geodesic_points(spark, sf):
    """A place for each customer, up to 5,000 km away on the ellipsoid."""
    lat, lon = P.geodesic_point("lat", "lon", "0.1 + c_custkey % 5000", "c_custkey * 37 % 360")
    rows = geo._customers(spark, sf).select("c_custkey", F.expr(lat).alias("lat2"), F.expr(lon).alias("lon2"))
    return rows.select("c_custkey", F.round("lat2", 8).alias("lat2"), F.round("lon2", 8).alias("lon2"))


QUERIES = {f.__name__: f for f in (thin_events, thin_shipments, country_points, nearest_axis, geodesic_points)}
_KM = "(2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"
SQL = {
    "thin_events": f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) AS t, 35 + (event_id * 7919 % 100) / 500.0::DOUBLE AS lat, -110 + (event_id * 104729 % 100) / 500.0::DOUBLE AS lon, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT 1::BIGINT AS i UNION ALL
  SELECT min(b.i) FROM f JOIN e a ON a.i = f.i JOIN e b ON b.i > a.i AND b.t - a.t >= 7200000000 AND {_KM.format(a='a', b='b')} >= 5 HAVING count(*) > 0)
SELECT event_id FROM f JOIN e USING (i)""",
    "thin_shipments": f"""WITH RECURSIVE e AS (SELECT l_suppkey, l_orderkey, l_linenumber, epoch_us(l_shipdate) AS t, 30 + (l_partkey * 7919 % 100) / 100.0::DOUBLE AS lat, -100 + (l_partkey * 104729 % 100) / 100.0::DOUBLE AS lon,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, 30 + (l_partkey * 7919 % 100) / 100.0::DOUBLE, -100 + (l_partkey * 104729 % 100) / 100.0::DOUBLE) AS i FROM lineitem),
f AS (SELECT DISTINCT l_suppkey, 1::BIGINT AS i FROM e UNION ALL
  SELECT f.l_suppkey, min(b.i) FROM f JOIN e a ON a.l_suppkey = f.l_suppkey AND a.i = f.i JOIN e b ON b.l_suppkey = a.l_suppkey AND b.i > a.i AND b.t - a.t >= 259200000000 AND {_KM.format(a='a', b='b')} >= 40 GROUP BY f.l_suppkey)
SELECT l_suppkey, l_orderkey, l_linenumber FROM f JOIN e USING (l_suppkey, i)""",
    "country_points": """WITH c AS (SELECT c_nationkey AS n, c_custkey % 360 AS k, 2.5::DOUBLE + sum(CAST(round(c_acctbal * 100) AS BIGINT)) // count(*) / 800000.0::DOUBLE AS r FROM customer GROUP BY ALL),
p AS (SELECT n, s, k, round(-118 + n * 5 % 48 + s * r * cos(radians(k)), 6) AS x, round(28 + n * 7 % 18 + s * r * sin(radians(k)), 6) AS y FROM c, (SELECT unnest([1.0::DOUBLE, 0.4::DOUBLE]) AS s)),
e AS (SELECT n, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM p WINDOW w AS (PARTITION BY n, s ORDER BY k)
  UNION ALL SELECT DISTINCT n, -124 + n + unnest([1, 0.5])::DOUBLE, unnest([47, 48.5])::DOUBLE, -124 + n + unnest([0.5, 0])::DOUBLE, unnest([48.5, 47])::DOUBLE FROM c WHERE n % 2 = 1),
q AS (SELECT p_partkey, 25 + (p_partkey * 7919 % 2400) / 100::DOUBLE AS y, -124 + (p_partkey * 104729 % 5700) / 100::DOUBLE AS x FROM part)
SELECT p_partkey, n_name AS name FROM q JOIN e ON (y1 < y) <> (y2 < y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) JOIN nation ON n_nationkey = n
WHERE n_name <> 'NATION_3' GROUP BY p_partkey, n_name HAVING count(*) % 2 = 1""",
    "nearest_axis": """WITH a AS (SELECT s_nationkey, round(s_acctbal, -2) AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier)
SELECT c_custkey, arg_min(i, [abs(v - (round(c_acctbal, -2) + 50)), i]) AS place FROM customer JOIN a ON c_nationkey = s_nationkey GROUP BY c_custkey""",
    "geodesic_points": """WITH c AS (SELECT c_custkey, radians(25 + (c_custkey * 7919 % 2400) / 100::DOUBLE) AS lat, -124 + (c_custkey * 104729 % 5700) / 100::DOUBLE AS lon, 1000 * (0.1::DOUBLE + c_custkey % 5000) AS m, radians(c_custkey * 37 % 360) AS az FROM customer),
k AS (SELECT *, 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f FROM c),
u AS (SELECT *, a * (1 - f) AS b, atan((1 - f) * tan(lat)) AS u1, atan2((1 - f) * tan(lat), cos(az)) AS s1 FROM k),
s AS (SELECT *, cos(u1) * sin(az) AS sa, (1 - pow(cos(u1) * sin(az), 2)) AS ca FROM u),
v AS (SELECT *, ca * (a * a - b * b) / (b * b) AS q FROM s),
w AS (SELECT *, m / (b * (1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))))) AS s0, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS big, f / 16 * ca * (4 + f * (4 - 3 * ca)) AS c FROM v),
x AS (SELECT *, list_reduce(list_prepend(s0, list_transform(range(12), lambda i: 0::DOUBLE)), lambda s, i: s0 + big * sin(s) * (cos(2 * s1 + s) + big / 4 * (cos(s) * (2 * cos(2 * s1 + s) * cos(2 * s1 + s) - 1)
  - big / 6 * cos(2 * s1 + s) * (4 * sin(s) * sin(s) - 3) * (4 * cos(2 * s1 + s) * cos(2 * s1 + s) - 3)))) AS s FROM w)
SELECT c_custkey, round(degrees(atan2(sin(u1) * cos(s) + cos(u1) * sin(s) * cos(az), (1 - f) * sqrt(sa * sa + pow(sin(u1) * sin(s) - cos(u1) * cos(s) * cos(az), 2)))), 8) AS lat2,
  round(lon + degrees(atan2(sin(s) * sin(az), cos(u1) * cos(s) - sin(u1) * sin(s) * cos(az)) - (1 - c) * f * sa * (s + c * sin(s) * (cos(2 * s1 + s) + c * cos(s) * (2 * pow(cos(2 * s1 + s), 2) - 1)))), 8) AS lon2 FROM x""",
}
