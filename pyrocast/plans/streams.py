"""Batch forms of keyed streams, slabs through their source, and the burn chart as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import charts, episodes, folds
from ..session import shared_folder, table
from ..sources import slabs
from ..streaming import keyed

LATS, LONS = [25 + i / 2 for i in range(48)], [-124 + i / 2 for i in range(114)]


def requests(events):
    """Events as requests: a user has two addresses, each of which two users share; some requests have no session."""
    session = F.when(F.col("event_type") != "error", F.col("user_id"))
    return events.select("event_id", "ts", F.floor((F.col("user_id") + F.pmod("event_id", F.lit(2)) * 31) / 2).alias("address"), session.alias("session"))


def chained_limit(spark, sf):
    """Two limits on requests: of an address, then of a session."""
    out = folds.limit_twice(requests(table(spark, sf, "events")), "event_id", "ts", "address", "session", 2, 6 * 3600)
    return out.select(F.col("id").alias("event_id"), F.coalesce("rejected_by", F.lit("none")).alias("rejected_by"), F.round("retry_after", 0).alias("retry_after"))


def swept_sessions(spark, sf):
    return folds.swept_sessions(table(spark, sf, "events"), "user_id", "ts").select(F.col("key").cast("long").alias("user_id"), "session", F.unix_micros("started").alias("started"), F.unix_micros("last_seen").alias("last_seen"), "requests")


def zone_hours(spark, sf):
    """Of each nation and day of orders the last share of customers in debt so far, on the nation's own area."""
    return keyed.latest(_zone_points(spark, sf), ["zone", "hour", "day"], "at").select("zone", F.unix_seconds("hour").alias("hour"), "acres")


def _zone_points(spark, sf):
    customers = table(spark, sf, "customer")
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    points = orders.select(F.col("c_nationkey").alias("zone"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("o_orderkey", F.lit(86400)))).alias("at"), (F.col("o_totalprice") / 500000).alias("fraction"))
    areas = customers.groupBy(F.col("c_nationkey").alias("zone")).agg((F.count("*") * 43560).alias("area"))
    return keyed.hourly_areas(points, areas, "zone", "at", "fraction")


def slab_scan(spark, sf):
    """Events as daily cells, written as slabs and read back through their source: two features, some days, a box of cells."""
    cells = table(spark, sf, "events").select(F.col("event_type").alias("feature"), F.to_date("ts").alias("day"), F.pmod("user_id", F.lit(48)).cast("int").alias("lat_idx"), F.pmod("event_id", F.lit(114)).cast("int").alias("lon_idx"), F.round(F.col("value") * 10).cast("int").alias("raw"))
    path = shared_folder(spark)
    slabs.write_slabs(cells, path, LATS, LONS)
    rows = slabs.read_slabs(spark, path).filter("feature IN ('click', 'view') AND day BETWEEN DATE'2024-01-05' AND DATE'2024-01-20' AND lat >= 27 AND lat < 40 AND lon_idx > 10")
    return rows.select("feature", F.col("day").cast("string").alias("day"), F.col("lat_idx").cast("long"), F.col("lon_idx").cast("long"), "lat", "lon", F.round("value", 6).alias("value"))


def burn_chart(spark, sf):
    """For each kind of event as a zone: users (cells) burn with their first such event; the zone's burnt acres by hour on its own area, downsampled to 30 points that change once in six, with the axes' limits."""
    events = table(spark, sf, "events")
    cells, area = events.select("user_id").distinct().count(), events.groupBy(F.col("event_type").alias("zone")).agg((F.count("*") * 43560).alias("area"))
    lit = events.groupBy(F.col("event_type").alias("zone"), "user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    lit = lit.select("zone", "first.ts", "first.event_id")
    order = Window.partitionBy("zone").orderBy("ts", "event_id")
    shares = lit.withColumn("fraction", F.row_number().over(order) / F.lit(cells))
    hours = charts.hourly(shares, "zone", "ts", "event_id", "fraction").join(area, "zone")
    by_hour = Window.partitionBy("zone").orderBy("hour")
    acres = F.ceil(F.col("area") * F.col("fraction") / 1000).cast("double")
    points = hours.select("zone", (F.row_number().over(by_hour) - 1).cast("long").alias("pos"), (F.unix_seconds(F.col("hour").cast("timestamp")) / 3600).alias("a1"), acres.alias("a2"))
    settings = area.select("zone", *[F.lit(None).cast("double").alias(c) if c not in ("max_points", "expand_a2", "round_a2") else F.lit(None).cast("int" if c == "max_points" else "boolean").alias(c) if c != "round_a2" else F.lit(10.0).alias(c) for c in charts.AXIS_SETTINGS])
    limits = charts.axis_limits(points, settings, "zone", "pos", "a1", "a2")
    return charts.grown(points, "zone", "pos", "a1", "a2", 30, 6).join(limits, "zone").select("zone", "pos", F.col("a1").cast("long").alias("hour"), F.col("a2").cast("long").alias("acres"), F.col("min_a1").cast("long").alias("from_hour"), F.col("max_a1").cast("long").alias("to_hour"), F.col("max_a2").cast("long").alias("to_acres"))


def returned_reward(spark, sf):
    """Events of a user with the reward since the last purchase, which ends an episode, and the mean of the last 100 episodes' rewards."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf, "events").withColumn("step", F.row_number().over(order) - 1).withColumn("done", F.col("event_type") == "purchase")
    out = episodes.rewards(steps, "user_id", "step", "value", "done")
    return out.select("user_id", "step", F.col("episode").cast("long"), F.round("cumulative", 3).alias("cumulative"), F.round("mean_reward", 7).alias("mean_reward"))


QUERIES = {f.__name__: f for f in (chained_limit, swept_sessions, zone_hours, slab_scan, burn_chart, returned_reward)}
_LIMIT = """{p}e AS (SELECT {key} AS key, event_id, t, row_number() OVER (PARTITION BY {key} ORDER BY t, event_id) AS i FROM {src}),
{p}f AS (SELECT key, event_id, i, [t] AS times, true AS allowed, 0.0::DOUBLE AS retry_after FROM {p}e WHERE i = 1
  UNION ALL
  SELECT key, event_id, i, CASE WHEN len(l) >= 2 THEN l ELSE list_append(l, t) END, len(l) < 2, CASE WHEN len(l) >= 2 THEN l[1] + 21600 - t ELSE 0.0 END
  FROM (SELECT e.key, e.event_id, e.i, e.t, list_filter(f.times, lambda x: x >= e.t - 21600) AS l FROM {p}f f JOIN {p}e e ON e.key = f.key AND e.i = f.i + 1))"""
SQL = {
    "chained_limit": f"""WITH RECURSIVE r AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, (user_id + event_id % 2 * 31) // 2 AS address, CASE WHEN event_type <> 'error' THEN user_id END AS session FROM events),
{_LIMIT.format(p="a_", key="address", src="r")},
s AS (SELECT r.* FROM r JOIN a_f USING (event_id) WHERE allowed AND session IS NOT NULL),
{_LIMIT.format(p="b_", key="session", src="s")}
SELECT event_id, CASE WHEN NOT a.allowed THEN 'address' WHEN NOT coalesce(b.allowed, true) THEN 'session' ELSE 'none' END AS rejected_by, round(CASE WHEN a.allowed THEN coalesce(b.retry_after, 0.0) ELSE a.retry_after END, 0) AS retry_after
FROM a_f a LEFT JOIN b_f b USING (event_id)""",
    "swept_sessions": """WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) // 600000000 > (lag(epoch_us(ts)) OVER w + 14400000000) // 600000000, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CAST(new AS BIGINT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS started, max(t) AS last_seen, count(*) AS requests FROM s GROUP BY user_id, session""",
    "zone_hours": """WITH p AS (SELECT c_nationkey AS zone, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS seconds, o_totalprice / 500000 AS fraction FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT c_nationkey AS zone, count(*) * 43560 AS area FROM customer GROUP BY c_nationkey),
q AS (SELECT zone, seconds // 3600 * 3600 AS hour, seconds, CAST(ceil(area * fraction / 1000) AS BIGINT) AS acres FROM p JOIN a USING (zone))
SELECT zone, hour, max(acres) AS acres FROM (SELECT * FROM q QUALIFY seconds = max(seconds) OVER (PARTITION BY zone, hour)) GROUP BY zone, hour""",
    "slab_scan": """WITH c AS (SELECT event_type AS feature, CAST(ts AS DATE) AS day, user_id % 48 AS lat_idx, event_id % 114 AS lon_idx, max(CAST(round(value * 10) AS INT)) AS raw FROM events GROUP BY ALL)
SELECT feature, CAST(day AS VARCHAR) AS day, lat_idx, lon_idx, 25 + lat_idx / 2 AS lat, -124 + lon_idx / 2 AS lon, round(raw * 0.1::DOUBLE, 6) AS value FROM c
WHERE feature IN ('click', 'view') AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND lat_idx >= 4 AND lat_idx < 30 AND lon_idx > 10""",
    "burn_chart": """WITH n AS (SELECT count(DISTINCT user_id) AS cells FROM events), a AS (SELECT event_type AS zone, count(*) * 43560 AS area FROM events GROUP BY ALL),
l AS (SELECT event_type AS zone, user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL),
s AS (SELECT zone, ts, event_id, row_number() OVER (PARTITION BY zone ORDER BY ts, event_id) / cells AS fraction FROM l, n),
h AS (SELECT zone, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS hour, arg_max(fraction, (ts, event_id)) AS fraction FROM s GROUP BY ALL),
q AS (SELECT zone, hour, ceil(area * fraction / 1000) AS a2, row_number() OVER (PARTITION BY zone ORDER BY hour) - 1 AS pos, count(*) OVER (PARTITION BY zone) AS n FROM h JOIN a USING (zone)),
x AS (SELECT zone, min(hour) AS from_hour, max(hour) AS to_hour, CAST(ceil(max(a2) / 10) * 10 + 10 AS BIGINT) AS rounded, CAST(max(a2) AS BIGINT) AS top FROM q GROUP BY zone),
m AS (SELECT *, n - n % 6 AS m FROM q WHERE n > 24 AND pos < n - n % 6),
p AS (SELECT *, round(abs((lag(hour::DOUBLE) OVER w - hour) * (lead(a2) OVER w - a2) - (lead(hour::DOUBLE) OVER w - hour) * (lag(a2) OVER w - a2)) / 2, 6) AS area FROM m WINDOW w AS (PARTITION BY zone ORDER BY pos)),
b AS (SELECT *, CASE WHEN m <= 24 THEN pos WHEN pos = 0 OR pos = m - 1 THEN -1 - pos ELSE CAST(floor((pos - 1) * 22 / (m - 2)) AS BIGINT) END AS b FROM p),
o AS (SELECT zone, pos, hour, a2 FROM b QUALIFY row_number() OVER (PARTITION BY zone, b, (pos = 0 OR pos = m - 1) ORDER BY coalesce(area, 0) DESC, pos) = 1
  UNION ALL SELECT zone, pos, hour, a2 FROM q WHERE n <= 24 OR pos >= n - n % 6)
SELECT o.zone, pos, hour, CAST(a2 AS BIGINT) AS acres, from_hour, to_hour, top AS to_acres FROM o JOIN x USING (zone)""",
    "returned_reward": """WITH s AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events),
e AS (SELECT *, coalesce(sum(CAST(event_type = 'purchase' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM s),
c AS (SELECT *, sum(value) OVER (PARTITION BY user_id, episode ORDER BY step) AS cumulative FROM e),
d AS (SELECT user_id, episode, step, cumulative FROM c WHERE event_type = 'purchase'),
m AS (SELECT user_id, episode, avg(cumulative) OVER (PARTITION BY user_id ORDER BY episode ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean_reward FROM d)
SELECT c.user_id, c.step, CAST(c.episode AS BIGINT) AS episode, round(c.cumulative, 3) AS cumulative, round(mean_reward, 7) AS mean_reward FROM c LEFT JOIN m ON m.user_id = c.user_id AND m.episode = c.episode - 1""",
}
