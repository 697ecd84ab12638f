"""Time series queries: events as daily weather readings of stations (users) and features (types)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import folds
from ..operators import timeseries as S
from ..session import table


def _events(spark, sf):
    return table(spark, sf, "events")


def _daily(spark, sf):
    return _events(spark, sf).groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))


def _calendar(spark, sf):
    daily = _daily(spark, sf)
    spans = daily.groupBy("user_id", "event_type").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = S.calendar(spans, F.date_add("a", -1), F.date_add("b", 1)).drop("a", "b")
    return days.join(daily, ["user_id", "event_type", "day"], "left")


def calendar_fill(spark, sf):
    return _calendar(spark, sf).withColumn("day", F.col("day").cast("string"))


def interpolate(spark, sf):
    out = S.interpolate(_calendar(spark, sf), ["user_id", "event_type"], "day", "value")
    return out.select("user_id", "event_type", F.col("day").cast("string"), F.round("filled", 8).alias("filled"))


def fill_both(spark, sf):
    return S.fill_both(_calendar(spark, sf), ["user_id", "event_type"], "day", "value").select("user_id", "event_type", F.col("day").cast("string"), "filled")


FEATURES = ["click", "error", "purchase", "signup", "view"]


def window_days(spark, sf):
    """Windows from 6 days before to 1 day after each station's middle day, a column for each feature."""
    daily = _daily(spark, sf)
    anchors = daily.groupBy("user_id").agg(F.date_add(F.min("day"), 10).alias("at")).withColumn("sample_id", F.col("user_id"))
    out = S.interval_windows(anchors, daily.withColumnRenamed("event_type", "feature"), ["user_id"], FEATURES, 6, 1, 2, F.pmod("user_id", F.lit(2)) == 0)
    return out.select("sample_id", F.col("day").cast("string"), "label", *FEATURES)


def sequence_build(spark, sf):
    """Orders of exactly four lines as sequences; positive where a line was returned."""
    lines = table(spark, sf, "lineitem")
    out = S.sequences(lines, ["l_orderkey"], ["l_linenumber"], ["l_quantity", "l_discount"], 4, F.col("l_returnflag") == "R")
    return out.select("l_orderkey", "label", F.round(F.aggregate("steps", F.lit(0.0), lambda a, s: a + s[0]), 2).alias("quantity"), F.size("steps").cast("long").alias("n_steps"))


def strat_split(spark, sf):
    """56 / 14 / 30 percent of each order status, in order of a multiplicative hash of the key."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    order = [F.pmod(F.col("o_orderkey") * 48271, F.lit(2147483647)), F.col("o_orderkey")]
    return S.stratified_split(orders, "o_orderstatus", order, [("train", 0.56), ("valid", 0.14), ("test", 0.30)])


def sentinel_filter(spark, sf):
    rows = table(spark, sf, "lineitem")
    kept = rows.filter(S.not_sentinel(["l_quantity", "l_tax"], 0.0))
    raw = S.unpack(F.col("l_quantity"), F.lit(50.0), F.lit(0.1), F.lit(5.0))
    return kept.select("l_orderkey", "l_linenumber", F.round(raw, 4).alias("unpacked"))


def asof_latest(spark, sf):
    """Of each purchase the value of the station's last view before it."""
    rows = S.latest_before(_events(spark, sf), "user_id", "ts", "event_id", "value", F.col("event_type") == "view", "view_value")
    return rows.filter("event_type = 'purchase'").select("event_id", "view_value")


def forecast_priority(spark, sf):
    """Of each station and day the reading of the source that comes first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("purchase", "view", "click", "signup")]), F.col("event_type"))
    out = S.first_by_priority(_events(spark, sf).withColumn("day", F.to_date("ts")), ["user_id", "day"], [F.when(rank == 0, 9).otherwise(rank), F.col("ts"), F.col("event_id")])
    return out.select("user_id", F.col("day").cast("string"), "event_id", "event_type")


def feature_rows(spark, sf):
    """Humidity, month angles, scaled reading and probability of each event."""
    sin, cos = P.month_angle("month(ts)")
    return _events(spark, sf).select(
        "event_id",
        F.expr(f"round({P.relative_humidity('280 + value % 25', '278 + value % 20', 'value % 3')}, 4)").alias("humidity"),
        F.expr(f"round({sin}, 6)").alias("month_sin"),
        F.expr(f"round({cos}, 6)").alias("month_cos"),
        F.expr(f"round({P.sigmoid('(value - 50) / 30')}, 6)").alias("probability"),
        F.expr(f"{P.compass('value * 3.6')}").alias("compass"),
    )


def rate_limit(spark, sf):
    out = folds.limit_rate(_events(spark, sf), "user_id", "ts", "event_id", 3, 6 * 3600)
    return out.select("user_id", "event_id", "allowed", F.round("retry_after", 0).alias("retry_after"))


def session_ttl(spark, sf):
    """Sessions that end four hours after their last request."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)) > 4 * 3600
    numbered = _events(spark, sf).withColumn("session", F.sum(F.coalesce(gap, F.lit(True)).cast("long")).over(w))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("requests"))


def tumbling(spark, sf):
    return _events(spark, sf).groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def years_missing(spark, sf):
    """Years that orders have and a cache of every other year lacks."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.join(years.filter("year % 2 = 0"), "year", "left_anti")


def report_upsert(spark, sf):
    """Order priorities, patched where a repair has an answer."""
    orders = table(spark, sf, "orders")
    patch = orders.filter("o_orderkey % 7 = 0").select("o_orderkey", F.concat(F.lit("fixed "), "o_orderstatus").alias("fix"))
    return orders.join(patch, "o_orderkey", "left").select("o_orderkey", F.coalesce("fix", "o_orderpriority").alias("priority"))


def dedup_union(spark, sf):
    """Union of three classes, then distinct by key: the first class wins."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    parts = [o.filter(F.col("o_orderstatus") == s).withColumn("class", F.lit(i)) for i, s in enumerate(("F", "O", "P"))]
    out = S.first_by_priority(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["o_custkey"], [F.col("class"), F.col("o_orderkey")])
    return out.select("o_custkey", "o_orderkey", "class")


_DAILY = "daily AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value FROM events GROUP BY ALL)"
_CALENDAR = f"""WITH {_DAILY}, days AS (SELECT user_id, event_type, CAST(unnest(generate_series(min(day) - INTERVAL 1 DAY, max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY user_id, event_type),
cal AS (SELECT user_id, event_type, day, value FROM days LEFT JOIN daily USING (user_id, event_type, day))"""
_AROUND = """, n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER b AS ad, last_value(value IGNORE NULLS) OVER b AS av,
  first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER f AS bd, first_value(value IGNORE NULLS) OVER f AS bv FROM cal
  WINDOW b AS (PARTITION BY user_id, event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id, event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

QUERIES = {
    f.__name__: f
    for f in (calendar_fill, interpolate, fill_both, window_days, sequence_build, strat_split, sentinel_filter, asof_latest, forecast_priority, feature_rows, rate_limit, session_ttl, tumbling, years_missing, report_upsert, dedup_union)
}
SQL = {
    "calendar_fill": f"{_CALENDAR} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, value FROM cal",
    "interpolate": f"{_CALENDAR}{_AROUND} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, round(coalesce(CASE WHEN bd = ad THEN av ELSE av + (bv - av) * date_diff('day', ad, day) / date_diff('day', ad, bd) END, av, bv), 8) AS filled FROM n",
    "fill_both": f"{_CALENDAR}{_AROUND} SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, coalesce(av, bv) AS filled FROM n",
    "window_days": f"""WITH {_DAILY}, anchors AS (SELECT user_id, min(day) + 10 AS mid FROM daily GROUP BY user_id),
days AS (SELECT user_id AS sample_id, mid, CAST(unnest(generate_series(mid - INTERVAL 6 DAY, mid + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM anchors)
SELECT sample_id, CAST(d.day AS VARCHAR) AS day, CASE WHEN sample_id % 2 = 0 AND date_diff('day', d.day, mid) + 1 < 2 THEN 'Yes' ELSE 'No' END AS label,
{', '.join(f"max(value) FILTER (event_type = '{f}') AS {f}" for f in FEATURES)}
FROM days d LEFT JOIN daily r ON r.user_id = d.sample_id AND r.day = d.day GROUP BY sample_id, d.day, mid""",
    "sequence_build": "SELECT l_orderkey, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS label, round(sum(l_quantity), 2) AS quantity, count(*) AS n_steps FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4",
    "strat_split": """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey * 48271 % 2147483647, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN i < floor(n * 0.56::DOUBLE + 1e-9) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE + 1e-9) THEN 'valid' ELSE 'test' END AS split FROM r""",
    "sentinel_filter": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 50 THEN round(l_quantity * 0.1::DOUBLE + 5.0, 4) END AS unpacked FROM lineitem WHERE NOT (coalesce(l_quantity = 0, false) OR coalesce(l_tax = 0, false))",
    "asof_latest": """WITH w AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_value FROM events)
SELECT event_id, view_value FROM w WHERE event_type = 'purchase'""",
    "forecast_priority": """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY coalesce(list_position(['purchase', 'view', 'click', 'signup'], event_type), 9), ts, event_id) = 1""",
    "feature_rows": """WITH t AS (SELECT event_id, value, 280 + value % 25 - 273.15 AS warm, 278 + value % 20 - 273.15 AS mean, 2 * pi() * (month(ts) - 1) / 12 AS angle FROM events),
v AS (SELECT *, 0.6108 * exp(17.2693882 * warm / (warm + 237.3)) AS most, 0.6108 * exp(17.2693882 * mean / (mean + 237.3)) - value % 3 AS vapour FROM t)
SELECT event_id, round(100 * CASE WHEN vapour <= 0 THEN 0 WHEN vapour >= most THEN 1 ELSE vapour / most END, 4) AS humidity, round(sin(angle), 6) AS month_sin, round(cos(angle), 6) AS month_cos,
  round(exp((value - 50) / 30) / (exp((value - 50) / 30) + 1), 6) AS probability, CAST(floor((value * 3.6 + 11.25) / 22.5) AS BIGINT) % 16 AS compass FROM v""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, [t] AS times, true AS allowed, 0.0::DOUBLE AS retry_after FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN len(l) >= 3 THEN l ELSE list_append(l, t) END, len(l) < 3, CASE WHEN len(l) >= 3 THEN l[1] + 21600 - t ELSE 0.0 END
  FROM (SELECT e.user_id, e.event_id, e.i, e.t, list_filter(f.times, lambda x: x >= e.t - 21600) AS l FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, event_id, allowed, round(retry_after, 0) AS retry_after FROM f""",
    "session_ttl": """WITH g AS (SELECT *, coalesce(date_trunc('second', ts) - date_trunc('second', lag(ts) OVER w) > INTERVAL 4 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CAST(new AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS last_seen, count(*) AS requests FROM s GROUP BY user_id, session""",
    "tumbling": "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "years_missing": "SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) % 2 <> 0",
    "report_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'fixed ' || o_orderstatus ELSE o_orderpriority END AS priority FROM orders",
    "dedup_union": """WITH u AS (SELECT o_custkey, o_orderkey, list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS class FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))
SELECT o_custkey, o_orderkey, CAST(class AS INT) AS class FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY class, o_orderkey) = 1""",
}
