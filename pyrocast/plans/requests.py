"""Queries on requests, episodes as wholes, axes, and small conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as P
from ..functions import text as T
from ..operators import charts, episodes, reports, retrieval, samples, validation
from ..session import table
from . import fires


def grow_window(spark, sf):
    """Of each user's events the first downsampled to 24 points, and the last (count % 6) as they are."""
    return charts.grown(fires._points(spark, sf), "user_id", "pos", "a1", "a2", 30, 6).select("user_id", "pos", "a2")


def axis_limits(spark, sf):
    """Limits of axes by settings that depend on the user; user 0 has no events."""
    users = table(spark, sf, "events").select("user_id").union(spark.range(1)).distinct()
    u = F.col("user_id")
    when = lambda m, r, v: F.when(F.pmod(u, F.lit(m)) == r, F.lit(v))
    settings = users.select(
        "user_id",
        F.coalesce(when(3, 0, 20), when(3, 1, 5)).alias("max_points"),
        when(6, 0, 1.5).alias("fixed_min_a1"),
        when(4, 0, 50.0).alias("fixed_max_a1"),
        when(8, 0, -5.0).alias("fixed_min_a2"),
        when(2, 0, 80.0).alias("fixed_max_a2"),
        F.coalesce(when(5, 0, 30.0), when(5, 1, 0.0)).alias("initial_max_a1"),
        (F.pmod(u, F.lit(3)) != 1).alias("expand_a2"),
        when(7, 0, 10.0).alias("round_a2"),
    )
    return charts.axis_limits(fires._points(spark, sf), settings, "user_id", "pos", "a1", "a2")


def running_burn(spark, sf):
    """Of each nation's customers in order of keys: those in debt so far, and their share of all."""
    out = episodes.running_share(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], ["c_custkey"], F.col("c_acctbal") < 0)
    return out.select("c_custkey", "c_nationkey", "hits", F.round("share", 6).alias("share"))


def gained_burn(spark, sf):
    """Events of a user with a running total of purchases, that of the event before, and what came since."""
    rows = episodes.running_share(fires._steps(spark, sf), ["user_id"], ["step"], F.col("event_type") == "purchase")
    return episodes.gained(rows, "user_id", "step", "hits").select("user_id", "step", F.col("hits").alias("total"), "before", "gained")


def episode_averages(spark, sf):
    """One row: means over users of the number of steps, the last event and the highest value."""
    each = fires._steps(spark, sf).groupBy("user_id").agg(F.count("*").alias("steps"), F.max_by("event_id", "step").alias("last_event"), F.max("value").alias("peak"))
    return episodes.averages(each, ["steps", "last_event", "peak"]).select("episodes", *[F.round(f"avg_{c}", 4).alias(f"avg_{c}") for c in ("steps", "last_event", "peak")])


def class_counts(spark, sf):
    return samples.counted(table(spark, sf, "orders"), "o_orderstatus")


def _dot(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", retrieval.unit(F.col("embedding")).alias("v"))


def unit_vectors(spark, sf):
    """Length and first component of each vector after it is brought to length one."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return _dot(spark, sf).select("vec_id", F.round(length, 6).alias("length"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


def request_check(spark, sf):
    """Requests made of parts: kinds in turn, with faults by their key."""
    k = F.col("p_partkey")
    every = lambda m, yes, no: F.when(F.pmod(k, F.lit(m)) == 0, yes).otherwise(no)
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.get(F.array(*map(F.lit, ("predict", "query", "pdf", "audio", "fax"))), F.pmod(k, F.lit(5)).cast("int")).alias("kind"),
        every(7, F.lit("north"), F.lit("40.5")).alias("lat"),
        every(11, F.lit("west"), F.lit("-100")).alias("lon"),
        every(3, F.lit("2024-13-05"), F.lit("2024-01-05")).alias("date"),
        every(4, F.lit(" "), F.lit("s1")).alias("session_id"),
        every(6, none, every(9, F.repeat(F.lit("x"), F.lit(2001)), F.col("p_name"))).alias("query"),
        every(8, F.lit(None).cast("long"), F.pmod(k, F.lit(32)) * (1 << 20)).alias("bytes"),
    )
    return validation.checked(rows).select("p_partkey", "status", "reason")


def session_lookup(spark, sf):
    """Orders of keys up to three times the customers' against customers, found or not."""
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + F.pmod("o_orderkey", F.lit(2)) * 1000000).alias("c_custkey"))
    out = validation.looked_up(orders, table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return out.select("o_orderkey", "found", F.coalesce("c_nationkey", F.lit(-1)).cast("long").alias("nation"))


def body_pages(spark, sf):
    """Turns of conversations as pages, from the second on; some are made tables of contents."""
    x = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("Table of Contents Chapter 1 Unit 2 "), "text")).otherwise(F.concat(F.lit("Chapter 1 table of contents "), "text"))
    return reports.body_pages(table(spark, sf, "conversations").select("conv_id", "turn", x.alias("x")), "turn", "x", F.lit(1)).select("conv_id", "turn")


def small_conversions(spark, sf):
    """Parts as pixels, places and reports: height, box, id, first text."""
    k = F.col("p_partkey")
    box = P.km_box("25 + p_partkey % 25", "-124 + p_partkey % 57", "40", "27.1")
    rows = table(spark, sf, "part")
    return rows.select(
        "p_partkey",
        F.expr(f"round({P.height_of('p_partkey % 256', 'p_size', '4000.0')}, 6)").alias("height"),
        *[F.expr(f"round({e}, 6)").alias(n) for n, e in box.items()],
        T.incident_id(F.col("p_name"), F.timestamp_seconds(k * 86400 + 1700000000)).alias("incident_id"),
        T.first_text(F.when(F.pmod(k, F.lit(2)) == 0, F.lit("")), F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit(" a  "), "p_brand"))).alias("said"),
    )


_S = fires._STEPS
QUERIES = {f.__name__: f for f in (grow_window, axis_limits, running_burn, gained_burn, episode_averages, class_counts, unit_vectors, request_check, session_lookup, body_pages, small_conversions)}
SQL = {
    "grow_window": f"""WITH {_S}, n AS (SELECT user_id, step AS pos, value AS a2, count(*) OVER (PARTITION BY user_id) AS n FROM steps),
h AS (SELECT *, n - n % 6 AS m FROM n WHERE n > 24 AND pos < n - n % 6),
p AS (SELECT *, round(abs((lag(CAST(pos AS DOUBLE)) OVER w - pos) * (lead(a2) OVER w - a2) - (lead(CAST(pos AS DOUBLE)) OVER w - pos) * (lag(a2) OVER w - a2)) / 2, 6) AS area FROM h WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
b AS (SELECT *, CASE WHEN m <= 24 THEN pos WHEN pos = 0 OR pos = m - 1 THEN -1 - pos ELSE CAST(floor((pos - 1) * 22 / (m - 2)) AS BIGINT) END AS b FROM p)
SELECT user_id, pos, a2 FROM (SELECT user_id, pos, a2 FROM b QUALIFY row_number() OVER (PARTITION BY user_id, b, (pos = 0 OR pos = m - 1) ORDER BY coalesce(area, 0) DESC, pos) = 1)
UNION ALL SELECT user_id, pos, a2 FROM n WHERE n <= 24 OR pos >= n - n % 6""",
    "axis_limits": f"""WITH {_S}, u AS (SELECT DISTINCT user_id FROM events UNION SELECT 0),
s AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 5 END AS mp, CASE WHEN user_id % 6 = 0 THEN 1.5::DOUBLE END AS n1, CASE WHEN user_id % 4 = 0 THEN 50.0::DOUBLE END AS x1,
  CASE WHEN user_id % 8 = 0 THEN -5.0::DOUBLE END AS n2, CASE WHEN user_id % 2 = 0 THEN 80.0::DOUBLE END AS x2, CASE user_id % 5 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS i1,
  user_id % 3 <> 1 AS ex, CASE WHEN user_id % 7 = 0 THEN 10.0::DOUBLE END AS r2 FROM u),
p AS (SELECT steps.*, count(*) OVER (PARTITION BY steps.user_id) AS n, mp FROM steps JOIN s ON s.user_id = steps.user_id),
q AS (SELECT *, NOT (mp IS NOT NULL AND n >= mp) OR step >= n - mp AS seen FROM p),
g AS (SELECT user_id, count(*) AS n, count(*) FILTER (seen) AS k, min(step) FILTER (seen)::DOUBLE AS l1, max(step) FILTER (seen)::DOUBLE AS h1, min(value) FILTER (seen) AS l2, max(value) FILTER (seen) AS h2, max(value) AS a2 FROM q GROUP BY user_id)
SELECT s.user_id, coalesce(n1, CASE WHEN coalesce(k, 0) = 0 THEN 0 ELSE l1 END) AS min_a1,
  CASE WHEN coalesce(n, 0) <= x1 THEN x1 WHEN coalesce(k, 0) = 0 THEN coalesce(nullif(i1, 0), mp, 100) WHEN k < mp THEN coalesce(nullif(i1, 0), mp) ELSE h1 END AS max_a1,
  coalesce(n2, CASE WHEN coalesce(k, 0) = 0 THEN 0 ELSE l2 END) AS min_a2,
  CASE WHEN NOT ex AND x2 IS NOT NULL THEN x2 WHEN coalesce(k, 0) = 0 THEN 100 WHEN ex AND x2 IS NOT NULL THEN greatest(x2, CASE WHEN r2 IS NULL THEN a2 ELSE ceil(a2 / r2) * r2 + r2 END) WHEN ex THEN a2 ELSE h2 END AS max_a2
FROM s LEFT JOIN g ON g.user_id = s.user_id""",
    "running_burn": """SELECT c_custkey, c_nationkey, CAST(count(*) FILTER (c_acctbal < 0) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS hits,
  round(count(*) FILTER (c_acctbal < 0) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) / count(*) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer""",
    "gained_burn": f"""WITH {_S}, t AS (SELECT user_id, step, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY step) AS total FROM steps)
SELECT user_id, step, total, lag(total, 1, 0) OVER w AS before, total - lag(total, 1, 0) OVER w AS gained FROM t WINDOW w AS (PARTITION BY user_id ORDER BY step)""",
    "episode_averages": f"""WITH {_S}, e AS (SELECT user_id, count(*) AS steps, arg_max(event_id, step) AS last_event, max(value) AS peak FROM steps GROUP BY user_id)
SELECT count(*) AS episodes, round(avg(steps), 4) AS avg_steps, round(avg(last_event), 4) AS avg_last_event, round(avg(peak), 4) AS avg_peak FROM e""",
    "class_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)",
    "unit_vectors": """WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, round(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END, 6) AS length, round(v[1] / coalesce(nullif(n, 0), 1), 6) AS first FROM l""",
    "request_check": """WITH r AS (SELECT p_partkey AS k, ['predict', 'query', 'pdf', 'audio', 'fax'][p_partkey % 5 + 1] AS kind, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 32 END AS mb FROM part)
SELECT k AS p_partkey, CASE WHEN mb > 30 THEN 413 WHEN kind = 'predict' AND (k % 7 = 0 OR k % 11 = 0 OR k % 3 = 0) THEN 400 WHEN kind IN ('query', 'pdf') AND k % 4 = 0 THEN 400 WHEN kind = 'query' AND (k % 6 = 0 OR k % 9 = 0) THEN 400
    WHEN kind IN ('pdf', 'audio') AND mb IS NULL THEN 400 WHEN kind = 'pdf' AND mb > 20 OR kind = 'audio' AND mb > 25 THEN 413 WHEN kind = 'fax' THEN 400 ELSE 200 END AS status,
  CASE WHEN mb > 30 THEN 'body too large' WHEN kind = 'predict' AND (k % 7 = 0 OR k % 11 = 0 OR k % 3 = 0) THEN 'lat, lon and date are required' WHEN kind IN ('query', 'pdf') AND k % 4 = 0 THEN 'session_id is required'
    WHEN kind = 'query' AND k % 6 = 0 THEN 'query is required' WHEN kind = 'query' AND k % 9 = 0 THEN 'query too long' WHEN kind IN ('pdf', 'audio') AND mb IS NULL THEN 'file is required'
    WHEN kind = 'pdf' AND mb > 20 THEN 'pdf too large' WHEN kind = 'audio' AND mb > 25 THEN 'audio too large' WHEN kind = 'fax' THEN 'unknown request' END AS reason FROM r""",
    "session_lookup": "SELECT o_orderkey, c_custkey IS NOT NULL AS found, CAST(coalesce(c_nationkey, -1) AS BIGINT) AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey + o_orderkey % 2 * 1000000",
    "body_pages": "SELECT conv_id, turn FROM conversations WHERE turn >= 1 AND NOT (conv_id % 3 = 0 OR (length(lower(text)) - length(replace(lower(text), 'chapter', ''))) / 7 + (length(lower(text)) - length(replace(lower(text), 'unit', ''))) / 4 >= 1)",
    "small_conversions": r"""SELECT p_partkey, round((p_partkey % 256 * 256 + p_size) / 65535.0::DOUBLE * 4000, 6) AS height,
  round(25 + p_partkey % 25 - 27.1::DOUBLE / 111 / 2, 6) AS south, round(25 + p_partkey % 25 + 27.1::DOUBLE / 111 / 2, 6) AS north,
  round(-124 + p_partkey % 57 - 40.0::DOUBLE / (111 * cos(radians(25 + p_partkey % 25))) / 2, 6) AS west, round(-124 + p_partkey % 57 + 40.0::DOUBLE / (111 * cos(radians(25 + p_partkey % 25))) / 2, 6) AS east,
  trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || strftime(make_timestamp((p_partkey * 86400 + 1700000000) * 1000000), '%Y_%m_%d') AS incident_id,
  CASE WHEN p_partkey % 3 = 0 THEN trim(regexp_replace(' a  ' || p_brand, '\s+', ' ', 'g')) ELSE '' END AS said FROM part""",
}
