"""Simulation and chart queries: users as episodes or zones, their events as steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics as P
from ..operators import charts, episodes, fire
from ..session import table


def _steps(spark, sf):
    """Events of a user in order: step from 0, value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value", (F.row_number().over(w) - 1).cast("long").alias("step"))


def lag_spread(spark, sf):
    """Purchases that no purchase precedes, of every fifth step."""
    return episodes.newly(_steps(spark, sf), ["user_id"], "step", F.col("event_type") == "purchase", 5).select("user_id", "step")


def frame_stack(spark, sf):
    out = episodes.frames(_steps(spark, sf), "user_id", "step", "event_id")
    return out.select("user_id", "step", F.array_join(F.transform("stack", lambda x: x.cast("string")), ",").alias("stack"))


def running_reward(spark, sf):
    out = episodes.running(_steps(spark, sf), "user_id", "step", "value", 20)
    return out.select("user_id", "step", F.round("cumulative", 3).alias("cumulative"), F.round("rolling", 7).alias("rolling"))


def episode_stats(spark, sf):
    rows = _steps(spark, sf).withColumn("burning", F.floor(F.col("value") / 10)).withColumn("burnt", F.col("event_id"))
    return episodes.statistics(rows, "user_id", "step", "burning", "burnt").withColumn("peak_step", F.col("peak_step").cast("long"))


def _points(spark, sf):
    return _steps(spark, sf).select("user_id", F.col("step").alias("pos"), F.col("step").cast("double").alias("a1"), F.col("value").alias("a2"))


def downsample(spark, sf):
    return charts.downsample(_points(spark, sf), "user_id", "pos", "a1", "a2", 30).select("user_id", "pos", "a2")


def visible_points(spark, sf):
    return charts.visible(_points(spark, sf), "user_id", "pos", 25).select("user_id", "pos", "a2")


def axis_extents(spark, sf):
    return charts.extents(_points(spark, sf), "user_id", "a1", "a2", 20, 0)


def hourly_points(spark, sf):
    return charts.hourly(table(spark, sf, "events"), "event_type", "ts", "event_id", "value")


def burn_rate(spark, sf):
    """Spread rates between two cells for each part: fuel, wind, slope and moisture by its key; what can't burn has rate 0."""
    names = ("sav", "beta", "load", "mx", "depth")
    fuels = F.array(*[F.struct(F.lit(n).alias("fuel"), *[F.lit(v).cast("double").alias(k) for k, v in zip(names, told or [None] * 5, strict=True)]) for n, told in P.VEGETATION.items()])
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", F.element_at(fuels, (F.pmod(key, F.lit(len(P.VEGETATION))) + 1).cast("int")).alias("f"))
    rows = rows.select("p_partkey", "f.*").withColumns(
        {"dx": F.pmod(key, F.lit(5)) - 2.0, "dy": F.pmod(key * 3, F.lit(4)) - 1.5, "dz": F.pmod(key, F.lit(41)) - 20.0, "moisture": 0.03 + F.pmod(key, F.lit(7)) / 100, "cell_size": F.lit(100.0), "wind": 1.0 + F.pmod(key, F.lit(20)), "wind_dir": F.pmod(key * 31, F.lit(360)).cast("double")}
    )
    return fire.spread_rate(rows).select("p_partkey", "fuel", F.round(F.coalesce("spread_rate", F.lit(0.0)), 3).alias("spread_rate"))


def _grid(spark, sf):
    """A grid of 24 x 16 cells for each region, lit in its middle."""
    cells = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("episode"), F.explode(F.sequence(F.lit(0), F.lit(383))).alias("i"))
    fuels = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("sav", "beta", "load", "mx", "depth"), P.FUELS[n], strict=True)]) for n in ("grass", "shrub")])
    x, y, e = F.pmod("i", F.lit(24)), F.floor(F.col("i") / 24).cast("int"), F.col("episode")
    rows = cells.select("episode", x.alias("x"), y.alias("y"), F.element_at(fuels, (F.pmod(e + F.floor(x / 6), F.lit(2)) + 1).cast("int")).alias("f"))
    rows = rows.select("episode", "x", "y", (F.col("x") * 3.0 + F.col("episode")).alias("elevation"), F.lit(0.05).alias("moisture"), "f.*")
    lit = (F.col("x") == 12) & (F.col("y") == 8)
    return rows.withColumns({"burnable": ~((F.col("x") == 18) & (F.col("y") > 3)), "state": F.lit(fire.UNBURNT), "ignition": F.when(lit, 0.0).otherwise(float("inf")), "burn_time": F.lit(500.0), "rate": F.lit(0.0)})


def fire_step(spark, sf):
    """Counts and earliest ignition after two steps, as joins."""
    cells = _grid(spark, sf)
    for time in (1.0, 60.0):
        cells = fire.step(cells, time, 5.0, 45.0, 500.0)
    return cells.groupBy("episode").agg(F.count_if(F.col("state") == fire.BURNING).alias("burning"), F.count_if(F.col("ignition") < 1e9).alias("scheduled"), F.round(F.max("rate"), 3).alias("rate"))


def fire_episodes(spark, sf):
    """Counts by state over forty steps of each episode."""
    return fire.simulate(_grid(spark, sf), [1.0 + 15 * i for i in range(40)], 5.0, 45.0, 500.0)


def zone_burn(spark, sf):
    """Share of a nation's customers in debt: burnt cells of a zone against all."""
    out = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 0).alias("burned"), F.count("*").alias("cells"))
    return out.withColumn("fraction", F.round(F.col("burned") / F.col("cells"), 6)).withColumn("acres", F.ceil(43560 * F.col("fraction") / 1000).cast("long"))


def status_map(spark, sf):
    """State and burn index of each part as one code, and back."""
    state, index = F.pmod("p_partkey", F.lit(3)), F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 25, 1).otherwise(2)
    code = (state * 3 + index).cast("long")
    rows = table(spark, sf, "part").select("p_partkey", code.alias("code"))
    return rows.select("*", F.floor(F.col("code") / 3).alias("state"), F.pmod("code", F.lit(3)).alias("burn_index"))


_STEPS = "steps AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"


def _spread_sql() -> str:
    """The rate of spread written out: reaction intensity and heat sink, then wind and slope as one vector, then the ellipse."""
    values = """(0, 'grasslands', 2100, 0.00306, 0.294, 0.15, 3.0), (1, 'closed_shrublands', 1672, 0.01198, 0.239, 0.3, 1.2), (2, 'open_shrublands', 1500, 0.01, 0.2, 0.3, 1.0),
      (3, 'evergreen_needleleaf', 1716, 0.04878, 0.0459, 0.2, 0.1), (4, 'deciduous_needleleaf', 1650, 0.045, 0.04, 0.2, 0.1), (5, 'evergreen_broadleaf', 1500, 0.035, 0.06, 0.25, 0.12),
      (6, 'deciduous_broadleaf', 1400, 0.03, 0.05, 0.25, 0.1), (7, 'mixed_forest', 1608, 0.042, 0.05295, 0.22, 0.11), (8, 'woody_savannas', 1400, 0.008, 0.18, 0.3, 0.8),
      (9, 'savannas', 1450, 0.0085, 0.17, 0.25, 0.7), (10, 'croplands', 1200, 0.015, 0.2, 0.3, 0.5), (11, 'cropland_mosaic', 1300, 0.012, 0.18, 0.25, 0.6),
      (12, 'permanent_wetlands', 800, 0.007, 0.12, 0.5, 0.5), (13, 'barren', 600, 0.002, 0.01, 0.1, 0.05), (14, 'urban_built', NULL, NULL, NULL, NULL, NULL),
      (15, 'snow_ice', NULL, NULL, NULL, NULL, NULL), (16, 'water', NULL, NULL, NULL, NULL, NULL)"""
    inner = f"""(SELECT p_partkey, fuel, sav::DOUBLE AS sav, beta::DOUBLE AS beta, load::DOUBLE AS load, mx::DOUBLE AS mx, depth::DOUBLE AS depth, p_partkey % 5 - 2.0::DOUBLE AS dx, p_partkey * 3 % 4 - 1.5::DOUBLE AS dy, p_partkey % 41 - 20.0::DOUBLE AS dz,
      0.03::DOUBLE + (p_partkey % 7) / 100 AS moisture, 100.0::DOUBLE AS cell_size, 1.0::DOUBLE + p_partkey % 20 AS wind, CAST(p_partkey * 31 % 360 AS DOUBLE) AS wind_dir
      FROM part JOIN (VALUES {values}) f(k, fuel, sav, beta, load, mx, depth) ON k = p_partkey % 17)"""
    return f"""WITH i AS (SELECT * FROM {inner}),
a AS (SELECT *, beta / (3.348 * pow(sav, -0.8189)) AS rel, 7.47 * exp(-0.133 * pow(sav, 0.55)) AS c, 0.02526 * pow(sav, 0.54) AS b, 0.715 * -0.000359 * sav AS e, 133 * pow(sav, -0.7913) AS fa, moisture / mx AS m FROM i),
b AS (SELECT *, pow(sav, 1.5) / (495 + 0.0594 * pow(sav, 1.5)) * pow(rel, fa) * exp(fa * (1 - rel)) * load * 8000 * (1 - 2.59 * m + 5.11 * m * m - 3.52 * m * m * m) * 0.174 * pow(0.01, -0.19)
  * exp((0.792 + 0.681 * sqrt(sav)) * (beta + 0.1)) / (192 + 0.2595 * sav) / (load / (1 - 0.0555) / depth * exp(-138 / sav) * (250 + 1116 * moisture)) AS r0, sqrt(dx * dx + dy * dy) AS d FROM a),
c AS (SELECT *, r0 * c * pow(wind * 88, b) * pow(rel, -e) AS w, r0 * 5.275 * pow(beta, -0.3) * pow(dz / (d * cell_size), 2) * CASE WHEN dz >= 0 THEN 1 ELSE -1 END AS s FROM b),
v AS (SELECT *, s * dx / d - w * sin(radians(wind_dir)) AS x, s * dy / d - w * cos(radians(wind_dir)) AS y FROM c),
r AS (SELECT *, r0 + sqrt(x * x + y * y) AS rh, 1 + 0.25 / 88 * pow(sqrt(x * x + y * y) / r0 / (c * pow(rel, -e)), 1 / b) AS z FROM v)
SELECT p_partkey, fuel, round(coalesce(rh * (1 - sqrt(z * z - 1) / z) / (1 - sqrt(z * z - 1) / z * cos(atan2(dy, dx) - atan2(y, x))), 0), 3) AS spread_rate FROM r"""


QUERIES = {
    f.__name__: f
    for f in (lag_spread, frame_stack, running_reward, episode_stats, downsample, visible_points, axis_extents, hourly_points, burn_rate, fire_step, fire_episodes, zone_burn, status_map)
}
SQL = {
    "lag_spread": f"WITH {_STEPS} SELECT user_id, step FROM steps QUALIFY event_type = 'purchase' AND NOT coalesce(lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY step), false) AND step % 5 = 0",
    "frame_stack": f"""WITH {_STEPS}, s AS (SELECT user_id, step, list(event_id) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l, first_value(event_id) OVER (PARTITION BY user_id ORDER BY step) AS f FROM steps)
SELECT user_id, step, array_to_string(list_transform(CASE len(l) WHEN 1 THEN [f, f, f, l[1]] WHEN 2 THEN [f, f, l[1], l[2]] WHEN 3 THEN [f, l[1], l[2], l[3]] ELSE l END, lambda x: CAST(x AS VARCHAR)), ',') AS stack FROM s""",
    "running_reward": f"""WITH {_STEPS} SELECT user_id, step, round(sum(value) OVER w, 3) AS cumulative, round(avg(value) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 7) AS rolling
FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "episode_stats": f"""WITH {_STEPS}, b AS (SELECT *, CAST(floor(value / 10) AS BIGINT) AS burning FROM steps)
SELECT user_id, count(*) AS steps, arg_max(event_id, step) AS final_burnt, max(burning) AS peak_burning, CASE WHEN max(burning) > 0 THEN arg_max(step, burning * 1000000 - step) ELSE 0 END AS peak_step FROM b GROUP BY user_id""",
    "downsample": f"""WITH {_STEPS}, p AS (SELECT user_id, step AS pos, value AS a2, count(*) OVER (PARTITION BY user_id) AS n,
  round(abs((lag(CAST(step AS DOUBLE)) OVER w - step) * (lead(value) OVER w - value) - (lead(CAST(step AS DOUBLE)) OVER w - step) * (lag(value) OVER w - value)) / 2, 6) AS area FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY step)),
b AS (SELECT *, CASE WHEN n <= 30 THEN pos WHEN pos = 0 OR pos = n - 1 THEN -1 - pos ELSE CAST(floor((pos - 1) * 28 / (n - 2)) AS BIGINT) END AS b FROM p)
SELECT user_id, pos, a2 FROM b QUALIFY row_number() OVER (PARTITION BY user_id, b, (pos = 0 OR pos = n - 1) ORDER BY coalesce(area, 0) DESC, pos) = 1""",
    "visible_points": f"WITH {_STEPS} SELECT user_id, step AS pos, value AS a2 FROM steps QUALIFY step > max(step) OVER (PARTITION BY user_id) - 25",
    "axis_extents": f"WITH {_STEPS} SELECT user_id, CAST(min(step) AS DOUBLE) AS min_a1, greatest(CAST(max(step) AS DOUBLE), 20.0) AS max_a1, least(min(value), 0.0) AS min_a2, CAST(ceil(max(value) / 10) * 10 AS DOUBLE) AS max_a2 FROM steps GROUP BY user_id",
    "hourly_points": "SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    "burn_rate": _spread_sql(),
    "zone_burn": "SELECT *, CAST(ceil(43560 * fraction / 1000) AS BIGINT) AS acres FROM (SELECT c_nationkey, count(*) FILTER (c_acctbal < 0) AS burned, count(*) AS cells, round(count(*) FILTER (c_acctbal < 0) / count(*), 6) AS fraction FROM customer GROUP BY c_nationkey)",
    "status_map": "SELECT p_partkey, c AS code, c // 3 AS state, c % 3 AS burn_index FROM (SELECT p_partkey, p_partkey % 3 * 3 + CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END AS c FROM part)",
}
