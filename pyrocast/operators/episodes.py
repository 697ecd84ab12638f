"""Analytics of episodes: changes of state, frames, running and rolling figures, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newly(rows: DataFrame, keys: list[str], step: str, active, every: int = 1) -> DataFrame:
    """Rows where `active` holds and did not hold in the step before, of steps divisible by `every`."""
    w = Window.partitionBy(*keys).orderBy(step)
    flagged = rows.withColumn("__now", active)
    return flagged.withColumn("__was", F.lag("__now", 1, False).over(w)).filter(F.col("__now") & ~F.col("__was") & (F.col(step) % every == 0)).drop("__now", "__was")


def frames(rows: DataFrame, key: str, step: str, frame: str, depth: int = 4) -> DataFrame:
    """The last `depth` frames of each step, oldest first; the first frame stands for those before it."""
    order = Window.partitionBy(key).orderBy(step)
    last = F.collect_list(frame).over(order.rowsBetween(-(depth - 1), 0))
    first = F.first(frame).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stack", F.concat(F.array_repeat(first, F.lit(depth) - F.size(last)), last))


def running(rows: DataFrame, key: str, step: str, value: str, window: int = 100) -> DataFrame:
    """cumulative: sum so far; rolling: mean of the last `window` values."""
    order = Window.partitionBy(key).orderBy(step)
    total = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cumulative", total).withColumn("rolling", F.avg(value).over(order.rowsBetween(-(window - 1), 0)))


def rewards(rows: DataFrame, key: str, step: str, reward: str, done: str, window: int = 100) -> DataFrame:
    """episode (from 0), cumulative: the reward of the episode so far, which ends with a row that is done; mean_reward: of the last `window` episodes that have ended, null before."""
    order = Window.partitionBy(key).orderBy(step)
    ended = F.coalesce(F.sum(F.col(done).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("episode", ended)
    rows = rows.withColumn("cumulative", F.sum(reward).over(Window.partitionBy(key, "episode").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))
    # the total of each episode stands in its last row; a row sees those of the episodes before its own
    of = F.avg("cumulative").over(Window.partitionBy(key).orderBy("episode").rowsBetween(-(window - 1), 0))
    means = rows.filter(done).select(F.col(key), (F.col("episode") + 1).alias("episode"), of.alias("mean_reward"))
    return rows.join(means, [key, "episode"], "left")


def gained(rows: DataFrame, key: str, step: str, total: str) -> DataFrame:
    """before: the total of the step before (0 at first); gained: what came since."""
    rows = rows.withColumn("before", F.lag(total, 1, 0).over(Window.partitionBy(key).orderBy(step)))
    return rows.withColumn("gained", F.col(total) - F.col("before"))


def running_share(rows: DataFrame, keys: list[str], order: list[str], hit) -> DataFrame:
    """hits: how often `hit` held up to each row of a key; share: that of all rows of the key."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("hits", F.sum(hit.cast("long")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("share", F.col("hits") / F.count("*").over(w))


def averages(episodes: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of episodes, and the mean of each column as avg_<column>."""
    return episodes.agg(F.count("*").alias("episodes"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


def statistics(rows: DataFrame, key: str, step: str, burning: str, burnt: str) -> DataFrame:
    """Of each episode: steps, last burnt, most burning and the first step where it stood (0 if never above 0)."""
    peak = F.min(F.struct((-F.col(burning)).alias("n"), F.col(step).alias("s")))
    out = rows.groupBy(key).agg(F.count("*").alias("steps"), F.max_by(burnt, step).alias("final_burnt"), F.max(burning).alias("peak_burning"), peak.alias("p"))
    return out.withColumn("peak_step", F.when(F.col("peak_burning") > 0, F.col("p.s")).otherwise(0)).drop("p")
