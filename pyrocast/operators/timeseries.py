"""Calendars, interval windows, interpolation, sequences, splits, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def calendar(keys: DataFrame, start: Column, end: Column) -> DataFrame:
    """keys with a row for each day from start to end."""
    return keys.withColumn("day", F.explode(F.sequence(start, end, F.expr("interval 1 day"))))


def interpolate(rows: DataFrame, keys: list[str], day: str, value: str, out: str = "filled") -> DataFrame:
    """Nulls of value filled in proportion to time between neighbours; at both ends the nearest value."""
    order = Window.partitionBy(*keys).orderBy(day)
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    rows = rows.withColumn("__a", F.last(known, ignorenulls=True).over(before)).withColumn("__b", F.first(known, ignorenulls=True).over(after))
    span, part = F.datediff("__b.d", "__a.d"), F.datediff(F.col(day), F.col("__a.d"))
    between = F.when(span == 0, F.col("__a.v")).otherwise(F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * part / span)
    return rows.withColumn(out, F.coalesce(between, "__a.v", "__b.v")).drop("__a", "__b")


def fill_both(rows: DataFrame, keys: list[str], day: str, value: str, out: str = "filled") -> DataFrame:
    """Forward, then backward fill."""
    order = Window.partitionBy(*keys).orderBy(day)
    last = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(out, F.coalesce(last, first))


def interval_windows(anchors: DataFrame, readings: DataFrame, keys: list[str], features: list[str], before: int, after: int, label_days: int, positive: Column) -> DataFrame:
    """A row for each anchor and day from before to after its date, a column for each feature, and a label.

    anchors: sample_id, keys, at (date). readings: keys, day, feature, value. The days of a window
    are made first, so the join is on equal keys and days; features turn into columns in one
    aggregation. The last label_days days of a positive sample are labelled Yes.
    """
    days = anchors.withColumn("positive", positive).withColumn("day", F.explode(F.sequence(F.date_add("at", -before), F.date_add("at", after), F.expr("interval 1 day"))))
    joined = days.join(readings, [*keys, "day"], "left")
    wide = joined.groupBy("sample_id", "day", "at", "positive").pivot("feature", features).agg(F.first("value"))
    left = F.datediff(F.date_add("at", after), F.col("day"))
    return wide.withColumn("label", F.when(F.col("positive") & (left < label_days), "Yes").otherwise("No")).drop("positive")


def not_sentinel(columns: list[str], sentinel: float) -> Column:
    """Whether no column holds the sentinel; null isn't it."""
    out = F.lit(True)
    for c in columns:
        out = out & ~F.coalesce(F.col(c) == sentinel, F.lit(False))
    return out


def unpack(raw: Column, fill: Column, scale: Column, offset: Column) -> Column:
    """scale * raw + offset; null where raw is the fill value."""
    return F.when(raw != fill, raw * scale + offset)


def sequences(rows: DataFrame, key: list[str], order: list[str], features: list[str], length: int, positive: Column) -> DataFrame:
    """Complete sequences: key, steps (arrays of features in order), label (any positive step)."""
    step = F.struct(*order, *[f for f in features if f not in order])
    grouped = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(step)).alias("steps"), F.max(positive.cast("int")).alias("label"))
    return grouped.filter(F.col("n") == length).withColumn("steps", F.transform("steps", lambda s: F.array(*[s[f].cast("double") for f in features]))).drop("n")


def stratified_split(rows: DataFrame, label: str, order: list[Column], parts: list[tuple[str, float]]) -> DataFrame:
    """rows with `split`: of each label the first share in the given order, the next, and so on; the last takes the rest.

    Rows are dealt to ranges of label and order, counted by range, and numbered inside their range, so
    that no task sees all rows of a label.
    """
    named = rows.withColumns({f"__o{i}": c for i, c in enumerate(order)})
    by = [f"__o{i}" for i in range(len(order))]
    ranged = written(named.repartitionByRange(label, *by).withColumn("__r", F.spark_partition_id()))
    counts = ranged.groupBy(label, "__r").agg(F.count("*").alias("__k"))
    of_label = Window.partitionBy(label)
    counts = counts.withColumn("__n", F.sum("__k").over(of_label)).withColumn("__before", F.sum("__k").over(of_label.orderBy("__r")) - F.col("__k"))
    counts = counts.select(F.col(label).alias("__l"), F.col("__r").alias("__c"), "__n", "__before")
    placed = ranged.withColumn("__i", F.row_number().over(Window.partitionBy(label, "__r").orderBy(*by)) - 1)
    placed = placed.join(counts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__r") == F.col("__c")))
    edge, out = 0.0, None
    for name, share in parts[:-1]:
        edge += share
        test = F.col("__before") + F.col("__i") < F.floor(F.col("__n") * edge + 1e-9)
        out = F.when(test, name) if out is None else out.when(test, name)
    return placed.withColumn("split", out.otherwise(parts[-1][0])).select(*rows.columns, "split")


def latest_before(rows: DataFrame, key: str, at: str, tie: str, value: str, is_source: Column, out: str) -> DataFrame:
    """As-of lookup in one pass: for each row the last value of a source row at or before it, without a join."""
    order = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(order))


def first_by_priority(rows: DataFrame, keys: list[str], priority: list[Column]) -> DataFrame:
    """Of each key the row that comes first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*priority))).filter("__n = 1").drop("__n")


def concat(batches: list[DataFrame], batch: str) -> DataFrame:
    """The rows of all batches by the names of their columns, with the number of their batch."""
    out = None
    for i, rows in enumerate(batches):
        rows = rows.withColumn(batch, F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def joined_years(rows: DataFrame, key: str, year: str, values: str) -> DataFrame:
    """key, values: the arrays of a key's years, one after the other."""
    held = F.sort_array(F.collect_list(F.struct(year, values)))
    return rows.groupBy(key).agg(F.flatten(F.transform(held, lambda x: x[values])).alias(values))
