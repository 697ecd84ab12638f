"""Places and running sums over a whole order, by ranges of it: no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows up to this one in order, itself included.

    Rows go to ranges of the order, which are summed first; then each is summed inside. Rows that are equal
    in order come in any order, so the order should tell rows apart.
    """
    cut = written(rows.repartitionByRange(*order).withColumns({"__range": F.spark_partition_id(), "__value": value}))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each range, that is for each task that wrote one
    sums = cut.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")
    sums = sums.select("__range", before.alias("__before"))
    out = cut.withColumn(name, F.sum("__value").over(inside)).join(F.broadcast(sums), "__range")
    return out.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__value", "__before")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order, from 0."""
    return running(rows, order, F.lit(1), name).withColumn(name, F.col(name) - 1)
