"""Sinks: shuffled CSV, JSON lines, wide reports, patches of reports, summaries, partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled_csv(rows: DataFrame, path: str, seed: int) -> None:
    """All rows in a random order that only seed and values decide."""
    rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns)).write.mode("overwrite").option("header", True).csv(path)


def json_lines(rows: DataFrame, path: str, ascii_only: bool = False) -> None:
    """JSON lines; with ascii_only other characters are escaped."""
    rows.write.mode("overwrite").option("writeNonAsciiCharacterAsCodePoint", ascii_only).json(path)


def report(header: DataFrame, rows: DataFrame, path: str) -> None:
    """A report of an evaluation or of episodes: one header, and rows as JSON lines, in folders of their own."""
    header.limit(1).write.mode("overwrite").json(f"{path}/header")
    rows.write.mode("overwrite").json(f"{path}/rows")


def window_csv(window: DataFrame, day: str, path: str) -> None:
    """One window, some dozens of days, as one CSV file in order of days."""
    window.orderBy(day).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def wide_csv(rows: DataFrame, columns: list[str], path: str) -> bool:
    """The named columns, nested ones as JSON; nothing is written where there are no rows."""
    if rows.isEmpty():
        return False
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "map", "struct")}
    rows.select([F.to_json(c).alias(c) if c in nested else F.col(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)
    return True


def append(rows: DataFrame, path: str, partition: str) -> None:
    rows.write.mode("append").partitionBy(partition).option("compression", "zstd").parquet(path)


def patched(report: DataFrame, fixes: DataFrame, key: str, columns: list[str], error: str) -> DataFrame:
    """Rows that failed take the columns of their fix; others, and those without a fix, stay."""
    f = fixes.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__fixed"))
    failed = F.trim(F.coalesce(error, F.lit(""))) != ""
    take = failed & F.coalesce("__fixed", F.lit(False))
    joined = report.join(f, key, "left")
    return joined.select([F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in report.columns])


def required(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """A lookup join that fails where a key has no partner."""
    joined = rows.join(lookup.withColumn("__there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string"))).cast("boolean")
    return joined.filter(F.coalesce("__there", missing)).drop("__there")


def summary(chunks: DataFrame, title: str) -> DataFrame:
    """Counts by title and in all, as one JSON text."""
    each = chunks.groupBy(title).agg(F.count("*").alias("n"))
    return each.agg(F.to_json(F.struct(F.sum("n").alias("chunks"), F.sort_array(F.collect_list(F.struct(title, "n"))).alias("documents"))).alias("summary"))
