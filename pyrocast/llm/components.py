"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: About how many rows a file of a round holds: in very many small files, rows would cost more to open than to join.
_FILE_ROWS = 10_000


def _point(rows: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """rows with column replaced by its parent, where it has one."""
    p = parents.select(F.col("v").alias("__v"), F.col("p").alias("__p"))
    return rows.join(p, F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__p", column)).drop("__v", "__p")


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b of one type with an order) -> v, component: the smallest vertex that v reaches, for each vertex of a link.

    Each round points every vertex at its smallest neighbour, if smaller, follows the pointers to
    their roots by doubling, and keeps the links between different roots: at least the vertices that
    aren't smallest among their neighbours go. Rounds are written to the shared folder, in files as
    few as the number of links allows, however many partitions a shuffle has.
    """
    first = saved(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct(), "links")
    # no round has more rows than the first links, but for the last, which has two vertices for each
    files, left, rounds = 1 + first.count() // _FILE_ROWS, first, []
    while not left.isEmpty():
        parents = saved(left.groupBy(F.col("high").alias("v")).agg(F.min("low").alias("p")).coalesce(files), "parents")
        while True:
            p = parents.select(F.col("v").alias("__v"), F.col("p").alias("__p"))
            if parents.join(p, F.col("p") == F.col("__v"), "left_semi").isEmpty():
                break
            parents = saved(_point(parents, parents, "p").coalesce(files), "parents")
        rounds.append(parents)
        left = _point(_point(left, parents, "low"), parents, "high").filter("low <> high")
        left = saved(left.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct().coalesce(files), "links")
    out = first.select(F.explode(F.array("low", "high")).alias("v")).distinct().withColumn("component", F.col("v"))
    for parents in rounds:
        out = _point(out, parents, "component")
    return saved(out.coalesce(2 * files), "components")
