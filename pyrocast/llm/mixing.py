"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

A document's key is -ln(u) / weight with u from a hash of its id, so that documents of higher
quality weight tend to come first. Of each source whole epochs are taken first; the rest of the
target is filled in key order: all before the document that would cross it, and of the next ones in
order (_FILL, that one included) each that still fits, then the first that comes nearer to the target than
what is left. Running sums are made in two levels (sums of
ranges of source and key, then rows of the one range where the budget ends), so no task sees all rows
of a large source. What the rows need to know is a cutoff key for each source, and the few keys after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, saved, uniform, unpacked

#: Documents from the cutoff on that may fill what is left of a target.
_FILL = 256


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str, size: Column) -> Column:
    """From 0.2 to 1: falls with the symbols a word."""
    symbols = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>!]")), F.lit(0))
    return F.greatest(F.lit(0.2), 1 - symbols / F.greatest(size, F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> the same with target double.

    Sources in order of code points (null last) get the weights in turn and share `share` times all
    sizes; a target ends at `most` times its source's size, and what is above is shared by weight
    among the others until none is above. That is target = least(most * size, level * weight) for one
    level, which sources in order of most * size / weight give in one pass. One row for each source; all
    of them are in one window, so they should be few against the documents.
    """
    assert share <= most
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source"))
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(lower), F.lit(0.0))
    rows = rows.withColumn("__level", left / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(lower), F.lit(0.0))))
    # the level holds from the first source whose cap is not below it
    level = F.min(F.when(F.col("__cap") >= F.col("__level") * F.col("__w"), F.struct((F.col("__cap") / F.col("__w")).alias("r"), F.col("__level").alias("v")))).over(every)
    return rows.withColumn("target", F.least("__cap", F.coalesce(level["v"] * F.col("__w"), F.col("__cap")))).drop("__w", "__cap", "__level")


def _key(id_col: str, seed: int, weight: Column) -> Column:
    return -F.log(uniform(F.col(id_col).cast("long"), F.lit(seed))) / weight


def plan(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, sources). rows: doc_id, source, size, key. sources: source, source_size, target, epochs, cutoff (keys below it are taken), extra (keys taken from there on)."""
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), F.col(text_col).alias("__text"))
    weight = quality_weight("__text", F.col("size")) if weight is None else weight
    rows = sized.withColumn("key", _key("doc_id", seed, weight)).drop("__text")
    # texts are read once; ranges hold about equal numbers of rows, however keys are spread
    rows = saved(saved(rows, "sized").repartitionByRange("source", "key").withColumn("range", F.spark_partition_id()), "mix")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = (
        targets(totals)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("__rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    goals = saved(goals, "goals")
    g = goals.select(F.col("source").alias("g_source"), "__rest")
    placed = rows.join(g, rows["source"].eqNullSafe(g["g_source"]))
    sums = placed.groupBy("source", "range", "__rest").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")
    last = sums.withColumn("before", before).filter("before <= __rest AND __rest < before + n").select(F.col("source").alias("l_source"), F.col("range").alias("l_range"), "before")
    # rows of the range in which the budget ends; rows of one key (repeated ids) go together
    edge = placed.join(last, placed["source"].eqNullSafe(last["l_source"]) & (placed["range"] == last["l_range"]))
    edge = edge.groupBy("source", "key", "before", "__rest").agg(F.sum("size").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("key"))
    over = edge.withColumn("upto", upto).filter(F.col("upto") > F.col("__rest"))
    first = over.groupBy("source").agg(F.min(F.struct("key", "upto", "n", "__rest")).alias("x"))
    first = saved(first.select(F.col("source").alias("c_source"), F.col("x.key").alias("cutoff"), (F.col("x.__rest") - F.col("x.upto") + F.col("x.n")).alias("left")), "first")
    # the next keys of each source; the limit holds in each task before anything is shuffled
    after = rows.filter("size > 0").join(first, rows["source"].eqNullSafe(first["c_source"])).filter("key >= cutoff")
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy("key"))
    after = after.withColumn("place", rank).filter(F.col("place") <= _FILL).groupBy("source", "cutoff", "left", "key").agg(F.sum("size").cast("double").alias("n"))
    after = after.groupBy("source", "cutoff", "left").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("next"))
    start = F.struct(F.col("left"), F.array().cast("array<double>").alias("keys"))
    fits = lambda s, x: F.struct((s["left"] - x["n"]).alias("left"), F.concat(s["keys"], F.array(x["key"])).alias("keys"))
    after = after.withColumn("s", F.aggregate("next", start, lambda s, x: F.when(x["n"] <= s["left"], fits(s, x)).otherwise(s)))
    nearer = F.filter("next", lambda x: ~F.array_contains(F.col("s.keys"), x["key"]) & (x["n"] < 2 * F.col("s.left")))
    extra = F.concat("s.keys", F.transform(F.slice(nearer, 1, 1), lambda x: x["key"]))
    ends = after.select(F.col("source").alias("e_source"), "cutoff", extra.alias("extra"))
    # a source without words has no cutoff and is not taken
    sources = goals.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source", "__rest")
    return rows.drop("range"), saved(sources, "sources")


def _copies(key: str, size: str, source: str = "") -> Column:
    """How often a row is taken; source: prefix of the columns of its source."""
    cutoff, extra, epochs = (F.col(f"{source}{c}") for c in ("cutoff", "extra", "epochs"))
    more = F.coalesce((F.col(key) < cutoff) | F.array_contains(extra, F.col(key)), F.lit(False))
    return F.when(F.col(size) > 0, epochs + more.cast("long")).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, taken, copies.

    size counts the words of the text (null: none); taken = copies * size, and a document is taken
    whole or not at all, at most twice. A source's words differ from its target by less than any
    document from the cutoff on that isn't taken, of the first _FILL. Documents without words are not taken. Rows of one source with
    one id share a key and are taken alike. A null source is a source. Equal for equal input.
    """
    rows, sources = plan(docs, seed, id_col, text_col, source_col)
    s = sources.withColumnRenamed("source", "s_source")
    out = rows.join(s, rows["source"].eqNullSafe(s["s_source"])).withColumn("copies", _copies("key", "size"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken."""
    _, sources = plan(docs, seed, id_col, text_col, source_col)
    s = sources.select([F.col(c).alias(f"__{c}") for c in sources.columns])
    row = F.col("__row").getField
    out = packed(docs).withColumns({"__text": row(text_col), "__id": row(id_col), "__size": words(row(text_col))})
    out = out.withColumn("__key", _key("__id", seed, quality_weight("__text", F.col("__size")))).drop("__text")
    out = out.join(s, row(source_col).cast("string").eqNullSafe(F.col("__source")))
    taken = F.array_repeat(F.lit(1), _copies("__key", "__size", "__").cast("int"))
    return out.withColumn("__copy", F.explode(taken)).select(*unpacked(docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')) AS symbols,
         (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(31) || '17'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents
), t AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w FROM d GROUP BY source)
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER lower, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER lower, 0)) AS level
  FROM t WINDOW lower AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE cap >= level * w) * w, cap)) AS target FROM l
), k AS (
  SELECT doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
         -ln(u) / greatest(0.2::DOUBLE, 1 - symbols::DOUBLE / greatest(size, 1)) AS key
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM k
), n AS (
  SELECT source, key, any_value(rest) AS rest, sum(size)::DOUBLE AS n, max(upto) AS upto FROM c WHERE size > 0 GROUP BY source, key
), o AS (
  SELECT source, key, n, row_number() OVER (PARTITION BY source ORDER BY key) AS i, first_value(rest - upto + n) OVER (PARTITION BY source ORDER BY key) AS room FROM n WHERE upto > rest QUALIFY i <= 256
), f AS (
  SELECT source, key, i, n <= room AS fits, CASE WHEN n <= room THEN room - n ELSE room END AS room FROM o WHERE i = 1
  UNION ALL
  SELECT o.source, o.key, o.i, o.n <= f.room, CASE WHEN o.n <= f.room THEN f.room - o.n ELSE f.room END FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.i = f.i + 1
), z AS (
  SELECT source, arg_max(room, i) AS room FROM f GROUP BY source
), y AS (
  SELECT o.source, min(o.i) AS i FROM o JOIN f ON o.source IS NOT DISTINCT FROM f.source AND o.i = f.i JOIN z ON o.source IS NOT DISTINCT FROM z.source
  WHERE NOT f.fits AND o.n < 2 * z.room GROUP BY o.source
), t2 AS (
  SELECT f.source, f.key, f.fits OR y.i IS NOT NULL AS fits FROM f LEFT JOIN y ON f.source IS NOT DISTINCT FROM y.source AND f.i = y.i
)
SELECT c.doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (epochs + CAST(upto <= rest OR coalesce(fits, false) AS INT)) * size END AS BIGINT) AS taken
FROM c LEFT JOIN t2 ON c.source IS NOT DISTINCT FROM t2.source AND c.key = t2.key
"""
