"""Evaluation of retrieval and answers: runs, relevance rules, metrics of usage, weighted means."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .retrieval import MOST_TERMS

#: Models in a group; characters of the parts by which matchers are looked up.
_GROUP, _GRAM = 256, 4


def runs(models: DataFrame, prompts: DataFrame, n_models: int) -> DataFrame:
    """A row for each model and prompt, with the columns of both.

    n_models: about how many models there are. They are dealt into groups of some hundred, which are joined
    with the prompts, one row for each group: no task needs all models, none is dropped.
    """
    groups = max(1, -(-n_models // _GROUP))
    own = F.struct(*[F.col(c) for c in models.columns])
    held = models.select(F.pmod(F.xxhash64(F.to_json(own)), F.lit(groups)).cast("int").alias("__group"), own.alias("__model"))
    # a group holds about _GROUP models; equal ones share one
    held = held.groupBy("__group").agg(F.collect_list("__model").alias("__models"))
    rows = prompts.withColumn("__group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return rows.join(held, "__group").withColumn("__model", F.explode("__models")).select(*[prompts[c] for c in prompts.columns], "__model.*")


def _held(hay: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunk_id, kind, gram: the wanted grams (gram, of _GRAM characters or fewer) that a text (chunk_id, kind, text) has, once each.

    Few enough grams are sent to all tasks; else texts give all they have, and the join that follows keeps the wanted.
    """
    few = wanted.select("gram").distinct().limit(MOST_TERMS + 1)
    sizes = [r.n for r in wanted.select(F.length("gram").alias("n")).distinct().collect()]  # _GRAM at most
    kept = None
    if few.count() <= MOST_TERMS:
        kept = hay.sparkSession.sparkContext.broadcast(frozenset(r.gram for r in few.toLocalIterator()))

    def run(batches):
        for batch in batches:
            ids, kinds, found = [], [], []
            for chunk, kind, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                for n in sizes:
                    mine = {text[i : i + n] for i in range(len(text) - n + 1)}
                    mine = mine & kept.value if kept else mine
                    ids += [chunk] * len(mine)
                    kinds += [kind] * len(mine)
                    found += mine
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(kinds, pa.string()), pa.array(found, pa.string())], ["chunk_id", "kind", "gram"])

    return hay.mapInArrow(run, f"chunk_id {dict(hay.dtypes)['chunk_id']}, kind string, gram string")


def relevant(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, chunk_id of chunks that a matcher of the case fits, once each.

    chunks: chunk_id, doc_title, section_path, text; cases: case_id, matchers (array of doc_title, section_contains,
    text_contains; null or empty: any). A matcher needs the exact title and the other two as parts of the
    normalised text. Of what a matcher looks for in a text (or else in a section) the part of four characters that fewest chunks have
    is looked up among the chunks' parts; what is found is then tested whole. Matchers of a title alone are joined by
    it; one that asks for nothing fits every chunk.
    """
    blank = lambda x: F.nullif(x, F.lit(""))
    rules = cases.select("case_id", F.explode("matchers").alias("m"))
    rules = rules.select("case_id", blank("m.doc_title").alias("title"), blank(T.norm(F.col("m.section_contains"))).alias("part"), blank(T.norm(F.col("m.text_contains"))).alias("words"))
    kind = F.when(F.col("words").isNotNull(), "text").when(F.col("part").isNotNull(), "section").when(F.col("title").isNotNull(), "title").otherwise("any")
    rules = written(rules.distinct().withColumns({"kind": kind, "needle": F.coalesce("words", "part")}))
    told = chunks.select("chunk_id", "doc_title", T.norm(F.coalesce("section_path", F.lit(""))).alias("section"), T.norm(F.coalesce("text", F.lit(""))).alias("text"))
    fits = (F.col("title").isNull() | (F.col("title") == F.col("doc_title"))) & (F.col("part").isNull() | F.contains(F.col("section"), F.col("part"))) & (F.col("words").isNull() | F.contains(F.col("text"), F.col("words")))
    hay = told.select("chunk_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("text", "section")])).alias("h")).select("chunk_id", "h.kind", "h.text")
    needles = rules.filter("needle IS NOT NULL").select("kind", "needle").distinct()
    cut = F.expr(f"array_distinct(transform(sequence(1, greatest(length(needle) - {_GRAM - 1}, 1)), i -> substring(needle, i, {_GRAM})))")
    grams = written(needles.withColumn("gram", F.explode(cut)))
    often = _held(hay, grams).groupBy("kind", "gram").agg(F.count("*").alias("df"))
    rarest = grams.join(often, ["kind", "gram"], "left").groupBy("kind", "needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram"))).alias("r")).filter("r.df > 0")
    rarest = written(rarest.select("kind", "needle", F.col("r.gram").alias("gram")))
    near = rarest.join(_held(hay, rarest), ["kind", "gram"]).select("kind", "needle", "chunk_id")
    found = rules.join(near, ["kind", "needle"]).join(told, "chunk_id").filter(fits).select("case_id", "chunk_id")
    titled = rules.filter("kind = 'title'").join(told, F.col("title") == F.col("doc_title")).select("case_id", "chunk_id")
    found = found.unionByName(titled)
    whole = rules.filter("kind = 'any'").select("case_id").distinct()
    if n := whole.count():  # each of these cases has every chunk in its result
        found = found.unionByName(runs(whole, chunks.select("chunk_id"), n))
    return found.distinct()


def flattened(rows: DataFrame, column: str, prefix: str, fields: list[str]) -> DataFrame:
    """Fields of a struct as columns with a prefix; null where the struct is."""
    return rows.select("*", *[F.col(f"{column}.{f}").alias(f"{prefix}_{f}") for f in fields]).drop(column)


def weighted(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def judged(replies: Column, schema: str) -> Column:
    """The judge's JSON in its reply as a struct; null where there is none."""
    return F.from_json(T.json_object(replies), schema)


def rate_limited(message: Column) -> Column:
    return F.rlike(F.lower(F.coalesce(message, F.lit(""))), F.lit(r"429|rate.?limit|quota|too many requests|resource.?exhausted"))
