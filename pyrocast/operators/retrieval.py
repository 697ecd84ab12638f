"""Inverted index, BM25, dense scan, hybrid ranking, context merge and retrieval metrics."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SECTION_BONUS, TOKEN, tokens
from ..session import written

K1, B = 1.5, 0.75
#: Queries and rows that are held against each other at a time, and rows of these that are scored together: a task holds
#: matrices of so many queries, and rows, by the different terms of the queries.
QUERY_BLOCK, ROW_BLOCK, SLICE = 256, 4096, 256
#: Terms of queries that are sent to every task.
MOST_TERMS = 500_000


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """term, doc_id, tf."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_tokens."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(tokens(F.col(text))).cast("long").alias("n_tokens"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def terms(posted: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf."""
    return posted.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(n_docs), F.col("df")))


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """query_id, doc_id, score for each pair with a common term; a term that a query repeats counts again.

    Texts are read once: a document's asked terms, and a null term that carries its length, are counted
    and written to the shared folder; postings, lengths and their mean come from there.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    split = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t"))
    all_terms = split.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("t"))).alias("term"))
    known = asked.select("term").distinct().withColumn("asked", F.lit(True))
    kept = all_terms.join(known, "term", "left").filter("asked OR term IS NULL")
    posted = written(kept.groupBy("term", "doc_id", "n_tokens").agg(F.count("*").alias("tf")))
    stats = posted.filter("term IS NULL").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("n_tokens") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    posted = posted.filter("term IS NOT NULL")
    counted = posted.groupBy("term").agg(F.count("*").alias("df"))
    weight = idf(F.col("n_docs"), F.col("df")) * F.col("times") * F.col("tf") * (K1 + 1)
    norm = F.col("tf") + K1 * (1 - B + B * F.greatest("n_tokens", F.lit(1)) / F.greatest("avg_len", F.lit(1.0)))
    joined = posted.join(asked, "term").join(counted, "term").crossJoin(F.broadcast(stats))  # one row
    return joined.groupBy("query_id", "doc_id").agg(F.sum(weight / norm).alias("score"))


def top(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", item: str = "doc_id") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller item."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def term_vectors(docs: DataFrame, doc_id: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, terms (array of long: hashes of 64 bits), tfs: the terms of each row's text and how often it has them.

    known: term; only these terms are kept, where they are few enough to be sent to every task.
    """
    kept = None
    if known is not None:
        few = known.select("term").distinct().limit(MOST_TERMS + 1)
        if few.count() <= MOST_TERMS:
            kept = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in few.toLocalIterator()))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("terms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32()))])

    def run(batches):
        find, wanted, numbers = re.compile(TOKEN).findall, kept.value if kept else None, {}
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for x in batch.column(1).to_pylist():
                found = Counter(find(x or ""))
                n.append(found.total())
                # forms of a word that differ in case or outer marks are one term
                words: dict[str, int] = {}
                for word, times in found.items():
                    word = word.lower().strip("._-")
                    words[word] = words.get(word, 0) + times
                for word, times in words.items():
                    if wanted is None or word in wanted:
                        number = numbers.get(word)
                        if number is None:
                            if len(numbers) > 500_000:
                                numbers.clear()
                            number = numbers[word] = xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)
                        terms.append(number)
                        tfs.append(times)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int64()), (tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, terms array<long>, tfs array<int>")


def keyword_sides(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str) -> tuple[DataFrame, DataFrame]:
    """(docs, queries) as search takes them. docs: doc_id, terms, impacts; queries: query_id, terms, weights: the BM25 score of a pair is the sum, over common terms, of impact * weight.

    Texts are read once. Each row is a document of its own, also if it has another's id.
    """
    known = queries.select(F.explode(tokens(F.col(query))).alias("term"))
    held = written(term_vectors(docs, doc_id, text, known))
    stats = held.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avg")).first()
    counted = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = term_vectors(queries, query_id, query).select(F.col("doc_id").alias("query_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    weight = idf(F.lit(stats["n"]), F.col("df")) * F.col("times") * (K1 + 1)
    asked = asked.select("query_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times")).join(counted, "term").withColumn("weight", weight)
    asked = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    size = K1 * (1 - B + B * F.greatest("n_tokens", F.lit(1)) / max(stats["avg"] or 1.0, 1.0))
    return held.select("doc_id", "terms", F.transform("tfs", lambda tf: tf / (tf + size)).alias("impacts")), asked


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def _column(table: pa.Table, name: str, kind: pa.DataType):
    return table.column(name).combine_chunks().cast(kind) if name in table.column_names else pa.nulls(len(table), kind)


def _vectors(table: pa.Table, dims: int) -> np.ndarray:
    """Vectors as rows; zeros where there is none."""
    lists = _column(table, "vector", pa.list_(pa.float64()))
    out, has = np.zeros((len(lists), dims)), np.asarray(lists.value_lengths().fill_null(0)) == dims
    if has.any() and dims:
        out[has] = np.asarray(lists.filter(pa.array(has)).flatten()).reshape(-1, dims)
    return np.nan_to_num(out, nan=0.0)


def _sparse(table: pa.Table, values: str):
    """(row of each term, terms, values)."""
    terms, found = _column(table, "terms", pa.list_(pa.int64())), _column(table, values, pa.list_(pa.float64()))
    return np.repeat(np.arange(len(terms)), np.asarray(terms.value_lengths().fill_null(0))), np.asarray(terms.flatten()), np.asarray(found.flatten())


def search(chunks: DataFrame, queries: DataFrame, k: int, n_docs: int, n_queries: int, above: float | None = 0.0, keyword_weight: float = 0.25) -> DataFrame:
    """query_id, doc_id, score: of every pair the sum of dense part, keyword part and bonuses; the k best of each query above `above` (None: any) are among the rows.

    chunks: doc_id and what there is of vector, terms and impacts (keyword_sides), bonus and section
    (chunk_bonus); queries: query_id and what there is of vector, terms and weights, and sections
    (hinted_sections). The dense part is the dot product, 0 where either has no vector and for a row and itself
    (which is left out where nothing but vectors is compared); the keyword part is the BM25 score times
    keyword_weight; a pair gains SECTION_BONUS where the query hints at the chunk's section. Parts are not
    rounded; sums are, to 10 digits, so that equal scores tie.

    n_docs, n_queries: about how many there are. Both sides are dealt by hash into blocks of ROW_BLOCK and
    QUERY_BLOCK, and each pair of blocks gives its k best for each query, ties to the smaller id, which top() then
    ranks. Inside, chunks are taken some at a time: a query whose k-th best so far is above the most that these may
    reach (by each term's largest impact and the longest vector) is passed over.
    """
    rows, asked = max(1, -(-n_docs // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    kinds = {"vector": "array<double>", "terms": "array<long>", "impacts": "array<double>", "weights": "array<double>", "bonus": "double", "section": "string", "sections": "array<string>"}
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    have = [c for c in kinds if c in chunks.columns or c in queries.columns]
    told = lambda df: [(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in have]
    docs = chunks.select(F.lit(False).alias("asked"), F.col("doc_id").cast("long").alias("id"), *told(chunks)).filter("id IS NOT NULL")
    docs = docs.withColumn("q", everywhere(asked)).withColumn("d", block("id", rows))
    sought = queries.select(F.lit(True).alias("asked"), F.col("query_id").cast("long").alias("id"), *told(queries)).filter("id IS NOT NULL")
    sought = sought.withColumn("q", block("id", asked)).withColumn("d", everywhere(rows))
    dense_alone = not {"terms", "bonus", "section"} & set(have)
    empty = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]).empty_table()

    def cell(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        q, d = table.filter(pc.field("asked")), table.filter(~pc.field("asked"))
        if not len(q) or not len(d):
            return empty
        qs, ds = np.asarray(q.column("id")), np.asarray(d.column("id"))
        lengths = [n for t in (q, d) for n in np.unique(np.asarray(_column(t, "vector", pa.list_(pa.float64())).value_lengths().fill_null(0)))]
        dims = max(lengths)
        qv, dv = _vectors(q, dims), _vectors(d, dims)
        q_row, q_term, q_weight = _sparse(q, "weights")
        terms = np.unique(q_term)
        weight = np.zeros((len(terms), len(qs)))
        weight[np.searchsorted(terms, q_term), q_row] = q_weight
        d_row, d_term, d_impact = _sparse(d, "impacts")
        at = np.minimum(np.searchsorted(terms, d_term), max(len(terms) - 1, 0))
        known = terms[at] == d_term if len(terms) else np.zeros(len(d_term), bool)
        d_row, d_term, d_impact = d_row[known], at[known], d_impact[known]
        starts = np.searchsorted(d_row, np.arange(len(ds) + 1))
        bonus = np.nan_to_num(np.asarray(_column(d, "bonus", pa.float64()).fill_null(0.0)))
        sections, hints = _column(d, "section", pa.string()).to_pylist(), _column(q, "sections", pa.list_(pa.string())).to_pylist()
        number = {name: i for i, name in enumerate(sorted({x for x in sections if x is not None}))}
        section = np.array([number.get(x, -1) for x in sections], int)
        hinted = np.zeros((len(qs), len(number) + 1))
        for i, names in enumerate(hints):
            hinted[i, [number[x] for x in names or () if x in number]] = SECTION_BONUS
        far = np.linalg.norm(qv, axis=1)
        best, of = np.full((len(qs), k), -np.inf), np.full((len(qs), k), np.iinfo(np.int64).max)
        for a in range(0, len(ds), SLICE):
            b = min(a + SLICE, len(ds))
            part = slice(starts[a], starts[b])
            impact = np.zeros((b - a, len(terms)))
            impact[d_row[part] - a, d_term[part]] = d_impact[part]
            most = keyword_weight * (impact.max(axis=0) @ weight) + far * np.linalg.norm(dv[a:b], axis=1).max() + bonus[a:b].max() + hinted[:, np.unique(section[a:b])].max(axis=1)
            who = np.flatnonzero(most >= best[:, -1] - 1e-9)
            if not len(who):
                continue
            score = qv[who] @ dv[a:b].T
            score[qs[who][:, None] == ds[None, a:b]] = -np.inf if dense_alone else 0.0
            score += keyword_weight * (weight[:, who].T @ impact.T) + bonus[None, a:b] + hinted[who][:, section[a:b]]
            score = np.where(np.isfinite(score), _rounded(score, 10), score)
            # slices go by id and the sort is stable, so ties stay with the smaller
            found = np.argsort(-score, axis=1, kind="stable")[:, :k]
            joined = np.concatenate([best[who], np.take_along_axis(score, found, 1)], axis=1)
            ids = np.concatenate([of[who], ds[a:b][found]], axis=1)
            order = np.argsort(-joined, axis=1, kind="stable")[:, :k]
            best[who], of[who] = np.take_along_axis(joined, order, 1), np.take_along_axis(ids, order, 1)
        good = np.isfinite(best) if above is None else best > above
        return pa.table({"query_id": np.repeat(qs, k)[good.ravel()], "doc_id": of[good], "score": best[good]})

    return docs.unionByName(sought).groupBy("q", "d").applyInArrow(cell, "query_id long, doc_id long, score double")


def dense_top(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int, n_docs: int, n_queries: int) -> DataFrame:
    """query_id, doc_id, score: the k largest dot products of each query (query_id, vector) are among the rows; itself is left out."""
    rows = vectors.select(F.col(vec_id).alias("doc_id"), F.col(vector).alias("vector"))
    return search(rows.filter(F.size("vector") > 0), queries.select("query_id", "vector").filter(F.size("vector") > 0), k, n_docs, n_queries, above=None)


def merge_context(*lists: DataFrame, keys: list[str]) -> DataFrame:
    """The ordered union of ranked lists: of each key its first occurrence, by list, then rank."""
    union = None
    for i, rows in enumerate(lists):
        rows = rows.withColumn("list", F.lit(i))
        union = rows if union is None else union.unionByName(rows)
    order = Window.partitionBy(*keys).orderBy("list", "rank")
    return union.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def routed(queries: DataFrame, facts: DataFrame, incident: DataFrame, doctrine: DataFrame, keys: list[str]) -> DataFrame:
    """The context of each query by its class: lists that its class asks for, merged in this order.

    queries: query_id, query_class, has_profile; lists: query_id, keys, rank. Questions on the incident take
    its facts and chunks, those on doctrine its chunks, synthesis and safety all three. Unclear ones take
    all with the two best of doctrine where there is a profile, else doctrine alone.
    """
    c, known = F.col("query_class"), F.coalesce(F.col("has_profile"), F.lit(False))
    whole = c.isin("incident+doctrine synthesis", "safety-critical")
    unclear = ~whole & ~c.isin("incident-fact", "doctrine")
    of_incident = (c == "incident-fact") | whole | (unclear & known)
    of_doctrine = (c == "doctrine") | whole | (unclear & (~known | (F.col("rank") <= 2)))
    told = queries.select("query_id", "query_class", "has_profile")
    lists = [rows.join(told, "query_id").filter(test).drop("query_class", "has_profile") for rows, test in ((facts, of_incident), (incident, of_incident), (doctrine, of_doctrine))]
    return merge_context(*lists, keys=["query_id", *keys])


def unit(vector: Column) -> Column:
    """The vector by its length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0)))


def with_vectors(chunks: DataFrame, vectors: DataFrame, chunk_id: str) -> DataFrame:
    """Chunks with their vectors by id, not by place; those without one stay out."""
    return chunks.join(vectors, chunk_id)


def fact_overlap(queries: DataFrame, facts: DataFrame, n_facts: int, n_queries: int, k: int = 5) -> DataFrame:
    """query_id, fact_id, overlap, rank: the k facts with the most distinct terms in common, ties to the smaller id.

    queries: query_id, text; facts: fact_id, text, and value where there is one: facts with an empty value are left out.
    n_facts, n_queries: about how many there are (see search).
    """
    if "value" in facts.columns:
        facts = facts.filter(F.coalesce("value", F.lit("")) != "")
    ones = F.transform("terms", lambda t: F.lit(1.0))
    q = term_vectors(queries, "query_id", "text").select(F.col("doc_id").alias("query_id"), "terms", ones.alias("weights"))
    f = term_vectors(facts, "fact_id", "text", queries.select(F.explode(tokens(F.col("text"))).alias("term"))).select("doc_id", "terms", ones.alias("impacts"))
    found = top(search(f, q, k, n_facts, n_queries, keyword_weight=1.0), k)
    return found.select("query_id", F.col("doc_id").alias("fact_id"), F.col("score").cast("long").alias("overlap"), "rank")


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Of each query: precision, recall, hit and reciprocal rank at k. ranked: query_id, doc_id, rank; relevant: query_id, doc_id."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    each = hits.groupBy("query_id").agg(F.count("*").alias("retrieved"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    each = each.join(n, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    return each.select(
        "query_id",
        F.round(F.col("found") / F.greatest("retrieved", F.lit(1)), 4).alias("precision_at_k"),
        F.round(F.col("found") / F.greatest("relevant", F.lit(1)), 4).alias("recall_at_k"),
        (F.col("found") > 0).cast("int").alias("hit_at_k"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("reciprocal_rank"),
    )


def keyword_correctness(reply: Column, expected: Column) -> Column:
    """Share of the expected strings in the reply, whatever their case; null where none is expected."""
    low = F.lower(reply)
    found = F.size(F.filter(expected, lambda e: F.contains(low, F.lower(e))))
    return F.when(F.size(expected) > 0, F.round(found / F.size(expected), 4))
