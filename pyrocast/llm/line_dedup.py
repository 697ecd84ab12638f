"""Line dedup: two Bloom filters find suspected repeats, which alone are shuffled and confirmed.

A first pass keeps, for each document, 16-byte digests of its distinct line keys. Two filters over
all digests, once-seen and twice-seen, are merged from those of the tasks; the second one is
broadcast (its size is bounded, see filter_bits). Lines that it holds are suspected repeats: their
digests are shuffled, confirmed to stand in two documents, and give the smallest document. Texts move
only where a filter of ids, bounded too, says that they may lose lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_filter, filter_bits, giving_back, has, packed, positions, saved, twice_filter, unpacked

#: Keys with at least so many suspected lines are hot, and at most so many keys are.
_HOT_ROWS, _HOT_KEYS = 1000, 4096
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes) -> bytes:
    """White space off both ends, A-Z in lower case."""
    return line.strip(_SPACE).lower()


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _digests(text: str | None, least: int) -> bytes:
    keys = {line_key(x) for x in (text or "").encode().split(b"\n")}
    return b"".join({xxhash.xxh3_128_digest(k) for k in keys if _counts(k, least)})


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """For each document with lines to drop: doc_id, drops (their 16-byte digests).

    A null id counts as one document that comes after all others.
    """

    def digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digests(x, min_chars) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "keys"])

    lines = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(digest), "doc_id long, keys binary"), "lines")
    total = lines.agg(F.sum(F.length("keys"))).first()[0] or 0
    bits = filter_bits(total // 16)
    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(lines.select("keys"), bits))

    def suspect(batches):
        for batch in batches:
            ids, found = [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = positions(np.frombuffer(data, np.uint64).reshape(-1, 2), bits)
                hit = np.flatnonzero(has(twice.value, a) & has(twice.value, b))
                found += [data[16 * i : 16 * i + 16] for i in hit]
                ids += [doc_id] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "key"])

    suspects = saved(lines.mapInArrow(giving_back(suspect), "doc_id long, key binary"), "suspects")
    firsts = (
        suspects.groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("lost"), F.count("*").alias("n"))
        .filter((F.col("first") != F.col("last")) | (F.col("lost") & F.col("first").isNotNull()))
        .select("key", "first", "n")
    )
    firsts = saved(firsts, "firsts")
    # lines of hot keys stay where they are: their firsts, a bounded number, are sent to them
    hot = F.col("n") >= max(_HOT_ROWS, suspects.count() // _HOT_KEYS)
    told = suspects.join(F.broadcast(firsts.filter(hot).select("key", F.col("first").alias("__hot"))), "key", "left")
    known = told.filter("__hot IS NOT NULL").withColumnRenamed("__hot", "first")
    asked = told.filter("__hot IS NULL").drop("__hot").join(firsts.filter(~hot).drop("n"), "key")
    gone = known.unionByName(asked).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_set("key").alias("drops"))


def _kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """docs in the column __row, and __kept (text, n_lines, n_dropped)."""
    drops = saved(repeated_lines(docs, id_col, text_col, min_chars).select(F.col("doc_id").alias("__id"), F.col("drops").alias("__drops")), "drops")
    bits = filter_bits(drops.count())
    may = docs.sparkSession.sparkContext.broadcast(any_filter(drops.select(F.xxhash64("__id").alias("h")), bits))

    @F.pandas_udf("boolean")
    def may_lose(hashes):
        import pandas as pd

        return pd.Series(has(may.value, hashes.to_numpy() & (bits - 1)))

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def kept(texts, drops):
        import pandas as pd

        out = []
        for text, gone in zip(texts, drops, strict=True):
            lines = (text or "").encode().split(b"\n")
            stay = lines
            if gone is not None and len(gone):
                gone = {bytes(x) for x in gone}
                stay = [x for x in lines if not (_counts(k := line_key(x), min_chars) and xxhash.xxh3_128_digest(k) in gone)]
            out.append((text if len(stay) == len(lines) else b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    ids, text = F.col("__row").getField(id_col).cast("long"), F.col("__row").getField(text_col)
    rows = packed(docs).withColumn("__may", may_lose(F.xxhash64(ids)))
    lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long")
    whole = rows.filter("NOT __may").drop("__may").withColumn("__kept", F.struct(text.alias("text"), lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))
    joined = rows.filter("__may").drop("__may").join(drops, ids.eqNullSafe(F.col("__id")), "left").drop("__id")
    return whole.unionByName(joined.withColumn("__kept", kept(text, F.col("__drops"))).drop("__drops"))


def _replaced(columns: list[str], text_col: str) -> list:
    return [F.col("__kept.text").alias(c) if c == text_col else x for c, x in zip(columns, unpacked(columns), strict=True)]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with text_col replaced, and the columns n_lines and n_dropped.

    Lines stand between \\n. Keys (line_key) of at least min_chars code points that stand in two or
    more documents lose all their lines except those in the smallest id that holds them; other lines
    stay, joined by \\n. Null and empty texts are one empty line; a text that loses nothing stays as
    it is. Rows with one id count as one document and lose the same keys. Other columns pass
    through; columns named n_lines or n_dropped are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_dropped")
    done = _kept(docs, id_col, text_col, min_chars)
    return done.select(*_replaced(docs.columns, text_col), "__kept.n_lines", "__kept.n_dropped")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with text_col replaced as by dedup_lines, and its own columns alone, whatever their names."""
    done = _kept(docs, id_col, text_col, min_chars)
    return done.select(*_replaced(docs.columns, text_col))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.*, f.first IS NOT NULL AND f.first <> l.doc_id AS gone FROM lines l LEFT JOIN firsts f USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
