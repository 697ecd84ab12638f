"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Features (runs of words) fall into hash buckets. Postings (bucket, document, count) are shuffled by
bucket; where a bucket's postings are, its counts in both corpora meet and give its gain, each
posting becomes a contribution of count * gain, and contributions are shuffled back and summed by
document. Documents go in blocks of some thousand, so that a shuffled row holds the postings of one
block in one range of buckets (a part), or the contributions of one part to one block. A part is dealt
to as many tasks as it has groups of blocks: a bucket that most documents have is not in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, running, saved, unpacked

#: Documents, and postings, in a block; ranges of buckets; blocks of one part in a task.
_BLOCK_DOCS, _BLOCK_POSTINGS, _PARTS, _TASK_BLOCKS = 4096, 1 << 20, 40, 128
#: Bytes of a text that are cut into words at a time.
_PIECE = 1 << 20

# Words hold digits, letters a-z (A-Z count as these) and all characters from U+0080 on.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: str | None):
    """Lists of the text's words as bytes, in order: all of them, some MB of text at a time."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while len(data) - at > _PIECE:
        end = data.find(b" ", at + _PIECE)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


class _Buckets(dict):
    """The bucket of each feature, remembered."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(text: str | None, most: int, number: _Buckets):
    """(buckets of some of the text's features, words among them): together all runs of 1 to most words."""
    tail: list[bytes] = []
    for words in pieces(text):
        joined = tail + words
        found = [number[w] for w in words]
        for n in range(2, most + 1):
            first = max(0, len(tail) - n + 1)
            found += [number[b" ".join(joined[i : i + n])] for i in range(first, len(joined) - n + 1)]
        tail = joined[len(joined) - most + 1 :] if most > 1 else []
        yield np.array(found, np.int64), len(words)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.bincount(at, np.concatenate(counts)).astype(np.int64)


_POSTED = "block long, part int, ids binary, buckets binary, places binary, counts binary"


def posted(docs: DataFrame, id_col: str, text_col: str, most: int, buckets: int) -> DataFrame:
    """A row for each block and part: buckets (from the part's first on), places of documents in the block, counts.

    Part -1 of a block has its documents in ids (null: lowest value and a 0 in counts), with digests of
    their texts in places and the numbers of features and words in buckets.
    """
    width = -(-buckets // _PARTS)
    assert width <= 1 << 16 and most >= 1
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("ids", "buckets", "places", "counts")]])

    def run(batches):
        number, task, block = _Buckets(buckets), TaskContext.get().partitionId(), 0
        ids: list = []
        digests: list[int] = []
        sizes: list[tuple[int, int]] = []
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def rows():
            name = task << 32 | block
            known = np.array([i is not None for i in ids], np.uint8)
            yield name, -1, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), np.array(digests, np.int64).tobytes(), known.tobytes()
            if not keys:
                return
            key, n = _summed(keys, counts)
            bucket, place = key >> 16, key & 0xFFFF
            cuts = np.searchsorted(bucket, np.arange(_PARTS + 1) * width)
            for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    yield name, part, None, (bucket[a:b] - part * width).astype(np.uint16).tobytes(), place[a:b].astype(np.uint16).tobytes(), n[a:b].astype(np.uint32).tobytes()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows(), strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, digest, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(ids) == _BLOCK_DOCS or held > _BLOCK_POSTINGS:
                    yield flush()
                    block, held = block + 1, 0
                    for x in (ids, digests, sizes, keys, counts):
                        x.clear()
                total = words = 0
                for found, n in features(text, most, number):
                    total, words = total + len(found), words + n
                    values, times = np.unique(found, return_counts=True)
                    keys.append(values << 16 | len(ids))
                    counts.append(times)
                    held += len(values)
                ids.append(doc)
                digests.append(digest)
                sizes.append((total, words))
        if ids:
            yield flush()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, _POSTED)


def _totals(postings: DataFrame, name: str) -> DataFrame:
    """part, bucket (from the part's first on) and its count in the whole corpus; each task sums its own rows first."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = np.bincount(np.frombuffer(at, np.uint16), np.frombuffer(counts, np.uint32)).astype(np.int64)
                if len(found) > len(sums.get(part, ())):
                    found[: len(sums.get(part, ()))] += sums.get(part, 0)
                    sums[part] = found
                else:
                    sums[part][: len(found)] += found
        for part, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at.astype(np.int32)), pa.array(found[at])], ["part", "bucket", name])

    rows = postings.filter("part >= 0").select("part", "buckets", "counts").mapInArrow(run, f"part int, bucket int, {name} long")
    return rows.groupBy("part", "bucket").agg(F.sum(name).alias(name))


def gains(postings: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """part, gains (a gain for each of its buckets, in order): both corpora's counts of a part meet in one place.

    A bucket's gain is floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))), where s and t count
    its features in the corpus and in the target, S and T all features.
    """
    width = -(-buckets // _PARTS)
    counted = saved(_totals(postings, "s").join(_totals(target, "t"), ["part", "bucket"], "full").fillna(0, ["s", "t"]), "counted")
    every = counted.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    gain = lambda s, t: F.floor(1000 * F.log((t + 1.0) * (every["s"] + float(buckets)) / ((s + 1.0) * (every["t"] + float(buckets))))).cast("long")
    found = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("s", "t")))).alias("m"))  # at most `width` entries
    zero = F.lit(0.0)
    return found.select("part", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: gain(F.coalesce(F.col("m")[b]["s"], zero), F.coalesce(F.col("m")[b]["t"], zero))).alias("gains"))


def weights(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, digest (of the text), n_features, n_words, weight (the sum of its features' gains)."""
    spark = docs.sparkSession
    postings = saved(posted(docs, id_col, text_col, most, buckets), "postings")
    wanted = posted(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).alias("text")), "doc_id", "text", most, buckets)
    salts = max(1, -(-postings.filter("part < 0").count() // _TASK_BLOCKS))
    gain = gains(postings, wanted, buckets).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = postings.filter("part >= 0").select("block", "part", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "buckets", "places", "counts")

    def contribute(batches):
        for batch in batches:
            out = []
            for at, places, counts, values in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3, 4)], strict=True):
                each = np.array(values, np.float64)[np.frombuffer(at, np.uint16)] * np.frombuffer(counts, np.uint32)
                found = np.bincount(np.frombuffer(places, np.uint16), each).astype(np.int64)
                out.append((found if np.abs(found).max() >= 1 << 31 else found.astype(np.int32)).tobytes())
            wide = [len(x) // (int(np.frombuffer(p, np.uint16).max()) + 1) for x, p in zip(out, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.int32()), pa.array(out, pa.binary())], ["block", "part", "buckets"])

    met = rows.join(gain.hint("merge"), ["part", "salt"]).select("block", "buckets", "places", "counts", "gains")
    added = met.mapInArrow(contribute, "block long, part int, buckets binary")
    heads = postings.filter("part < 0").select("block", "part", "buckets", "ids", "places", "counts")

    def total(group: pa.Table) -> pa.Table:
        part, data = group.column("part").to_pylist(), group.column("buckets").to_pylist()
        head = part.index(-1)
        sizes = np.frombuffer(data[head], np.int64).reshape(-1, 2)
        weight = np.zeros(len(sizes), np.int64)
        for wide, values in zip(part, data, strict=True):
            if wide > 0:
                values = np.frombuffer(values, np.int32 if wide == 4 else np.int64)
                weight[: len(values)] += values
        known = np.frombuffer(group.column("counts")[head].as_py(), np.uint8) == 0
        ids = pa.array(np.frombuffer(group.column("ids")[head].as_py(), np.int64), mask=known)
        digest = np.frombuffer(group.column("places")[head].as_py(), np.int64)
        return pa.table({"doc_id": ids, "digest": digest, "n_features": sizes[:, 0], "n_words": sizes[:, 1], "weight": weight})

    both = heads.unionByName(added, allowMissingColumns=True)
    # a block's group: its documents and one row for each part, at most _PARTS
    return both.groupBy("block").applyInArrow(total, "doc_id long, digest long, n_features long, n_words long, weight long")


def ranked(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, digest, n_features, weight, score, rank (null: not drawn), all long.

    Words are runs of digits, letters (A-Z in lower case) and characters from U+0080 on; features are
    all runs of 1 to `most` of them. A document's score is its weight plus Gumbel noise of its id, so that the
    highest are a draw without replacement. Of the documents with at least least_words words, percent
    in 100 (rounded down) are drawn, ranked from 1, ties to the smaller id (null first). Null and empty
    texts have no features and weight 0; repeated rows are rows of their own, and so are repeated ids; an id's noise is
    that of the text `seed:id` (null: nothing after the colon). Other columns are not read. An empty
    table gives an empty table, an empty target is one without features.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = saved(weights(docs, target, most, buckets, id_col, text_col, target_col).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    columns = ["doc_id", "digest", "n_features", "weight", "score"]
    equal = able.groupBy(*columns).agg(F.count("*").alias("times"))
    upto = running(equal, [], [F.col("score").desc(), F.col("doc_id"), F.col("digest")], F.col("times"), "upto")
    places = F.explode(F.sequence(F.col("upto") - F.col("times") + 1, F.col("upto")))
    placed = upto.select(*columns, places.alias("rank")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are drawn, with all their columns. options: as of ranked.

    Rows equal in id and text are drawn together if one of them is.
    """
    found = ranked(docs, target, id_col=id_col, text_col=text_col, **options).filter("rank IS NOT NULL")
    found = found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    row = F.col("__row").getField
    same = row(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(row(text_col)) == F.col("__digest"))
    return packed(docs).join(found, same, "left_semi").select(*unpacked(docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH table_of AS (
  SELECT list(c ORDER BY i) AS c FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i))
), w AS (
  SELECT 0 AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
  SELECT kind, doc_id, unnest(w) AS f FROM w
), n AS (
  SELECT DISTINCT f, list_transform(range(1, 2 * octet_length(encode(f)), 2), lambda i: CAST('0x' || substr(hex(encode(f)), i, 2) AS BIGINT)) AS bytes FROM f
), b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c // 256, table_of.c[xor(c % 256, x) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM n, table_of
), c AS (
  SELECT kind, doc_id, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL
), t AS (
  SELECT coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM c
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE + 1) * (any_value(t.s) + 10000)
    / ((coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE + 1) * (any_value(t.t) + 10000)))) AS BIGINT) AS gain FROM c, t GROUP BY bucket
), d AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM c JOIN g USING (bucket) WHERE kind = 0 GROUP BY doc_id
), s AS (
  SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM s LEFT JOIN r ON s.doc_id = r.doc_id
"""
