"""Sharding by a two-pass external shuffle, in DataFrame operations alone.

First pass: whole records are scattered into memory-sized buckets by a seeded hash. Second pass: each
bucket is brought into one order, shuffled by Fisher-Yates with seeded draws and written to its shards. (Spark's own shuffle()
draws by partition, so a task that runs again elsewhere would deal differently; it isn't used.) The
buckets, end to end, are the shuffled corpus; rows are dealt from it to the shards in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, saved, shared_folder, unpacked

#: Bytes of text and rows in a bucket on average; a permutation takes time by the square of the rows.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 1024
_BLOCK_BUCKETS = 4096
#: Bytes of text in a task at most; numbers of copies that are made together.
_TASK_BYTES, _RUN = 512 << 20, 65_536


def _random(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def fisher_yates(n: str, draw: str) -> Column:
    """A permutation of 0 to n - 1: each i takes the place j <= i that is drawn, what stood there goes to the end.

    n, draw: SQL; draw is a long that depends on i.
    """
    j = f"pmod({draw}, i + 1L)"
    step = f"""aggregate(array({j}), a, (b, k) -> concat(
        slice(b, 1, cast(k AS int)), array(i), slice(b, cast(k AS int) + 2, greatest(i - cast(k AS int) - 1, 0)), slice(b, cast(k AS int) + 1, 1)))"""
    return F.expr(f"aggregate(sequence(0, cast({n} AS int) - 1), cast(array() AS array<int>), (a, i) -> {step})")


def _size(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _copies(times: Column) -> Column:
    """1 to times, as two nested arrays of at most _RUN numbers and of times / _RUN."""
    last = F.least(times, (F.col("__run") + 1) * _RUN)
    return F.sequence(F.col("__run") * _RUN + 1, last)


def _numbered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (__row, __h) with __copy, 1 to n for n equal records; counts: __h, __n of the hashes that several rows have.

    Records whose hash no other has are numbered where they are scanned; the others are counted first,
    so that many equal ones are numbered like any others.
    """
    once = F.lit(1).cast("long").alias("__copy")
    if counts.isEmpty():
        return rows.select("__row", "__h", once)
    counted = rows.join(counts.select("__h"), "__h", "left_semi").groupBy("__row", "__h").agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / _RUN))))
    counted = counted.select("__row", "__h", F.explode(_copies(F.col("__n"))).alias("__copy"))
    return rows.join(counts.select("__h"), "__h", "left_anti").select("__row", "__h", once).unionByName(counted)


def _started(sizes: DataFrame) -> DataFrame:
    """__bucket, __n with __start, the rows in all buckets before; sums go by blocks of buckets, then inside each."""
    sizes = sizes.withColumn("__block", F.floor(F.col("__bucket") / _BLOCK_BUCKETS))
    blocks = sizes.groupBy("__block").agg(F.sum("__n").alias("__m"))
    blocks = blocks.select("__block", (F.sum("__m").over(Window.orderBy("__block")) - F.col("__m")).alias("__before"))
    inside = F.sum("__n").over(Window.partitionBy("__block").orderBy("__bucket")) - F.col("__n")
    return sizes.join(blocks, "__block").select("__bucket", "__n", (F.col("__before") + inside).alias("__start"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 23, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """docs, with shard and slot, as Parquet partitioned by shard, in order of slot inside each file.

    Shards' row counts differ by one at most; slots count from 0 without gaps in each shard. Texts are
    shuffled once, into buckets. Equal input, in any order and partitioning, gives equal shards;
    records that are equal in all columns are interchangeable and all of them are written. Columns
    named shard and slot are replaced; columns of maps can't be compared and aren't taken.
    """
    docs = docs.drop("shard", "slot")
    row = F.col("__row").getField
    rows = packed(docs).withColumn("__h", F.xxhash64(F.lit(0), *[row(c) for c in docs.columns]))
    # texts are read twice: for hashes and sizes, and to be written
    keys = saved(rows.select("__h", _size(row(text_col)).alias("__size")), "keys")
    total = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("bytes")).first()
    many = saved(keys.groupBy("__h").agg(F.count("*").alias("__n")).filter("__n > 1"), "repeated")
    buckets = max(1, -(-total["n"] // bucket_rows), -(-total["bytes"] // bucket_bytes))
    bucket = F.pmod(_random(seed, "__h", "__copy"), F.lit(buckets)).cast("int").alias("__bucket")
    placed = _numbered(rows, many).select("__row", "__h", "__copy", bucket)
    # records with one hash are equal but for chance; where they aren't, they are numbered apart, so counts go by what is placed
    sizes = saved(placed.groupBy("__bucket").agg(F.count("*").alias("__n")), "buckets") if many.count() else saved(keys.select("__h", F.lit(1).cast("long").alias("__copy")).select(bucket).groupBy("__bucket").agg(F.count("*").alias("__n")), "buckets")
    sizes = _started(sizes)
    # a task holds some buckets: more in a large table, so that its files are not too small
    task_bytes = min(max(8 * bucket_bytes, total["bytes"] // 4096), _TASK_BYTES)
    tasks = max(1, -(-total["bytes"] // task_bytes))
    dealt = sizes.repartition(tasks, "__bucket").select("__bucket", "__start", fisher_yates("__n", f"xxhash64({seed + 2}, __bucket, i)").alias("__at"))
    order = Window.partitionBy("__bucket").orderBy(_random(seed + 1, "__h", "__copy"), "__copy", row(id_col), row(text_col))
    ranked = placed.repartition(tasks, "__bucket").withColumn("__i", F.row_number().over(order))
    place = F.col("__start") + F.element_at("__at", F.col("__i"))
    out = ranked.join(dealt.hint("merge"), "__bucket").withColumn("__place", place)
    out = out.select(*unpacked(docs.columns), F.floor(F.col("__place") / shards).cast("long").alias("slot"), F.pmod("__place", F.lit(shards)).cast("int").alias("shard"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What write_shards wrote of docs."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("shard", "slot").schema)
    return docs.sparkSession.read.schema(f"{fields}, slot long, shard int").parquet(path)


def shard(docs: DataFrame, shards: int = 16, seed: int = 23, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each record in the shards, which are written to the shared folder; the law is `rows`.

    size: bytes of the text in UTF-8 (null: none) plus 1. All are read back from the shards, which
    hold every row of docs (see write_shards). An empty table gives an empty table.
    """
    path = f"{shared_folder(docs.sparkSession)}/shards"
    write_shards(docs, path, shards, seed, bucket_rows, id_col, text_col)
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")).alias("text_crc32")
    return read_shards(docs, path).select(F.col(id_col).cast("long").alias("doc_id"), _size(text_col).alias("size"), crc, "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    done = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
