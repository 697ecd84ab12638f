"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from itertools import chain, islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or of this session where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="pyrocast-")
        base = _own[app]
    return f"{base.rstrip('/')}/pyrocast-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """docs with all its columns in the struct __row, so that no name of a column can clash with an operator's own."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"))


def unpacked(columns: list[str]) -> list[Column]:
    """The columns of packed rows."""
    return [F.col("__row").getField(c).alias(c) for c in columns]


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends only on the values, from 52 bits of their MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def running(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the column name: the sum of value over the rows of the group up to this one, itself included.

    Sums go by ranges of group and order, then inside each range, so that no task sees all rows of a
    large group. group has no nulls; rows that are equal in group and order come in any order.
    """
    cut = rows.repartitionByRange(*[F.col(c) for c in group], *order).withColumns({"__range": F.spark_partition_id(), "__value": value})
    cut = saved(cut, "ranges")
    inside = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cut.groupBy(*group, "__range").agg(F.sum("__value").alias("__sum"))
    # a row for each range of a group
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__range")) - F.col("__sum")
    sums = sums.withColumn("__before", before).drop("__sum")
    out = cut.withColumn(name, F.sum("__value").over(inside)).join(sums, [*group, "__range"])
    return out.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__value", "__before")


# --- Memory of Python workers -------------------------------------------------------------------


def give_back() -> None:
    """Returns to the system what this process has freed: Arrow's pool and C's allocator keep it for themselves otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    # only the GNU library has this
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(run):
    """run, a function of a task's batches, with give_back() after the task: its worker may stay idle beside other stages for long."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


# --- Bloom filters over the whole corpus -------------------------------------------------------

_BLOCK = 17  # a block of a filter has 2**17 bits


def filter_bits(n_keys: int, bits_per_key: int = 16, most: int = 1 << 29) -> int:
    """A power of two with room for n_keys, from one block to `most` bits (64 MB).

    `most` bounds what is broadcast. Beyond it filters fill up and let more keys through; each user
    of a filter confirms what passes, so results stay exact and only the pruning weakens.
    """
    bits = 1 << _BLOCK
    while bits < min(n_keys * bits_per_key, most):
        bits *= 2
    return bits


def positions(digests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key; digests: uint64 of shape (n, 2)."""
    mask = np.uint64(bits - 1)
    return (digests[:, 0] & mask).astype(np.uint32), (digests[:, 1] & mask).astype(np.uint32)


def _packed(offsets: np.ndarray) -> bytes:
    """Bits of one block: a list of offsets while that is shorter, else a bitmap."""
    if len(offsets) * 4 < (1 << _BLOCK) // 8:
        return offsets.astype(np.uint32).tobytes()
    bitmap = np.zeros(1 << _BLOCK, np.uint8)
    bitmap[offsets] = 1
    return np.packbits(bitmap).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == (1 << _BLOCK) // 8:
        return np.frombuffer(data, np.uint8)
    bitmap = np.zeros(1 << _BLOCK, np.uint8)
    bitmap[np.frombuffer(data, np.uint32)] = 1
    return np.packbits(bitmap)


def twice_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the second filter: what at least two keys have set.

    keys: one binary column with 16-byte digests end to end. Each task fills a filter of once-seen
    and one of twice-seen positions and sends their blocks; a block's filters are merged where the
    shuffle puts them: what is twice in one task, or once in two. Only the merged second filter, of
    `bits` bits, reaches the driver.
    """
    import pyarrow as pa

    (column,) = keys.columns

    def blocks(found: np.ndarray):
        values, counts = np.unique(found, return_counts=True)
        which = values >> _BLOCK
        starts = np.flatnonzero(np.diff(which, prepend=-1)) if len(values) else []
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            low = values[a:b] & ((1 << _BLOCK) - 1)
            yield int(which[a]), _packed(low), _packed(low[counts[a:b] > 1])

    schema = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def fill(batches):
        held, n = [], 0

        def flush():
            for row in blocks(np.concatenate(held).astype(np.int64)):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

        for batch in batches:
            for data in batch.column(0).to_pylist():
                if data:
                    held += positions(np.frombuffer(data, np.uint64).reshape(-1, 2), bits)
                    n += len(data) // 8
            if n > 4_000_000:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def merge(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = _unpacked(a), _unpacked(b)
                if block in once:
                    twice[block] = twice[block] | b | (once[block] & a)
                    once[block] = once[block] | a
                else:
                    once[block], twice[block] = a, b
        for block, found in twice.items():
            yield pa.RecordBatch.from_pylist([{"block": block, "twice": found.tobytes()}], pa.schema([("block", pa.int32()), ("twice", pa.binary())]))

    filled = keys.mapInArrow(giving_back(fill), "block int, once binary, twice binary")
    merged = filled.repartition("block").mapInArrow(giving_back(merge), "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row.block << (_BLOCK - 3)
        out[at : at + (1 << (_BLOCK - 3))] = np.frombuffer(row.twice, np.uint8)
    return out


def any_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of a filter with one bit a key; keys: one column of uniformly spread longs.

    Blocks reach the driver packed, a partition at a time with a job for each: 64 blocks (1 MB) make a partition,
    however many the shuffles before have.
    """
    import pyarrow as pa

    (column,) = keys.columns
    rows = keys.select(F.col(column).bitwiseAND(bits - 1).alias("p")).distinct()
    low = F.collect_list(F.col("p").bitwiseAND((1 << _BLOCK) - 1).cast("int"))
    rows = rows.groupBy(F.shiftright("p", _BLOCK).cast("int").alias("block")).agg(low.alias("low"))

    def pack(batches):
        for batch in batches:
            data = [_packed(x.values.to_numpy()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["block", "data"])

    rows = rows.repartition(max(1, bits >> (_BLOCK + 6))).mapInArrow(giving_back(pack), "block int, data binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = row.block << (_BLOCK - 3)
        out[at : at + (1 << (_BLOCK - 3))] = _unpacked(row.data)
    return out


def has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these positions are set."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


# --- Texts in chunks that tokenizers may take one by one ----------------------------------------

# Fixed value: the usual pattern of byte-level vocabularies.
USUAL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


def joined_pieces(chunks: list[str], findall) -> list[str]:
    """The matches of the pattern in all chunks, in order.

    Chunks that begin with a space and another character may follow any other one (see ChunkTable), so
    they are matched together.
    """
    begins = [i for i, c in enumerate(chunks) if c[:1] != " " or c[1:2].isspace() or len(c) == 1]
    if not begins or begins[0]:
        begins.insert(0, 0)
    ends = [*begins[1:], len(chunks)]
    return [p for a, b in zip(begins, ends, strict=True) for p in findall("".join(chunks[a:b]))]


class _Numbered(dict):
    """Numbers its keys as they are asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class ChunkTable:
    """Ids of texts from those of their chunks, each of which is encoded once.

    Texts are cut before spaces that stand before another character than white space. The usual
    pattern of byte-level vocabularies never matches across such a cut, whatever stands before it: it
    gives such a space to the piece that follows. Chunks recur, texts do not. With cuts=False (any
    other pattern) a text is one chunk. learn(chunks) gives the ids of chunks end to end, and the number
    of ids of each. With more than `most` chunks the table keeps, between two batches, those that were met twice or more
    since it last did so, or starts anew if these are more than half of `most`.
    """

    def __init__(self, learn, most: int, cuts: bool = True):
        self.learn, self.most, self.cuts = learn, most, cuts
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.new, self.new_chars = _Numbered(), [], 0
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.blank = np.empty(0, bool)
        self.uses = np.empty(0, np.int32)

    def _numbered(self, chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks, and how many each text has. The first of a text is kept with a space before it, the others without theirs."""
        number, known = self.numbers.__getitem__, len(self.numbers)
        each = [[number(" " + c[0]), *map(number, c[1:])] for c in chunks]
        new = list(islice(reversed(self.numbers), len(self.numbers) - known))[::-1]
        if new:
            # a cut before white space (or the end) is none; what it gave isn't encoded
            blank = [not k or (k[0] != " " and k[0].isspace()) for k in new]
            self.blank = np.append(self.blank, blank)
            found = ["" if no else k[1:] if k[:1] == " " else " " + k for k, no in zip(new, blank, strict=True)]
            self.new += found
            self.new_chars += sum(map(len, found))
        many = np.array([len(x) for x in each], np.int64)
        return np.fromiter(chain.from_iterable(each), np.int32, int(many.sum())), many

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' chunks end to end, and how many each has."""
        if not self.cuts:
            return self._numbered([[x] for x in texts])
        chunks = [x.split(" ") for x in texts]
        numbers, many = self._numbered(chunks)
        wrong = self.blank[numbers]
        if wrong.any():
            wrong = np.add.reduceat(wrong, np.cumsum(many) - many, dtype=np.int64) > 0
            numbers, many = self._numbered([_SPLIT.split(x) if w else c for x, c, w in zip(texts, chunks, wrong.tolist(), strict=True)])
        return numbers, many

    def enter(self) -> None:
        """Encodes the chunks that are numbered but not known yet."""
        if not self.new:
            return
        ids, counts = self.learn(self.new)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids[: self.used], np.empty(self.used + 2 * len(ids), np.uint32))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts, self.counts = np.append(self.starts, self.used + np.cumsum(counts) - counts), np.append(self.counts, counts)
        self.used += len(ids)
        self.new, self.new_chars = [], 0

    def gather(self, numbers: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's ids), from what number() gave."""
        met = np.bincount(numbers, minlength=len(self.counts)).astype(np.int32)
        met[: len(self.uses)] += self.uses
        self.uses = met
        n = self.counts[numbers]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.starts[numbers] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.append(0, ends)[np.cumsum(many)], prepend=0)

    def turn(self, most: int | None = None) -> None:
        """Between two batches: a table that is full (of more than `most` chunks, if given) keeps what recurs."""
        most = self.most if most is None else most
        if len(self.numbers) <= most:
            return
        again = np.flatnonzero(self.uses >= 2)
        if self.new or not 0 < len(again) <= most // 2:
            self._clear()
            return
        names, n, starts, blank = list(self.numbers), self.counts[again], self.starts[again], self.blank[again]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(starts - (ends - n), n) + np.arange(ends[-1])]
        self._clear()
        for i in again.tolist():
            self.numbers[names[i]]
        self.ids, self.used = np.append(ids, np.empty(1 << 16, np.uint32)), len(ids)
        self.starts, self.counts, self.blank = ends - n, n, blank

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's ids)."""
        self.turn()
        told = self.number(texts)
        self.enter()
        return self.gather(*told)


def parts(batch, text: int, most: int = 1 << 21):
    """The batch in slices of some MB of text (column number `text`), so that what a task holds stays small."""
    import pyarrow.compute as pc

    sizes, start, held = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
