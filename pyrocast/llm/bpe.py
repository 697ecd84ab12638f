"""Byte-level BPE by corpus-level merge replay.

Each task gathers the distinct pieces of its texts (up to a bound), lays them out as one sequence of
tokens, and keeps an inverted index from token pair (by the rank of its merge) to the positions where
it stands. Merges are applied in rank order to all positions at once; only the neighbours of a merged
pair change, and only their entries are added. Texts are then put together from their pieces, so
nothing is shuffled. What a worker has encoded, it keeps in a bounded table for its next batches. So the
corpus of one replay is what a task has gathered, and a piece that several workers meet is replayed by each. A piece
where a merge brings up a pair of lower rank, while others of this rank are left, is merged alone, with a heap of its pairs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import USUAL_PATTERN, ChunkTable, giving_back, joined_pieces, parts

#: Characters of new chunks, and chunks of texts, that a task gathers before a replay; chunks that a worker keeps.
_NEW_CHARS, _HELD_CHUNKS, _KEPT_CHUNKS = 1 << 19, 1 << 21, 150_000
#: Positions that a replay enters at a time.
_ENTERED = 1 << 18
#: Chunks and merges that a worker keeps between tasks, when it may stay idle beside other stages.
_IDLE_CHUNKS, _IDLE_MERGES = 40_000, 60_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes pieces by ranks; the rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.findall = regex.compile(pattern).findall
        self.merges: dict[int, int] = {}
        self.table = ChunkTable(self._learn, _KEPT_CHUNKS, cuts=pattern == USUAL_PATTERN)

    def _merge(self, pair: int) -> int:
        """The id that a pair (first << 32 | second) merges to, or -1."""
        found = self.merges.get(pair)
        if found is None:
            if len(self.merges) > 200_000:
                self.merges.clear()
            found = self.merges[pair] = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], -1)
        return found

    def _alone(self, piece: bytes) -> list[int]:
        """The ids of one piece, one merge after the other; a heap holds its pairs."""
        ids, n = self.bytes[list(piece)].tolist(), len(piece)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := self._merge(ids[i] << 32 | ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self._merge(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := self._merge(ids[left] << 32 | ids[after[left]])) >= 0:
                    heapq.heappush(heap, (r, left))
        return [x for x in ids if x >= 0]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces (none empty) end to end, number of each one's ids).

        All positions of the pairs of one rank are merged together. That equals merging them one by
        one from the left, but for a piece where a merge brings up a pair of lower rank while others
        of this rank are left: such a piece is encoded alone.
        """
        size = np.array([len(p) for p in pieces], np.int64)
        start, n = np.cumsum(size) - size, int(size.sum())
        # the widest arrays of a task, so no wider than positions need
        kind = np.int32 if n < 1 << 31 else np.int64
        tok = self.bytes.astype(kind)[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces), dtype=kind), size)
        after, before = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
        after[start + size - 1], before[start] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[tuple[int, int]] = []
        alone: set[int] = set()

        def add(at: np.ndarray, low: int) -> np.ndarray:
            """Enters the pairs that start at these positions; gives the positions of those of lower rank."""
            keys = tok[at].astype(np.int64) << 32 | tok[after[at]]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = at[order]
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)).tolist()
            lower, a = [], 0
            for key, b in zip(keys[np.array(ends) - 1].tolist(), ends, strict=True):
                r = self._merge(key)
                if r >= 0:
                    if key in index:
                        index[key].append(at[a:b])
                    else:
                        index[key] = [at[a:b]]
                        heapq.heappush(heap, (r, key))
                    if r < low:
                        lower.append(at[a:b])
                a = b
            return np.concatenate(lower) if lower else at[:0]

        # in slices, as the sort of all positions would take more than all else
        for a in range(0, n, _ENTERED):
            if (at := a + np.flatnonzero(after[a : a + _ENTERED] >= 0)).size:
                add(at.astype(kind), -1)
        while heap:
            r, key = heapq.heappop(heap)
            keys = [key]
            while heap and heap[0][0] == r:
                keys.append(heapq.heappop(heap)[1])
            found = []
            for key in keys:
                p = np.concatenate(index.pop(key))
                p = p[(tok[p] == key >> 32) & (after[p] >= 0)]
                found.append(p[tok[after[p]] == key & 0xFFFFFFFF])
            p = np.unique(np.concatenate(found))
            q = after[p]
            if (q[:-1] == p[1:]).any():  # pairs that overlap: from the left
                kept, last = [], -1
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
                    if x != last:
                        kept.append(i)
                        last = y
                p, q = p[kept], q[kept]
            if not len(p):
                continue
            tok[p], tok[q] = r, -1
            n = after[q]
            after[p] = n
            right = n >= 0
            before[n[right]] = p[right]
            left = before[p]
            new = np.concatenate([p[right], left[left >= 0]])
            if len(new):
                lower = add(new, r)
                if len(lower):
                    words, times = np.unique(word[p], return_counts=True)
                    alone.update(np.intersect1d(word[lower], words[times > 1]).tolist())
        ids, counts = tok[tok >= 0].astype(np.uint32), np.add.reduceat(tok >= 0, start, dtype=np.int64)
        if not alone:
            return ids, counts
        each = np.split(ids, np.cumsum(counts)[:-1])
        for w in alone:
            each[w] = np.array(self._alone(pieces[w]), np.uint32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks end to end, number of each one's ids)."""
        if self.table.cuts:
            found, many = joined_pieces(chunks, self.findall), None
        else:
            each = [self.findall(c) for c in chunks]
            found, many = [p for c in each for p in c], np.array([len(c) for c in each])
        numbers: dict[str, int] = {}
        number = np.fromiter((numbers.setdefault(p, len(numbers)) for p in found), np.int64, len(found))
        if not len(number):
            return np.empty(0, np.uint32), np.zeros(len(chunks), np.int64)
        ids, counts = self.replay([p.encode() for p in numbers])
        n = counts[number]
        ends, starts = np.cumsum(n), np.cumsum(counts) - counts
        ids = ids[np.repeat(starts[number] - (ends - n), n) + np.arange(ends[-1])]
        if many is not None:
            return ids, np.diff(np.append(0, ends)[np.cumsum(many)], prepend=0)
        # tokens never cross chunks, so chunks end where their bytes do
        upto = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(c.encode()) for c in chunks]), side="right")
        return ids, np.diff(upto, prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native unsigned 32-bit integers."""
        return self._each(*self.table.encode(texts))

    def _each(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        data, ends = ids.tobytes(), np.cumsum(counts) * 4
        return [data[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)]

    def batches(self, rows):
        """(head, ids of each text) for each of rows (head, texts); new chunks of many rows are replayed together."""
        held, chunks = [], 0
        self.table.turn()
        for head, texts in rows:
            told = self.table.number(texts)
            held.append((head, told))
            chunks += len(told[0])
            if self.table.new_chars > _NEW_CHARS or chunks > _HELD_CHUNKS:
                self.table.enter()
                for head, told in held:
                    yield head, self._each(*self.table.gather(*told))
                held, chunks = [], 0
                self.table.turn()
        self.table.enter()
        for head, told in held:
            yield head, self._each(*self.table.gather(*told))
        held.clear()
        self.table.turn(_IDLE_CHUNKS)
        if len(self.merges) > _IDLE_MERGES:
            self.merges.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist())) if ids else b""


_workers: dict[str, MergeReplay] = {}


def _replay(kept) -> MergeReplay:
    """One for each vocabulary and worker, with what it has encoded so far; kept: broadcast of (digest, ranks, pattern)."""
    key, ranks, pattern = kept.value
    if key not in _workers:
        _workers.clear()
        _workers[key] = MergeReplay(ranks, pattern)
    return _workers[key]


def _sent(spark, ranks: dict[bytes, int], pattern: str):
    """Vocabulary and pattern, broadcast with a digest of both; a vocabulary has a fixed size."""
    told = hashlib.sha256(pattern.encode())
    for token, i in sorted(ranks.items(), key=lambda x: x[1]):
        told.update(b"%d %d " % (i, len(token)) + token)
    return spark.sparkContext.broadcast((told.hexdigest(), ranks, pattern))


def _coded(docs: DataFrame, ranks, pattern: str, id_col: str, text_col: str, fields: str, row) -> DataFrame:
    """doc_id and what row(coder, ids) gives for each text; fields: names and types after doc_id."""
    assert sys.byteorder == "little"
    kept = _sent(docs.sparkSession, ranks, pattern)
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        coder = _replay(kept)
        slices = (part for batch in batches for part in parts(batch, 1, 1 << 20))
        for head, ids in coder.batches((part.column(0), [x or "" for x in part.column(1).to_pylist()]) for part in slices):
            cols = zip(*[row(coder, x) for x in ids], strict=True)
            yield pa.RecordBatch.from_arrays([head, *map(pa.array, cols)], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), "doc_id long, " + fields)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens long, ids binary (unsigned 32-bit, little-endian), a row for each row of docs.

    Each match of pattern is encoded by itself, without special tokens. Null and empty texts have no
    ids. Repeated rows stay repeated; other columns are not read. ranks: rank of each token's bytes,
    all 256 single bytes included; they are broadcast (the vocabulary has a fixed size).
    """
    return _coded(docs, ranks, pattern, id_col, text_col, "n_tokens long, ids binary", lambda coder, ids: (len(ids) // 4, ids))


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """encoded with the column decoded binary: the bytes of all ids, end to end."""
    kept = _sent(encoded.sparkSession, ranks, pattern)

    def run(batches):
        coder = _replay(kept)
        for batch in batches:
            for part in parts(batch, batch.schema.get_field_index("ids")):
                ids = part.column("ids").to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([coder.decode(x or b"") for x in ids], pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(giving_back(run), ", ".join(f"`{n}` {t}" for n, t in encoded.drop("decoded").dtypes) + ", decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encode, then decode, in one pass over the texts."""

    def row(coder, ids):
        digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()
        return (len(ids) // 4, *digests, ids) if with_ids else (len(ids) // 4, *digests)

    return _coded(docs, ranks, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, row)


def query(spark, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path(vocabulary))
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
