"""Token ids in files compressed by Re-Pair.

Documents are brought into ascending id order by ranges, and each range is encoded and written in
files of bounded size. In each file, frequent pairs of ids are replaced by nonterminals until none is
left. A file holds its documents' ids and lengths, the rules with the length each expands to, and
the remaining sequence: a reader that wants ids i to j sums lengths up to i and expands only what
covers the span.
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import USUAL_PATTERN, parts, saved, shared_folder
from .files import content, written

_MAGIC = b"RPTOK2\0\0"
#: Ids in a file, segments of text that a worker keeps the ids of, bytes of text encoded at a time, and ids that a reader expands at a time.
FILE_IDS, _KEPT_SEGMENTS, _SLICE, _READ_IDS = 1 << 20, 500_000, 1 << 22, 1 << 18
#: Ids of a rule that a reader expands once, and files that a task reads where there are many.
_SHORT, _TASK_FILES = 64, 4
_GONE = np.uint32(0xFFFFFFFF)


def _grouped(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, where each stood); bits: how many of a key may be set."""
    places = max(1, (len(keys) - 1).bit_length())
    if bits + places > 64:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    # sorting numbers alone is several times faster than sorting places by them
    both = np.sort(keys << np.uint64(places) | np.arange(len(keys), dtype=np.uint64))
    return both >> np.uint64(places), (both & np.uint64((1 << places) - 1)).astype(np.int64)


def repair(ids: np.ndarray, symbols: int, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rules of shape (n, 2), lengths): symbol symbols + i stands for rules[i] and expands to lengths[i] ids.

    Goes on until no pair stands `least` times. Each round ranks the pairs that do by their number and
    replaces a pair wherever neither pair that overlaps it has a better rank; in a run of one symbol
    every other pair counts, from the left. A pair that is left fewer than `least` times waits for a
    later round; the best one is always replaced everywhere, so each round makes a rule. A pair
    becomes frequent only by a new symbol, so a round looks only at the places where a pair was frequent
    before or a neighbour is new; the sequence is a list linked in both directions.
    """
    n = len(ids)
    sym, after, before = ids.astype(np.uint32), np.arange(1, n + 1), np.arange(-1, n - 1)
    never = np.iinfo(np.int32).max
    rank_at = np.full(n + 1, never, np.int32)  # the last place stands for what is beyond both ends
    at, wait = np.arange(n - 1), np.zeros(n, bool)
    rules, named, lengths = [], symbols, np.empty(0, np.int64)
    while True:
        first, second = sym.take(at), sym.take(after.take(at))
        late = at[:0]
        if len(same := np.flatnonzero(first == second)):
            run, i = at[same], np.arange(len(same))
            begins = np.append(True, after[run[:-1]] != run[1:])
            odd = (i - np.maximum.accumulate(np.where(begins, i, 0))) % 2 == 1
            late, free = run[odd], np.ones(len(at), bool)
            free[same[odd]] = False
            if len(late):
                free = np.flatnonzero(free)
                at, first, second = at.take(free), first.take(free), second.take(free)
        half = max(1, (named - 1).bit_length())
        keys, order = _grouped(first.astype(np.uint64) << np.uint64(half) | second, 2 * half)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
        counts = np.diff(np.append(starts, len(keys)))
        often = counts >= least
        if not often.any():
            break
        pairs, many = keys[starts[often]], counts[often]
        by_count = np.argsort(-many, kind="stable")
        # by place: the rank of each pair that stands often, else never
        place = np.full(len(counts), never, np.int32)
        place[np.flatnonzero(often)[by_count]] = np.arange(len(many), dtype=np.int32)
        rank = np.empty(len(at), np.int32)
        rank[order] = np.repeat(place, counts)
        some = np.flatnonzero(rank < never)
        at, rank = at.take(some), rank.take(some)
        rank_at[at] = rank
        hit = (rank < rank_at.take(before.take(at), mode="wrap")) & (rank < rank_at.take(after.take(at)))
        rank_at[at] = never
        hit = np.flatnonzero(hit)
        p, best = at.take(hit), rank.take(hit)
        stays = np.bincount(best, minlength=len(many)) >= least
        hit = np.flatnonzero(stays.take(best))
        p, best = p.take(hit), best.take(hit)
        new = pairs[by_count][stays]
        rules.append(np.stack([new >> np.uint64(half), new & np.uint64((1 << half) - 1)], 1).astype(np.int64))
        name = (named + np.cumsum(stays) - 1).astype(np.uint32)
        named, lengths = named + len(new), np.append(lengths, _sizes(rules[-1], lengths, symbols).sum(1))
        gone = after.take(p)
        beyond = after.take(gone)
        sym[p], sym[gone] = name.take(best), _GONE
        after[p] = beyond
        inner = beyond < n
        before[beyond[inner]] = p[inner]
        left = before.take(p)
        wait[at] = True
        wait[late] = True
        wait[gone] = False
        wait[p] = inner
        wait[left[left >= 0]] = True
        at = np.flatnonzero(wait)
        wait[at] = False
    return sym[sym != _GONE], np.concatenate([np.empty((0, 2), np.int64), *rules]), lengths


def _sizes(values: np.ndarray, lengths: np.ndarray, symbols: int) -> np.ndarray:
    """The number of ids that each symbol expands to; lengths: of what each rule expands to."""
    return np.append(1, lengths)[np.maximum(values.astype(np.int64) - (symbols - 1), 0)]


def _width(symbols: int) -> int:
    """Bytes that a symbol takes in a file."""
    return 2 if symbols <= 1 << 16 else 3 if symbols <= 1 << 24 else 4


def _narrow(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :width]).tobytes()


def _split(todo: np.ndarray, at: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of at most `most` ids that these stand for, and where each one's ids begin; at: where these ones' do."""
    done = [(todo[:0], at[:0])]
    while len(todo):
        large = _sizes(todo, lengths, symbols) > most
        done.append((todo[~large], at[~large]))
        at, pair = at[large], rules[todo[large] - symbols]
        todo, at = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([at, at + _sizes(pair[:, 0], lengths, symbols)])
    return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])


class Expander:
    """Gives the ids that sequences stand for; lengths: of what each rule expands to.

    Rules of few ids are expanded once, and copied from there; longer ones are split first.
    """

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, symbols: int):
        self.told = rules, lengths, symbols
        short = np.flatnonzero(lengths <= _SHORT)
        n = lengths[short]
        begins = np.cumsum(n) - n
        todo, at = _split(short + symbols, begins, *self.told, 1)
        self.ids = np.empty(symbols + int(n.sum()), np.uint32)
        self.ids[:symbols] = np.arange(symbols)
        self.ids[symbols + at] = todo
        self.starts = np.arange(symbols + len(rules))
        self.starts[symbols + short] = symbols + begins

    def __call__(self, seq: np.ndarray) -> np.ndarray:
        rules, lengths, symbols = self.told
        todo = seq.astype(np.int64)
        n = _sizes(todo, lengths, symbols)
        if (large := n > _SHORT).any():
            at = np.cumsum(n) - n
            more, where = _split(todo[large], at[large], *self.told, _SHORT)
            order = np.argsort(np.concatenate([at[~large], where]), kind="stable")
            todo = np.concatenate([todo[~large], more])[order]
            n = _sizes(todo, lengths, symbols)
        ends = np.cumsum(n)
        return self.ids.take(np.repeat(self.starts.take(todo) - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0))


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: int) -> np.ndarray:
    """The ids that a sequence stands for; lengths: of what each rule expands to."""
    return Expander(rules, lengths, symbols)(seq)


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, symbols: int) -> list[bytes]:
    """The parts of a file."""
    seq, rules, lengths = repair(ids, symbols)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = struct.pack("<8sQQQQQ", _MAGIC, symbols, len(doc_ids), len(rules), len(seq), len(ids))
    width = _width(symbols + len(rules))
    arrays = [known, np.array([x or 0 for x in doc_ids], np.int64), np.array(counts, np.int64)]
    return [head, *[x.tobytes() for x in arrays], _narrow(rules, width), lengths.astype(np.uint32).tobytes(), _narrow(seq, width)]


class TokenFile:
    """A file read back."""

    def __init__(self, data: bytes):
        magic, self.symbols, docs, rules, n, self.n_ids = struct.unpack_from("<8sQQQQQ", data)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        width, at = _width(self.symbols + rules), struct.calcsize("<8sQQQQQ")

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        def named(count):
            out = np.zeros((count, 4), np.uint8)
            out[:, :width] = take(np.uint8, count * width).reshape(-1, width)
            return out.view("<u4").ravel()

        known, ids = take(np.uint8, docs), take(np.int64, docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.counts = take(np.int64, docs)
        self.rules = named(2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take(np.uint32, rules).astype(np.int64)
        self.seq = named(n)
        self.ends = np.cumsum(_sizes(self.seq, self.lengths, self.symbols))
        self.expand = Expander(self.rules, self.lengths, self.symbols)

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file, as unsigned 32-bit integers."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.ends, [start, stop - 1], side="right")
        skipped = int(self.ends[a - 1]) if a else 0
        return self.expand(self.seq[a : b + 1])[start - skipped : stop - skipped]


_workers: dict = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where ASCII letters stand, where the first byte of other Latin or Cyrillic ones does: U+00C0 to U+023F, U+0400 to U+047F), the latter without the last byte."""
    lead, after = data[:-1], data[1:]
    two = (lead == 0xC3) & (after != 0x97) & (after != 0xB7)
    return ((data | 32) - np.uint8(97)) < 26, two | ((lead - np.uint8(0xC4)) < 5) | ((lead - np.uint8(0xD0)) < 2)


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments of UTF-8 texts begin; offsets: where texts do, and where the last one ends.

    No match of the usual pattern crosses a cut, and a segment's matches are the same alone. Cuts are at the
    beginnings of texts, and before a space that another character than white space follows, an ASCII
    character that is no letter behind a Latin or Cyrillic letter, and what follows a line's end behind another ASCII
    character than white space. Bytes tell all this only for ASCII, these letters and characters that are surely no white space.
    """
    letter, two = _letters(data)
    ink = (data - np.uint8(0x21)) < 0x5E
    # white space begins with 0xC2 and 0xE1 to 0xE3 at most
    seen = ink | ((data >= 0xC3) & ((data - np.uint8(0xE1)) > 2))
    space = data == 32
    full = offsets[1:] > offsets[:-1]
    space[offsets[1:][full] - 1] = False
    cut = np.zeros(len(data), bool)
    cut[:-1] = space[:-1] & seen[1:]
    ended = letter[:-1].copy()
    ended[1:] |= two[:-1]
    cut[1:] |= ended & (data[1:] < 0x80) & ~letter[1:]
    cut[2:] |= (data[1:-1] == 10) & ink[:-2] & seen[2:]
    cut[offsets[:-1][full]] = True
    return np.flatnonzero(cut)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values end to end, where each begins and the last one ends); values: large_binary."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset)
    n = int(offsets[-1] - offsets[0])
    return np.frombuffer(data, np.uint8, n, int(offsets[0])) if n else np.empty(0, np.uint8), offsets - offsets[0]


class SegmentTable:
    """Ids of texts from those of their segments (see _cuts), each of which is encoded once.

    Segments are numbered by Arrow, behind those that are known. learn(segments) gives the ids of segments end to
    end, and the number of ids of each. With more than `most` segments the table keeps, between two batches, those that were
    met twice or more since it last did so, or starts anew if these are more than half of `most`.
    """

    def __init__(self, learn, most: int):
        self.learn, self.most = learn, most
        self._keep(pa.array([], pa.large_binary()), np.empty(0, np.uint32), np.empty(0, np.int64))

    def _keep(self, known: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.known, self.ids, self.counts = known, ids, counts
        self.starts, self.uses = np.cumsum(counts) - counts, np.zeros(len(counts), np.int64)

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these segments end to end, where each one's end)."""
        n = self.counts[numbers]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.starts[numbers] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _turn(self) -> None:
        again = np.flatnonzero(self.uses >= 2)
        again = again[: len(again) if len(again) <= self.most // 2 else 0]
        self._keep(self.known.take(pa.array(again)), self._ids(again)[0], self.counts[again])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's ids)."""
        if len(self.known) > self.most:
            self._turn()
        data, offsets = _bytes(texts.cast(pa.large_binary()))
        cuts = np.append(_cuts(data, offsets), len(data))
        found = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        k = len(self.known)
        found = pa.concat_arrays([self.known, found]).dictionary_encode()
        if len(found.dictionary) > k:
            ids, counts = self.learn(found.dictionary.slice(k))
            self.known, self.starts = found.dictionary, np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
            self.ids, self.counts = np.append(self.ids, ids), np.append(self.counts, counts)
        numbers = found.indices.to_numpy()[k:]
        met = np.bincount(numbers, minlength=len(self.counts))
        met[: len(self.uses)] += self.uses
        self.uses = met
        ids, ends = self._ids(numbers)
        return ids, np.diff(np.append(0, ends)[np.searchsorted(cuts, offsets)])


#: Bytes that are in no UTF-8, and the number of pieces that a model is asked for in one word.
_NEVER, _GROUP = [0xC0, 0xC1, *range(0xF5, 0x100)], 64


class Encoder:
    """A tokenizer of the tokenizers library (from its JSON), with the ids of the segments it has met.

    Where the tokenizer is byte-level BPE with its usual pattern, its model is asked for the pieces of
    each distinct segment, many in one call; otherwise, and for texts that hold an added token, the whole
    tokenizer for each text.
    """

    def __init__(self, text: str, pattern: str | None):
        from tokenizers import Tokenizer, pre_tokenizers

        told = json.loads(text)
        how = told.get("pre_tokenizer") or {}
        self.whole, self.table = Tokenizer.from_str(text), None
        self.added = [x["content"] for x in told.get("added_tokens", [])]
        if pattern == USUAL_PATTERN and how.get("type") == "ByteLevel" and how.get("use_regex") and not how.get("add_prefix_space") and not told.get("normalizer"):
            # gives matches in letters for their bytes; its own tables of Unicode decide, as other libraries have other versions
            self.cut = self.whole.pre_tokenizer.pre_tokenize_str
            letters = _byte_letters()
            self.model = Tokenizer(self.whole.model)
            vocabulary = self.model.get_vocab()
            self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.bytes[i] = len(token)
            # pieces are asked for as one word, between letters that no merge takes; else as words, between zero bytes
            named = told["model"]
            plain = named.get("type") == "BPE" and not any(named.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            merged = set("".join(x if isinstance(x, str) else "".join(x) for x in named.get("merges", [])))
            free = [b for b in _NEVER[:-1] if plain and letters[b] in vocabulary and letters[b] not in merged]
            self.between, self.mark = (free[0], vocabulary[letters[free[0]]]) if free else (_NEVER[0], None)
            self.letters = np.array([ord(letters[b]) for b in range(256)], "<u4")
            self.letters[_NEVER[-1]] = ord("\n")
            if not free:
                self.letters[self.between] = 0
                self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")
            self.table = SegmentTable(self._learn, _KEPT_SEGMENTS)

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = _bytes(new)
        begins, asked = offsets[:-1], offsets[1:]
        # Latin and Cyrillic letters behind a space or none are one match, whatever the version of Unicode; others are cut by the library
        letter, two = _letters(data)
        letter[:-1] |= two
        letter[1:] |= two
        letter[begins] |= data[begins] == 32
        others = np.flatnonzero(np.logical_or.reduceat(~letter, begins))
        inner = [np.cumsum([len(p) for p, _ in self.cut(text.decode())])[:-1] + at for at, text in zip(begins[others].tolist(), new.take(pa.array(others)).to_pylist(), strict=True)]
        ends = np.sort(np.concatenate([asked, *inner]))[:-1]
        marks = np.full(len(ends), self.between, np.uint8)
        marks[_GROUP - 1 :: _GROUP] = _NEVER[-1]
        words = self.letters[np.insert(data, ends, marks)].tobytes().decode("utf-32-le").split("\n")
        ids = np.fromiter(chain.from_iterable([x.ids for x in self.model.encode_batch_fast(words, add_special_tokens=False)]), np.uint32)
        if self.mark is not None:
            ids = ids[ids != self.mark]
        # tokens never cross segments, so segments end where their bytes do
        ends = np.cumsum(self.bytes[ids])
        upto = np.searchsorted(ends, asked, side="right")
        if not len(ends) or ends[-1] != asked[-1] or (np.append(0, ends)[upto] != asked).any():
            raise ValueError("the vocabulary doesn't cover all bytes")
        return ids, np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's ids)."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        alone = np.full(len(texts), self.table is None)
        for token in self.added:
            alone |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not alone.any():
            return self.table.encode(texts)
        at = np.flatnonzero(alone).tolist()
        told = {i: np.array(e.ids, np.uint32) for i, e in zip(at, self.whole.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True)}
        ids, counts = self.table.encode(pc.if_else(pa.array(alone), "", texts)) if self.table else (np.empty(0, np.uint32), np.zeros(len(texts), np.int64))
        each = np.split(ids, np.cumsum(counts)[:-1])
        each = [told.get(i, x) for i, x in enumerate(each)]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def _encoder(text: str, pattern: str | None) -> Encoder:
    """One for each tokenizer and worker."""
    key = hash((text, pattern))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(text, pattern)
    return _workers[key]


def write(docs: DataFrame, folder: str, tokenizer: str, pattern: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of each text and end_id, in ascending order of document ids; gives the manifest.

    Manifest: path, part, roll, n_ids, start (ids in all files before). tokenizer: JSON of
    the tokenizers library, broadcast (its vocabulary has a fixed size); pattern: how a byte-level
    tokenizer splits texts, if it does so as usual. Null texts are empty; rows
    without an id come first; rows with one id stand in order of a hash of their texts (and may lie in
    several ranges). Other columns are not read. An empty table gives no files.
    """
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(tokenizer)
    symbols = max([end_id, *json.loads(tokenizer)["model"]["vocab"].values(), *[x["id"] for x in json.loads(tokenizer)["added_tokens"]]]) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, roll, coder = TaskContext.get().partitionId(), 0, _encoder(kept.value, pattern)
        doc_ids, counts, held, size = [], [], [], 0

        def flush():
            path = written(folder, f"ids-{part:06d}-{roll:06d}", ".rptok", pack(doc_ids, counts, np.concatenate(held), symbols))
            return pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "roll": pa.array([roll], pa.int32()), "n_ids": pa.array([size], pa.int64())})

        for part_of in (x for batch in batches for x in parts(batch, 1, _SLICE)):
            named, (ids, many) = part_of.column(0).to_pylist(), coder.encode(part_of.column(1))
            ids, many = np.insert(ids, np.cumsum(many), end_id), many + 1
            ends, a = np.cumsum(many), 0
            while a < len(named):
                begin = int(ends[a - 1]) if a else 0
                # up to the document that fills the file
                b = min(len(named), int(np.searchsorted(ends, begin + file_ids - size)) + 1)
                doc_ids += named[a:b]
                counts += many[a:b].tolist()
                held.append(ids[begin : int(ends[b - 1])])
                size, a = size + len(held[-1]), b
                if size >= file_ids:
                    yield flush()
                    doc_ids, counts, held, size, roll = [], [], [], 0, roll + 1
        if doc_ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    manifest = saved(ordered.mapInArrow(run, "path string, part int, roll int, n_ids long"), "manifest")
    # sums of the parts, of which a job has thousands at most, then of the files in each
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    sums = sums.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("roll")) - F.col("n_ids")
    return manifest.join(sums, F.col("part") == F.col("p")).withColumn("start", F.col("before") + inside).drop("p", "before")


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, and its ids (binary) if asked for.

    Documents are read by spans of their file, some at a time.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(content(path))
                ends = np.cumsum(file.counts)
                a = 0
                while a < len(ends):
                    begin = int(ends[a - 1]) if a else 0
                    b = min(len(ends), int(np.searchsorted(ends, begin + _READ_IDS)) + 1)
                    whole = memoryview(file.span(begin, int(ends[b - 1])).tobytes())
                    cuts = ((np.append(begin, ends[a:b]) - begin) * 4).tolist()
                    data = [whole[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    cols = [file.doc_ids[a:b], start + ends[a:b] - file.counts[a:b], file.counts[a:b], [zlib.crc32(x) for x in data]]
                    cols += [[bytes(x) for x in data]] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)
                    a = b

    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    # a file is one unit of work
    files = manifest.count()
    tasks = max(1, min(files, manifest.sparkSession.sparkContext.defaultParallelism), -(-files // _TASK_FILES))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(run, fields)


def query(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        tokenizer = f.read()
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/ids", tokenizer, public_tokenizers.PATTERN)
    return read(saved(manifest, "starts"))
