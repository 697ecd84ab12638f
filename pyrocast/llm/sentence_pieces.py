"""SentencePiece encoding (BPE models) and decoding, with every piece's span in the original bytes.

A text is first normalised: at each place the longest prefix that the model's compiled character map
knows is replaced, any other character stays, and for every byte of the outcome the place in the
original that it came from is kept. Pieces are merges of the normalised text, best score first, the
leftmost of equal ones; through the alignment each piece is projected to the bytes of the original
that it stands for. Merges never cross certain places (before a space mark that follows another
character, around characters that no longer piece has: found from the vocabulary), so texts are cut
there into chunks, which recur; what a worker has encoded it keeps in a bounded table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
import sys
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

#: Chunks, and pieces of them, that a worker keeps.
_KEPT_CHUNKS, _KEPT_PIECES = 200_000, 2_000_000
SPACE = "▁"

# Fixed values of the model's file format.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6

_NO = float("inf")
_NEVER = np.iinfo(np.int32).max


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


class CharacterMap:
    """A compiled character map: a double array of prefixes, and what each is replaced by.

    A unit of the array holds a label (the byte that leads to it), an offset to its children and
    whether it ends a prefix; the unit at a node's own offset then holds where the replacement begins.
    """

    def __init__(self, data: bytes):
        (n,) = struct.unpack_from("<I", data) if data else (0,)
        self.units = np.frombuffer(data, "<u4", n // 4, 4).tolist() if n else []
        self.strings = data[4 + n :]
        self.found: dict[int, str] = {}
        first = [b for b in range(256) if self.units and self._step(self._offset(self.units[0]), b) is not None]
        # places where a prefix may begin
        self.starts = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in first) + b"]") if first else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The unit that byte leads to from the children at node."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[str, int] | None:
        """(replacement, bytes that it replaces) of the longest known prefix of data from at on."""
        node, best = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            here = self._step(node, data[i])
            if here is None:
                break
            unit = self.units[here]
            node = here ^ self._offset(unit)
            if unit >> 8 & 1:
                best = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        value, n = best
        if value not in self.found:
            self.found[value] = self.strings[value : self.strings.index(b"\0", value)].decode()
        return self.found[value], n


class _Chunks(dict):
    """Numbers of chunks, in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _bytewise(error):
    """Each byte that isn't UTF-8 is a replacement character of its own."""
    return "�", error.start + 1


codecs.register_error("pyrocast_bytewise", _bytewise)


class Pieces:
    """Encodes and decodes texts by a SentencePiece model of kind BPE; model: the file's content."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        spec: dict[int, dict] = {2: {}, 3: {}}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, _NORMAL)))
            elif number in spec:
                spec[number] = dict(_fields(value))
        trainer, normal = spec[2], spec[3]
        kinds = {kind for _, _, kind in self.pieces}
        if trainer.get(3, 1) != 2 or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or trainer.get(24, 0):
            raise ValueError("only BPE models without user-defined or unused pieces and with the space mark in front are supported")
        self.map = CharacterMap(normal.get(2, b""))
        self.dummy, self.collapse, self.mark = bool(normal.get(3, 1)), bool(normal.get(4, 1)), SPACE if normal.get(5, 1) else " "
        ids = {piece: i for i, (piece, _, _) in enumerate(self.pieces)}
        self.begin, self.end = (ids.get(trainer.get(n, default).decode() if n in trainer else default, -1) for n, default in ((46, "<s>"), (47, "</s>")))
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == _UNKNOWN)
        self.normal = {piece: (-score, i) for i, (piece, score, kind) in enumerate(self.pieces) if kind == _NORMAL}
        self.byte = {int(piece[1:-1], 16): i for i, (piece, _, kind) in enumerate(self.pieces) if kind == _BYTE} if trainer.get(35, 0) else {}
        surface = trainer.get(44, " ⁇ ".encode())
        self.text = [b"" if kind == _CONTROL else surface if kind == _UNKNOWN else bytes([int(piece[1:-1], 16)]) if kind == _BYTE else piece.replace(SPACE, " ").encode() for piece, _, kind in self.pieces]
        self.silent = {i for i, x in enumerate(self.pieces) if x[2] == _CONTROL}
        # for merges of many chunks at a time: each character's piece, and what two pieces merge to, with its place in the order of scores
        self.of_char = np.full(sys.maxunicode + 1, -1, np.int32)
        for piece, (_, i) in self.normal.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        order = {cost: k for k, cost in enumerate(sorted({cost for cost, _ in self.normal.values()}))}
        get, found = self.normal.get, []
        for piece, (cost, i) in self.normal.items():
            for k in range(1, len(piece)):
                a, b = get(piece[:k]), get(piece[k:])
                if a and b:
                    found.append((a[1] * len(self.pieces) + b[1], i, order[cost]))
        found = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.pairs, self.merged_to, self.places = found[:, 0].copy(), found[:, 1].astype(np.int32), found[:, 2].astype(np.int32)
        self.widths = np.array([len(piece.encode()) for piece, _, _ in self.pieces], np.int64)
        # places that no piece goes across
        long = [piece for piece in self.normal if len(piece) > 1]
        lone = "".join(c for c in map(chr, range(128)) if not any(c in piece for piece in long))
        lead = not any(SPACE in piece.lstrip(SPACE) for piece in long)
        lone_class = re.escape(lone)
        other = f"[^{SPACE}{lone_class}]+"
        runs = f"[{lone_class}]|" if lone else ""
        self.cut = re.compile(f"{runs}{SPACE}*{other}|{SPACE}+" if lead else f"{runs}[^{lone_class}]+" if lone else r"(?s:.+)").findall
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Chunks()
        self.known, self.used = 0, 0
        self.ids, self.ends = np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.int32)
        self.starts, self.counts, self.sizes = (np.empty(0, np.int64) for _ in range(3))

    # --- normalisation

    def normalised(self, text: str) -> tuple[str, np.ndarray | None]:
        """(the normalised text, for each of its bytes and its end the byte of text it came from; None: see plain)."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.map.starts is None and not self.collapse:
            return (self.mark if self.dummy else "") + text.replace(" ", self.mark), None
        data = text.encode()
        out: list[str] = []
        at: list[tuple[int, int]] = []  # (bytes, where from)
        mark = self.mark

        def put(chars: str, source: int, n: int) -> None:
            """chars for n bytes from source on; a text as long as its source is aligned byte by byte."""
            out.append(chars)
            at.append((len(chars.encode()), source if n < 0 else -source - 1))

        def steps():
            """(replacement, where from, bytes replaced)."""
            i = 0
            while i < len(data):
                found = self.map.longest(data, i) if self.map.starts is not None else None
                if found:
                    yield found[0], i, found[1]
                    i += found[1]
                else:
                    n = 1 if data[i] < 128 else 2 if data[i] < 224 else 3 if data[i] < 240 else 4
                    yield data[i : i + n].decode(), i, n
                    i += n

        lead, after_space, begun = self.collapse, self.collapse, False
        for chars, i, n in steps():
            if lead and chars == " ":
                continue
            lead = False
            if not begun:
                begun = True
                if self.dummy:
                    put(mark, i, -1)
            if after_space:
                chars = chars.lstrip(" ")
            if chars:
                put(chars.replace(" ", mark), i, -1)
                after_space = chars.endswith(" ")
            if not self.collapse:
                after_space = False
        text_out = "".join(out)
        source = np.repeat(np.array([x[1] for x in at], np.int64), [x[0] for x in at])
        end = len(data)
        if self.collapse:
            kept = text_out.rstrip(mark)
            if len(kept) < len(text_out):
                size = len(kept.encode())
                end = int(source[size])
                text_out, source = kept, source[:size]
        return text_out, np.append(source, end)

    # --- merges

    def _short(self, symbols: list[str]) -> list[str]:
        """The symbols merged: the best pair is looked for anew each time, which is quick where there are few."""
        score = [normal[0] if (normal := self.normal.get(a + b)) else _NO for a, b in zip(symbols, symbols[1:])]
        get = self.normal.get
        while score:
            best = min(score)
            if best == _NO:
                break
            i = score.index(best)
            symbols[i : i + 2] = [merged := symbols[i] + symbols[i + 1]]
            del score[i]
            if i:
                found = get(symbols[i - 1] + merged)
                score[i - 1] = found[0] if found else _NO
            if i < len(score):
                found = get(merged + symbols[i + 1])
                score[i] = found[0] if found else _NO
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The symbols merged, with a heap of pairs."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        normal, heap = self.normal.get, []
        for i in range(n - 1):
            found = normal(symbols[i] + symbols[i + 1])
            if found:
                heap.append((found[0], i, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j < 0 or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0:
                    a, b = symbols[left], symbols[after[left]]
                    found = normal(a + b)
                    if found:
                        heapq.heappush(heap, (found[0], left, len(a) + len(b)))
        return [x for x in symbols if x]

    def _chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        """(ids, where each ends, in bytes of the chunk)."""
        symbols, normal = list(chunk), self.normal.get
        ids, ends, at = [], [], 0
        for symbol in self._short(symbols) if len(symbols) <= 40 else self._long(symbols):
            size, found = len(symbol.encode()), normal(symbol)
            if found:
                ids.append(found[1])
                ends.append(at + size)
            elif self.byte:
                # all but the last byte are empty spans before the character
                ids += [self.byte[b] for b in symbol.encode()]
                ends += [at] * (size - 1) + [at + size]
            else:
                ids.append(self.unknown)
                ends.append(at + size)
            at += size
        return ids, ends

    def _found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what each two pieces merge to, its place in the order of scores; _NEVER where they don't)."""
        keys = a.astype(np.int64) * len(self.pieces) + b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return self.merged_to[at], np.where(self.pairs[at] == keys, self.places[at], _NEVER)

    def _together(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, how many of each row) of chunks of one length, a row of characters' pieces each: a step merges the best pair of every row, the leftmost of equal ones."""
        n, width = symbols.shape
        out, left = symbols.copy(), np.full(n, width, np.int64)
        if width == 1 or not len(self.pairs):
            return out, left
        into, place = (x.reshape(n, width - 1) for x in self._found(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()))
        live, symbols, merges = np.arange(n), symbols, 0
        while len(live):
            best = place.argmin(axis=1)
            row = np.arange(len(live))
            goes_on = place[row, best] < _NEVER
            if not goes_on.all():
                done = ~goes_on
                out[live[done], : width - merges], left[live[done]] = symbols[done], width - merges
                live, best, symbols, into, place = live[goes_on], best[goes_on], symbols[goes_on], into[goes_on], place[goes_on]
                row = row[: len(live)]
            if not len(live):
                break
            new = into[row, best]
            merges += 1
            last = width - merges  # the pairs that there were
            # one symbol less: those after the pair move up
            behind = np.arange(last) > best[:, None]
            symbols = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            symbols[row, best] = new
            if last == 1:
                out[live, :1], left[live] = symbols, 1
                break
            behind = behind[:, :-1] | (np.arange(last - 1) == best[:, None])
            into, place = np.where(behind, into[:, 1:], into[:, :-1]), np.where(behind, place[:, 1:], place[:, :-1])
            for at in (best - 1, best):
                known = np.flatnonzero((at >= 0) & (at < last - 1))
                at = at[known]
                into[known, at], place[known, at] = self._found(symbols[known, at], symbols[known, at + 1])
        return out, left

    def _chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all chunks end to end, where each ends in the bytes of its chunk, ids and bytes of each chunk).

        Short chunks of characters that all are pieces are merged together, by length; the others one by one.
        """
        codes = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
        many = np.array([len(c) for c in new], np.int64)
        begins = np.cumsum(many) - many
        pieces = self.of_char[codes]
        able = (many <= 40) & (np.minimum.reduceat(pieces, begins) >= 0)
        sizes = np.add.reduceat(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64), begins)
        counts, found = np.zeros(len(new), np.int64), []
        for width in np.unique(many[able]).tolist():
            which = np.flatnonzero(able & (many == width))
            rows, left = self._together(pieces[begins[which][:, None] + np.arange(width)])
            counts[which] = left
            found.append((which, rows, left))
        alone = {i: self._chunk(new[i]) for i in np.flatnonzero(~able).tolist()}
        for i, (x, _) in alone.items():
            counts[i] = len(x)
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        for which, rows, left in found:
            place = np.arange(rows.shape[1])
            here = place < left[:, None]
            ids[(starts[which][:, None] + place)[here]] = rows[here]
        upto = np.cumsum(self.widths[ids])
        ends = upto - np.repeat(upto[starts] - self.widths[ids[starts]], counts)
        for i, (x, y) in alone.items():
            ids[starts[i] : starts[i] + len(x)], ends[starts[i] : starts[i] + len(x)] = x, y
        return ids, ends.astype(np.int32), counts, sizes

    def _learn(self) -> None:
        """Encodes the chunks that are numbered but not known yet."""
        new = list(self.numbers)[self.known :] if self.known < len(self.numbers) else []
        if not new:
            return
        ids, ends, counts, sizes = self._chunks(new)
        if self.used + len(ids) > len(self.ids):
            for name in ("ids", "ends"):
                old = getattr(self, name)
                setattr(self, name, np.append(old[: self.used], np.empty(self.used + 2 * len(ids), old.dtype)))
        self.ids[self.used : self.used + len(ids)], self.ends[self.used : self.used + len(ids)] = ids, ends
        self.starts = np.append(self.starts, self.used + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.sizes = np.append(self.sizes, sizes)
        self.used += len(ids)
        self.known = len(self.numbers)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, spans) of each text: unsigned 32-bit integers; a span is its first byte in the text and that after its last.

        Begin and end ids come first and last, with empty spans.
        """
        if len(self.numbers) > _KEPT_CHUNKS or self.used > _KEPT_PIECES:
            self._clear()
        number = self.numbers.__getitem__
        normal = [self.normalised(x) for x in texts]
        numbers = [np.array([number(c) for c in self.cut(x)], np.int64) for x, _ in normal]
        self._learn()
        return [self._whole(x, source, n, text) for (x, source), n, text in zip(normal, numbers, texts, strict=True)]

    def _whole(self, normal: str, source: np.ndarray | None, numbers: np.ndarray, text: str) -> tuple[bytes, bytes]:
        counts, sizes = self.counts[numbers], self.sizes[numbers]
        upto = np.cumsum(counts)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(self.starts[numbers] - (upto - counts), counts) + np.arange(total)
        ends = self.ends[at] + np.repeat(np.cumsum(sizes) - sizes, counts)  # in the normalised text
        spans = np.zeros((total + 2, 2), np.uint32)
        if source is None:
            # every space is a mark of more bytes, and the first mark may be in front of the text
            raw = np.frombuffer(text.encode(), np.uint8)
            extra = len(self.mark.encode()) - 1
            widths = np.where(raw == 32, 1 + extra, 1) if extra else np.ones(len(raw), np.int64)
            source_end = np.cumsum(widths) + (len(self.mark.encode()) if self.dummy else 0)
            ends = np.searchsorted(source_end, ends, side="right")
            size = len(raw)
        else:
            ends = source[ends]
            size = len(text.encode())
        spans[1 : total + 1, 1] = ends
        spans[2 : total + 1, 0] = ends[:-1]
        spans[total + 1] = size
        ids = np.empty(total + 2, np.uint32)
        ids[0], ids[1 : total + 1], ids[total + 1] = self.begin, self.ids[at], self.end
        if source is not None and total:
            spans[1, 0] = source[0]
        return ids.tobytes(), spans.tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8; bytes that aren't UTF-8 are replacement characters, the space mark in front goes."""
        seen = memoryview(ids).cast("I").tolist() if ids else []
        marks = 0  # in front
        for i in seen if self.dummy or self.collapse else ():
            if i not in self.silent:
                piece, _, kind = self.pieces[i]
                marks += kind == _NORMAL and piece.startswith(SPACE)
                if not self.collapse or piece != SPACE:
                    break
        out = b"".join(map(self.text.__getitem__, seen))
        try:
            out.decode()
            whole = self.silent.isdisjoint(seen[1:-1])
        except UnicodeDecodeError:
            whole = False
        if not whole:
            # bytes belong together only where nothing is between them
            runs = groupby(seen, lambda i: self.pieces[i][2] == _BYTE)
            out = b"".join(b"".join(map(self.text.__getitem__, run)).decode("utf-8", "pyrocast_bytewise").encode() for _, run in runs)
        return out[marks:]


_workers: dict[str, Pieces] = {}


def _pieces(kept) -> Pieces:
    """One for each model and worker; kept: broadcast of (digest, model)."""
    key, model = kept.value
    if key not in _workers:
        _workers.clear()
        _workers[key] = Pieces(model)
    return _workers[key]


def _sent(spark, model: bytes):
    """The model, broadcast; a vocabulary has a fixed size."""
    Pieces(model)  # an unknown kind of model fails here
    return spark.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _coded(docs: DataFrame, model: bytes, id_col: str, text_col: str, fields: str, row) -> DataFrame:
    """doc_id and what row(coder, ids, spans) gives for each text; fields: names and types after doc_id."""
    assert sys.byteorder == "little"
    kept = _sent(docs.sparkSession, model)
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches):
        coder = _pieces(kept)
        for batch in batches:
            for part in parts(batch, 1):
                found = coder.encode([x or "" for x in part.column(1).to_pylist()])
                cols = zip(*[row(coder, *x) for x in found], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + fields)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens long, ids binary (unsigned 32-bit, little-endian), spans binary (two such for each id), a row for each row of docs.

    Begin and end ids are among them. A span is the first byte of the original text that a piece stands for and
    the one after its last; a space mark in front of the text, the begin and end ids and all but the last of the
    byte pieces of a character have empty ones. Null and empty texts have the begin and end ids alone.
    Repeated rows stay repeated; other columns are not read.
    """
    return _coded(docs, model, id_col, text_col, "n_tokens long, ids binary, spans binary", lambda coder, ids, spans: (len(ids) // 4, ids, spans))


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded with the column decoded string: the text of the ids."""
    kept = _sent(encoded.sparkSession, model)

    def run(batches):
        coder = _pieces(kept)
        for batch in batches:
            for part in parts(batch, batch.schema.get_field_index("ids")):
                ids = part.column("ids").to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([coder.decode(x or b"").decode() for x in ids], pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in encoded.drop("decoded").dtypes) + ", decoded string")


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256: encode, then decode, in one pass over the texts."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _coded(docs, model, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", lambda coder, ids, spans: (len(ids) // 4, sha(ids), sha(coder.decode(ids)), sha(spans)))


def query(spark, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_model(public_tokenizers.path(model)))
