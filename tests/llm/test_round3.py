"""Importance resampling, sentence pieces and the prefix trie against brute-force versions and the library."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pyrocast.llm import importance, prefix_trie, sentence_pieces
from pyrocast.llm.common import running

MODEL = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
DOCS = "doc_id long, text string, part int, block string, rank string, ids string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randint(0, 5)) for i in range(500)]
    got = running(spark.createDataFrame(rows, "g long, i long, v long").repartition(7), ["g"], [F.col("i").desc()], F.col("v"), "s").collect()
    sums = collections.Counter()
    want = {}
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        sums[g] += v
        want[i] = sums[g]
    assert {r.i: r.s for r in got} == want


# --- 11: importance resampling


def some_texts():
    rng = random.Random(5)
    words = ["the", "Wind", "fire", "é", "日本", "x1", "a"] + ["w%d" % i for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(80)]
    return [None, "", " .,-", "one two", *texts, *texts[:6], "the " * 3000 + "end", "A-b\x00c\td"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def importance_of(docs, target, most, buckets, seed, percent, least):
    """(doc_id, n_features, weight, score, rank) of each of docs."""

    def bag(text):
        w = words_of(text)
        runs = [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
        return collections.Counter(zlib.crc32(r.encode()) % buckets for r in runs), len(w)

    bags = [(i, *bag(t)) for i, t in docs]
    s, t = collections.Counter(), collections.Counter()
    for _, b, _ in bags:
        s += b
    for x in target:
        t += bag(x)[0]
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, b, n in bags:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(k) * c for k, c in b.items())
        out.append([i, sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("most,blocks", [(1, 4096), (3, 7)])
def test_importance(spark, monkeypatch, most, blocks):
    monkeypatch.setattr(importance, "_BLOCK_DOCS", blocks)
    monkeypatch.setattr(importance, "_TASK_BLOCKS", 2)
    docs = list(enumerate(some_texts())) + [(None, "no id " * 30)]
    target = ["the wind and the fire", None, "", "fire fire w3 w5"]
    df = spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in docs], DOCS).repartition(3)
    got = importance.ranked(df, spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=500, percent=30)
    assert rows_of(got.drop("digest")) == importance_of(docs, target, most, 500, 2024, 30, 20)


def test_importance_long_texts(spark, monkeypatch):
    """A text cut into many pieces has the runs that go across them."""
    monkeypatch.setattr(importance, "_PIECE", 50)
    docs = list(enumerate(some_texts()))
    assert [len(p) for p in importance.pieces("ab " * 60)] != [60]
    number = importance._Buckets(1000)
    for _, text in docs[:30]:
        found = np.concatenate([x for x, _ in importance.features(text, 3, number)])
        w = [x.encode() for x in words_of(text)]
        want = [zlib.crc32(b" ".join(w[i : i + n])) % 1000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        assert sorted(found.tolist()) == sorted(want)


def test_importance_repeated_and_empty(spark):
    text = "fire and wind " * 20
    docs = [(7, text)] * 30 + [(7, "other words " * 15)] * 3 + [(8, text)]
    df = spark.createDataFrame([(*d, 1, "b", "r", "i") for d in docs], DOCS).repartition(4)
    target = spark.createDataFrame([("fire",)], "text string")
    got = importance.ranked(df, target, percent=100)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 35))
    assert rows_of(got.drop("digest", "rank")) == sorted(((i, n, w, s) for i, n, w, s, _ in importance_of(docs, ["fire"], 1, 10_000, 2024, 100, 20)), key=repr)
    none = df.limit(0)
    assert importance.ranked(none, target).count() == 0
    assert importance.resample(none, target).columns == df.columns
    drawn = importance.resample(df, target.limit(0), percent=10)
    assert drawn.columns == df.columns and {r.part for r in drawn.collect()} == {1}
    # all but the drawn ones' equals are gone
    best = importance_of(docs, [], 1, 10_000, 2024, 10, 20)
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in best if r[4]}


# --- 12: sentence pieces


def awkward_texts(n=1500):
    rng = random.Random(9)
    pool = list(" \n\t▁aábct e1,.<>😀日本\x00\x7f　éЖ") + ["the", "ing", " of", "  "]
    mixed = ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(n)]
    return ["", " ", "  ", "   x", "a\tb\r\n\n  c", "▁", "a▁ b", "<s> </s> <0x0A>", "日本語 テスト　x", "a" * 3000, " " * 50 + "a" + " " * 33, *mixed]


def compared(model, texts):
    mine, library = sentence_pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text, (ids, spans) in zip(texts, mine.encode(texts), strict=True):
        told = np.frombuffer(ids, np.uint32).tolist()
        assert told == library.encode(text, add_bos=True, add_eos=True), text
        assert mine.decode(ids).decode() == library.decode(told), text
        want = [[p.begin, p.end] for p in library.encode(text, return_type="proto").pieces]
        got = np.frombuffer(spans, np.uint32).reshape(-1, 2).tolist()
        assert got[1:-1] == want, text
        assert got[0] == [0, 0] and got[-1] == [len(text.encode())] * 2


def test_pieces_as_the_library():
    compared(MODEL, awkward_texts())


def test_pieces_tables_start_anew(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "_KEPT_CHUNKS", 20)
    mine, library = sentence_pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for text in awkward_texts(100):
        assert np.frombuffer(mine.encode([text])[0][0], np.uint32).tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_pieces_long_and_short_merges_agree():
    mine = sentence_pieces.Pieces(MODEL)
    for text in awkward_texts(300):
        assert mine._short(list(text)) == mine._long(list(text))


def test_pieces_decode_any_ids():
    mine, library = sentence_pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rng = random.Random(4)
    for _ in range(2000):
        ids = rng.choices([*range(0, 262), *rng.choices(range(32_000), k=60)], k=12)
        assert mine.decode(np.array(ids, np.uint32).tobytes()).decode() == library.decode(ids), ids


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def compiled(rules):
    """A compiled character map of these rules: a double array, built by trying bases one after the other."""
    strings, where = b"", {}
    for key, out in rules.items():
        where[key.encode()] = len(strings)
        strings += out.encode() + b"\0"
    units = {0: 0}
    taken = {0}

    def place(at, prefix):
        """The children of the node at `at`."""
        nexts = sorted({k[len(prefix)] for k in where if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in where
        for base in range(256, 1 << 16, 256):
            spots = [base ^ c for c in nexts] + ([base] if leaf else [])
            if not taken & set(spots):
                break
        taken.update(spots)
        offset = base ^ at
        own = units.get(at, 0)
        units[at] = own | offset << 10 | (256 if leaf else 0)
        if leaf:
            units[base] = where[prefix] | 1 << 31
        for c in nexts:
            units[base ^ c] = c
        for c in nexts:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    size = -(-(max(taken) + 1) // 256) * 256
    return struct.pack("<I", size * 4) + struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)]) + strings


def with_rules(rules, collapse, dummy=True):
    """The model with another normaliser."""
    out = b""
    for number, value in sentence_pieces._fields(MODEL):
        if number == 3:
            value = field(1, b"own") + field(2, compiled(rules)) + field(3, int(dummy)) + field(4, int(collapse)) + field(5, 1)
        out += field(number, value)
    return out


RULES = {"ﬁ": "fi", "Å": "Å", "Å": "Å", "　": " ", "\t": " ", "\n": " ", "㍿": "株式会社", "​": "", "é": "e", "éa": "EA", "…": "...", " ": " "}


@pytest.mark.parametrize("collapse,dummy", [(False, True), (True, True), (True, False), (False, False)])
def test_pieces_character_map(collapse, dummy):
    model = with_rules(RULES, collapse, dummy)
    rng = random.Random(7)
    pool = [*RULES, " ", "  ", "a", "the", "é", "x", "日", "▁", "."]
    compared(model, ["", " ", "　", "​", " ​ ", "éa éb", *["".join(rng.choices(pool, k=rng.randint(1, 25))) for _ in range(600)]])


def test_pieces_of_documents(spark):
    texts = [None, *awkward_texts(60), "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, 1, "b", "r", "i") for i, t in enumerate(texts)], DOCS).repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    found = sentence_pieces.encode(df, MODEL).collect()
    want = sorted((library.encode(t or "", add_bos=True, add_eos=True) for t in texts), key=repr)
    assert sorted((np.frombuffer(r.ids, np.uint32).tolist() for r in found), key=repr) == want
    told = {r.doc_id: r for r in sentence_pieces.decode(sentence_pieces.encode(df, MODEL), MODEL).collect()}
    trip = {r.doc_id: r for r in sentence_pieces.round_trip(df, MODEL).collect()}
    for i, t in enumerate(texts):
        if i:
            ids = library.encode(t or "", add_bos=True, add_eos=True)
            assert told[i].decoded == library.decode(ids) and trip[i].n_tokens == len(ids)
            assert trip[i].ids_sha256 == hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest()
            assert trip[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentence_pieces.round_trip(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        sentence_pieces.encode(df, MODEL + field(2, field(3, 1)))


# --- 13: prefix trie


def trie_of(turns, groups=5, most=9):
    """Rows of the trie of conversations; turns: (conv, turn, role, text)."""
    convs = collections.defaultdict(list)
    told = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", told(role or "", text or ""), text or ""))
    order = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c in order:
        h = zlib.crc32(str(c).encode()) % most
        root = c - (abs(c) % groups) * (1 if c >= 0 else -1)
        built[c] = tuple(order.get(root, [])[:h] + order[c][h:])
    nodes = collections.defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes[x[:d]].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items()
    )


def test_trie(spark):
    rng = random.Random(11)
    said = ["yes", "no", "", None, "é日本", "a longer text " * 9]
    turns = [(c, t, rng.choice(["user", "assistant"]), rng.choice(said)) for c in range(-12, 60) for t in range(rng.randint(1, 5))]
    turns += [(100, t, "user", "x") for t in range(300)] + [(c, t, "user", "x") for c in (101, 103, 104, 205) for t in range(rng.choice([260, 300]))]
    turns += [(70, None, None, "first"), (70, None, "user", "b"), (70, 1, "user", "b"), (70, 1, "user", "b"), (70, 1, "a", None), (None, 0, "user", "lost")]
    turns += [(c, t, "user", "hot") for c in range(1000, 1080) for t in range(3)]
    df = spark.createDataFrame([(*t, 1, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, depth int, conv string, name string").repartition(5)
    assert sorted(map(tuple, prefix_trie.conversation_trie(df).collect())) == trie_of(turns)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(df).count() == 0
    one = spark.createDataFrame([(4, 0, "user", "hi")], df.schema)
    assert [tuple(r) for r in prefix_trie.conversation_trie(one).orderBy("depth").collect()] == trie_of([(4, 0, "user", "hi")])


def test_trie_digests_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK", 100)
    turns = [(c, 0, "user", "hot") for c in range(0, 400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    assert sorted(map(tuple, prefix_trie.conversation_trie(df).collect())) == trie_of(turns)


# --- 3, 6, 7, 8, 10: further cases


def test_group_pairs_lose_no_link():
    """Sets that link always pass the filter of groups; most that don't, with 60 % in common, fail it."""
    from pyrocast.llm import jaccard_join as jj

    rng = np.random.default_rng(6)
    passed = 0
    for n in (1, 2, 3, 5, 9, 10, 33, 60, 156, 301):
        for _ in range(60):
            base = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            other = base.copy()
            changed = rng.integers(0, n // 5 + 2)
            other[rng.permutation(n)[:changed]] = rng.integers(0, 1 << 63, min(changed, n), dtype=np.uint64)
            sets = [base, np.unique(np.append(other, rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1), dtype=np.uint64)))]
            sizes = np.array([len(s) for s in sets])
            o = len(np.intersect1d(*sets))
            may = jj.group_pairs([s[: jj.prefix(len(s), 80)] for s in sets], sizes, 80)[0, 1]
            linked = 100 * o >= 80 * (sizes.sum() - o)
            assert may or not linked
            assert jj.spanning_links(sets, 80) == ([(0, 1)] if linked and may else [])
    for _ in range(50):
        shared = rng.integers(0, 1 << 63, 94, dtype=np.uint64)
        sets = [np.sort(np.append(shared, rng.integers(0, 1 << 63, 62, dtype=np.uint64))) for _ in range(2)]
        passed += jj.group_pairs([s[: jj.prefix(156, 80)] for s in sets], np.array([156, 156]), 80)[0, 1]
    assert passed < 5


def test_shards_by_definition(spark, tmp_path, monkeypatch):
    """Which row goes where, replayed in Python on the same hashes; columns with the names of the operator's own; many equal rows."""
    from pyrocast.llm import sharding

    monkeypatch.setattr(sharding, "_RUN", 4)
    data = [(i, f"text {i}", i * 7, "c", i % 3, i) for i in range(60)] + [(5, "same", 1, "c", 1, 1)] * 11 + [(None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, __h long, __copy string, __bucket int, __i int").repartition(4)
    shards, seed, bucket_rows = 5, 23, 9
    sharding.write_shards(df, str(tmp_path / "x"), shards, seed, bucket_rows)
    got = {}
    for r in sharding.read_shards(df, str(tmp_path / "x")).collect():
        got[r.shard, r.slot] = tuple(r)[:6]
    assert sorted(map(repr, got.values())) == sorted(map(repr, data))
    copies = collections.Counter()
    told = []
    hashed = df.select(*df.columns, F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in df.columns]).alias("hash")).collect()
    for r in hashed:
        copies[r.hash] += 1
        told.append((r.hash, copies[r.hash], tuple(r)[:6]))
    keyed = spark.createDataFrame([(h, c) for h, c, _ in told], "h long, c long").distinct()
    keyed = {(r.h, r.c): (r.b, r.o) for r in keyed.select("h", "c", F.xxhash64(F.lit(seed), "h", "c").alias("b"), F.xxhash64(F.lit(seed + 1), "h", "c").alias("o")).collect()}
    buckets = -(-len(data) // bucket_rows)
    held = collections.defaultdict(list)
    for h, c, row in told:
        b, o = keyed[h, c]
        held[b % buckets].append((o, c, row))
    draws = {(r.b, r.i): r.d for r in spark.range(buckets).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(80))).alias("i")).select("b", "i", F.xxhash64(F.lit(seed + 2), "b", "i").alias("d")).collect()}
    want, start = {}, 0
    for b in sorted(held):
        rows = [row for _, _, row in sorted(held[b], key=lambda x: x[:2])]
        places: list[int] = []
        for i in range(len(rows)):
            k = draws[b, i] % (i + 1)
            places.append(i)
            places[k], places[i] = i, places[k]
        for i, row in enumerate(rows):
            place = start + places[i]
            want[place % shards, place // shards] = row
        start += len(rows)
    assert got == want


def test_quality_by_definition(spark, sf_dir):
    """Features, regression, calibration and verdicts computed anew with plain loops and a dense matrix."""
    import xxhash

    from pyrocast.llm import quality

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    lower = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    dims, mask = 1 << quality._BITS, (1 << 64) - 1
    m0, m1, gram = int(quality._MIX[0]), int(quality._MIX[1]), int(quality._GRAM)

    def features(text):
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
        chars = [ord(c) for c in lower(text)]
        found = [[x % dims for x in h], [((a * m0 + b) & mask) * m1 % (mask + 1) >> (64 - quality._BITS) for a, b in zip(h, h[1:])], []]
        for i in range(len(chars) - 3):
            code = chars[i]
            for c in chars[i + 1 : i + 4]:
                code = (code * gram + c) % (1 << 32)
            found[2].append(code * gram % (1 << 32) >> (32 - quality._BITS))
        out = np.zeros(3 * dims)
        for k, family in enumerate(found):
            for d in family:
                out[k * dims + d] += 1 / len(family)
        return out

    quality_of = collections.defaultdict(set)
    for r in labels.collect():
        if r.quality in (0, 1) and r.doc_id in texts:
            quality_of[r.doc_id].add(r.quality)
    ids = sorted(i for i, q in quality_of.items() if len(q) == 1)
    assert len(ids) < 1500
    y, x = np.array([min(quality_of[i]) for i in ids], float), np.array([features(texts[i]) for i in ids]).astype(np.float32).astype(float) * 30
    held = np.array([xxhash.xxh32_intdigest(str(i)) % 4 == 0 for i in ids])
    weight = np.where(y == 1, 0.5 / y[~held].mean(), 0.5 / (1 - y[~held].mean()))
    w, m, v = np.zeros(3 * dims + 1), 0, 0
    inputs = np.hstack([x, np.ones((len(x), 1))])[~held]
    for step in range(1, 151):
        error = (1 / (1 + np.exp(-inputs @ w)) - y[~held]) * weight[~held] / (~held).sum()
        grad = inputs.T @ error + 1e-5 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z = np.hstack([x, np.ones((len(x), 1))])[held] @ w
    t = np.where(y[held] == 1, (y[held].sum() + 1) / (y[held].sum() + 2), 1 / (len(z) - y[held].sum() + 2))
    loss = lambda a, b: -(t * np.log(1 / (1 + np.exp(-a * z - b))) + (1 - t) * np.log(1 - 1 / (1 + np.exp(-a * z - b)))).sum()
    agree = 0
    got = {r.doc_id: r for r in quality.query(spark, sf_dir).collect()}
    model = quality.train(docs, labels)
    # the calibration is a minimum of the loss, but for a little shrinkage
    a, b = model.scale, model.shift - model.scale * model.bias if hasattr(model, "bias") else None
    if b is not None:
        assert all(loss(a, b) <= loss(a + da, b + db) + 0.05 for da in (-0.3, 0.3) for db in (-0.3, 0.3))
    for i, text in texts.items():
        share = features(text) @ w[:-1] * 30
        p = 1 / (1 + np.exp(-np.clip(model.scale * share + model.shift, -30, 30)))
        assert got[i].probability == pytest.approx(p, abs=0.02), i
        if abs(p - 0.5) > 0.02:
            assert got[i].kept == (not got[i].base_failed and p >= 0.5)
            agree += 1
    assert agree > 0.9 * len(texts)


def test_warc_repeated_smallest_id_and_strays(spark, monkeypatch):
    """Rows that repeat the smallest id are responses, each with its payload; rows that only a filter takes for copies keep theirs."""
    from pyrocast.llm import warc
    from pyrocast.llm.common import shared_folder

    # filters that let everything through
    monkeypatch.setattr(warc, "has", lambda kept, at: np.ones(len(at), bool))
    long = "<p>" + "same words, " * 30
    pages = [(1, "u", long), (1, "u", long), (2, "u", long), (None, "u", long), (None, "w", long + "!"), (3, "v", long + "?"), (4, "v", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.read(warc.write(df, f"{shared_folder(spark)}/warc")).collect()
    told = lambda i, url, kind, to, payload: (i, url, kind, to, payload)
    want = [told(1, "u", "response", None, long)] * 2 + [told(2, "u", "revisit", 1, None), told(None, "u", "revisit", 1, None), told(None, "w", "response", None, long + "!"), told(3, "v", "response", None, long + "?"), told(4, "v", "response", None, "")]
    assert sorted((told(r.page_id, r.url, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in got), key=repr) == sorted(want, key=repr)


def test_token_files_with_repeated_ids(spark):
    """Repeated ids stay rows of their own, side by side; rows without an id come first."""
    from tokenizers import Tokenizer

    from pyrocast.llm import token_files
    from pyrocast.llm.common import shared_folder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        told = f.read()
    coder = Tokenizer.from_str(told)
    rows = [(2, "two words"), (1, "one"), (1, "one again, and more"), (None, "none"), (2, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(token_files.read(token_files.write(df, f"{shared_folder(spark)}/ids", told), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 2]
    want = sorted((("" if i is None else str(i)), [*coder.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted((("" if r.doc_id is None else str(r.doc_id)), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_filters_take_few_jobs_whatever_the_partitions(spark):
    """A filter of few blocks goes to the driver in some jobs, not in one for each partition of a shuffle."""
    from pyspark.sql import functions as F

    from pyrocast.llm.common import any_filter, has

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    keys, bits = spark.range(3000).select(F.xxhash64("id").alias("h")).cache(), 1 << 18
    want = np.array([r.h for r in keys.collect()]) & (bits - 1)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("filter", "filter")
        found = any_filter(keys, bits)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("filter")
    finally:
        spark.sparkContext.setJobGroup("", "")
        keys.unpersist()
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert has(found, want).all() and np.unpackbits(found).sum() == len(np.unique(want))
    assert 0 < len(jobs) <= 8


def test_components_of_few_links_lie_in_few_files(spark):
    """Rounds are written in files by the number of links, not by the partitions of a shuffle."""
    from pyrocast.llm.components import connected_components

    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    links = [(i, i + 1) for i in range(300) if i % 7] + [(500, 500), (3, 299)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = connected_components(spark.createDataFrame(links, "a long, b long"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {x: (x - 1) // 7 * 7 + 1 for x in range(1, 301)}
    want = {x: c if c != 295 else 1 for x, c in want.items()}  # 3 and 299
    assert {r.v: r.component for r in found.collect()} == want
    assert len(found.inputFiles()) <= 2


def test_chunks_merged_together_are_as_one_by_one():
    """Many chunks merged by steps over all of them give the ids and ends of each alone: ties, long ones, bytes and lone characters too."""
    coder, r = sentence_pieces.Pieces(sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))), random.Random(5)
    chunks = ["a", "▁", "▁▁▁", "aaaaaaa", "▁the", "▁" + "ab" * 40, "\U0001f600x", "é", "▁naïve", "\x01", "中文字", "a\x00b"]
    chunks += ["▁" * r.randint(0, 2) + "".join(r.choice("etaoinshrdluéß中\x02") for _ in range(r.randint(1, 45))) for _ in range(400)]
    ids, ends, counts, sizes = coder._chunks(chunks)
    each = [coder._chunk(c) for c in chunks]
    assert ids.tolist() == [i for x, _ in each for i in x] and ends.tolist() == [i for _, x in each for i in x]
    assert counts.tolist() == [len(x) for x, _ in each] and sizes.tolist() == [len(c.encode()) for c in chunks]


def test_full_chunk_table_keeps_what_recurs():
    """A full table forgets the chunks met once; the others aren't encoded again, and ids stay right."""
    from pyrocast.llm.common import ChunkTable

    asked = []

    def learn(new):
        asked.extend(new)
        return np.array([ord(x) for c in new for x in c], np.uint32), np.array([len(c) for c in new], np.int64)

    table = ChunkTable(learn, 40)
    for i in range(12):
        texts = ["often and  again " + " ".join(f"w{i}x{k}" for k in range(15)), "often and\nagain", "", f"w{i}x0 often", "again "]
        ids, counts = table.encode(texts)
        assert "".join(map(chr, ids)) == "".join(texts) and counts.tolist() == [len(x) for x in texts]
        assert len(table.numbers) < 80
    assert asked.count(" often") == 1 and asked.count(" w0x3") == 1 and len(asked) > 12 * 15
