"""Segments of token files against the tokenizers library, what its model is asked for, and how ids are read back."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyrocast.llm import token_files
from pyrocast.llm.common import shared_folder

ODD = """a b the Don é ß ñ ÿ À × ÷ ª µ º ā я ж λ א ع 日本 ひ カ 한 😀 é ́ 0 12 ٣ ² ½ Ⅷ . , .. !? % # ' 's 't 're 'll 'S ' ’ - _ = « » ¿ “ … | <|endoftext|>""".split()
ODD += [" "] * 12 + ["\n"] * 6 + ["  ", "\n\n", "\r\n", "\t", "\x0b", "\x0c", "\r", "\0", "\x01", "\x1c", "\x1f", "\x7f", "\x80", "\x85", "\xa0", "\xad", "́"]
ODD += [chr(i) for i in (0x7FF, 0x800, 0xFFF, 0x1000, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x2FFF, 0x3000, 0x3001, 0xFEFF, 0xFFFF, 0x10000, 0x10FFFF)]
# versions of Unicode differ about these
ODD += [chr(i) for i in (0x558, 0x58B, 0x88F, 0xC5C, 0x208F, 0x209D, 0xA7D2, 0x10940, 0x10EC5)]


def tokenizer(**changes):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        told = json.load(f)
    return json.dumps(told | {"model": told["model"] | changes})


@pytest.mark.parametrize("changes", [{}, {"ignore_merges": True}])
def test_segments_of_odd_texts(changes):
    """Cuts stand where no match of the pattern does, next to any character; tables that are full change no ids."""
    from tokenizers import Tokenizer

    rng, told = random.Random(7), tokenizer(**changes)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(12_000)] + ["", None, " ", "\n", "a ", "a\n ", " \n ", "\n a", "a\n\n", "x" * 3000]
    texts += [t for c in map(chr, range(0x20, 0x500)) for t in (f"ab{c}, {c} x\n{c}b", f" {c}{c}.{c}1{c}'s", f"{c}\n {c}  {c}\n\n{c}{c}#")]
    rng.shuffle(texts)
    coder, whole = token_files.Encoder(told, public_tokenizers.PATTERN), Tokenizer.from_str(told)
    assert (coder.mark is None) == bool(changes)
    coder.table.most = 500
    want = [e.ids for e in whole.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    kinds = [pa.array(texts, pa.string()), pa.array(texts, pa.large_string())]
    for a in range(0, len(texts), 1500):
        ids, counts = coder.encode(kinds[a // 1500 % 2].slice(a, 1500))
        for t, got, ask in zip(texts[a : a + 1500], np.split(ids, np.cumsum(counts)[:-1]), want[a : a + 1500], strict=True):
            assert got.tolist() == ask, t
    ids, counts = coder.encode(["", None])
    assert (len(ids), counts.tolist()) == (0, [0, 0])


def test_model_is_asked_once_for_each_word():
    """Words that differ only in what stands behind them, or recur in another batch, are asked of the model once."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=12)) for _ in range(400)]
    coder, asked = token_files.Encoder(tokenizer(), public_tokenizers.PATTERN), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def encode_batch_fast(self, texts, **kw):
            asked.extend(map(len, texts))
            return self.model.encode_batch_fast(texts, **kw)

    coder.model = Counted(coder.model)
    for end in (",", ".", "!", "%%%", ".\n", ""):
        coder.encode([f" {w}{end} and" for w in words])
    assert sum(asked) < 2 * sum(len(w) + 2 for w in words)


def test_rules_of_many_ids():
    """Nested rules, short and long ones, a chain, and a span of each."""
    symbols, n = 300, 500
    chain = np.array([[7, 9], *[[symbols + i, i % symbols] for i in range(n)]])
    twice = np.array([[symbols + i, symbols + i] for i in range(n, n + 5)])
    rules = np.concatenate([chain, twice])
    lengths = []
    plain = []
    for a, b in rules.tolist():
        parts = [plain[x - symbols] if x >= symbols else [x] for x in (a, b)]
        plain.append(parts[0] + parts[1])
        lengths.append(len(plain[-1]))
    seq = np.random.default_rng(3).integers(0, symbols + len(rules), 400)
    want = [i for x in seq.tolist() for i in (plain[x - symbols] if x >= symbols else [x])]
    assert token_files.expand(seq, rules, np.array(lengths), symbols).tolist() == want
    assert max(lengths) > 64 > min(lengths)


def test_readers_take_several_files(spark):
    """Where there are many files, a task reads some of them, and every document comes once."""
    df = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(600)], "doc_id long, text string").repartition(4)
    manifest = token_files.write(df, f"{shared_folder(spark)}/ids", tokenizer(), public_tokenizers.PATTERN, file_ids=200)
    files, got = manifest.count(), token_files.read(manifest)
    assert files > 4 * spark.sparkContext.defaultParallelism
    assert got.rdd.getNumPartitions() <= files // 2
    assert sorted(r.doc_id for r in got.collect()) == list(range(600))
