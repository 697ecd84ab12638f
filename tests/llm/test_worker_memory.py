"""What a Python worker of byte-level BPE holds: in a replay, between tasks."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_llm import RANKS, reference_encoding

from pyrocast.llm import bpe, common


def odd_words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 9))) for _ in range(n)]


def test_replay_takes_few_bytes_a_character():
    coder = bpe.MergeReplay(RANKS, public_tokenizers.PATTERN)
    pieces = [w.encode() for w in odd_words(60_000, 1)]
    coder.replay(pieces)  # merges are known from here on
    tracemalloc.start()
    ids, counts = coder.replay(pieces)
    peak = tracemalloc.get_traced_memory()[1] / sum(map(len, pieces))
    tracemalloc.stop()
    reference, ends = reference_encoding(), np.cumsum(counts)
    for i in range(0, len(pieces), 997):
        assert ids[ends[i] - counts[i] : ends[i]].tolist() == reference.encode_ordinary(pieces[i].decode())
    assert peak < 50


def test_idle_worker_keeps_little():
    coder, reference = bpe.MergeReplay(RANKS, public_tokenizers.PATTERN), reference_encoding()
    for seed in (1, 2):
        words = odd_words(70_000, seed)
        texts = [" ".join(words[a : a + 500]) for a in range(0, len(words), 500)]
        done = [x for _, each in coder.batches([(None, texts[:70]), (None, texts[70:] + texts[:5])]) for x in each]
        assert [np.frombuffer(x, np.uint32).tolist() for x in done] == reference.encode_ordinary_batch(texts + texts[:5])
        assert len(coder.table.numbers) <= 40_000 and len(coder.merges) <= 60_000
    # what is kept is still right
    assert [np.frombuffer(x, np.uint32).tolist() for x in coder.encode(texts[:9])] == reference.encode_ordinary_batch(texts[:9])


def test_giving_back(monkeypatch):
    """Batches pass as they are; memory goes back when a task ends, is left early or fails."""
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1))
    batch = pa.RecordBatch.from_pydict({"a": [1]})
    assert list(common.giving_back(lambda batches: iter(batches))([batch, batch])) == [batch, batch] and len(told) == 1
    early = common.giving_back(lambda batches: iter(batches))([batch, batch])
    next(early)
    early.close()
    assert len(told) == 2

    def fails(batches):
        yield batch
        raise ValueError

    with pytest.raises(ValueError):
        list(common.giving_back(fails)([batch]))
    assert len(told) == 3


def test_give_back():
    pool = pa.default_memory_pool()
    held = pool.bytes_allocated()
    common.give_back()
    assert pool.bytes_allocated() == held
