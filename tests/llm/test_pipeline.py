"""The corpus pipeline, each stage against a brute-force version on its own input."""

import hashlib

import corpus_pipeline
import numpy as np
from test_llm import brute_components, brute_counts, deduped, reference_encoding, words

from pyrocast.llm.common import saved


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        held.append((before.toPandas(), docs.toPandas()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    (a, b), (c, d), (e, f), (g, h), (i, j) = held
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    base = {r.doc_id: brute_counts(r.text) for r in a.itertuples()}
    fails = {k for k, v in base.items() if v[0] < 50 or 100 * v[4] > 50 * v[0]}
    assert not fails & set(b.doc_id) and set(b.doc_id) <= set(a.doc_id)
    good, bad = (set(labels[labels.quality == q].doc_id) - fails for q in (1, 0))
    assert len(good & set(b.doc_id)) >= 0.99 * len(good) and len(bad & set(b.doc_id)) <= 0.1 * len(bad)
    want = deduped(dict(zip(c.doc_id, c.text, strict=True)))
    assert {r.doc_id: r.text for r in d.itertuples()} == {k: v[0] for k, v in want.items()}
    assert d.n_chars.tolist() == [len(t) for t in d.text]
    groups = brute_components(dict(zip(e.doc_id, e.text, strict=True)))
    assert sorted(f.doc_id) == sorted(k for k, (_, x) in groups.items() if x == k)
    assert set(h.doc_id) <= set(g.doc_id) and h.groupby("doc_id").size().max() <= 2
    total = g.text.map(lambda t: len(words(t))).sum()
    assert abs(h.text.map(lambda t: len(words(t))).sum() - 1.5 * total) < 0.05 * total
    coder = reference_encoding()
    digests = lambda t: hashlib.sha256(np.array(coder.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    assert sorted(zip(j.doc_id, j.ids_sha256, strict=True)) == sorted((r.doc_id, digests(r.text)) for r in i.itertuples())


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_take_awkward_tables(spark, sf_dir):
    """Nulls in any column, empty and repeated texts, clashing columns, and no rows at all."""
    long = " ".join(f"word{i} and some more of it" for i in range(30))
    fields = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_dropped long, size string, key double, __id string"
    rows = [(i, t, None, None if i % 3 else "s", None, "x", 5, "y", None, "z") for i, t in enumerate([None, "", " \n ", long, long, long + " end", long.upper(), "one two"])]
    for held in (rows, [(None, *r[1:]) for r in rows], []):
        docs = spark.createDataFrame(held, fields)
        for name, stage in corpus_pipeline.STAGES:
            done = saved(stage(spark, docs, sf_dir), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert done.columns == docs.columns and done.count() <= 2 * max(1, len(held))
                assert {(r.n_lines, r.n_dropped, r.size) for r in done.collect()} <= {("x", 5, "y")}
                if name == "quality_rules":
                    continue  # it rejects these short texts, so that the next stages take the rows themselves
