"""Quality rules: counts of each text, and a classifier on hashed word and character n-grams.

A logistic regression is fitted on a bounded sample of labelled documents (sample_rows, chosen by
the hash of the id), its probabilities are calibrated on the part held out, and all documents are
scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
_BITS = 14
_DIMS = 1 << _BITS  # of words; as many again of pairs of words, and of 4-grams of characters
_FAMILIES = 3
_GRAM = np.uint32(0x9E3779B1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Model:
    """weights: of words, of pairs of words, then of 4-grams of characters, each family by its share of the text."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def share(self, families: list[np.ndarray]) -> float:
        """The weighted shares of a text: the mean weight of each family's dimensions, added up."""
        return sum(float(self.weights[dims].mean()) for dims in families if len(dims))

    def probability(self, share: np.ndarray) -> np.ndarray:
        """Calibrated probability of good quality for weighted shares (the uncalibrated log odds)."""
        return 1 / (1 + np.exp(-np.clip(self.scale * share + self.shift, -30, 30)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def dimensions(hashes: np.ndarray, text: str) -> list[np.ndarray]:
    """Dimensions of the words, of pairs of neighbouring words, and of the 4-grams of characters (A-Z lowered), repeats included."""
    top = np.uint64(64 - _BITS)
    pairs = (hashes[:-1] * _MIX[0] + hashes[1:]) * _MIX[1] >> top
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where((chars >= 65) & (chars <= 90), chars + np.uint32(32), chars)
    code = chars[:-3] if len(chars) > 3 else chars[:0]
    for i in range(1, 4 if len(code) else 1):
        code = code * _GRAM + chars[i : len(chars) - 3 + i]
    grams = code * _GRAM >> np.uint32(32 - _BITS)
    return [x.astype(np.int64) + i * _DIMS for i, x in enumerate((hashes & np.uint64(_DIMS - 1), pairs, grams))]


def repeat_words(hashes: np.ndarray) -> int:
    """Words in windows of three that stand twice or more, the first included."""
    if len(hashes) < 4:
        return 0
    window = (hashes[:-2] * _MIX[0] + hashes[1:-1]) * _MIX[1] + hashes[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    hit = np.zeros(len(window), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def counts(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hashes of the words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []
    hashes = word_hashes(words)
    base = (len(words), len(text) - sum(text.count(c) for c in _SPACES), sum(text.count(c) for c in _SYMBOLS), len(lines) - len(set(lines)), repeat_words(hashes))
    return base, hashes


def _shares(families: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions that a text has, and the share of its family that each of them takes."""
    found = [np.unique(dims, return_counts=True) for dims in families]
    return np.concatenate([d for d, _ in found]), np.concatenate([n / max(1, n.sum()) for _, n in found])


def judge(texts: list[str | None], model: Model | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The base counts (a row a text), base_failed, probability and kept of each text."""
    base, shares = [], []
    for text in texts:
        counted, hashes = counts(text)
        base.append(counted)
        shares.append(model.share(dimensions(hashes, text or "")) if model is not None else 0.0)
    base = np.array(base, np.int64).reshape(-1, 5)
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    p = model.probability(np.array(shares, float)) if model is not None else np.ones(len(base))
    return base, failed, p, ~failed & (p >= threshold)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], held_out: np.ndarray, steps: int = 150) -> Model | None:
    """Logistic regression by Adam on all rows that aren't held out; Platt's calibration on those that are.

    None where either part lacks one of the two labels.
    """
    y = np.array([r[2] for r in rows], float)
    if any(len(set(y[part])) < 2 for part in (held_out, ~held_out)):
        return None
    # the driver holds these, so they are no wider than they need be
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    dims, values = np.concatenate([r[0] for r in rows]).astype(np.int32), np.concatenate([r[1] for r in rows]).astype(np.float32) * np.float32(30)
    fitted = ~held_out[row]
    weight = np.where(y == 1, 0.5 / y[~held_out].mean(), 0.5 / (1 - y[~held_out]).mean()) * ~held_out
    w, bias = np.zeros(_FAMILIES * _DIMS), 0.0
    m, v = np.zeros(_FAMILIES * _DIMS + 1), np.zeros(_FAMILIES * _DIMS + 1)
    d, r, x = dims[fitted], row[fitted], values[fitted]
    for step in range(1, steps + 1):
        z = np.bincount(r, x * w[d], len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / (~held_out).sum()
        grad = np.append(np.bincount(d, x * error[r], _FAMILIES * _DIMS) + 1e-5 * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    z = (np.bincount(row, values * w[dims], len(rows)) + bias)[held_out]
    t, a, b = y[held_out], 1.0, 0.0
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    for _ in range(50):  # Newton's steps, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = p * (1 - p) + 1e-6
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        change = np.linalg.solve(h, g)
        a, b = a - np.clip(change[0], -1, 1), b - np.clip(change[1], -1, 1)
    return Model((w * 30).astype(np.float64), bias, float(a), float(b + a * bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 3000) -> Model | None:
    """Fits on at most sample_rows labelled documents: half of each label, by the hash of the id.

    Only their hashed features reach the driver. Labels that are null are not used, nor are documents
    that are labelled both good and bad.
    """
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    order = F.xxhash64("doc_id", F.lit(7))
    sample = labels.filter("label = 0").orderBy(order).limit(sample_rows // 2).unionByName(labels.filter("label = 1").orderBy(order).limit(sample_rows // 2))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")

    def features(batches):
        for batch in batches:
            dims, shares = [], []
            for text in batch.column(1).to_pylist():
                d, s = _shares(dimensions(counts(text)[1], text or ""))
                dims.append(d.astype(np.uint16).tobytes())
                shares.append(s.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(dims, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "label", "dims", "shares"])

    rows = sorted(texts.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, label int, dims binary, shares binary").collect())
    if not rows:
        return None
    held = np.array([xxhash.xxh32_intdigest(str(r.doc_id)) % 4 == 0 for r in rows])
    return fit([(np.frombuffer(r.dims, np.uint16), np.frombuffer(r.shares, np.float32), r.label) for r in rows], held)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept, a row for each row of docs.

    base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words. kept: not base_failed, and the
    probability of good quality is at least threshold; without a model it is 1. Null texts have no
    words. Repeated rows stay; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    kept = context.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            base, failed, p, good = judge(batch.column(1).to_pylist(), kept.value, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(base[:, i]) for i in range(5)], pa.array(failed), pa.array(p), pa.array(good)], ["doc_id", *names, "base_failed", "probability", "kept"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, probability double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns."""
    kept = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        return pd.Series(judge(texts.tolist(), kept.value, threshold)[3], dtype=bool)

    return docs.filter(good(F.col(text_col)))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
