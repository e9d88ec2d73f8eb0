"""Document quality by a factorisation machine.

A document becomes a sparse row: L2-normalised counts of its hashed words, and one indicator per
structure statistic (share of capitals, digits, marks, repeated words and lines, lengths, ...), cut into
bins at fixed quantiles of the training sample. The machine adds to a linear score all pairwise
interactions of rank ``RANK``, in time linear in the row by
``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``.

The model is fitted with numpy on at most ``SAMPLE`` labelled rows: those of the smallest hash of their
id among the rows with labels that the caller allows. Its size is fixed (hashed words, bins, rank);
it goes to the tasks with the function. Scoring is one pass without a shuffle and reads the text
and nothing else; labels, language, source and id are no inputs.

Null and empty texts are scored like any other, by their statistics. Rows of the labels with a null id
or label are left out; an id labelled both ways counts as 0. Without labels, or with one class only,
every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protoscan.llm.common import binary_text, columns, others, worker_state

WORDS = 4096
RANK = 8
BINS = 8
SAMPLE = 4000
EPOCHS = 30
CUT = 0.3
KEPT = 400_000

_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
STATISTICS = 16


class Buckets(dict):
    """Word to bucket, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = bucket = zlib.crc32(word) % WORDS
        return bucket


def features(text: bytes, buckets: Buckets | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, statistics) of one text; ``buckets`` remembers those of its words."""
    buckets = Buckets() if buckets is None else buckets
    words = text.split()
    n = len(words)
    found, counts = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int32, n), return_counts=True)
    values = counts / max(np.sqrt((counts * counts).sum()), 1e-9)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = max(len(text), 1)
    lines = text.split(b"\n")
    marks = bytes_[_MARKS].sum()
    sentence = bytes_[[33, 44, 46, 63]].sum()
    statistics = np.array([
        np.log1p(n), np.log1p(len(text)), len(text) / max(n, 1), bytes_[65:91].sum() / total, bytes_[48:58].sum() / total,
        marks / total, (marks - sentence) / total, bytes_[33] / total, bytes_[46] / max(n, 1), bytes_[124] / max(n, 1),
        bytes_[128:].sum() / total, len(set(words)) / max(n, 1), (counts.max() if n else 0) / max(n, 1), len(lines) / max(n, 1),
        len(set(lines)) / len(lines), bytes_[[35, 36, 37, 38, 42]].sum() / max(n, 1),
    ])
    return found, values.astype(np.float32), statistics


@dataclass
class Machine:
    """w0 + <w, x> + pairwise interactions; the last ``STATISTICS * BINS`` inputs are the bins."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray

    def bins(self, statistics: np.ndarray) -> np.ndarray:
        return WORDS + np.arange(STATISTICS) * BINS + (statistics[:, None] > self.edges).sum(1)

    def score(self, text: bytes, buckets: Buckets | None = None) -> float:
        found, values, statistics = features(text, buckets)
        at = np.concatenate([found, self.bins(statistics)])
        x = np.concatenate([values, np.full(STATISTICS, 0.5, np.float32)])
        v = self.v[at] * x[:, None]
        total = v.sum(0)
        raw = self.w0 + x @ self.w[at] + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss, Adam, mini-batches; every array has a fixed size given ``len(texts)``."""
    size = WORDS + STATISTICS * BINS
    rate = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or rate in (0.0, 1.0):
        return Machine(float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), np.zeros((STATISTICS, BINS - 1)))
    buckets = Buckets()
    rows = [features(t, buckets) for t in texts]
    edges = np.quantile(np.array([r[2] for r in rows]), np.arange(1, BINS) / BINS, axis=0).T
    model = Machine(float(np.log(rate / (1 - rate))), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), edges)
    x = np.zeros((len(rows), size), np.float32)
    for i, (found, values, statistics) in enumerate(rows):
        x[i, found] = values
        x[i, model.bins(statistics)] = 0.5
    rng = np.random.default_rng(seed)
    params = [np.array([model.w0], np.float32), model.w, rng.normal(0, 0.05, (size, RANK)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            b, y = x[at], labels[at]
            w0, w, v = params
            total = b @ v
            raw = w0 + b @ w + 0.5 * ((total * total).sum(1) - (b * b) @ (v * v).sum(1))
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(at)).astype(np.float32)
            weighted = b * error[:, None]
            slopes = [np.array([error.sum()]), weighted.sum(0) + 1e-5 * w, weighted.T @ total - v * ((b * b).T @ error)[:, None] + 1e-4 * v]
            step += 1
            for p, g, m, s in zip(params, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2], edges)


def train(documents: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE, label: str = "quality") -> Machine:
    """Fit on at most ``sample`` labelled documents; ``allowed`` is a condition on the label rows."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    rows = rows.groupBy("doc_id").agg(F.min(label).cast("double").alias("_label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", binary_text().alias("__text"))
    got = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "__text").limit(sample).select("__text", "_label").toArrow()
    return fit(got["__text"].to_pylist(), np.array(got["_label"].to_pylist(), np.float32))


def score(documents: DataFrame, model: Machine) -> DataFrame:
    """``documents`` with ``score`` (0 to 1, higher: label 1 likelier) in place of any column of that name.

    Python is given the text and returns a number; the documents themselves stay in the JVM.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            buckets = worker_state(("quality",), Buckets)
            yield pa.array([model.score(t.as_py(), buckets) for t in texts], pa.float64())

    rest = columns(others(documents, "score"))
    return documents.select(*rest, scored(binary_text()).alias("score"))
