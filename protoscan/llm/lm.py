"""Log-bilinear language model, trained by noise-contrastive estimation.

Words are counted over all training texts (map-side first). The model's classes are the end of a text,
the ``CLASSES - 2`` most frequent words and one class for all other words; inside it a word has the
add-one share of its count. The two previous classes predict the next one:
``s(w | u, v) = (r_u * c_1 + r_v * c_2) . q_w + b_w``. ``exp`` of a sum is a product, so the normalisers of
all contexts are one matrix product, and every token gets its exact normalised log-probability
from three table look-ups.

Training passes over all training texts: each round takes the half of the documents that its hash names, every task
trains in numpy from the round's start, with noise words that a batch shares, and the tasks' models are averaged
by tokens in ``GROUPS`` groups, then on the driver; a model has a fixed size. Scoring looks up the ``HEAD`` most frequent words in
the tasks; the rarer words of each text are joined with the counts by shuffle. None of them has much more than
``1 / HEAD`` of all tokens, so no key is hot.

Null texts count as empty: one token, the end. Rows that repeat are scored and counted each for itself.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protoscan.llm.common import LOWER, binary_text, columns, fields, map_batches, materialise, others, pieces

CLASSES = 2048
RANK = 16
HEAD = 200_000
NOISE = 64
BATCH = 8192
ROUNDS = 2
RATE = 0.02
GROUPS = 32
HELD = 300_000
END, REST = 0, 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c): how often each lower-cased word occurs in column _text."""

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, "__text"):
                for text in part.column(0).to_pylist():
                    counts.update(text.translate(LOWER).split())
                    if len(counts) > HELD:
                        yield table(counts)
                        counts = Counter()
        yield table(counts)

    return texts.select("__text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words, ``HEAD`` at most: all above a count that a histogram (a few thousand bins) finds."""
    bin_ = F.floor(100 * F.log("c"))
    left, least = HEAD, None
    for b, n in sorted(map(tuple, counts.groupBy(bin_.alias("b")).count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = b
    if least is None:
        return []
    got = counts.where(bin_ >= least).toArrow()
    return sorted(zip(got["word"].to_pylist(), got["c"].to_pylist()), key=lambda x: (-x[1], x[0]))


@dataclass
class Model:
    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(frequency: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        r, q = rng.normal(0, 0.1, (2, CLASSES, RANK)).astype(np.float32)
        return Model(r, q, np.ones((2, RANK), np.float32), np.log(frequency).astype(np.float32))

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c, self.b)]).astype(np.float32).tobytes()

    @staticmethod
    def unpack(data) -> Model:
        flat = np.array(data, np.float32)
        n = CLASSES * RANK
        return Model(flat[:n].reshape(CLASSES, RANK), flat[n : 2 * n].reshape(CLASSES, RANK), flat[2 * n : 2 * n + 2 * RANK].reshape(2, RANK), flat[2 * n + 2 * RANK :])

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, log_z): log P(w | u, v) = first[u, w] + second[v, w] - log_z[u, v]; u came before v."""
        first, second = (self.r * self.c[0]) @ self.q.T, (self.r * self.c[1]) @ self.q.T + self.b
        top1, top2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
        log_z = np.log(np.exp(first - top1) @ np.exp(second - top2).T + 1e-37) + top1 + top2.T
        return first, second, log_z


def _gather(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Adagrad on the NCE loss; contexts (u, v) and words w come as arrays of classes."""

    def __init__(self, model: Model, frequency: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.log_noise = np.log(frequency * NOISE).astype(np.float32)
        self.cumulative = np.cumsum(frequency)
        self.sums = [np.full_like(x, 1e-2) for x in (model.r, model.q, model.c, model.b)]
        self.tokens = 0

    def _step(self, i: int, param: np.ndarray, rows, slope) -> None:
        self.sums[i][rows] += slope * slope
        param[rows] += RATE * slope / np.sqrt(self.sums[i][rows])

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), CLASSES - 1)
        ru, rv, qw, qn = m.r[u], m.r[v], m.q[w], m.q[noise]
        h = ru * m.c[0] + rv * m.c[1]
        true = 1 / (1 + np.exp(np.clip((h * qw).sum(1) + m.b[w] - self.log_noise[w], -30, 30)))
        false = -1 / (1 + np.exp(-np.clip(h @ qn.T + (m.b[noise] - self.log_noise[noise]), -30, 30)))
        dh = true[:, None] * qw + false @ qn
        slope_c = np.stack([(dh * ru).sum(0), (dh * rv).sum(0)])
        rows_q, slope_q = _gather(np.concatenate([w, noise]), np.concatenate([true[:, None] * h, false.T @ h]))
        rows_r, slope_r = _gather(np.concatenate([u, v]), np.concatenate([dh * m.c[0], dh * m.c[1]]))
        slope_b = np.bincount(np.concatenate([w, noise]), np.concatenate([true, false.sum(0)]), CLASSES).astype(np.float32)
        self._step(0, m.r, rows_r, slope_r)
        self._step(1, m.q, rows_q, slope_q)
        self._step(2, m.c, slice(None), slope_c / len(w))
        self._step(3, m.b, slice(None), slope_b)
        self.tokens += len(w)


def classes_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Classes of a text, with two ends before it (its contexts) and one behind."""
    get = known.get
    return np.array([END, END, *[get(w, REST) for w in words], END], np.int32)


def train_round(texts: DataFrame, start: Model, known: dict[bytes, int], frequency: np.ndarray) -> Model:
    """One pass of NCE over column _text from ``start``; the average of the tasks' models."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((start.pack(), known, frequency))

    def run(batches):
        from pyspark import TaskContext

        packed, known, frequency = shared.value
        task = TaskContext.get().partitionId()
        trainer = Trainer(Model.unpack(np.frombuffer(packed, np.float32)), frequency, task)
        held, size = [], 0

        def flush():
            runs = np.concatenate(held)
            word = np.flatnonzero(np.concatenate([np.arange(len(x)) >= 2 for x in held]))
            word = word[trainer.rng.permutation(len(word))]
            for at in range(0, len(word), BATCH):
                w = word[at : at + BATCH]
                trainer.learn(runs[w - 2], runs[w - 1], runs[w])

        for batch in batches:
            for part in pieces(batch, "__text"):
                for text in part.column(0).to_pylist():
                    held.append(classes_of(text.translate(LOWER).split(), known))
                    size += len(held[-1])
                    if size > 64 * BATCH:
                        flush()
                        held, size = [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([task % GROUPS]), pa.array([trainer.tokens]), pa.array([trainer.m.pack()], pa.binary())], names=["part", "tokens", "model"])

    def average(frame):
        total = frame["tokens"].sum()
        mean = sum(np.frombuffer(m, np.float32) * (n / max(total, 1)) for m, n in zip(frame["model"], frame["tokens"]))
        return frame.iloc[:1].assign(tokens=total, model=mean.astype(np.float32).tobytes())

    schema = "part bigint, tokens bigint, model binary"
    models = materialise(texts.select("__text").mapInArrow(run, schema))
    got = models.where("tokens > 0").groupBy("part").applyInPandas(average, schema).collect()
    shared.unpersist()
    total = sum(x["tokens"] for x in got)
    if not total:
        return start
    return Model.unpack(sum(np.frombuffer(x["model"], np.float32) * np.float32(x["tokens"] / total) for x in got))


@dataclass
class Fitted:
    """What scoring needs: the model, the head's counts and the totals; the counts of all words stay a table."""

    model: Model
    head: dict[bytes, tuple[int, int]]
    counts: DataFrame
    tokens: int
    distinct: int
    ends: int
    rest_total: int


def fit(documents: DataFrame, training: Column, text: str = "text") -> Fitted:
    """Learn from the rows of ``documents`` for which ``training`` holds."""
    texts = documents.where(training).select(binary_text(text).alias("__text"))
    ends = texts.count()
    counts = materialise(word_counts(texts))
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = frequent(counts)
    words = [w for w, _ in top[: CLASSES - 2]]
    known = {w: i + 2 for i, w in enumerate(words)}
    own = sum(c for _, c in top[: CLASSES - 2])
    frequency = np.full(CLASSES, 0.5)
    frequency[END], frequency[REST] = ends + 0.5, n_words - own + 0.5
    frequency[2 : 2 + len(words)] = [c + 0.5 for _, c in top[: CLASSES - 2]]
    frequency[2 + len(words) :] = 1e-12
    frequency /= frequency.sum()
    model = Model.start(frequency)
    for i in range(ROUNDS):
        model = train_round(texts.where(F.pmod(F.xxhash64("__text"), F.lit(ROUNDS)) == i), model, known, frequency)
    head = {w: (known.get(w, REST), c) for w, c in top}
    rest = (n_words - own) + (distinct - len(words)) + 1
    return Fitted(model, head, counts, n_words + ends, distinct + (ends > 0), ends, rest)


def score(documents: DataFrame, fitted: Fitted, text: str = "text") -> DataFrame:
    """``documents`` without text, with n_tokens, n_known, base_score and score (log10 of a text's probability)."""
    spark = documents.sparkSession
    ends, rest_total = fitted.ends, fitted.rest_total
    shared = spark.sparkContext.broadcast((fitted.model.pack(), fitted.head))
    added = ("n_tokens", "n_known", "base_score", "score")
    rest = others(documents, text.lower(), *added)
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            packed, head = shared.value
            state.append((Model.unpack(np.frombuffer(packed, np.float32)).tables(), head))
        (first, second, log_z), head = state[0]
        out = []
        for text in batch.column("__text").to_pylist():
            words = text.translate(LOWER).split()
            found = [head.get(w) for w in words]
            ids = np.array([END, END, *[REST if x is None else x[0] for x in found], END])
            u, v, w = ids[:-2], ids[1:-1], ids[2:]
            logs = float((first[u, w] + second[v, w] - log_z[u, v]).sum(dtype=np.float64))
            counts = np.array([x[1] for x in found if x is not None], np.float64)
            inside = np.array([x[1] for x in found if x is not None and x[0] == REST], np.float64)
            tail = [w for w, x in zip(words, found) if x is None]
            out.append((
                len(words) + 1, len(counts) + (ends > 0), float(np.log10(counts + 1).sum()) + np.log10(ends + 1),
                logs / np.log(10) + float(np.log10(inside + 1).sum()) - np.log10(rest_total) * (len(inside) + len(tail)), tail))
        n, k, base, total, tails = zip(*out)
        return pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in rest), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()),
            pa.array(tails, pa.list_(pa.binary()))], names=[*rest, "n_tokens", "__known", "__base", "__score", "__tail"])

    schema = fields(documents, rest, "n_tokens bigint, __known bigint, __base double, __score double, __tail array<binary>")
    rows = map_batches(documents.select(*columns(rest), binary_text(text).alias("__text")), run, schema, "__text")
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()))
    tails = rows.select("__row", F.explode("__tail").alias("word")).join(fitted.counts, "word")
    sums = tails.groupBy("__row").agg(F.sum(F.log10(F.col("c") + 1)).alias("__sum"), F.count("*").alias("__n"))
    joined = rows.drop("__tail").join(sums, "__row", "left")
    more, seen = F.coalesce("__sum", F.lit(0.0)), F.coalesce("__n", F.lit(0))
    each = float(np.log10(fitted.tokens + fitted.distinct + 1))
    return joined.select(*columns(rest), "n_tokens", (F.col("__known") + seen).alias("n_known"), (F.col("__base") + more - F.col("n_tokens") * each).alias("base_score"), (F.col("__score") + more).alias("score"))
