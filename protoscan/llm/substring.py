"""Long passages that repeat across documents, found at difference-cover anchors.

A window is ``WINDOW`` consecutive words. Positions whose remainder modulo ``PERIOD`` is in ``COVER`` carry an
anchor, the hash of the next ``WINDOW - PERIOD + 1`` words. For any two positions there is a shift below
``PERIOD`` that puts both on the cover, so any window that two documents share holds an anchor that
both have hashed: 3 of 7 positions are hashed instead of all.

1. Anchors are counted (map-side first, so a passage in a third of all documents is a few rows); those
   met once are done with.
2. The others form a bit table of fixed size that goes to the tasks, where each document extends its
   shared anchors to the windows around them. The table only saves work: where two hashes share a bit,
   a few windows more are looked at.
3. Windows are matched on 95 bits of hash in one shuffle: those that a smaller document has, too, are removed. A task
   settles what it can within a batch first and sends on one document per window, so frequent windows are
   a few rows a task. Consecutive starts go on as runs; up to
   ``BROADCAST_ROWS`` documents with runs, by count, are broadcast to the texts, more are joined by shuffle.

Null and empty texts have no words. A null id is larger than all others. Rows of equal id and text get the same result,
repeats within one id do not count.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from protoscan.llm.common import binary_text, columns, fields, map_batches, materialise, others
from protoscan.operators.bounded import broadcast_if_small

WINDOW = 13
PERIOD = 7
#: A perfect difference cover modulo 7.
COVER = (0, 1, 3)
BITS = 27
BROADCAST_ROWS = 200_000
#: Where a null id stands in the order of documents.
LAST = (1 << 63) - 1

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_ODD = _RNG.integers(0, 1 << 63, (3, 64), dtype=np.int64).astype(_U) * _U(2) + _U(1)


#: A value per byte, and the powers of an odd number and of its inverse, for prefix sums of hashes.
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, _U), np.full(n + 1, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return up, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def run_hashes(words: np.ndarray, starts: np.ndarray, size: int, which: int) -> np.ndarray:
    """Hashes of ``size`` words from each start: a multilinear form over mixed word hashes, mixed again."""
    total = np.zeros(len(starts), _U)
    for j in range(size):
        total += words[starts + j] * _ODD[which, j]
    return _mixed(total)


def _hash_chunk(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    starts, ends = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    up, down = _powers(max(1 << 17, 1 << len(text).bit_length()))
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=_U)])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(text: bytes) -> np.ndarray:
    """64 bits for each word, by sums over prefixes; long texts in chunks that end between words."""
    if len(text) <= CHUNK:
        return _hash_chunk(text)
    out, begin = [], 0
    while begin < len(text):
        end = begin + CHUNK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        out.append(_hash_chunk(text[begin:end]))
        begin = end
    return np.concatenate(out)


def anchor_places(n: int, window: int) -> np.ndarray:
    size = window - PERIOD + 1
    at = np.arange(max(n - size + 1, 0)) if n >= window else np.zeros(0, np.int64)
    return at[np.isin(at % PERIOD, COVER)]


def anchors(df: DataFrame, window: int) -> DataFrame:
    """The distinct anchors of every row, as an array of longs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(0).to_pylist():
            words = word_hashes(text)
            out.append(np.unique(run_hashes(words, anchor_places(len(words), window), window - PERIOD + 1, 0)).view(np.int64))
        ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([lists], names=["anchors"])

    return map_batches(df.select(binary_text().alias("_text")), run, "anchors array<bigint>", "_text").select(F.explode("anchors").alias("anchor"))


def bit_table(shared: DataFrame) -> np.ndarray:
    """The low ``BITS`` bits of every hash (column anchor) as a bit table: ``2**BITS / 8`` bytes, whatever the input."""

    low = shared.select(F.expr(f"cast(anchor & {(1 << BITS) - 1}L as int)").alias("low")).distinct()
    words = low.groupBy(F.shiftright("low", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, low & 63)")).alias("bits"))
    got = words.toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table


def windows(df: DataFrame, window: int, table) -> DataFrame:
    """(doc_id, place, h1, h2, tail): the windows around anchors whose bit is set in the broadcast ``table``.

    place: 32 bits of the text's key above the position, which tells rows of equal id apart. Places whose window is also in
    a smaller document of the same batch are settled: they come as runs (``tail`` is the last start), with
    a hash of their own. So a batch sends a frequent window on for one document only.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = table.value
        counts, starts_of, first, second = [], [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, _U)]
        for text in batch.column("__text").to_pylist():
            words = word_hashes(text)
            n = len(words)
            at = anchor_places(n, window)
            low = run_hashes(words, at, window - PERIOD + 1, 0) & _U((1 << BITS) - 1)
            at = at[(bits[(low >> _U(6)).astype(np.int64)] >> (low & _U(63)).astype(np.int64)) & 1 == 1]
            near = np.zeros(max(n - window + 1, 0), bool)
            for back in range(PERIOD):
                start = at - back
                near[start[(start >= 0) & (start < len(near))]] = True
            starts = np.flatnonzero(near)
            counts.append(len(starts))
            starts_of.append(starts)
            first.append(run_hashes(words, starts, window, 1))
            second.append(run_hashes(words, starts, window, 2) >> _U(33))
        row = np.repeat(np.arange(batch.num_rows), counts)
        at, h1, h2 = np.concatenate(starts_of), np.concatenate(first), np.concatenate(second)
        order = np.array([LAST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
        tags = batch.column("tag").to_numpy(zero_copy_only=False) << 32

        by = np.lexsort((order[row], h2, h1))
        new = np.ones(len(by), bool)
        new[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
        least = order[row][by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else np.zeros(0, np.int64)
        settled = np.zeros(len(by), bool)
        settled[by] = order[row][by] > least

        open_, done = np.flatnonzero(~settled), np.flatnonzero(settled)
        joined = (at[done][1:] == at[done][:-1] + 1) & (row[done][1:] == row[done][:-1])
        heads = done[np.concatenate([[True], ~joined])] if len(done) else done
        tails = done[np.concatenate([~joined, [True]])] if len(done) else done
        every = np.concatenate([open_, heads])
        own = _mixed((tags[row[heads]] | at[heads]).astype(_U) ^ h1[heads])
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(row[every])), pa.array(tags[row[every]] | at[every]),
            pa.array(np.concatenate([h1[open_], own]).view(np.int64)), pa.array(np.concatenate([h2[open_], np.zeros(len(heads), _U)]).astype(np.int32)),
            pa.array([None] * 0, pa.int32()) if not len(every) else pa.array(np.concatenate([np.zeros(len(open_), np.int64), at[tails]]).astype(np.int32), mask=np.arange(len(every)) < len(open_))],
            names=["doc_id", "place", "h1", "h2", "tail"])

    tagged = df.select("doc_id", F.expr("coalesce(xxhash64(text), 0) >> 33").alias("tag"), binary_text().alias("__text"))
    return map_batches(tagged, run, "doc_id bigint, place bigint, h1 bigint, h2 int, tail int", "__text")


def keep(text: bytes, heads: list[int], tails: list[int], window: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space); windows start from each head to its tail."""
    words = text.split()
    kept, at = [], 0
    for head, tail in sorted(zip(heads, tails)):
        kept += words[at : max(head, at)]
        at = max(at, min(tail + window, len(words)))
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tag, heads, tails): the runs of window starts that are removed, for documents that have any."""
    spark = documents.sparkSession
    shared = materialise(anchors(documents, window).groupBy("anchor").count().where("count > 1").select("anchor"))
    table = spark.sparkContext.broadcast(bit_table(shared))
    found = windows(documents, window, table).withColumn("order", F.coalesce("doc_id", F.lit(LAST)))
    least = F.min("order").over(Window.partitionBy("h1", "h2"))
    later = found.withColumn("least", least).where("tail is not null or least < order")
    at = "cast(place & 4294967295 as int)"
    starts = later.groupBy("doc_id", F.shiftright("place", 32).alias("tag")).agg(
        F.sort_array(F.collect_set(F.expr(f"if(tail is null, {at}, null)"))).alias("a"),
        F.collect_list(F.expr(f"if(tail is null, null, named_struct('head', {at}, 'tail', tail))")).alias("runs"))
    heads, tails = "filter(a, (x, i) -> i = 0 or x - a[i - 1] > 1)", "filter(a, (x, i) -> i = size(a) - 1 or a[i + 1] - x > 1)"
    return materialise(starts.select("doc_id", "tag", F.expr(f"concat({heads}, runs.head)").alias("heads"), F.expr(f"concat({tails}, runs.tail)").alias("tails")))


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` with text (words that stay, joined by one space), n_words and n_removed."""
    gone = repeats(documents.select("doc_id", "text"), window)
    gone = broadcast_if_small(gone.toDF("__id", "__tag", "__heads", "__tails"), BROADCAST_ROWS)
    rest = others(documents, "text", "n_words", "n_removed")
    tagged = documents.select(*columns(rest), binary_text().alias("__text"), F.expr("xxhash64(text) >> 33").alias("__of"))
    joined = tagged.join(gone, F.expr("doc_id <=> __id and __of = __tag"), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, removed = [], [], []
        for text, heads, tails in zip(*(batch.column(c).to_pylist() for c in ("__text", "__heads", "__tails"))):
            n, m, kept = keep(text, heads or [], tails or [], window)
            texts.append(kept)
            counts.append(n)
            removed.append(m)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
            names=[*rest, "text", "n_words", "n_removed"])

    schema = fields(documents, rest, "text string, n_words bigint, n_removed bigint")
    return map_batches(joined.select(*columns(rest), "__text", "__heads", "__tails"), run, schema, "__text")
