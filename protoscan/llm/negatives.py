"""Hard negatives by exact integer inner products, looked up in tables of subset sums (the Four Russians' method).

Components are scaled and rounded down to integers. A candidate is stored as bit planes in two's complement: plane b holds bit b of
all components, eight dimensions to a byte. For an anchor and a group of eight dimensions, a table holds the sum of the
anchor's components over each of the 256 subsets. A plane's share of the inner product is then one lookup per byte; planes are added
from the top, which counts negative, doubling at each step. That gives full, exact scores, eight dimensions to an addition.

An anchor's positives are the rows of its label with the highest scores; a positive's negatives are rows of other labels whose
score lies between ``low`` and 100 per cent of the positive's score: likely confusions, but not above what is known to belong.

Every anchor is compared with every row, in blocks: anchors in parts of at most ``PART`` rows, all rows in slices of at most
``SLICE``; a task holds one part and one slice in packed form, and the tables of ``AT_ONCE`` anchors. Slices follow a hash of
the whole row, so neither a frequent label nor a cluster of equal vectors makes one large. Tasks return the best few of each anchor; these
lists are merged by rank. There are two such passes, since negatives need the scores of the positives, and no cap on anchors or
candidates in either.

Rows with a null id, a null label, a null vector, or any null, NaN or infinite component take no part. Zero vectors do; vectors of
different lengths never meet. Rows that repeat in id, label and integers count once. Rows of an anchor's own id are never its
positives or negatives; an id with different labels or vectors gives one anchor each. Ties in score go to the smaller id. An anchor without
positives, or a positive without negatives, gives no row. Components stop at the range of a long, and sums beyond it wrap around.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from protoscan.llm.common import materialise

GROUP = 8
SLICE = 131_072
LEAST_SLICE = 2_048
SPREAD = 64
PART = 16_384
AT_ONCE = 64
STRIP = 2_048

MEMBER = "key long, id long, label string, dims int, planes binary"
FOUND = "key long, found long, score long, threshold long"


def pack(vectors: np.ndarray) -> list[bytes]:
    """Bit planes of integer rows (rows, dims): of each row the lowest plane first, as many as its largest component needs and one for signs."""
    rows, dims = vectors.shape
    if not dims:
        return [b""] * rows
    size = np.where(vectors < 0, ~vectors, vectors).max(axis=1)  # without a sign
    planes = np.array([int(x).bit_length() + 1 for x in size])
    out: list[bytes] = [b""] * rows
    for n in np.unique(planes):
        at = np.flatnonzero(planes == n)
        bits = (vectors[at][:, None, :] >> np.arange(n)[None, :, None]).astype(np.uint8) & 1
        packed = np.packbits(bits, axis=2, bitorder="little").reshape(len(at), -1)
        for i, row in zip(at, packed):
            out[i] = row.tobytes()
    return out


def plane_bytes(packed: list[bytes], dims: int) -> np.ndarray:
    """(planes, groups, rows) of packed rows of one length; rows of fewer planes repeat their sign plane."""
    groups = (dims + GROUP - 1) // GROUP
    planes = max((len(x) // groups for x in packed), default=0) if groups else 0
    out = np.zeros((planes, groups, len(packed)), np.uint8)
    for n in {len(x) for x in packed} if groups else ():
        at = np.array([i for i, x in enumerate(packed) if len(x) == n])
        block = np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), n // groups, groups).transpose(1, 2, 0)
        out[: n // groups, :, at] = block
        out[n // groups :, :, at] = block[-1]
    return out


def unpack(planes: np.ndarray, dims: int) -> np.ndarray:
    """The integers (rows, dims) of ``plane_bytes``."""
    out = np.zeros((planes.shape[2], dims), np.int64)
    for b in range(len(planes)):
        bits = np.unpackbits(planes[b].T, axis=1, bitorder="little")[:, :dims].astype(np.int64)
        out = out - (bits << b) if b == len(planes) - 1 else out + (bits << b)
    return out


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """(groups, 256, anchors): sums of each anchor's components over every subset of eight dimensions."""
    n, dims = anchors.shape
    groups = (dims + GROUP - 1) // GROUP
    padded = np.zeros((n, groups * GROUP), kind)
    padded[:, :dims] = anchors
    parts = padded.reshape(n, groups, GROUP).transpose(1, 2, 0)
    table = np.zeros((groups, 1 << GROUP, n), kind)
    for d in range(GROUP):
        table[:, 1 << d : 2 << d] = table[:, : 1 << d] + parts[:, d : d + 1]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, rows): inner products by lookup, plane by plane from the top."""
    groups, _, n = table.shape
    rows = planes.shape[2]
    out = np.empty((n, rows), np.int64)
    room = np.empty((min(rows, STRIP), n), table.dtype)
    for low in range(0, rows, STRIP):
        part = planes[:, :, low : low + STRIP]
        looked = room[: part.shape[2]]
        total = np.zeros(looked.shape, table.dtype)
        for b in range(len(part) - 1, -1, -1):
            total += total
            for g in range(groups):
                np.take(table[g], part[b, g], axis=0, out=looked, mode="clip")
                total = total - looked if b == len(part) - 1 else np.add(total, looked, out=total)
        out[:, low : low + STRIP] = total.T
    return out


def best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the positions ``at`` the ``k`` of the highest score, ties by id."""
    if len(at) > 4 * k:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _kind(anchors: np.ndarray, planes: int) -> type:
    """32 bits where no sum on the way can pass them."""
    most = float(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0)) * 2.0**planes
    return np.int32 if most < 2**31 else np.int64


def _compare(members: pa.Table, asking: pa.Table, pick) -> list[tuple]:
    """``pick(anchor, scores, ids, other, same)`` over all anchors and members of one length; positions are within the members."""
    out = []
    if not members.num_rows or not asking.num_rows:
        return out
    rows, asks = members.to_pandas(), asking.rename_columns([c.removeprefix("a_") for c in asking.column_names]).to_pandas()
    for dims, ask in asks.groupby("dims"):
        part = rows[rows["dims"] == dims]
        if not len(part):
            continue
        planes = plane_bytes(part["planes"].tolist(), dims)
        ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
        codes, names = pd.factorize(labels)
        number = {name: i for i, name in enumerate(names)}
        for low in range(0, len(ask), AT_ONCE):
            few = ask.iloc[low : low + AT_ONCE]
            whole = unpack(plane_bytes(few["planes"].tolist(), dims), dims)
            found = scores(subset_sums(whole, _kind(whole, len(planes))), planes)
            for i, anchor in enumerate(few.itertuples(index=False)):
                out += pick(anchor, found[i], ids, ids != anchor.id, codes == number.get(anchor.label, -1))
    return out


def _positives(k: int):
    def pick(anchor, score, ids, other, same):
        return [(anchor.key, int(ids[j]), int(score[j]), None) for j in best(score, ids, np.flatnonzero(same & other), k)]

    return pick


def _negatives(k: int, low: int):
    def pick(anchor, score, ids, other, same):
        tops = sorted({int(x) for x in anchor.thresholds}, reverse=True)
        floor = {top: -(-low * top // 100) for top in tops}  # the smallest whole score of at least ``low`` per cent
        wanted = [top for top in tops if floor[top] <= top]
        if not wanted:
            return []
        near = np.flatnonzero((score <= max(wanted)) & (score >= min(floor[x] for x in wanted)) & ~same & other)
        own, out = score[near], []
        for top in wanted:
            at = near[(own <= top) & (own >= floor[top])]
            out += [(anchor.key, int(ids[j]), int(score[j]), top) for j in best(score, ids, at, k)]
        return out

    return pick


def packed(df: DataFrame, id_column: str, label: str, vector: str, scale: float) -> DataFrame:
    """(key, id, label, dims, planes) of the rows that take part, each once."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"), x.cast("array<double>").alias("vec"))
    top = np.nextafter(2.0**63, 0)

    def run(batches):
        for batch in batches:
            vec = batch.column("vec")
            sizes = vec.value_lengths().to_numpy()
            flat, starts = vec.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            planes: list[bytes] = [b""] * len(sizes)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                whole = np.clip(np.floor(flat[starts[at][:, None] + np.arange(dims)] * scale), -(2.0**63), top).astype(np.int64)
                for i, row in zip(at, pack(whole)):
                    planes[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(planes, pa.binary())], names=["id", "label", "dims", "planes"])

    each = rows.mapInArrow(run, "id long, label string, dims int, planes binary").distinct()
    return each.select(F.xxhash64("id", "label", "dims", "planes").alias("key"), "*")


def _dealt(members: DataFrame, asking: DataFrame, slices: int, parts: int, pick) -> DataFrame:
    """``pick`` over every pair of a slice of all rows and a part of the anchors, one pair to a task's turn."""
    own = members.select(F.pmod("key", F.lit(slices)).alias("slice"), F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"), "id", "label", "dims", "planes")
    theirs = asking.select(F.explode(F.expr(f"sequence(0L, {slices - 1}L)")).alias("slice"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), *asking.columns)
    theirs = theirs.toDF("slice", "part", *(f"a_{c}" for c in asking.columns))  # the two sides of a cogroup share no column

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(zip(*_compare(left, right, pick))) or [(), (), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["key", "found", "score", "threshold"])

    return own.groupBy("slice", "part").cogroup(theirs.groupBy("slice", "part")).applyInArrow(meet, FOUND)


def mine(df: DataFrame, anchors: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchors`` holds.

    ``anchors`` is a condition on ``id``.
    """
    members = materialise(packed(df, id_column, label, vector, scale))
    asking = members.where(anchors)
    total, asked = members.count(), asking.count()
    slices = max(1, math.ceil(total / SLICE), min(SPREAD, total // LEAST_SLICE))
    parts = max(1, math.ceil(asked / PART))

    near = _dealt(members, asking, slices, parts, _positives(positives))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "found")))
    chosen = materialise(ranked.where(F.col("n") <= positives).select("key", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))

    limits = chosen.groupBy("key").agg(F.collect_set("positive_score").alias("thresholds"))
    hard = _dealt(members, asking.join(limits, "key"), slices, parts, _negatives(negatives, low))
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("key", "threshold").orderBy(F.desc("score"), "found")))
    lists = ranked.where(F.col("rank") <= negatives).select("key", F.col("threshold").alias("positive_score"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asking.select("key", F.col("id").alias("anchor_id"))
    return chosen.join(lists, ["key", "positive_score"]).join(names, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
