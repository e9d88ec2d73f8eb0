"""Approximate nearest neighbours by a forest of hash prefixes.

In each of ``TREES`` trees a vector's hash is a string of ``CHARS`` characters, all that a long holds; a character names the axis,
with its sign, that lies closest to the vector after a random rotation (the mean of at most ``SAMPLE`` vectors is taken off first).
A query descends with its own string and with its ``PROBES - 1`` next best first characters. The trees then ascend together: prefix
lengths are taken from the longest on, over all trees and probes, until ``ENOUGH`` candidates per tree and probe have been
seen. The length reached is taken whole, however many vectors share the prefix; at length zero these are all vectors, once.

Spark counts the vectors of every prefix in question, which gives each query its length, and deals out the vectors of the
prefixes at these lengths. Prefixes with more than ``BLOCK`` vectors are cut into blocks by key, and their queries go to each
block, so no prefix is too frequent for a task: a dense cluster whose strings are all equal is compared whole, block by block.
Tasks compute exact distances in double precision and return the best of every query and block.

Equal vectors are one row of the forest with their ``k + 1`` smallest ids, all that a list of ``k`` can show of them.
Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of different lengths never meet. Rows
that repeat count once; null ids are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from protoscan.llm.common import materialise
from protoscan.operators.bounded import broadcast_if_small

TREES = 16
CHARS = 9
BITS = 7
AXES = 64
PROBES = 4
ENOUGH = 100
SAMPLE = 10_000
SEED = 20240611
ROWS = 40_000
BLOCK = 20_000
BROADCAST_ROWS = 200_000


def usable(vector: str) -> Column:
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


@lru_cache(maxsize=4)
def rotations(dim: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, dim])
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :AXES] for _ in range(TREES * CHARS)]).reshape(TREES, CHARS, dim, -1)


def strings(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, trees, probes): hashes as longs, ``BITS`` bits per character; the first probe is the vector's own hash."""
    turns = rotations(x.shape[1])
    probes = min(probes, turns.shape[3])
    out = np.zeros((len(x), TREES, probes), np.int64)
    every = np.arange(len(x))
    for t in range(TREES):
        rest = np.zeros(len(x), np.int64)
        for c in range(CHARS):
            y = x @ turns[t, c]
            if c == 0:
                order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
                first = 2 * order + (np.take_along_axis(y, order, 1) > 0)
            else:
                best = np.abs(y).argmax(1)
                rest = rest << BITS | 2 * best + (y[every, best] > 0)
        out[:, t] = first << BITS * (CHARS - 1) | rest[:, None]
    return out


def distinct_vectors(df: DataFrame, k: int, id_column: str, vector: str) -> DataFrame:
    """(key, ids, vec): the k + 1 smallest ids of every distinct usable vector."""
    rows = df.where(usable(vector) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).distinct()
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.xxhash64("vec").alias("key"), "ids", "vec")


def _hashed(rows: DataFrame, means: dict, probes: int) -> DataFrame:
    """(key, ids, vec, dim, hashes): the hashes of every tree, those of all probes in each."""

    def run(frames):
        for frame in frames:
            for dim, part in frame.groupby(frame["vec"].map(len)):
                x = np.array(part["vec"].tolist(), np.float64)
                yield part.assign(dim=np.int32(dim), hashes=strings(x - means[dim], probes).tolist())

    return rows.select("key", "ids", "vec").mapInPandas(run, "key long, ids array<bigint>, vec array<double>, dim int, hashes array<array<bigint>>")


def _prefixes(hashed: DataFrame, levels: list[int]) -> DataFrame:
    """(key, dim, tree, level, prefix) of every hash; level 0, which all vectors of a dimension share, in the first tree only."""
    each = hashed.select("key", "dim", F.posexplode("hashes").alias("tree", "hash")).select("key", "dim", "tree", F.explode("hash").alias("hash"))
    each = each.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level")).where("level > 0 or tree = 0")
    return each.select("key", "dim", "tree", "level", F.expr(f"shiftright(hash, {BITS} * ({CHARS} - level))").alias("prefix"))


def _nearest(frame: pd.DataFrame, k: int) -> list[tuple]:
    """(query, distances, ids) of the best ``k + 1`` for the queries of each cell."""
    out = []
    for _, part in frame.groupby(["dim", "cell"], sort=False):
        items, asks = part[~part["asks"]], part[part["asks"]].drop_duplicates("key")
        if not len(items) or not len(asks):
            continue
        x = np.array(items["vec"].tolist(), np.float64)
        ids = items["ids"].to_numpy()
        least = np.array([v[0] for v in ids])
        for key, vec in zip(asks["key"], asks["vec"]):
            far = np.sqrt(((x - np.asarray(vec, np.float64)) ** 2).sum(1))
            near = np.flatnonzero(far <= np.partition(far, k)[k]) if len(far) > k + 1 else np.arange(len(far))
            best = near[np.lexsort((least[near], far[near]))][: k + 1]
            out.append((key, far[best].tolist(), [list(ids[i]) for i in best]))
    return out


def search(df: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of every row for which ``queries`` holds, nearest first."""
    rows = materialise(distinct_vectors(df, k, id_column, vector))
    wanted = df.where(queries & usable(vector) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("query_id"), F.xxhash64(F.col(vector).cast("array<double>")).alias("key")).distinct()
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toPandas()["vec"]
    means = {dim: np.mean(np.array(part.tolist(), np.float64), axis=0) for dim, part in sample.groupby(sample.map(len))}
    for dim in (x[0] for x in rows.select(F.size("vec")).distinct().collect()):
        means.setdefault(dim, np.zeros(dim))

    items = materialise(_hashed(rows, means, 1))
    asks = materialise(_hashed(rows.join(wanted.select("key").distinct(), "key", "left_semi"), means, PROBES))
    cell = ["dim", "tree", "level", "prefix"]
    every = list(range(CHARS + 1))
    asked = _prefixes(asks, every).distinct()
    counts = materialise(_prefixes(items, every).groupBy(*cell).count().join(asked.select(*cell).distinct(), cell, "left_semi"))
    seen = asked.join(counts, cell).groupBy("key", "level").agg(F.sum("count").alias("n")).where(F.col("n") >= ENOUGH * TREES * PROBES)
    reached = asks.select("key").join(seen.groupBy("key").agg(F.max("level").alias("level")), "key", "left").select("key", F.coalesce("level", F.lit(0)).alias("level"))
    asked = materialise(asked.join(reached, ["key", "level"]))
    cells = materialise(counts.join(asked.select(*cell).distinct(), cell, "left_semi").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")))
    total = cells.agg(F.sum("count"), F.collect_set("level")).first()
    parts = max(4, (total[0] or 0) // ROWS)
    known = broadcast_if_small(cells.drop("count"), BROADCAST_ROWS)

    def placed(found: DataFrame, block: Column) -> DataFrame:
        return found.join(known, cell).withColumn("block", block).select("key", F.struct("dim", F.xxhash64(*cell, "block").alias("cell")).alias("at"))

    def dealt(places: DataFrame, vectors: DataFrame, asking: bool) -> DataFrame:
        places = places.groupBy("key").agg(F.collect_set("at").alias("at"))
        each = vectors.select("key", "ids", "vec").join(places, "key").select("key", "ids", "vec", F.explode("at").alias("at"))
        return each.select(F.pmod("at.cell", F.lit(parts)).alias("to"), "at.dim", "at.cell", "key", "ids", "vec", F.lit(asking).alias("asks"))

    members = placed(_prefixes(items, sorted(total[1]) or [0]), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    askers = placed(asked, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = dealt(members, items, False).union(dealt(askers, asks, True))

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_nearest(frame, k), columns=["key", "far", "ids"])

    walked = materialise(both.groupBy("to").applyInPandas(group, "key long, far array<double>, ids array<array<bigint>>"))

    found = walked.select("key", F.explode(F.arrays_zip("far", "ids")).alias("c"))
    found = found.select("key", F.col("c.far").alias("score"), F.explode("c.ids").alias("id")).distinct()
    near = Window.partitionBy("key").orderBy("score", "id")
    lists = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n")
    answers = wanted.join(lists, "key").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
