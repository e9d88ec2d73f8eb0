"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into three segments. Fingerprints that differ in at most four bits differ in at
most one bit of some segment, so every fingerprint looks up its own segments and those with one more
bit set, and full distances settle the rest. Work is done on distinct fingerprints, so thousands of
copies are one row. Fingerprints that differ in a single bit are joined first (a masked value has
two owners at most, so this is linear), and the look-up leaves out pairs that are already together;
a dense group of near copies thus does not become all its pairs.

Rows with a null or empty text have no words and the fingerprint zero, linked like any other. A null
doc_id is never the smallest one; a component of nulls only has a null id. Repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protoscan.llm.common import LOWER, binary_text, map_batches, materialise

SEED = 42
WORDS = 5
MAX_BITS = 4
#: (shift, width) of the segments; one more than half the allowed bits, so one of them has a difference of one bit at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes, words: int) -> int:
    from xxhash import xxh64_intdigest

    found = text.translate(LOWER).split()
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    if n <= words:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    first, last = [0, *ends[: n - words].tolist()], (ends[words - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every row, as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(x, words) for x in batch.column("__text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[id_column, "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_batches(df.select(id_column, binary_text(text).alias("__text")), run, f"`{id_column}` {kind}, fp bigint", "__text")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not the smallest of its component.

    Each round maps every node to the smallest of itself and its neighbours and rewrites the edges;
    the rounds' maps are put together at the end. Every table is written before it is used again.
    """
    spark = edges.sparkSession
    steps: list[DataFrame] = []
    edges = materialise(edges.select("u", "v").where("u <> v").distinct())
    while edges.limit(1).count():
        both = edges.union(edges.select("v", "u"))
        step = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).where("root < node"))
        steps.append(step)
        to_u, to_v = step.toDF("u", "_u"), step.toDF("v", "_v")
        moved = edges.join(to_u, "u", "left").join(to_v, "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
        edges = materialise(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if not steps:
        return spark.createDataFrame([], "node bigint, root bigint")
    known = steps[0]
    for step in steps[1:]:
        later = step.toDF("root", "_root")
        known = materialise(known.join(later, "root", "left").select("node", F.coalesce("_root", "root").alias("root")).union(step.join(known, "node", "left_anti")))  # a label may be a node met before
    return known


def _segment(fp: Column, i: int) -> Column:
    shift, width = SEGMENTS[i]
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _tagged(i: int, value: Column) -> Column:
    return F.lit(i << 32).bitwiseOR(value)


def classes(nodes: DataFrame) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint (column fp)."""
    fp = F.col("fp")
    masked = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    masked = masked.select("fp", "bit", F.expr("fp & ~shiftleft(1L, bit)").alias("rest"))
    single = masked.groupBy("rest", "bit").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).where("u < v").select("u", "v")
    near = components(single)
    placed = materialise(nodes.join(near.toDF("fp", "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))

    table = placed.select("root", "fp", F.explode(F.array(*[_tagged(i, _segment(fp, i)) for i in range(len(SEGMENTS))])).alias("key"))
    asks = [_tagged(i, _segment(fp, i)) for i in range(len(SEGMENTS))] + [
        F.when(_segment(fp, i).bitwiseAND(F.lit(1 << bit)) == 0, _tagged(i, _segment(fp, i).bitwiseOR(F.lit(1 << bit))))
        for i, (_, width) in enumerate(SEGMENTS) for bit in range(width)
    ]
    probes = placed.select(F.col("root").alias("root2"), F.col("fp").alias("fp2"), F.explode(F.array(*asks)).alias("key")).where("key is not null")
    found = probes.join(table, "key").where("root <> root2").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MAX_BITS)
    far = components(found.select(F.least("root", "root2").alias("u"), F.greatest("root", "root2").alias("v")))
    return placed.join(far.toDF("root", "top"), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(df: DataFrame, words: int = WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id that links of at most four bits reach."""
    prints = materialise(fingerprints(df, words, id_column, text))
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_column).alias("smallest")))
    placed = materialise(classes(nodes.select("fp")))
    named = placed.join(nodes, "fp")
    tops = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return prints.join(placed.join(tops, "root").select("fp", "component_id"), "fp").select(id_column, "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
