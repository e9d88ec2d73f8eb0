"""Row order over a whole table, without sending the table through one task.

A window without a partition key pulls every row into one task. Here the rows are range
partitioned by a total order and written to the checkpoint folder once, each with the
number of its partition and its place there. Each partition then works on its own, and one summary row per partition
carries what it needs from the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from protoscan.session import materialise

_LOCAL_BITS = 33


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned and sorted by a total order, with ``_part`` and ``_row`` (both from 0)."""
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "_part": F.shiftright(at, _LOCAL_BITS), "_row": at.bitwiseAND(2**_LOCAL_BITS - 1),
    })
    return materialise(placed)


def _before(summary: DataFrame, total: str, out: str) -> DataFrame:
    """Running total over the one-row-per-partition summary, not counting the row itself."""
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the range sort: its size is the partition count, so it may be broadcast
    return F.broadcast(summary.select("_part", F.coalesce(F.sum(total).over(w), F.lit(0)).alias(out)))


def number_rows(df: DataFrame, order: list[Column], out: str, group: list[str] | None = None) -> DataFrame:
    """Number the rows 1, 2, ... by a total order, afresh for each ``group`` if given."""
    keys = group or []
    rows = in_order(df, [F.col(g).asc() for g in keys] + order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    placed = rows.join(_before(sizes, "_n", "_skip"), "_part").withColumn("_at", F.col("_skip") + F.col("_row"))
    if not keys:
        return placed.withColumn(out, F.col("_at") + 1).drop("_part", "_row", "_skip", "_at")
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    first = first.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_first")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    return (
        placed.join(first, same)
        .withColumn(out, F.col("_at") - F.col("_first") + 1)
        .drop("_part", "_row", "_skip", "_at", "_first", *[f"_g{i}" for i in range(len(keys))])
    )


def running_sum(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """Inclusive running sum over rows made by ``in_order``."""
    w = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_v", value).withColumn("_local", F.sum("_v").over(w))
    totals = local.groupBy("_part").agg(F.sum("_v").alias("_t"))
    return local.join(_before(totals, "_t", "_skip"), "_part").withColumn(out, F.col("_skip") + F.col("_local")).drop("_v", "_local", "_skip")


def with_previous(rows: DataFrame, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Columns of the row before, over rows made by ``in_order``; null for the first row."""
    w = Window.partitionBy("_part").orderBy("_row")
    kept = F.struct(*columns)
    tails = rows.groupBy("_part").agg(F.max_by(kept, "_row").alias("_tail"))
    summary = Window.partitionBy(F.lit(0)).orderBy("_part")
    carried = F.broadcast(tails.select("_part", F.lag("_tail").over(summary).alias("_carry")))
    looked = rows.withColumn("_lag", F.lag(kept).over(w)).join(carried, "_part", "left")
    previous = F.when(F.col("_row") == 0, F.col("_carry")).otherwise(F.col("_lag"))
    return looked.withColumn("_p", previous).withColumns({prefix + c: F.col("_p")[c] for c in columns}).drop("_p", "_lag", "_carry")
