"""Joins with a side that is expected to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast once a count has shown the table to be small.

    The count stops at ``max_rows`` + 1 rows. A larger table comes back without a hint and
    is joined by shuffle, where adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
