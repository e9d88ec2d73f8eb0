"""Text lines with their place in the file, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_ROW_BITS = 33


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Rows file, block, line_seq, text.

    ``line_seq`` grows along each file, whatever the size of its splits: the place where the
    file split begins plus the row number within the task that read it. A line takes a byte
    at least, so a split's rows end before the next split's begin. It orders the lines of one
    file; order by (file, line_seq) where a table comes from several.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    row = F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)
    return lines.select(
        F.col("file_path").alias("file"), F.col("file_block_start").alias("block"),
        (F.col("file_block_start") + row).alias("line_seq"), F.regexp_replace("value", "\r$", "").alias("text"),
    )
