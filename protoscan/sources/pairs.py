"""Guide/site pair files and guide lists."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F

from protoscan.operators.bounded import broadcast_if_small
from protoscan.session import materialise
from protoscan.sources.lines import read_lines

# --- fixed values: header words and columns of the two pair-file layouts ----------
HEADER_WORD = "target_id"
CONTEXT_WORD = "dna_seq_29nt"
CONTEXT_COLUMNS = ["id", "guide", "context"]
LOCUS_COLUMNS = ["id", "guide", "genome", "cell_type", "chrom", "strand", "start"]


def looks_like_csv(spark: SparkSession, path: str, characters: int = 4096) -> bool:
    """Whether a CSV dialect can be told from the head of the file."""
    head = "\n".join(r[0] or "" for r in spark.read.text(path).select(F.left("value", F.lit(characters))).head(characters))[:characters]
    try:
        csv.Sniffer().sniff(head)
    except csv.Error:
        return False
    return True


def parse_pairs(lines: DataFrame) -> DataFrame:
    """Rows below the ``target_id`` header of each file, whatever stands above it.

    ``lines`` has file, line_seq and text (see ``read_lines``). One table for both layouts: rows of sequence files have
    ``context``, rows of coordinate files have genome, cell_type, chrom, strand and start; ``input`` keeps the cells as
    they were given. Files of both layouts may be mixed. Lines that can hold a header are written once; the
    header of a file is its first, so whichever split a line is in, the comparison with that one row places it.
    """
    fields = ", ".join(f"c{i} string" for i in range(len(LOCUS_COLUMNS)))
    named = lines.filter(F.contains("text", F.lit(HEADER_WORD))).select("file", "line_seq", F.from_csv("text", fields).alias("row"))
    first = named.filter(F.col("row.c0") == HEADER_WORD).groupBy("file").agg(F.min("line_seq").alias("_at"), F.min_by("row.c2", "line_seq").alias("_third"))
    headers = materialise(first)
    below = lines.filter("trim(text) != ''").join(broadcast_if_small(headers), "file").filter("line_seq > _at").withColumn("row", F.from_csv("text", fields))
    by_context = F.coalesce(F.col("_third") == CONTEXT_WORD, F.lit(False))
    cells = {name: F.col(f"row.c{i}") for i, name in enumerate(LOCUS_COLUMNS)}
    given = F.struct(
        cells["id"].alias("id"), cells["guide"].alias("guide"), F.when(by_context, F.col("row.c2")).alias("context"),
        *[F.when(~by_context, cells[n]).alias(n) for n in ("genome", "cell_type", "chrom", "strand", "start")],
    )
    rows = below.select("file", "line_seq", given.alias("input"))
    return rows.select("file", "line_seq", *[F.col(f"input.{c}").alias(c) for c in ("id", "guide", "context", "genome", "cell_type", "chrom", "strand")], F.expr("try_cast(input.start as bigint)").alias("start"), "input")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``parse_pairs`` of files."""
    return parse_pairs(read_lines(spark, path))


def guides_in_text(df: DataFrame, text: str, out: str = "guide") -> DataFrame:
    """Distinct upper-case words of comma- or blank-separated guide lists."""
    words = F.split(F.upper(F.trim(F.regexp_replace(F.trim(F.col(text)), ",+", " "))), "\\s+")
    return df.select(F.explode(words).alias(out)).distinct()
