"""Alignment tables of a short-read aligner, primary and alternative hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protoscan.sources.lines import read_lines


def cigar_span(cigar: Column) -> Column:
    """Reference letters covered: the M, S and D counts."""
    counts = F.regexp_extract_all(cigar, F.lit("(\\d+)[MSD]"), F.lit(1))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def parse_hits(records: DataFrame, text: str = "text") -> DataFrame:
    """One row per hit: the record's columns plus contig, strand, start, end, cigar, primary.

    The primary hit takes its strand from bit 16 of the flag; alternatives (XA tag, entries
    ``contig,±position,cigar,edits;``) carry a sign. Records without a hit are left out.
    """
    f = F.split(F.col(text), "\t")
    alternates = F.regexp_extract(F.col(text), "XA:Z:([^\\t]*)", 1)
    primary = F.struct(
        F.get(f, F.lit(2)).alias("contig"),
        F.when(F.get(f, F.lit(1)).cast("int").bitwiseAND(16) != 0, "-").otherwise("+").alias("strand"),
        F.get(f, F.lit(3)).cast("bigint").alias("start"), F.get(f, F.lit(5)).alias("cigar"), F.lit(True).alias("primary"),
    )
    others = F.transform(
        F.filter(F.split(alternates, ";"), lambda x: F.trim(x) != ""),
        lambda x: F.struct(
            F.get(F.split(x, ","), F.lit(0)).alias("contig"), F.left(F.get(F.split(x, ","), F.lit(1)), F.lit(1)).alias("strand"),
            F.substring(F.get(F.split(x, ","), F.lit(1)), 2, 20).cast("bigint").alias("start"),
            F.get(F.split(x, ","), F.lit(2)).alias("cigar"), F.lit(False).alias("primary"),
        ),
    )
    keep = [c for c in records.columns if c != text]
    return (
        records.filter(~((F.get(f, F.lit(2)) == "*") & (F.get(f, F.lit(3)) == "0")))
        .select(*keep, F.get(f, F.lit(0)).alias("query"), F.get(f, F.lit(9)).alias("read"), F.explode(F.concat(F.array(primary), others)).alias("h"))
        .select(*keep, "query", "read", F.concat(F.lit("chr"), F.col("h.contig")).alias("contig"), "h.strand", "h.start",
                (F.col("h.start") + cigar_span(F.col("h.cigar")) - 1).alias("end"), "h.cigar", "h.primary")
    )


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return parse_hits(read_lines(spark, path).filter(~F.startswith("text", F.lit("@"))))
