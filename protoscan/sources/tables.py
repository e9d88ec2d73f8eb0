"""Annotation tables, expression data, splice events and catalogs as they are downloaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protoscan.functions.validate import is_assembled_chromosome
from protoscan.operators.bounded import broadcast_if_small
from protoscan.operators.tracks import repeat_code, subcompartment_code
from protoscan.sources.lines import read_lines


@dataclass(frozen=True)
class TrackLayout:
    """Column numbers of a tab table, from 0; negative ones count from the end."""

    chrom: int
    start: int
    end: int
    value: int | None = None
    strand: int | None = None
    header: bool = True


# --- fixed values: column places of the annotation tables -------------------------
LAYOUTS = {
    "dnase": TrackLayout(1, 2, 3, -4),
    "histone": TrackLayout(1, 2, 3, -4),
    "cpg_islands": TrackLayout(1, 2, 3, -1),
    "methylation": TrackLayout(1, 2, 3, 5, -4),
    "nucleosomes": TrackLayout(0, 1, 2, 3, None, False),
    "expression": TrackLayout(0, 1, 2, -3, 5),
    "subcompartments": TrackLayout(0, 1, 2, 3),
}


def _cell(row: Column, i: int) -> Column:
    return F.get(row, F.lit(i)) if i >= 0 else F.try_element_at(row, F.lit(i))


def _rows(spark: SparkSession, path: str, header: bool, separator: str = "\t") -> DataFrame:
    lines = read_lines(spark, path)
    if header:
        # the header is in the split a file begins with; one row per file
        first = lines.filter("block = 0").groupBy("file").agg(F.min("line_seq").alias("_first"))
        lines = lines.join(broadcast_if_small(first), "file").filter("line_seq > _first").drop("_first")
    return lines.select("file", F.col("line_seq").alias("load_seq"), F.split(F.trim("text"), separator).alias("_row"))


def read_track(spark: SparkSession, path: str, kind: str, replicate: int = 0) -> DataFrame:
    """chrom, start, end, value, load_seq (and track_strand, replicate) of an annotation table."""
    layout = LAYOUTS[kind]
    rows = _rows(spark, path, layout.header)
    value = _cell(F.col("_row"), layout.value)
    if kind == "nucleosomes":
        value = value.cast("double")
    elif kind == "subcompartments":
        value = subcompartment_code(value).cast("double")
    elif kind == "histone":
        value = F.when(value == ".", "0").otherwise(value)
    columns = [
        _cell(F.col("_row"), layout.chrom).alias("chrom"), _cell(F.col("_row"), layout.start).cast("bigint").alias("start"),
        _cell(F.col("_row"), layout.end).cast("bigint").alias("end"), value.alias("value"), "load_seq",
    ]
    if layout.strand is not None:
        columns.append(F.when(_cell(F.col("_row"), layout.strand) == "+", "+").otherwise("-").alias("track_strand"))
    return rows.select(*columns, F.lit(replicate).alias("replicate")).filter(is_assembled_chromosome("chrom"))


def read_repeats(spark: SparkSession, path: str, with_family: bool = False) -> DataFrame:
    r = F.col("_row")
    value = repeat_code(_cell(r, 11), _cell(r, 12) if with_family else None)
    return (
        _rows(spark, path, header=False)
        .select(_cell(r, 5).alias("chrom"), _cell(r, 6).cast("bigint").alias("start"), _cell(r, 7).cast("bigint").alias("end"), value.alias("value"), "load_seq")
        .filter(is_assembled_chromosome("chrom"))
    )


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene rows with exon arrays; ``gene`` is the fourth column from the end."""
    r = F.col("_row")

    def numbers(i: int) -> Column:
        return F.transform(F.split(F.regexp_replace(_cell(r, i), "^,+|,+$", ""), ","), lambda x: x.cast("bigint"))

    return _rows(spark, path, header=True).select(
        _cell(r, 1).alias("accession"), _cell(r, 2).alias("chrom"), _cell(r, 3).alias("strand"),
        _cell(r, 4).cast("bigint").alias("tx_start"), _cell(r, 5).cast("bigint").alias("tx_end"),
        _cell(r, 6).cast("bigint").alias("cds_start"), _cell(r, 7).cast("bigint").alias("cds_end"),
        _cell(r, 8).cast("int").alias("exon_count"), numbers(9).alias("exon_starts"), numbers(10).alias("exon_ends"),
        _cell(r, -4).alias("gene"), "load_seq",
    )


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, kind (centromere, telomere or the whole line's other words), load_seq."""
    lines = read_lines(spark, path)
    r = F.split(F.trim("text"), "\t")
    kind = F.regexp_extract("text", "(centromere|telomere)", 1)
    return lines.select(
        F.get(r, F.lit(1)).alias("chrom"), F.get(r, F.lit(2)).cast("bigint").alias("start"), F.get(r, F.lit(3)).cast("bigint").alias("end"),
        kind.alias("kind"), F.col("line_seq").alias("load_seq"),
    ).filter("kind != ''")


def read_chromosome_sizes(spark: SparkSession, path: str) -> DataFrame:
    found = F.regexp_extract("text", "^(chr[XYM0-9]+)\t([0-9]+)", 1)
    return (
        read_lines(spark, path)
        .select(found.alias("chrom"), F.regexp_extract("text", "^(chr[XYM0-9]+)\t([0-9]+)", 2).cast("bigint").alias("length"), "line_seq")
        .filter("chrom != ''").groupBy("chrom").agg(F.max_by("length", "line_seq").alias("length"))
    )


def read_housekeeping(spark: SparkSession, path: str) -> DataFrame:
    r = F.col("_row")
    return _rows(spark, path, header=True, separator=",").select(
        _cell(r, 2).alias("chrom"), _cell(r, 4).cast("bigint").alias("start"), _cell(r, 5).cast("bigint").alias("end"), "load_seq",
    )


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """entrez and the mean of its three control values; the last line of an id counts."""
    r = F.col("_row")
    mean = (_cell(r, 4).cast("double") + _cell(r, 5).cast("double") + _cell(r, 6).cast("double")) / 3.0
    rows = _rows(spark, path, header=True, separator=",").select(_cell(r, 0).alias("entrez"), mean.alias("m"), "load_seq")
    return rows.groupBy("entrez").agg(F.max_by("m", "load_seq").alias("expression"))


def read_splice_events(spark: SparkSession, path: str) -> DataFrame:
    lines = _rows(spark, path, header=False)
    r = F.transform("_row", lambda x: F.regexp_replace(x, '^"+|"+$', ""))
    at = {"entrez": 11, "event_type": 12, "location": 20, "region": 21, "accession": 23}
    return lines.withColumn("_r", r).select(
        F.col("load_seq").alias("line"), *[F.get("_r", F.lit(i)).alias(n) for n, i in at.items()],
        *[F.try_element_at("_r", F.lit(i + 1)).try_cast("double").alias(f"c{i}") for i in (4, 5, 6)],
    )


def read_psl(spark: SparkSession, path: str, skip: int = 5) -> DataFrame:
    """Alignments of accessions (the folder name of each file) to the genome."""
    r = F.split("text", "\t")

    def numbers(i: int) -> Column:
        return F.transform(F.split(F.regexp_replace(F.trim(F.get(r, F.lit(i))), "^,+|,+$", ""), ","), lambda x: x.cast("bigint"))

    lines = read_lines(spark, path)
    # five header lines, none of which begins with a number and holds 21 columns
    return lines.filter((F.size(r) > 20) & F.get(r, F.lit(0)).rlike("^[0-9]+$")).select(
        F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("accession"), F.col("line_seq").alias("line"),
        F.get(r, F.lit(0)).cast("bigint").alias("matches"), F.get(r, F.lit(8)).alias("strand"), F.get(r, F.lit(13)).alias("chrom"),
        numbers(18).alias("sizes"), numbers(20).alias("starts"),
    )


def read_included_regions(spark: SparkSession, path: str) -> DataFrame:
    names = ["accession", "type", "chrom", "start", "end", "strand", "entrez", "value"]
    rows = _rows(spark, path, header=True, separator=",")
    return rows.select(*[F.get("_row", F.lit(i)).cast("bigint" if n in ("start", "end") else "string").alias(n) for i, n in enumerate(names)], "load_seq")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV catalog with its header names (blanks as underscores) and load_seq."""
    table = spark.read.option("header", True).csv(path)
    named = table.toDF(*[c.replace(" ", "_") for c in table.columns])
    return named.withColumn("load_seq", F.monotonically_increasing_id())


def read_shape_table(spark: SparkSession, path: str) -> DataFrame:
    """pentamer, mgw, prot, roll, helt from Parquet (arrays of one and two values)."""
    return spark.read.parquet(path).select("pentamer", "mgw", "prot", "roll", "helt")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    from protoscan.operators.model import NODE_SCHEMA

    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in NODE_SCHEMA])
