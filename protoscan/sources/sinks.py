"""Result writers. Files are written by the tasks; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no arrays; they become blank-separated text."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in arrays}) if arrays else df


def write_scores(df: DataFrame, path: str) -> None:
    """Pair scores: the input columns and the score, with a header."""
    _flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_pair_scores(scored: DataFrame, path: str) -> None:
    """Scores of pair files: the cells as they were given and the score, in the order of the files."""
    ordered = scored.repartitionByRange("file", "line_seq").sortWithinPartitions("file", "line_seq")
    ordered.select("input.*", "score").write.mode("overwrite").option("header", True).csv(path)


def write_ranked(df: DataFrame, path: str, per_guide: str | None = None) -> None:
    """Ranked tables in their order; with ``per_guide`` one folder per guide.

    Rows are range-partitioned by guide and rank, so a guide is in one file, or in a few that follow each other if it
    has a large share of all rows.
    """
    order = [*([per_guide] if per_guide else []), *(["rank"] if "rank" in df.columns else [])]
    placed = _flat(df).repartitionByRange(*order).sortWithinPartitions(*order) if order else _flat(df)
    writer = placed.write.mode("overwrite").option("header", True)
    (writer.partitionBy(per_guide) if per_guide else writer).csv(path)


def write_loci(df: DataFrame, path: str) -> None:
    """The locus table before scoring."""
    _flat(df).write.mode("overwrite").parquet(path)


def write_track(df: DataFrame, path: str) -> None:
    """A parsed track for later runs, sorted so that reads skip row groups."""
    df.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").parquet(path)


def write_regions(df: DataFrame, path: str) -> None:
    """Exon and intron rows of the splice fold in file layout."""
    columns = ["accession", "type", "chrom", "start", "end", "strand", "entrez", "value"]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def for_display(df: DataFrame) -> DataFrame:
    """Numbers with two decimals, as the result page shows them."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.format_string("%.2f", F.col(c)) for c in floats}) if floats else df
