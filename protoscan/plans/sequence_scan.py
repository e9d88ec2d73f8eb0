"""All guides of a sequence with their on-target score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protoscan.fixed import SHORT_FLANK
from protoscan.operators.features import sequence_features
from protoscan.operators.genome import chunk_contigs
from protoscan.operators.model import TreeEnsemble, score
from protoscan.operators.post import format_results
from protoscan.operators.scan import as_ontarget_pairs, scan_sites
from protoscan.session import materialise


def scan_features(contigs: DataFrame, shape_table, flank: int = SHORT_FLANK) -> DataFrame:
    """Sites of both strands of (contig, seq) rows with their 48 features."""
    sites = scan_sites(chunk_contigs(contigs), flank)
    return sequence_features(as_ontarget_pairs(sites, flank), shape_table)


def score_sequences(contigs: DataFrame, shape_table, model: TreeEnsemble, flank: int = SHORT_FLANK) -> DataFrame:
    """Scored sites; with several sequences each row names its contig."""
    return score(scan_features(contigs, shape_table, flank), model)


def scan_report(contigs: DataFrame, shape_table, model: TreeEnsemble, names: dict[str, str] | None = None) -> DataFrame:
    """Ranked, decoded table; an empty one means that the sequences hold no site."""
    scored = score_sequences(contigs, shape_table, model).withColumnRenamed("contig", "chrom").drop("context", "flank")
    # ranking samples its input before it sorts: from a written table the sample reads the sort columns only, while a shuffle
    # before the sort would be merged with it and all features computed twice
    return format_results(materialise(scored), names, within=["chrom"], ties=[])
