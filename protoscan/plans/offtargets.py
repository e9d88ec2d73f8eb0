"""Genome-wide off-target search for one or many guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protoscan.fixed import SEARCH_MAX_GAPS, SITE_LEN
from protoscan.functions.validate import normalise_guide
from protoscan.operators.features import sequence_features
from protoscan.operators.model import TreeEnsemble, score
from protoscan.operators.post import drop_duplicates, format_results
from protoscan.operators.search import aligned_hits, search, searchable


def bare_guide(guide: str = "guide") -> Column:
    """The letters of a guide as the search takes them: upper case, T for U, no PAM."""
    return F.regexp_replace(normalise_guide(guide), "NGG$", "")


def offtarget_features(guides: DataFrame, chunks: DataFrame, shape_table) -> DataFrame:
    """Hits of every guide with alignment and features; guides may carry U or their PAM."""
    clean = guides.select(bare_guide().alias("guide")).filter(searchable("guide")).distinct()
    return sequence_features(aligned_hits(search(clean, chunks), chunks, site_length=SITE_LEN + SEARCH_MAX_GAPS), shape_table)


def rejected_offtarget_guides(guides: DataFrame) -> DataFrame:
    """The given guides that no search is made for, as they were given: all that ``offtarget_features`` leaves out."""
    return guides.filter(~searchable(bare_guide()))


def score_offtargets(guides: DataFrame, chunks: DataFrame, shape_table, model: TreeEnsemble) -> DataFrame:
    """Best hit per start and per end of every guide, scored."""
    scored = score(offtarget_features(guides, chunks, shape_table), model)
    return drop_duplicates(scored.withColumnRenamed("contig", "chrom"), within=["guide"], ties=[])


def offtarget_report(guides: DataFrame, chunks: DataFrame, shape_table, model: TreeEnsemble, names: dict[str, str] | None = None) -> DataFrame:
    """Ranked and decoded table per guide, ready for ``sources.sinks.write_ranked``."""
    scored = score_offtargets(guides, chunks, shape_table, model).drop("context", "flank", "edits")
    return format_results(scored, names, within=["guide"], ties=[])


def score_aligner_hits(hits: DataFrame, guide: str, chunks: DataFrame, shape_table, model: TreeEnsemble) -> DataFrame:
    """Score hits another aligner has found (see ``sources.sam``) for one guide."""
    named = hits.select(F.lit(guide).alias("guide"), "contig", "strand", "start", "end")
    scored = score(sequence_features(aligned_hits(named, chunks), shape_table), model)
    return drop_duplicates(scored.withColumnRenamed("contig", "chrom"), within=["guide"], ties=[])
