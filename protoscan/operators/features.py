"""The 48 sequence features of an aligned guide/site pair, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protoscan.fixed import SEQUENCE_FEATURES, SHORT_FLANK, SITE_LEN
from protoscan.functions import aligned
from protoscan.functions.seq import ColumnOrName, _col, codes, enthalpy, gc_content, occurrences, without_gaps
from protoscan.functions.shape import SHAPE_NAMES, shape_features

AFTER_PAM = 5


def pam_codes(site: ColumnOrName, aln_dna: ColumnOrName) -> list[Column]:
    coded = codes(site)
    return [
        F.right(coded, F.lit(2)).alias("PAM_2_first"),
        F.substring(coded, -3, 1).alias("PAM_N_id"),
        codes(F.left(without_gaps(aln_dna), F.lit(1))).alias("last_nucleotide"),
    ]


def proximal_couples(site: ColumnOrName) -> list[Column]:
    return [F.substring(codes(site), -8 + i, 2).alias(f"PamProximalCouple{i + 1}") for i in range(4)]


def position_ids(site: ColumnOrName) -> list[Column]:
    return [F.substring(codes(site), -8 + i, 1).alias(f"id_pos{5 - i}") for i in range(5)]


def after_pam_codes(context: ColumnOrName, flank: ColumnOrName) -> list[Column]:
    """Codes of the five letters after a 23-nt site; a short context has three and two zeros."""
    f = _col(flank)
    coded = codes(F.substr(_col(context), f + SITE_LEN + 1, F.lit(AFTER_PAM)))
    out = []
    for i in range(AFTER_PAM):
        code = F.substring(coded, i + 1, 1)
        out.append((code if i < SHORT_FLANK else F.when(f > SHORT_FLANK, code).otherwise("0")).alias(f"nuc_id_afterPAM{i + 1}"))
    return out


def nucleotide_counts(aln_dna: ColumnOrName) -> list[Column]:
    bare = without_gaps(aln_dna)
    return [occurrences(bare, x).alias("n" + x) for x in "ACTG"]


def alignment_counts(df: DataFrame, aln_rna: str = "aln_rna", aln_dna: str = "aln_dna") -> DataFrame:
    """Bulges, mismatches by place and class, and inconsistency runs of an aligned pair."""
    spaced = df.withColumn("_ops", aligned.operations(aln_rna, aln_dna)).withColumn("_spacer", aligned.protospacer("_ops"))
    counted = spaced.select(
        *df.columns, "_spacer",
        aligned.count_in("_ops", "D").alias("rna_bulges"), aligned.count_in("_ops", "I").alias("dna_bulges"),
        aligned.mismatch_count("_spacer").alias("mms_cnt"),
        aligned.inconsistency_runs("_spacer").alias("continuous_inconsistencies_cnt"),
        *aligned.quartet_mismatches("_spacer"), *aligned.mismatch_types("_spacer"),
    )
    total = F.col("rna_bulges") + F.col("dna_bulges")
    runs = F.col("continuous_inconsistencies_cnt")
    return counted.withColumns({
        "total_bulges": total,
        "continuous_inconsistencies_length": F.when(runs > 0, (F.col("mms_cnt") + total) / runs).otherwise(F.lit(0.0)),
    }).drop("_spacer")


def site_features(df: DataFrame) -> DataFrame:
    """Features that need only site, context, flank and aln_dna."""
    return enthalpies(site_codes(df))


def site_codes(df: DataFrame) -> DataFrame:
    """``site_features`` without the enthalpies."""
    return df.select(
        "*", *pam_codes("site", "aln_dna"), *proximal_couples("site"), *position_ids("site"),
        gc_content("context").alias("extended_genomic_GC_content"),
        *nucleotide_counts("aln_dna"), *after_pam_codes("context", "flank"),
    )


def enthalpies(df: DataFrame) -> DataFrame:
    """The enthalpies of the site and of its context."""
    return df.select("*", enthalpy("site").alias("dna_enthalpy"), enthalpy("context").alias("extended_dna_enthalpy"))


def shape_columns(df: DataFrame, shape_table) -> DataFrame:
    """The eight shape features of the 29 letters around the site start."""
    core = F.substr("context", F.col("flank") - SHORT_FLANK + 1, F.lit(SITE_LEN + 2 * SHORT_FLANK))
    return df.withColumn("_shape", shape_features(shape_table)(core)).select(*df.columns, *[F.col("_shape")[n].alias(n) for n in SHAPE_NAMES])


def sequence_features(df: DataFrame, shape_table) -> DataFrame:
    """All 48 features behind the given columns, in model order.

    Needs site, context (read on the site's strand), flank, aln_rna, aln_dna, pa_score.
    """
    keep = [c for c in df.columns if c not in SEQUENCE_FEATURES]
    # the Arrow function parts the columns into two projections: in a single one all of them together are too much to be compiled well
    built = enthalpies(shape_columns(site_codes(alignment_counts(df)), shape_table))
    return built.select(*keep, *SEQUENCE_FEATURES)
