"""Candidate sites in sequences: every PAM-adjacent 23-mer on both strands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protoscan.fixed import GUIDE_LEN, PAM_LEN, SHORT_FLANK, SITE_LEN
from protoscan.functions.seq import orient_to_site, oriented
from protoscan.operators.genome import HALO

# Site patterns as read on the plus strand; the minus pattern is the mirror image.
AG_OR_GG = ("[ACGT]{20}.[AG]G", "C[CT].[ACGT]{20}")


def _windows(chunks: DataFrame, patterns: dict[str, str], flank: int) -> DataFrame:
    """Rows (contig, strand, window_start, window) where a pattern fits with its flanks.

    ``patterns`` maps a strand to its pattern as read on the plus strand. One
    regular-expression pass per chunk and strand: the optional group in a look-ahead
    matches at every position, empty where there is no hit, so the array index is the
    offset and overlapping hits are all there. The chunks are read once for both strands.
    """
    passes = [
        F.struct(F.lit(strand).alias("strand"), F.regexp_extract_all("seq", F.lit(f"(?=(.{{{flank}}}{pattern}.{{{flank}}})?)"), F.lit(1)).alias("found"))
        for strand, pattern in patterns.items()
    ]
    return (
        chunks.select("contig", "chunk_start", "core_length", F.explode(F.array(*passes)).alias("_pass"))
        .select("contig", "chunk_start", "core_length", "_pass.strand", F.posexplode("_pass.found").alias("_at", "window"))
        .filter((F.col("window") != "") & (F.col("_at") < F.col("core_length")))
        .select("contig", "strand", (F.col("chunk_start") + F.col("_at") + 1).alias("window_start"), "window")
    )


def scan_sites(chunks: DataFrame, flank: int = SHORT_FLANK, patterns: tuple[str, str] = AG_OR_GG, halo: int = HALO, strands: str = "+-") -> DataFrame:
    """Sites with ``flank`` letters on both sides: contig, strand, start, end, site, context.

    Coordinates are 1-based on the plus strand; the context is turned so that the site can
    be read in it.
    """
    if SITE_LEN + 2 * flank - 1 > halo:
        raise ValueError("the halo is too short for this flank")
    windows = _windows(chunks, {s: p for s, p in zip("+-", patterns) if s in strands}, flank)
    start = F.col("window_start") + flank
    sites = windows.select(
        "contig", "strand", start.alias("start"), (start + SITE_LEN - 1).alias("end"),
        oriented(F.substring("window", flank + 1, SITE_LEN), "strand").alias("site"), "window",
    )
    return sites.withColumn("context", orient_to_site("window", "site")).drop("window")


def as_ontarget_pairs(sites: DataFrame, flank: int = SHORT_FLANK) -> DataFrame:
    """Each site with the guide that matches it: an identity alignment scoring 20."""
    return sites.withColumns({
        "sgrna": F.concat(F.left("site", F.lit(GUIDE_LEN)), F.lit("NGG")),
        "aln_rna": F.concat(F.left("site", F.lit(GUIDE_LEN)), F.lit("NGG")),
        "aln_dna": F.col("site"),
        "pa_score": F.lit(float(SITE_LEN - PAM_LEN)),
        "flank": F.lit(flank),
    })


def pam_windows(chunks: DataFrame, upstream: int, least: int) -> DataFrame:
    """PAMs of two purines with the ``upstream`` letters before them, read on their own strand.

    contig, strand, pam_edge (plus-strand position of the last PAM letter) and window (``upstream`` + 3 letters). At
    least ``least`` letters next to the PAM are A, C, G or T; the others may be anything, and are dots
    beyond the ends of the contig.
    """
    spare = upstream - least
    outer = F.lit("." * spare)
    opens = F.col("chunk_start") == 0
    closes = F.col("chunk_start") + F.length("seq") >= F.col("contig_length")
    # the dots before a contig's first letter count as letters of its first chunk
    padded = chunks.select(
        "contig", (F.col("chunk_start") - F.when(opens, spare).otherwise(0)).alias("chunk_start"),
        (F.col("core_length") + F.when(opens, spare).otherwise(0)).alias("core_length"),
        F.concat(F.when(opens, outer).otherwise(""), F.col("seq"), F.when(closes, outer).otherwise("")).alias("seq"),
    )
    windows = _windows(padded, {"+": f".{{{spare}}}[ACGT]{{{least}}}.[AG][AG]", "-": f"[CT][CT].[ACGT]{{{least}}}.{{{spare}}}"}, 0)
    edge = F.when(F.col("strand") == "+", F.col("window_start") + upstream + PAM_LEN - 1).otherwise(F.col("window_start"))
    return windows.select("contig", "strand", edge.alias("pam_edge"), oriented("window", "strand").alias("window"))
