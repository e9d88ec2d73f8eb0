"""Input rules for guides, contexts and loci, as expressions.

Nothing is dropped here: each rule yields the normalised value plus a reason text,
so that a caller can keep the good rows and write the others to a reject table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protoscan.fixed import (
    CELL_LINES, CHROMOSOME_NUMBER, GUIDE_LEN, LONG_CONTEXT, LONG_FLANK, PAM_LEN, SHORT_CONTEXT,
    SHORT_FLANK, SITE_LEN,
)
from protoscan.functions.seq import ColumnOrName, _col


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def carries_pam(guide: ColumnOrName) -> Column:
    """A 23-nt guide that ends in GG was given with its PAM."""
    g = _col(guide)
    return (F.length(g) == SITE_LEN) & F.upper(g).endswith("GG")


def normalise_guide(guide: ColumnOrName) -> Column:
    """Upper-case DNA letters, any PAM cut off, and NGG put behind."""
    g = _col(guide)
    bare = F.when(carries_pam(g), F.left(g, F.length(g) - PAM_LEN)).otherwise(g)
    return F.concat(F.translate(F.upper(bare), "U", "T"), F.lit("NGG"))


def guide_is_valid(guide: ColumnOrName) -> Column:
    """The first run of nucleotide letters of a normalised guide is 20 long."""
    return F.length(F.regexp_extract(_col(guide), "[AGCTU]+", 0)) == GUIDE_LEN


def guide_warning(guide: ColumnOrName) -> Column:
    return F.when(carries_pam(guide), F.lit("guide was cut to 20 nt: its NGG end was removed"))


def context_is_valid(context: ColumnOrName) -> Column:
    """Exactly 29 or 223 letters, all of them A, C, G or T."""
    return _col(context).rlike(f"^([ACGTacgt]{{{SHORT_CONTEXT}}}|[ACGTacgt]{{{LONG_CONTEXT}}})$")


def context_flank(context: ColumnOrName) -> Column:
    """Letters on each side of the site: 100 for a long context, else 3."""
    return F.when(F.length(_col(context)) == LONG_CONTEXT, F.lit(LONG_FLANK)).otherwise(F.lit(SHORT_FLANK))


def site_of(context: ColumnOrName, flank: ColumnOrName) -> Column:
    c, f = _col(context), _col(flank)
    return F.substr(c, f + 1, F.length(c) - 2 * f)


def model_mode(has_context: ColumnOrName, genome: ColumnOrName, flank: ColumnOrName) -> Column:
    """Which model family scores the row; genome tracks exist for hg19 only."""
    return (
        F.when(~_col(has_context) & (_col(genome) == "hg19"), "genomic")
        .when(_col(flank) == LONG_FLANK, "flanking")
        .otherwise("noflanking")
    )


def normalise_chromosome(chrom: ColumnOrName) -> Column:
    """``chr`` plus the bare name, upper-cased unless it is a number."""
    bare = F.regexp_replace(_col(chrom), "^[cC][hH][rR]", "")
    return F.concat(F.lit("chr"), F.upper(bare))


def normalise_strand(strand: ColumnOrName) -> Column:
    s = _col(strand)
    return F.when(s == "plusStrand", "+").when(s == "minusStrand", "-").otherwise(s)


def cell_line(alias: ColumnOrName) -> Column:
    """Canonical cell-line name; null when the alias is unknown."""
    return F.element_at(_literal_map(CELL_LINES), _col(alias))


def chromosome_number(chrom: ColumnOrName) -> Column:
    """Digits of the chromosome name, with X, Y and M numbered 23 to 25."""
    name = F.regexp_extract(_col(chrom), "chr([XYM0-9]+)", 1)
    named = F.element_at(_literal_map(CHROMOSOME_NUMBER), name)
    return F.coalesce(named, F.when(name != "", name))


def is_assembled_chromosome(chrom: ColumnOrName) -> Column:
    return _col(chrom).rlike("^chr[XYM0-9]+$")


def check_pairs(df: DataFrame, guide: str = "guide", context: str = "context") -> DataFrame:
    """Add sgrna, context, flank, site, mode, warnings and reject_reason to pairs with a context."""
    # one pattern per input column: the reason is what rows are filtered by, next to the scan
    reason = (
        F.when(F.col(context).isNull(), "no genomic sequence")
        .when(~context_is_valid(context), "DNA sequence must be 29 or 223 letters of ACGT")
        .when(~F.coalesce(guide_is_valid(normalise_guide(guide)), F.lit(False)), "guide must be 20 letters of ACGTU")
    )
    return (
        df.withColumns({
            "reject_reason": reason, "sgrna": normalise_guide(guide), "warnings": F.array_compact(F.array(guide_warning(guide))),
            "flank": context_flank(context), context: F.upper(F.col(context)),
        })
        .withColumn("site", site_of(context, "flank"))
        .withColumn("mode", model_mode(F.lit(True), F.lit(None).cast("string"), "flank"))
    )


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows) of a checked table."""
    return checked.filter("reject_reason is null").drop("reject_reason"), checked.filter("reject_reason is not null")
