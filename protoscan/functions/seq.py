"""Sequence expressions. All stay inside built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from protoscan.fixed import ENTHALPY_TENTHS, NUCLEOTIDE_CODE

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(s: ColumnOrName) -> Column:
    """Upper-cased reverse complement, IUPAC ambiguity letters included."""
    return F.reverse(F.translate(F.upper(_col(s)), "ACGTRYKMBVDHU", "TGCAYRMKVBHDA"))


def oriented(s: ColumnOrName, strand: ColumnOrName) -> Column:
    """The sequence as read on ``strand``: reverse complemented for ``-`` only."""
    return F.when(_col(strand) == "-", reverse_complement(s)).otherwise(_col(s))


def orient_to_site(context: ColumnOrName, site: ColumnOrName) -> Column:
    """Turn the context round when the site cannot be read in it."""
    return F.when(F.contains(_col(context), _col(site)), _col(context)).otherwise(reverse_complement(context))


def without_gaps(s: ColumnOrName) -> Column:
    return F.replace(_col(s), F.lit("-"))


def letters_only(s: ColumnOrName) -> Column:
    """Keep nucleotide letters, drop gaps and anything else."""
    return F.regexp_replace(_col(s), "[^ACGTacgt]", "")


def resolve_ambiguous(s: ColumnOrName) -> Column:
    """Replace non-ACGT letters by a fixed choice, so results do not vary by run.

    An IUPAC letter becomes the first nucleotide it stands for, all else ``A``.
    """
    known = F.translate(_col(s), "RYSWKMBDHVN", "ACCAGACAAAA")
    return F.when(_col(s).rlike("[^ACGT]"), F.regexp_replace(known, "[^ACGT]", "A")).otherwise(_col(s))


def codes(s: ColumnOrName) -> Column:
    """One digit per letter; letters without a code become 0."""
    known = "".join(NUCLEOTIDE_CODE)
    digits = "".join(NUCLEOTIDE_CODE.values())
    return F.translate(F.regexp_replace(_col(s), f"[^{known}]", "N"), known, digits)


def occurrences(s: ColumnOrName, word: str) -> Column:
    """Non-overlapping occurrences of ``word``, as a bigint."""
    gone = F.length(_col(s)) - F.length(F.replace(_col(s), F.lit(word)))
    return (gone / len(word)).cast("bigint") if len(word) > 1 else gone.cast("bigint")


def gc_content(s: ColumnOrName) -> Column:
    up = F.upper(_col(s))
    return (F.length(up) - F.length(F.replace(F.replace(up, F.lit("C")), F.lit("G")))) / F.length(up)


def enthalpy_tenths(s: ColumnOrName) -> Column:
    """Sum of the dinucleotide enthalpies times ten, exact in integers.

    Two different letters cannot overlap with themselves, so removing a word counts
    it. A doubled letter is counted as the letters left over once those followed
    by another letter, or by the end, are taken off.
    """
    s = resolve_ambiguous(s)
    count = {}
    for x in "ACGT":
        followed = F.when(F.endswith(s, F.lit(x)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        for y in "ACGT":
            if y != x:
                count[x + y] = occurrences(s, x + y)
                followed = followed + count[x + y]
        count[x + x] = occurrences(s, x) - followed
    total = F.lit(0).cast("bigint")
    for pair, tenths in ENTHALPY_TENTHS.items():
        total = total + count[pair] * tenths
    return total


def enthalpy(s: ColumnOrName) -> Column:
    return enthalpy_tenths(s) / F.lit(10.0)
