"""Expressions over an aligned guide/site pair (equal-length text with ``-``).

An aligned pair is first reduced to one *operation string*, one letter per column:

    M match   D gap in the site   I gap in the guide
    W wobble  Y pyrimidine pair   R purine pair   V other transversion   X undefined

Every count afterwards is plain string arithmetic on it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from protoscan.fixed import GAP, MATCH, MISMATCH, PAM_LEN
from protoscan.functions.seq import ColumnOrName, _col

# Letters per guide/site combination, rows and columns in the order "other, A, C, G, T".
_LETTERS = "ACGT"
_CLASSES = (
    "XXXXX"
    "XMRVR"
    "XYMYV"
    "XWRMR"
    "XYWYM"
)


def operations(aln_rna: ColumnOrName, aln_dna: ColumnOrName) -> Column:
    """The operation string of an aligned pair, over the whole alignment."""

    def letter(r: Column, d: Column) -> Column:
        cell = F.instr(F.lit(_LETTERS), r) * 5 + F.instr(F.lit(_LETTERS), d)
        return (
            F.when(r == d, "M")
            .when(d == "-", "D")
            .when(r == "-", "I")
            .otherwise(F.substr(F.lit(_CLASSES), cell + 1, F.lit(1)))
        )

    return F.array_join(F.zip_with(F.split(_col(aln_rna), ""), F.split(_col(aln_dna), ""), letter), "")


def protospacer(ops: ColumnOrName) -> Column:
    """Operations before the PAM."""
    ops = _col(ops)
    return F.left(ops, F.length(ops) - PAM_LEN)


def count_in(ops: ColumnOrName, letters: str) -> Column:
    """Columns with any of the letters; few letters are taken out one by one, which is the fast way."""
    ops = _col(ops)
    rest = ops
    for letter in letters:
        rest = F.replace(rest, F.lit(letter))
    return (F.length(ops) - F.length(rest)).cast("bigint")


def mismatch_count(ops: ColumnOrName) -> Column:
    ops = _col(ops)
    return F.length(F.replace(F.replace(F.replace(ops, F.lit("M")), F.lit("D")), F.lit("I"))).cast("bigint")


def match_count(ops: ColumnOrName) -> Column:
    return count_in(ops, "M")


def bulge_count(ops: ColumnOrName) -> Column:
    return count_in(ops, "DI")


def inconsistency_runs(spacer_ops: ColumnOrName) -> Column:
    """Runs of non-matches that a match follows; a run touching the PAM does not count."""
    return F.regexp_count(_col(spacer_ops), F.lit("[^M]+M")).cast("bigint")


def pam_proximal(spacer_ops: ColumnOrName, first: int, length: int | None) -> Column:
    """Alignment columns ``first``.. counted away from the PAM, 1-based."""
    return F.substring(F.reverse(_col(spacer_ops)), first, length if length is not None else 1000)


def quartet_mismatches(spacer_ops: ColumnOrName) -> list[Column]:
    ops = _col(spacer_ops)
    windows = [
        ("mismatches_1_4", 1, 4), ("mismatches_5_8", 5, 4), ("mismatches_9_12", 9, 4),
        ("mismatches_13_16", 13, 4), ("mismatches_17_end", 17, None),
    ]
    return [mismatch_count(pam_proximal(ops, at, n)).alias(name) for name, at, n in windows]


def mismatch_types(spacer_ops: ColumnOrName) -> list[Column]:
    ops = _col(spacer_ops)
    kinds = [("wobble_total", "W"), ("YY_total", "Y"), ("RR_total", "R"), ("Tv_total", "V")]
    return [count_in(ops, letter).alias(name) for name, letter in kinds]


def mismatch_class_at(spacer_ops: ColumnOrName, from_pam: int) -> Column:
    """Class code of the ``from_pam``-th column before the PAM (1 = next to it)."""
    op = F.substring(F.reverse(_col(spacer_ops)), from_pam, 1)
    code = F.translate(op, "MWRYV", "01234")
    return F.when(op.isin("D", "I"), "-1").when(op.isin("X", ""), "-2").otherwise(code)


def rescore(seq1: ColumnOrName, seq2: ColumnOrName) -> Column:
    """Alignment score of two texts, right-aligned to the shorter, PAM left out."""
    a, b = _col(seq1), _col(seq2)
    n = F.least(F.length(a), F.length(b))

    def letter(x: Column, y: Column) -> Column:
        return F.when((x == "-") | (y == "-"), "G").when(x == y, "M").otherwise("X")

    paired = F.zip_with(F.split(F.right(a, n), ""), F.split(F.right(b, n), ""), letter)
    spacer = F.left(F.array_join(paired, ""), n - PAM_LEN)
    return (
        count_in(spacer, "G") * F.lit(GAP)
        + count_in(spacer, "M") * F.lit(MATCH)
        + count_in(spacer, "X") * F.lit(MISMATCH)
    )
