"""Fill-in-the-middle: a text is cut at two unit borders, and its parts are put in another order behind markers.

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition, so ``match.ends(1)`` holds the borders of all
units: its length is their number n, and the two cut offsets are looked up in it. The function that runs in Python
takes a text and the two numbers drawn for it, and returns n and the two offsets; texts cross to Python once and never back.
Forms, parts and markers are DataFrame expressions.

Every draw is a number of eight hexadecimal digits from the SHA-256 of ``seed:id``, so a document gets the same form and
cuts in any run, on any machine, beside any other documents. Of the two draws for cuts, reduced modulo n + 1, the smaller ends the
prefix, the larger the middle.

A text that is empty or holds a marker stays as it is (form ``plain``), so ``restore`` can always cut the output at its three markers.
Null texts count as empty, a null id as the empty text. Rows are treated one by one: there is no shuffle, repeated rows stay, and
rows of equal id get equal draws. Other columns pass through; those named like an added column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protoscan.llm.common import columns, others

LINES = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
CUTS = "struct<n:bigint,first:bigint,second:bigint>"


@lru_cache(maxsize=8)
def _repeated(unit: str):
    import regex

    return regex.compile(f"((?>{unit}))*+")  # a unit once matched is never taken back


def cut(text: str, unit: str, first: int, second: int) -> tuple[int, int, int]:
    """(n, end of the prefix, end of the middle) in code points; the draws count modulo n + 1."""
    match = _repeated(unit).fullmatch(text)
    if match is None:
        raise ValueError("the units do not cover the text")
    ends = [0, *match.ends(1)]
    low, high = sorted((first % len(ends), second % len(ends)))
    return len(ends) - 1, ends[low], ends[high]


def _cuts(unit: str):
    @F.arrow_udf(CUTS)
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            found = [cut(t.as_py(), unit, a.as_py(), b.as_py()) for t, a, b in zip(texts, first, second)]  # one text at a time
            n, low, high = zip(*found) if found else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, low, high)], names=["n", "first", "second"])

    return cuts


def draw(number: int, id_column: str, seed: int) -> Column:
    """The ``number``-th (from 1) group of eight digits of the id's hash, as an unsigned integer."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * number - 7, 8), 16, 10).cast("bigint")


def rearrange(df: DataFrame, id_column: str = "doc_id", text: str = "text", unit: str = LINES, markers: tuple[str, str, str] = MARKERS, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """``df`` with n, form, prefix_chars, middle_chars and output.

    ``rate``: per cent of the texts that are rearranged at all. ``spm``: per cent of those whose suffix comes first.
    ``markers`` stand before prefix, suffix and middle.
    """
    p, s, m = map(F.lit, markers)
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = columns(others(df, *added))
    whole = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"), *[draw(i, id_column, seed).alias(f"__h{i}") for i in (1, 2, 3, 4)])
    marked = whole.select("*", _cuts(unit)("__text", "__h1", "__h2").alias("__cut"))
    holds = F.contains("__text", p) | F.contains("__text", s) | F.contains("__text", m)
    form = F.when((F.col("__text") == "") | holds | (F.col("__h3") % 100 >= rate), PLAIN).when(F.col("__h4") % 100 < spm, SPM).otherwise(PSM)
    parts = marked.select("*", form.alias("__form"), F.col("__cut.first").alias("__first"), (F.col("__cut.second") - F.col("__cut.first")).alias("__middle"))
    at = F.col("__first").cast("int")
    prefix = F.substr("__text", F.lit(1), at)
    middle = F.substr("__text", at + 1, F.col("__middle").cast("int"))
    suffix = F.substr("__text", F.col("__cut.second").cast("int") + 1, F.length("__text"))
    output = (
        F.when(F.col("__form") == PLAIN, F.col("__text"))
        .when(F.col("__form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    cut_up = F.col("__form") != PLAIN
    return parts.select(
        *kept, F.col("__cut.n").alias("n"), F.col("__form").alias("form"),
        F.when(cut_up, F.col("__first")).alias("prefix_chars"), F.when(cut_up, F.col("__middle")).alias("middle_chars"), output.alias("output"))


def restore(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from which ``rearrange`` made an output; the markers are in it once each, in the order of its form."""
    parts = F.split(F.col(output), "|".join(re.escape(x) for x in markers), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return F.when(F.col(form) == PSM, F.concat(piece(1), piece(3), piece(2))).when(F.col(form) == SPM, F.concat(piece(2), piece(3), piece(1))).otherwise(F.col(output))
