"""Result tables: duplicates, ranking, decoding and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protoscan.fixed import CODED_FEATURES, MISMATCH_CLASS_NAME, NUCLEOTIDE_CODE, SCORE
from protoscan.functions.validate import _literal_map
from protoscan.operators.ordered import number_rows

LOCUS = ["chrom", "strand", "start", "end"]


def _best_first(df: DataFrame, score: str, ties: list[str] | None) -> list[Column]:
    """A total order: score descending, then locus, then ``ties`` (by default every other column).

    Naming the columns that settle a tie keeps the sort keys short on wide tables.
    """
    place = [c for c in LOCUS if c in df.columns]
    rest = [c for c in df.columns if c not in place + [score]] if ties is None else ties
    return [F.col(score).isNull(), -F.col(score)] + [F.col(c) for c in place + rest]


def keep_best(df: DataFrame, keys: list[str], score: str = SCORE, ties: list[str] | None = None) -> DataFrame:
    """The first row per key in best-first order, by an aggregate that combines before the shuffle.

    Keys that are null equal each other. Many copies of one key shrink to one row per
    task before they are sent anywhere.
    """
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_best_first(df, score, ties))])
    row = F.struct(*df.columns)
    return (
        df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(F.min_by(row, order).alias("_row"))
        .select("_row.*")
    )


def drop_duplicates(df: DataFrame, score: str = SCORE, within: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Best row per start, then best row per end; the order of the two matters."""
    extra = within or []
    by_start = keep_best(df, extra + ["chrom", "strand", "start"], score, ties)
    return keep_best(by_start, extra + ["chrom", "strand", "end"], score, ties)


def rank_by_score(df: DataFrame, score: str = SCORE, within: list[str] | None = None, out: str = "rank", ties: list[str] | None = None) -> DataFrame:
    """Rank 1, 2, ... by score, ties by locus; per ``within`` group if given."""
    return number_rows(df, [c.asc() for c in _best_first(df, score, ties)], out, within)


def decode_nucleotides(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Digit codes back to letters; a code outside the table becomes null."""
    single = {v: k for k, v in NUCLEOTIDE_CODE.items()}
    pairs = {x + y: single[x] + single[y] for x in "1234" for y in "1234"}
    table = _literal_map({**pairs, **single})
    wanted = [c for c in (columns or CODED_FEATURES) if c in df.columns]
    return df.withColumns({c: F.element_at(table, F.col(c).cast("string")) for c in wanted}) if wanted else df


def decode_mismatch_classes(df: DataFrame, prefix: str = "MM_in_site_") -> DataFrame:
    """Class codes back to names, on the per-position columns if the table has any."""
    wanted = [c for c in df.columns if c.startswith(prefix)]
    table = _literal_map(MISMATCH_CLASS_NAME)
    return df.withColumns({c: F.element_at(table, F.col(c).cast("string")) for c in wanted}) if wanted else df


def positions_to_integers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")}).drop("index")


def rename_for_display(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Display names where there is one, the code name otherwise."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v is not None})


def read_display_names(table: DataFrame, max_rows: int = 10_000) -> dict[str, str]:
    """Mapping of feature code to display name from a table with ``feature`` and ``display_name``."""
    rows = table.select("feature", "display_name").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("a display-name table has one row per column; this one is far too long")
    return {r["feature"]: r["display_name"] for r in rows}


def format_results(df: DataFrame, names: dict[str, str] | None = None, within: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Ranked, decoded and renamed table for export."""
    ranked = positions_to_integers(rank_by_score(df, within=within, ties=ties))
    decoded = decode_mismatch_classes(decode_nucleotides(ranked))
    return rename_for_display(decoded, names or {})
