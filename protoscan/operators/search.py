"""Genome-wide search for sites a guide may bind, mismatches and gaps included.

PAM positions are found by the chunk scan, so the genome stays spread over its chunks, is read once and
is never shuffled. The guides go to the tasks (20 bytes each, counted first) and are indexed there by the
edited forms of their halves (``guide_index``): windows are looked up, and only the pairs that the index
finds are compared. A list longer than ``GUIDES_PER_PASS`` is split, each part with a pass of its own.

A hit is a span of 17 to 23 letters before a PAM with two purines that the guide fits with at most
``max_edits`` edits (mismatches and gap letters), of which ``max_gaps`` may be gap letters. The whole site
has a budget too: the PAM's N costs one edit and each A in its last two letters another. Every such span is
reported, so a PAM usually has several rows per guide; ``drop_duplicates`` later keeps the best by score.
Where fewer than 23 letters lie before a PAM (the end of a contig, an N), spans are as long as what is there.
A seed-based aligner prunes a little more, so its hits are a subset of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protoscan.fixed import GUIDE_LEN, LONG_FLANK, PAM_LEN, SEARCH_BUDGET, SEARCH_MAX_EDITS, SEARCH_MAX_GAPS
from protoscan.functions.seq import ColumnOrName, _col
from protoscan.operators.align import align_whole
from protoscan.operators.genome import site_contexts
from protoscan.operators.guide_index import BAD, GuideIndex, codes
from protoscan.operators.scan import pam_windows

GUIDES_PER_PASS = 1_000_000
GUIDES_PER_INDEX = 2_000
WINDOWS_AT_ONCE = 200_000

HIT = "contig string, strand string, pam_edge bigint, guide string, span int, edits int"


@lru_cache(maxsize=1)
def _index(guides: str, max_edits: int, max_gaps: int) -> GuideIndex:
    return GuideIndex(codes([guides], len(guides)).reshape(-1, GUIDE_LEN), max_edits, max_gaps)


def _usable(windows: np.ndarray) -> np.ndarray:
    """Letters ACGT next to the PAM, without a break."""
    bad = windows[:, ::-1] == BAD
    return np.where(bad.any(axis=1), bad.argmax(axis=1), windows.shape[1])


def _matcher(guides: str, max_edits: int, max_gaps: int, budget: int):
    """The function over batches of windows; ``guides``: the letters of all guides."""
    upstream = GUIDE_LEN + max_gaps
    per_index = GUIDES_PER_INDEX * GUIDE_LEN

    def match(table: pa.Table) -> pa.RecordBatch:
        letters = codes(table["window"].to_pylist(), upstream + PAM_LEN)
        pam = letters[:, -2:]
        spent = 1 + (pam != codes(["G"], 1)[0, 0]).sum(axis=1)
        windows = letters[:, :upstream]
        have, limits = _usable(windows), np.minimum(max_edits, budget - spent)
        parts = []
        for low in range(0, len(guides), per_index):
            part = guides[low : low + per_index]
            w, g, span, edits = _index(part, max_edits, max_gaps).hits(windows, have, limits)
            parts.append((w, g + low // GUIDE_LEN, span, edits))
        w, g, span, edits = map(np.concatenate, zip(*parts))
        at = pa.array(w)
        names = [guides[i * GUIDE_LEN : (i + 1) * GUIDE_LEN] for i in g.tolist()]
        columns = [table[c].combine_chunks().take(at) for c in ("contig", "strand", "pam_edge")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(span, pa.int32()), pa.array(edits, pa.int32())], names=["contig", "strand", "pam_edge", "guide", "span", "edits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= WINDOWS_AT_ONCE:
                yield match(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield match(pa.Table.from_batches(held))

    return run


def searchable(guide: ColumnOrName) -> Column:
    """20 letters ACGT: the one rule for guides that are searched; all others are rejected."""
    return F.coalesce(_col(guide).rlike(f"^[ACGT]{{{GUIDE_LEN}}}$"), F.lit(False))


def rejected_guides(guides: DataFrame, guide: str = "guide") -> DataFrame:
    """The rows of ``guides`` that ``search`` cannot take."""
    return guides.filter(~searchable(guide))


def search(
    guides: DataFrame, chunks: DataFrame, guide: str = "guide", max_edits: int = SEARCH_MAX_EDITS, max_gaps: int = SEARCH_MAX_GAPS,
    budget: int = SEARCH_BUDGET, list_size: int = GUIDES_PER_PASS,
) -> DataFrame:
    """Rows guide, contig, strand, start, end, edits for guides of 20 letters ACGT (no PAM).

    Guides of another form are never cut; ``rejected_guides`` lists them. ``edits`` are those of the guide's own letters.
    """
    wanted = guides.select(F.col(guide).alias("guide")).filter(searchable("guide")).distinct()
    lists = max(1, math.ceil(wanted.count() / list_size))
    windows = pam_windows(chunks, GUIDE_LEN + max_gaps, GUIDE_LEN - max_gaps)
    found = None
    for i in range(lists):
        part = wanted if lists == 1 else wanted.filter(F.pmod(F.xxhash64("guide"), F.lit(lists)) == i)
        letters = "".join(sorted(part.toArrow()["guide"].to_pylist()))
        matched = (windows if letters else windows.limit(0)).mapInArrow(_matcher(letters, max_edits, max_gaps, budget), HIT)
        found = matched if found is None else found.unionByName(matched)
    length = F.col("span") + PAM_LEN
    plus = F.col("strand") == "+"
    return found.select(
        "guide", "contig", "strand",
        F.when(plus, F.col("pam_edge") - length + 1).otherwise(F.col("pam_edge")).alias("start"),
        F.when(plus, F.col("pam_edge")).otherwise(F.col("pam_edge") + length - 1).alias("end"),
        "edits",
    )


def usable_hits(hits: DataFrame) -> DataFrame:
    """Hits with a whole ACGT context, on placed contigs, whose PAM ends in two purines."""
    return hits.filter(
        F.col("context_complete") & ~F.col("context").rlike("[^ACGT]")
        & ~F.contains("contig", F.lit("random")) & F.col("site").rlike("[AG]{2}$")
    )


def aligned_hits(hits: DataFrame, chunks: DataFrame, flank: int = LONG_FLANK, site_length: int | None = None) -> DataFrame:
    """Hits with context, site and the alignment of the guide with the hit's own span, of at most ``site_length`` letters if given."""
    around = site_contexts(hits, chunks, flank, site_length)
    placed = around.withColumn("flank", F.lit(flank)).withColumn("site", F.substr("context", F.lit(flank + 1), F.length("context") - 2 * flank))
    kept = usable_hits(placed).drop("context_complete", "fetch_warning")
    return align_whole(kept.withColumn("sgrna", F.concat("guide", F.lit("NGG"))))
