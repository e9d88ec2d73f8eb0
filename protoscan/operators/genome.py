"""A genome as rows: fixed-size chunks, each carrying a copy of the letters that follow it.

A chunk row is (contig, contig_length, chunk, chunk_start, core_length, seq). ``seq`` is
the chunk's own letters plus a halo from the next chunk, so any window that starts in
the chunk and is no longer than the halo can be read without a second row. Work is
spread by chunk, never by contig, so one contig holding most of the letters is split
like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protoscan.functions.seq import ColumnOrName, _col, oriented, reverse_complement

CHUNK = 4096
HALO = 256


def chunk_contigs(contigs: DataFrame, contig: str = "contig", seq: str = "seq", size: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Cut whole sequences (one per row) into chunk rows; one linear pass over each text."""
    if halo > size:
        raise ValueError("the halo must fit in the next chunk")
    pieces = F.regexp_extract_all(F.upper(F.col(seq)), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    with_halo = F.transform("_pieces", lambda p, i: F.concat(p, F.coalesce(F.left(F.get("_pieces", i + 1), F.lit(halo)), F.lit(""))))
    # an empty sequence has no pieces, so it needs no filter of its own
    return (
        contigs.select(F.col(contig).alias("contig"), F.length(seq).cast("bigint").alias("contig_length"), pieces.alias("_pieces"))
        .select("contig", "contig_length", F.posexplode(with_halo).alias("chunk", "seq"))
        .select(
            "contig", "contig_length", F.col("chunk").cast("bigint").alias("chunk"),
            (F.col("chunk").cast("bigint") * size).alias("chunk_start"),
            F.least(F.lit(size).cast("bigint"), F.col("contig_length") - F.col("chunk").cast("bigint") * size).alias("core_length"),
            "seq",
        )
    )


def contig_key(contig: ColumnOrName) -> Column:
    """Contig name without ``chr``, so that ``chr7`` and ``7`` name the same contig."""
    return F.regexp_replace(_col(contig), "^chr", "")


def _checked(letters: Column, size: int, halo: int) -> Column:
    """``letters`` if the chunk was cut with this size and halo; another table would give wrong letters, so it raises."""
    reach = F.least(F.col("_length") - F.col("_at"), F.lit(size + halo))
    wrong = (F.col("_at") != F.col("_chunk") * size) | (F.length("_seq") != reach)
    return F.when(wrong, F.raise_error(F.lit(f"the chunk table was not cut with size {size} and halo {halo}"))).otherwise(letters)


def fetch_regions(
    regions: DataFrame, chunks: DataFrame, contig: str = "contig", start: str = "start", end: str = "end",
    out: str = "seq", size: int = CHUNK, halo: int = HALO, longest: int | None = None,
) -> DataFrame:
    """Add the letters of ``start``..``end`` (1-based, both included) and a ``fetch_warning``.

    A region up to the halo is read from the one chunk it starts in, by an equi join on
    (contig, chunk) against a table with one row per key; a longer one is read from every chunk
    it touches and put together again. ``longest``: what no region exceeds, where the caller knows; within
    the halo the second way is left out of the plan. ``size`` and ``halo`` are compared with the chunks that are read.

    A chunk table of several genomes has a ``genome`` column; regions then name theirs in a column of that name.
    """
    by = ["genome"] if "genome" in chunks.columns else []
    ask = regions.withColumns({
        "_key": contig_key(contig),
        "_from": F.greatest(F.col(start), F.lit(1)).cast("bigint"),
        "_to": F.col(end).cast("bigint"),
    })
    have = chunks.select(
        *by, contig_key("contig").alias("_key"), F.col("chunk").alias("_chunk"), F.col("chunk_start").alias("_at"),
        F.col("core_length").alias("_core"), F.col("contig_length").alias("_length"), F.col("seq").alias("_seq"),
    )
    place, kept = [*by, "_key"], [c for c in ask.columns if c != out]
    fits = F.coalesce(F.col("_to") - F.col("_from") < halo, F.lit(True))
    only_short = longest is not None and longest <= halo
    short = F.substr("_seq", (F.col("_from") - F.col("_at")).cast("int"), F.greatest(F.col("_to") - F.col("_from") + 1, F.lit(0)).cast("int"))
    got = (
        (ask if only_short else ask.filter(fits)).withColumn("_chunk", F.expr(f"(_from - 1) div {size}"))
        .join(have, [*place, "_chunk"], "left")
        .withColumn(out, F.coalesce(_checked(short, size, halo), F.lit("")))
        .select(*kept, out)
    )
    if not only_short:
        # the letters of a region depend on nothing but its place, so equal regions are put together once
        first = F.greatest(F.col("_from") - 1, F.col("_at"))
        last = F.least(F.col("_to"), F.col("_at") + F.col("_core"))
        piece = F.substr("_seq", (first - F.col("_at") + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))
        ends = chunks.filter("chunk = 0").select(*by, contig_key("contig").alias("_key"), "contig_length")
        long = (
            ask.filter(~fits).select(*place, "_from", "_to").distinct().join(ends, place).filter("_from <= contig_length")
            .select(*place, "_from", "_to", F.least("_to", "contig_length").alias("_stop"))
            .select(*place, "_from", "_to", F.explode(F.sequence(F.expr(f"(_from - 1) div {size}"), F.expr(f"(_stop - 1) div {size}"))).alias("_chunk"))
            .join(have, [*place, "_chunk"])
            .groupBy(*place, "_from", "_to")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", _checked(piece, size, halo).alias("p")))), lambda x: x["p"]), "").alias("_long"))
        )
        far = ask.filter(~fits).join(long, [*place, "_from", "_to"], "left").withColumn(out, F.coalesce("_long", F.lit(""))).select(*kept, out)
        got = got.unionByName(far)
    asked = F.col(end) - F.col(start) + 1
    warning = (
        F.when(F.length(out) == 0, "no letters at these coordinates")
        .when((F.length(out) > 1) & (F.length(out) < asked), "coordinates run past the end of the contig")
    )
    return got.withColumn("fetch_warning", warning).drop("_key", "_from", "_to")


def site_contexts(loci: DataFrame, chunks: DataFrame, flank: int, site_length: int | None = None, **options) -> DataFrame:
    """Contexts of loci (contig, strand, start, end), read on the locus strand; short ones are flagged.

    ``site_length``: what no locus exceeds, where the caller knows it.
    """
    if site_length is not None:
        options["longest"] = site_length + 2 * flank
    wide = loci.withColumns({"_s": F.col("start") - flank, "_e": F.col("end") + flank})
    got = fetch_regions(wide, chunks, start="_s", end="_e", out="context", **options)
    full = F.length("context") == F.col("_e") - F.col("_s") + 1
    return (
        got.withColumn("context_complete", full)
        .withColumn("context", oriented("context", "strand"))
        .drop("_s", "_e")
    )


def true_coordinates(hints: DataFrame, chunks: DataFrame, seq: str = "seq", offset: int = 100, **options) -> DataFrame:
    """Find ``seq`` near a hinted locus (contig, hint_start, hint_end, strand or null).

    The window reaches ``offset`` letters to both sides; the forward reading wins. As in
    the lookup it stands for, positions count from the window start (0 when clipped).
    """
    # a window that would begin at 0 is clipped to 1 by the fetch, hence the separate origin
    low = F.greatest(F.col("hint_start") - offset, F.lit(0))
    high = F.when(F.col("hint_end") == 0, F.col("hint_start")).otherwise(F.col("hint_end")) + offset
    looked = fetch_regions(
        hints.withColumns({"_low": low, "_high": high}), chunks, start="_low", end="_high", out="_window", **options,
    )
    wanted = F.upper(F.col(seq))
    forward = F.when(F.coalesce(F.col("strand") == "+", F.lit(True)), F.instr("_window", wanted)).otherwise(0)
    backward = F.when(F.coalesce(F.col("strand") == "-", F.lit(True)), F.instr("_window", reverse_complement(seq))).otherwise(0)
    at = F.when(F.col("_fwd") > 0, F.col("_fwd")).otherwise(F.col("_rev"))
    found = (F.col("_fwd") > 0) | (F.col("_rev") > 0)
    return (
        looked.withColumns({"_fwd": forward, "_rev": backward})
        .withColumns({
            "found_start": F.when(found, F.col("_low") + at - 1),
            "found_end": F.when(found, F.col("_low") + at - 2 + F.length(seq)),
            "found_strand": F.when(F.col("_fwd") > 0, "+").when(F.col("_rev") > 0, "-"),
        })
        .drop("_low", "_high", "_window", "_fwd", "_rev", "fetch_warning")
    )


def five_prime_extension(loci: DataFrame, chunks: DataFrame, extension: int = 3, site: str = "site", **options) -> DataFrame:
    """Letters of a locus with ``extension`` more on its 5' side, and whether the rest equals the site."""
    minus = F.col("strand") == "-"
    wide = loci.withColumns({
        "_s": F.when(minus, F.col("start")).otherwise(F.col("start") - extension),
        "_e": F.when(minus, F.col("end") + extension).otherwise(F.col("end")),
    })
    got = fetch_regions(wide, chunks, start="_s", end="_e", out="extended", **options)
    return (
        got.withColumn("extended", oriented("extended", "strand"))
        .withColumn("consistent", F.substr("extended", F.lit(extension + 1), F.length("extended")) == F.upper(F.col(site)))
        .drop("_s", "_e", "fetch_warning")
    )
