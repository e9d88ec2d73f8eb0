"""Regions kept in transcripts, folded from a file of splice events.

Events are rows in file order. Consecutive rows of one accession form a run; within a run
the updates only remove exons or add introns, so they commute and a set per run is enough.
File order is needed just for telling runs apart, and that is done by range partitions of
the line number (see ``ordered``), not by one window over the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protoscan.operators.ordered import in_order, running_sum, with_previous

# --- fixed values: event types and what they do --------------------------------
REMOVES_EXONS = ["exon skipped", "exons skipped"]
NO_EVENT = "---"
INCLUDES_INTRON = ["intron retention", "novel exon", "novel exons"]


def in_coding_part(region: Column, location: Column) -> Column:
    return (region == "CDS") & ~location.startswith("<<<") & ~location.endswith(">>>")


def event_exons(location: Column, exons: Column) -> Column:
    """``x`` or ``x..y`` (any separator) as the ascending range of exon numbers; null if it reaches beyond ``exons``."""
    first = F.regexp_extract(location, "^([0-9]+)", 1).try_cast("bigint")
    last = F.regexp_extract(location, "([0-9]+)$", 1).try_cast("bigint")
    # the numbers are text from a file: compared before a range is made of them
    return F.when(F.greatest(first, last) <= exons, F.sequence(F.least(first, last), F.greatest(first, last)))


def block_exons(starts: Column, sizes: Column) -> Column:
    """Exon (start, end) pairs of alignment blocks given as 0-based starts and sizes."""
    return F.transform(
        F.arrays_zip(starts.alias("s"), sizes.alias("n")),
        lambda b: F.struct((b["s"] + 1).alias("start"), (b["s"] + b["n"]).alias("end")),
    )


def best_alignments(psl: DataFrame) -> DataFrame:
    """Per accession the alignment with most matches, the first one on ties."""
    kept = F.struct("chrom", "strand", "starts", "sizes")
    best = F.max_by(kept, F.struct(F.col("matches"), -F.col("line")))
    return (
        psl.groupBy("accession").agg(best.alias("b"))
        .select("accession", "b.chrom", "b.strand", block_exons(F.col("b.starts"), F.col("b.sizes")).alias("exons"))
    )


def first_coding_feature(features: DataFrame) -> DataFrame:
    """Location of the first CDS feature of each record (accession, type, position, location)."""
    return features.filter("type = 'CDS'").groupBy("accession").agg(F.min_by("location", "position").alias("location"))


def exon_features(features: DataFrame) -> DataFrame:
    return features.filter("type = 'exon'").select("accession", "position", "location")


def usable_events(events: DataFrame, genes: DataFrame) -> DataFrame:
    """Coding events with ``_n``, the exons of their gene, and ``listed``, their own exons.

    Rows of type ``---`` and rows that reach beyond the last exon are passed over as if they
    were not there: they neither open a run nor give it a value. Rows of unknown accessions stay, since they part runs.
    """
    coding = events.filter(in_coding_part(F.col("region"), F.col("location")))
    sized = coding.join(genes.select("accession", F.size("exons").alias("_n")), "accession", "left")
    listed = sized.withColumn("listed", event_exons(F.col("location"), F.col("_n")))
    return listed.filter(F.col("_n").isNull() | ((F.col("event_type") != NO_EVENT) & F.col("listed").isNotNull()))


def event_runs(coding: DataFrame) -> DataFrame:
    """Usable events with their run number; a repeat of the row before is left out."""
    ordered = with_previous(in_order(coding, [F.col("line").asc()]), ["accession", "location", "event_type"])
    changed = ~F.col("accession").eqNullSafe(F.col("prev_accession"))
    runs = running_sum(ordered, F.when(changed, 1).otherwise(0), "run")
    repeat = ~changed & F.col("location").eqNullSafe(F.col("prev_location")) & F.col("event_type").eqNullSafe(F.col("prev_event_type"))
    return runs.filter(~repeat).drop("_part", "_row", "prev_accession", "prev_location", "prev_event_type")


def fold_events(events: DataFrame, genes: DataFrame, intron_to_next_end: bool = True, flush_last: bool = True) -> DataFrame:
    """Kept exons and included introns of every run.

    events: line, accession, entrez, event_type, region, location, c4, c5, c6.
    genes: accession, chrom, strand, exons (array of start, end). Runs of unknown
    accessions give nothing. An included intron reaches to the end of the next exon
    unless ``intron_to_next_end`` is off.
    """
    runs = event_runs(usable_events(events, genes))
    if not flush_last:
        last = runs.agg(F.max("run").alias("_last"))
        runs = runs.join(F.broadcast(last), F.col("run") < F.col("_last")).drop("_last")
    sized = runs.filter(F.col("_n").isNotNull())
    removed = F.when(F.col("event_type").isin(REMOVES_EXONS), F.col("listed"))
    intron = F.when(F.col("event_type").isin(INCLUDES_INTRON) & (F.array_min("listed") < F.col("_n")), F.array_min("listed"))
    effects = F.concat(
        F.coalesce(F.transform(removed, lambda x: F.struct(x.alias("at"), F.lit(True).alias("exon"))), F.array()),
        F.when(intron.isNotNull(), F.array(F.struct(intron.alias("at"), F.lit(False).alias("exon")))).otherwise(F.array()),
    )
    # sets of exon numbers: their size is bounded by the exons of the gene
    folded = (
        sized.select("run", "accession", "line", "entrez", ((F.col("c4") + F.col("c5") + F.col("c6")) / 3.0).alias("mean"), F.explode_outer(effects).alias("fx"))
        .groupBy("run", "accession")
        .agg(
            F.collect_set(F.when(F.col("fx.exon"), F.col("fx.at"))).alias("removed"),
            F.collect_set(F.when(~F.col("fx.exon"), F.col("fx.at"))).alias("introns"),
            F.min_by("mean", "line").alias("value"), F.max_by("entrez", "line").alias("entrez"),
        )
    )
    here = F.col("exons")
    placed = folded.join(genes, "accession")
    numbered = F.transform(here, lambda e, i: F.struct((i + 1).cast("bigint").alias("at"), e["start"].alias("start"), e["end"].alias("end"), F.get(here, i + 1).alias("next")))
    kept = F.transform(
        F.filter(numbered, lambda e: ~F.array_contains("removed", e["at"])),
        lambda e: F.struct(F.lit("exon").alias("type"), e["at"].alias("at"), e["start"].cast("bigint").alias("start"), e["end"].cast("bigint").alias("end")),
    )
    included = F.transform(
        F.filter(numbered, lambda e: F.array_contains("introns", e["at"]) & e["next"].isNotNull()),
        lambda e: F.struct(F.lit("intron").alias("type"), e["at"].alias("at"), e["end"].cast("bigint").alias("start"),
                           (e["next"]["end"] if intron_to_next_end else e["next"]["start"]).cast("bigint").alias("end")),
    )
    return (
        placed.select("run", "accession", "chrom", "strand", "entrez", "value", F.explode(F.concat(kept, included)).alias("r"))
        .select("run", "accession", "r.type", "chrom", F.col("r.at").alias("number"), "r.start", "r.end", "strand", "entrez", "value")
    )
