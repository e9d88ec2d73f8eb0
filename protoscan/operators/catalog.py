"""Genome-assembly catalog: download addresses, last use and eviction, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: address patterns and the eviction age ------------------------
UCSC_ADDRESS = "http://hgdownload.cse.ucsc.edu/goldenPath/{0}/bigZips/{0}.fa.gz"
PLANTS_ADDRESS = "ftp://ftp.ensemblgenomes.org/pub/plants/release-44/fasta/{0}/dna/"
MONTH_DAYS = 30
EVICTION_MONTHS = 6


def _filled(pattern: str, name: Column) -> Column:
    return F.replace(F.lit(pattern), F.lit("{0}"), name)


def resolve_addresses(requests: DataFrame, refseq: DataFrame, plants: DataFrame) -> DataFrame:
    """Address and its origin per requested assembly: RefSeq first, then plants, else UCSC.

    refseq: assembly, url, load_seq. plants: value, assembly_name, load_seq. The first
    catalog line of a name counts. For plants the address is the folder to look in.
    """
    by_refseq = refseq.groupBy("assembly").agg(F.min_by("url", "load_seq").alias("_url"))
    by_plant = plants.groupBy(F.col("value").alias("assembly")).agg(F.min_by("assembly_name", "load_seq").alias("_plant"))
    return (
        requests.join(by_refseq, "assembly", "left").join(by_plant, "assembly", "left")
        .withColumns({
            "origin": F.when(F.col("_url").isNotNull(), "refseq").when(F.col("_plant").isNotNull(), "plants").otherwise("ucsc"),
            "address": F.coalesce("_url", _filled(PLANTS_ADDRESS, F.col("_plant")), _filled(UCSC_ADDRESS, F.col("assembly"))),
        })
        .drop("_url", "_plant")
    )


def is_older(last_use: Column, now: Column, months: int = EVICTION_MONTHS) -> Column:
    return last_use < F.date_sub(now, months * MONTH_DAYS)


def parse_last_use(text: Column) -> Column:
    """Month/day/two-digit-year text as a date."""
    return F.to_date(text, "MM/dd/yy")


def evictable(assemblies: DataFrame, now: Column, months: int = EVICTION_MONTHS) -> DataFrame:
    """Assemblies neither protected nor in work whose last use is long ago or unknown."""
    return assemblies.filter(
        ~F.col("protected") & ~F.col("processing") & (F.col("last_use").isNull() | is_older(F.col("last_use"), now, months))
    )


def genomes_in_use(script_lines: DataFrame) -> DataFrame:
    """Distinct genomes named by ``-g`` in the last line of each script (script, line, text)."""
    last = script_lines.groupBy("script").agg(F.max_by("text", "line").alias("text"))
    genome = F.trim(F.regexp_extract("text", "-g (.*?) ", 1))
    return last.select(genome.alias("genome")).filter("genome != ''").distinct()
