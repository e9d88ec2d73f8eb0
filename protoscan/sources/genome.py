"""FASTA files and plain sequence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from protoscan.operators.genome import CHUNK, HALO
from protoscan.sources.lines import read_lines


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one upper-case sequence each (file, seq)."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("contig"), "value")
    return text.select("contig", F.upper(F.trim(F.regexp_replace("value", "^\\s+|\\s+$", ""))).alias("seq"))


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """Sequence lines with their contig and offset: file, contig, offset (0-based), letters.

    Every file split works out its own lines: the header above a line, if it is in the
    split, and the letters since then. One summary row per split tells the next one which
    contig is open and how long it is already, so a contig of any size is read by as many
    tasks as it has splits.
    """
    lines = read_lines(spark, path).withColumn("text", F.trim("text")).filter("text != ''")
    is_header = F.startswith("text", F.lit(">"))
    lines = lines.select(
        "file", "block", "line_seq",
        F.when(is_header, F.regexp_extract("text", "^>\\s*(\\S+)", 1)).alias("name"),
        F.when(is_header, F.lit(0)).otherwise(F.length("text")).cast("bigint").alias("n"),
        F.when(~is_header, F.upper("text")).alias("letters"),
    )
    inside = Window.partitionBy("file", "block").orderBy("line_seq").rowsBetween(Window.unboundedPreceding, 0)
    local = lines.withColumns({
        "open": F.last("name", ignorenulls=True).over(inside),
        "headers": F.count("name").over(inside),
        "upto": F.sum("n").over(inside),
    })
    at_header = F.max(F.when(F.col("name").isNotNull(), F.col("upto"))).over(inside)
    local = local.withColumn("since", F.col("upto") - F.coalesce(at_header, F.lit(0)))

    splits = local.groupBy("file", "block").agg(
        F.max_by("open", "line_seq").alias("open"), F.max_by("since", "line_seq").alias("since"), F.max("headers").alias("headers"),
    )
    # one row per split of a file, so the window below is over split counts, not lines
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sections = splits.withColumn("_section", F.sum(F.when(F.col("headers") > 0, 1).otherwise(0)).over(before))
    section = Window.partitionBy("file", F.coalesce("_section", F.lit(0))).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sections.select(
        "file", "block",
        F.last("open", ignorenulls=True).over(whole).alias("carry_open"),
        F.coalesce(F.sum(F.when(F.col("headers") == 0, F.col("since")).otherwise(0)).over(section), F.lit(0)).alias("carry_rest"),
        F.coalesce(F.last(F.when(F.col("headers") > 0, F.col("since")), ignorenulls=True).over(whole), F.lit(0)).alias("carry_since"),
    )
    joined = local.filter("letters is not null").join(carried, ["file", "block"])
    fresh = F.col("headers") > 0
    return joined.select(
        "file",
        F.when(fresh, F.col("open")).otherwise(F.col("carry_open")).alias("contig"),
        (F.col("since") - F.col("n") + F.when(fresh, F.lit(0)).otherwise(F.col("carry_since") + F.col("carry_rest"))).alias("offset"),
        "letters",
    ).filter("contig is not null")


def chunk_lines(lines: DataFrame, size: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Chunk rows (see ``operators.genome``) from sequence lines.

    A line is cut where a chunk or its halo ends, and the pieces are put together per
    chunk: groups hold ``size + halo`` letters at most.
    """
    end = F.col("offset") + F.length("letters")
    first = F.greatest(F.expr(f"(offset - {halo}) div {size}"), F.lit(0))
    touched = F.sequence(first, F.expr(f"(offset + length(letters) - 1) div {size}"))
    low = F.greatest(F.col("offset"), F.col("chunk") * size)
    high = F.least(end, (F.col("chunk") + 1) * size + halo)
    piece = F.substr("letters", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    lengths = lines.groupBy("contig").agg(F.max(end).alias("contig_length"))
    chunks = (
        lines.select("contig", "offset", "letters", F.explode(touched).alias("chunk"))
        .filter(high > low)
        .groupBy("contig", "chunk")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(low.alias("at"), piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    )
    return chunks.join(lengths, "contig").select(
        "contig", "contig_length", "chunk", (F.col("chunk") * size).alias("chunk_start"),
        F.least(F.lit(size).cast("bigint"), F.col("contig_length") - F.col("chunk") * size).alias("core_length"), "seq",
    ).filter("core_length > 0")


def read_fasta(spark: SparkSession, path: str, size: int = CHUNK, halo: int = HALO) -> DataFrame:
    """A FASTA genome as chunk rows, ready to be written as Parquet."""
    return chunk_lines(read_fasta_lines(spark, path), size, halo)


def write_genome(chunks: DataFrame, path: str, genome: str | None = None) -> None:
    """Store chunk rows sorted by contig and chunk, so that point reads skip row groups.

    With ``genome`` the rows go into a store of several genomes, one partition each; writing one again
    replaces it and leaves the others. Joins on ``genome`` then read the genomes asked for only.
    """
    if genome is None:
        chunks.repartitionByRange("contig", "chunk").sortWithinPartitions("contig", "chunk").write.mode("overwrite").parquet(path)
    else:
        write_genome(chunks, f"{path.rstrip('/')}/genome={genome}")


def read_genomes(spark: SparkSession, path: str) -> DataFrame:
    """The store as chunk rows with a ``genome`` column."""
    return spark.read.parquet(path)


def fasta_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Identifier (header text before the last ``chr``) and the sequence line read last for it."""
    lines = read_lines(spark, path)
    header = F.regexp_extract("text", "(> ?.*)chr", 1)
    w = Window.partitionBy("file", "block").orderBy("line_seq").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("_id", F.when(header != "", header))
    open_here = named.withColumn("identifier", F.last("_id", ignorenulls=True).over(w))
    tails = open_here.groupBy("file", "block").agg(F.max_by("identifier", "line_seq").alias("_tail"))
    carry = tails.select("file", "block", F.last("_tail", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return (
        open_here.join(carry, ["file", "block"]).withColumn("identifier", F.coalesce("identifier", "_carry"))
        .filter(F.col("_id").isNull() & F.col("text").rlike("(?i)[actg]+") & F.col("identifier").isNotNull())
        .groupBy("identifier").agg(F.max_by("text", F.struct("file", "line_seq")).alias("seq"))
    )
