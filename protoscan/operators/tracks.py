"""Genome-annotation features of sites.

Sites have chrom, strand, start and end (1-based, closed). Tracks have chrom, start, end,
value and load_seq (the order in which the lines were read; later lines overwrite earlier
ones), plus track_strand and replicate where the feature needs them.

A text value always counts as present, whatever it says. A numeric value of 0 counts as
absent, so the lookup falls through to the other end of the site and then to the default.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from protoscan.fixed import GENOME_FEATURES, NO_DATA, REPEAT_CLASS, REPEAT_FAMILY, SUBCOMPARTMENT
from protoscan.functions.validate import _literal_map, is_assembled_chromosome
from protoscan.operators.bounded import broadcast_if_small
from protoscan.operators.intervals import annotate, annotations, last_loaded, walked_distance, walks
from protoscan.operators.tiles import LONGEST_SITE, Letters, sweep
from protoscan.session import materialise

_PLACE = ["chrom", "start", "end"]
_STRANDED = ["chrom", "strand", "start", "end"]
_LINE = ["genome", "cell_line"]
# --- fixed values: walking steps ------------------------------------------------------
DNASE_STEP = 50
DNASE_STEPS = 100
NUCLEOSOME_STEPS = 1000
LINES = 10_000
_NEVER = -(2**63)


def _first_present(start: Column, end: Column, numeric: bool) -> Column:
    if numeric:
        return F.coalesce(F.nullif(start, F.lit(0)), F.nullif(end, F.lit(0)))
    return F.coalesce(start, end)


def _at_ends(sites: DataFrame, track: DataFrame) -> DataFrame:
    """Sites with the track values at their two ends, ``_at_start`` and ``_at_end``."""
    return annotate(
        sites, track, _PLACE, ["chrom"], [],
        {"at_start": F.col("start"), "at_end": F.col("end")},
        {"_at_start": F.max("at_start"), "_at_end": F.max("at_end")},
    )


def _value(track: DataFrame, default, numeric: bool) -> Column:
    found = _first_present(F.col("_at_start"), F.col("_at_end"), numeric)
    return F.coalesce(found, F.lit(default).cast(track.schema["value"].dataType))


def endpoint_value(sites: DataFrame, track: DataFrame, out: str, default, numeric: bool = False) -> DataFrame:
    """Track value at the start of the site, else at its end, else ``default``."""
    return _at_ends(sites, track).withColumn(out, _value(track, default, numeric)).drop("_at_start", "_at_end")


def endpoint_numbers(sites: DataFrame, track: DataFrame, columns: dict[str, Column], default: int = 0) -> DataFrame:
    """Several whole numbers of one track's intervals, each as ``endpoint_value`` with ``numeric`` gives it, from one lookup.

    ``columns`` names them with what they are on ``track``: from -32767 to 32767, or null. They travel as one number.
    """
    if len(columns) > 3:
        raise ValueError("one number holds three columns at most")
    # null is the lowest 16-bit number, one below what a column may hold
    code = F.lit(0).cast("bigint")
    for c in columns.values():
        fits = F.when(c.between(-32767, 32767), c.cast("bigint")).when(c.isNotNull(), F.raise_error(F.lit("a value is too large to be packed")).cast("bigint"))
        code = F.shiftleft(code, 16).bitwiseOR(F.coalesce(fits, F.lit(-32768)).cast("bigint") + 32768)
    got = _at_ends(sites, track.withColumn("value", code))

    def part(at: str, i: int) -> Column:
        number = (F.shiftright(F.col(at), 16 * (len(columns) - 1 - i)).bitwiseAND(65535) - 32768).cast("int")
        return F.nullif(number, F.lit(-32768))

    picked = {n: F.coalesce(_first_present(part("_at_start", i), part("_at_end", i), numeric=True), F.lit(default)) for i, n in enumerate(columns)}
    return got.withColumns(picked).drop("_at_start", "_at_end")


def _located(sites: DataFrame, track: DataFrame) -> DataFrame:
    """Distinct places with the values at their ends, written once: only the misses have to walk."""
    places = sites.select(*_PLACE).distinct()
    return materialise(_at_ends(places, track))


def _walked(sites: DataFrame, located: DataFrame, track: DataFrame, hit: Column, covered: Column, step: int, limit: int, columns: list[str], numeric: bool = False) -> DataFrame:
    """Sites with a value and a distance column (``columns``) of their places."""
    steps = walks(located.filter(~hit & ~covered), track, ["chrom"], step, limit, "_k", numeric)
    measured = located.join(steps, _PLACE, "left").withColumn(columns[1], walked_distance(F.col("_k"), hit, covered, step))
    return sites.join(measured.select(*_PLACE, *columns), _PLACE, "left")


def dnase_signal(sites: DataFrame, track: DataFrame) -> DataFrame:
    """DHS_signalValue (text) and distance_from_DHS in steps of 50, at most 100 of them."""
    located = _located(sites, track).withColumn("DHS_signalValue", _value(track, "0", numeric=False))
    # a peak whose signal is literally "0" reads as a miss and is then met at the first step
    covered = F.col("_at_start").isNotNull() | F.col("_at_end").isNotNull()
    columns = ["DHS_signalValue", "distance_from_DHS"]
    return _walked(sites, located, track, F.col("DHS_signalValue") != "0", covered, DNASE_STEP, DNASE_STEPS, columns)


def nucleosome_signal(sites: DataFrame, track: DataFrame) -> DataFrame:
    """nucleosome_mapping (number) and length_from_nucleosome in single steps, at most 1,000."""
    located = _located(sites, track).withColumn("nucleosome_mapping", _value(track, 0.0, numeric=True))
    columns = ["nucleosome_mapping", "length_from_nucleosome"]
    return _walked(sites, located, track, F.col("nucleosome_mapping") != 0, F.col("_at_end").isNotNull(), 1, NUCLEOSOME_STEPS, columns, numeric=True)


def subcompartment_code(label: Column) -> Column:
    return F.element_at(_literal_map(SUBCOMPARTMENT), label)


def repeat_code(repeat_class: Column, family: Column | None = None) -> Column:
    """Number of a repeat class, or of a class/family pair; question marks are ignored."""
    cls = F.replace(repeat_class, F.lit("?"))
    if family is None:
        return F.element_at(_literal_map(REPEAT_CLASS), cls)
    return F.element_at(_literal_map(REPEAT_FAMILY), F.concat(cls, F.lit("/"), F.replace(family, F.lit("?"))))


def strand_signal(sites: DataFrame, track: DataFrame, replicates: int, own: str, opposite: str) -> DataFrame:
    """Per replicate the larger value just outside both ends, averaged over all replicates, by strand."""
    beside = F.greatest(F.col("before").cast("double"), F.col("after").cast("double"))
    mean = {
        own: F.coalesce(F.sum(F.when(F.col("track_strand") == F.col("strand"), beside)), F.lit(0.0)) / replicates,
        opposite: F.coalesce(F.sum(F.when(F.col("track_strand") != F.col("strand"), beside)), F.lit(0.0)) / replicates,
    }
    got = annotate(
        sites, track, _STRANDED, ["chrom"], ["track_strand", "replicate"],
        {"before": F.col("start") - 1, "after": F.col("end") + 1}, mean,
    )
    return got.fillna(0.0, [own, opposite])


def exon_membership(sites: DataFrame, exons: DataFrame) -> DataFrame:
    """in_NGG_exon and in_opposite_exon (1.0 or 0.0) from exon intervals by strand."""
    one = exons.select("chrom", "start", "end", "load_seq", "track_strand", F.lit(0).alias("replicate"), F.lit("1").alias("value"))
    return strand_signal(sites, one, 1, "in_NGG_exon", "in_opposite_exon")


def gene_membership(sites: DataFrame, genes: DataFrame) -> DataFrame:
    """in_tx and in_cds (1 or 0) from intervals whose ``kind`` is tx or cds.

    Transcripts are tested at the ends of the site, coding parts six letters further in.
    """
    flag = genes.select("chrom", "start", "end", "load_seq", "kind", F.lit(1).alias("value"))
    outer = F.coalesce(F.col("at_start"), F.col("at_end"))
    inner = F.coalesce(F.col("in_start"), F.col("in_end"))
    got = annotate(
        sites, flag, _PLACE, ["chrom"], ["kind"],
        {"at_start": F.col("start"), "at_end": F.col("end"), "in_start": F.col("start") + 6, "in_end": F.col("end") - 6},
        {"in_tx": F.max(F.when(F.col("kind") == "tx", outer)), "in_cds": F.max(F.when(F.col("kind") == "cds", inner))},
    )
    return got.fillna(0, ["in_tx", "in_cds"])


def replicate_mean(sites: DataFrame, track: DataFrame, replicates: int, out: str, stranded: bool = False) -> DataFrame:
    """Mean over replicates of the value at the start, else the end, else 0."""
    value = _first_present(F.col("at_start"), F.col("at_end"), numeric=False).cast("double")
    if stranded:
        value = F.when(F.col("track_strand") == F.col("strand"), value)
    got = annotate(
        sites, track, _STRANDED if stranded else _PLACE, ["chrom"], (["track_strand"] if stranded else []) + ["replicate"],
        {"at_start": F.col("start"), "at_end": F.col("end")},
        {out: F.coalesce(F.sum(value), F.lit(0.0)) / replicates},
    )
    return got.fillna(0.0, [out])


def _with_tables(sites: DataFrame, registry: DataFrame, mark: str) -> DataFrame:
    """Sites with ``_n``, the number of tables of the mark for their genome and cell line; null where there is no data."""
    known = registry.filter(F.col("mark") == mark).groupBy(*_LINE).agg(F.max("replicates").alias("_n"))
    silent = F.col("cell_line").isin(*NO_DATA.get(mark, ()))
    return sites.join(broadcast_if_small(known.filter((F.col("_n") > 0) & ~silent)), _LINE, "left")


def replicate_mean_by_line(sites: DataFrame, track: DataFrame, registry: DataFrame, mark: str, out: str, stranded: bool = False) -> DataFrame:
    """``replicate_mean`` of each site in the tables of its own genome and cell line.

    ``registry`` has a row (genome, cell_line, mark, replicates) for every mark that was measured in a line; ``track``
    has genome, cell_line and replicate. A line without the mark gives null, a site of a line that has it and no hit 0.
    """
    value = _first_present(F.col("at_start"), F.col("at_end"), numeric=False).cast("double")
    if stranded:
        value = F.when(F.col("track_strand") == F.col("strand"), value)
    locus = _LINE + (_STRANDED if stranded else _PLACE)
    got = annotate(
        _with_tables(sites, registry, mark), track, locus, [*_LINE, "chrom"], (["track_strand"] if stranded else []) + ["replicate"],
        {"at_start": F.col("start"), "at_end": F.col("end")}, {"_sum": F.sum(value)},
    )
    return got.withColumn(out, F.coalesce("_sum", F.lit(0.0)) / F.col("_n")).drop("_sum", "_n")


def strand_signal_by_line(sites: DataFrame, track: DataFrame, registry: DataFrame, mark: str, own: str, opposite: str) -> DataFrame:
    """``strand_signal`` of each site in the tables of its own genome and cell line; null as in ``replicate_mean_by_line``."""
    beside = F.greatest(F.col("before").cast("double"), F.col("after").cast("double"))
    same = F.col("track_strand") == F.col("strand")
    got = annotate(
        _with_tables(sites, registry, mark), track, _LINE + _STRANDED, [*_LINE, "chrom"], ["track_strand", "replicate"],
        {"before": F.col("start") - 1, "after": F.col("end") + 1},
        {"_own": F.sum(F.when(same, beside)), "_opposite": F.sum(F.when(~same, beside))},
    )
    mean = lambda c: F.coalesce(c, F.lit(0.0)) / F.col("_n")
    return got.withColumns({own: mean("_own"), opposite: mean("_opposite")}).drop("_own", "_opposite", "_n")


def inside_flag(sites: DataFrame, track: DataFrame, out: str) -> DataFrame:
    """1 when either end of the site lies on the track, else 0."""
    return endpoint_value(sites, track.withColumn("value", F.lit(1)), out, 0)


def value_before_end(sites: DataFrame, track: DataFrame, out: str, back: int = 3) -> DataFrame:
    """Track value ``back`` letters before the end of the site, else 0."""
    got = annotate(sites, track, _PLACE, ["chrom"], [], {"at": F.col("end") - back}, {out: F.max("at")})
    return got.fillna(0, [out])


def centromere_table(gaps: DataFrame) -> DataFrame:
    """chrom, cen_start, cen_end: the last centromere line of each chromosome."""
    last = F.max_by(F.struct("start", "end"), "load_seq")
    return (
        gaps.filter(F.col("kind").contains("centromere")).groupBy("chrom").agg(last.alias("c"))
        .select("chrom", F.col("c.start").alias("cen_start"), F.col("c.end").alias("cen_end"))
    )


def centromere_distance(sites: DataFrame, gaps: DataFrame, out: str = "Distance_from_centromere") -> DataFrame:
    """0 on the centromere, else the shorter way from the site to it."""
    start, end, c0, c1 = (F.col(c) for c in ("start", "end", "cen_start", "cen_end"))
    inside = start.between(c0, c1) | end.between(c0, c1)
    distance = F.when(c0.isNull(), F.lit(None)).when(inside, F.lit(0)).otherwise(F.least(F.abs(start - c1), F.abs(c0 - end)))
    return (
        sites.join(broadcast_if_small(centromere_table(gaps)), "chrom", "left")
        .withColumn(out, distance.cast("bigint")).drop("cen_start", "cen_end")
    )


def telomere_table(gaps: DataFrame, sizes: DataFrame) -> DataFrame:
    """chrom, tel_first (end of the first telomere), tel_last (start of the last one).

    A chromosome without telomere lines borrows the size of chr1's first telomere, or
    10,000 if there is none; a missing side falls back to the end of the chromosome.
    """
    ends = (
        gaps.filter(F.col("kind").contains("telomere")).groupBy("chrom")
        .agg(
            F.max_by(F.when(F.col("start") == 0, F.col("end")), F.when(F.col("start") == 0, F.col("load_seq"))).alias("first"),
            F.max_by(F.when(F.col("start") != 0, F.col("start")), F.when(F.col("start") != 0, F.col("load_seq"))).alias("last"),
            F.lit(True).alias("known"),
        )
    )
    lengths = sizes.filter(is_assembled_chromosome("chrom")).select("chrom", "length")
    # one row: what a chromosome without lines of its own gets
    borrowed = ends.agg(F.coalesce(F.max(F.when(F.col("chrom") == "chr1", F.col("first"))), F.lit(10000)).alias("borrowed")).withColumn("_one", F.lit(1))
    return (
        lengths.join(ends, "chrom", "full").withColumn("_one", F.lit(1)).join(F.broadcast(borrowed), "_one")
        .select(
            "chrom",
            F.when(F.col("known"), F.coalesce("first", F.lit(0))).otherwise(F.col("borrowed")).cast("bigint").alias("tel_first"),
            F.when(F.col("known"), F.coalesce("last", "length")).otherwise(F.col("length") - F.col("borrowed")).cast("bigint").alias("tel_last"),
        )
    )


def telomere_distance(sites: DataFrame, gaps: DataFrame, sizes: DataFrame, out: str = "Distance_from_telomere") -> DataFrame:
    """0 on a telomere, else the shorter way to one (negative if the site straddles the edge)."""
    start, end, t0, t1 = (F.col(c) for c in ("start", "end", "tel_first", "tel_last"))
    distance = F.when((end <= t0) | (start >= t1), F.lit(0)).otherwise(F.when(t0.isNotNull() & t1.isNotNull(), F.least(start - t0, t1 - end)))
    return (
        sites.join(broadcast_if_small(telomere_table(gaps, sizes)), "chrom", "left")
        .withColumn(out, distance.cast("bigint")).drop("tel_first", "tel_last")
    )


def gene_intervals(genes: DataFrame) -> DataFrame:
    """tx, cds and exon intervals of gene rows with exon_starts and exon_ends arrays."""
    exons = F.transform(
        F.slice(F.arrays_zip("exon_starts", "exon_ends"), F.lit(1), F.col("exon_count")),
        lambda x: F.struct(F.lit("exon").alias("kind"), x["exon_starts"].alias("start"), x["exon_ends"].alias("end")),
    )
    parts = F.concat(
        F.array(
            F.struct(F.lit("tx").alias("kind"), F.col("tx_start").alias("start"), F.col("tx_end").alias("end")),
            F.struct(F.lit("cds").alias("kind"), F.col("cds_start").alias("start"), F.col("cds_end").alias("end")),
        ),
        exons,
    )
    return (
        genes.filter(is_assembled_chromosome("chrom"))
        .select("chrom", F.col("strand").alias("track_strand"), "load_seq", F.explode(parts).alias("_p"))
        .select("chrom", "track_strand", "load_seq", "_p.kind", "_p.start", "_p.end")
    )


def loaded_in_order(transcripts: DataFrame) -> DataFrame:
    """The transcripts that an ordered load keeps, per chromosome and strand.

    They are taken by ``load_seq``; one is loaded if its start or its end is not covered yet. Whether a letter is
    covered depends on what overlaps it only, so the fold runs per connected stretch: rows are sorted by
    start over the whole table, and a stretch begins where no earlier end reaches. Transcripts of other than
    assembled chromosomes are left out.
    """
    group = ["chrom", "track_strand"]
    narrow = transcripts.filter(is_assembled_chromosome("chrom")).select(*group, "start", "end", "load_seq")
    stretches = _stretches(narrow, group)
    kept_columns = [*group, "load_seq"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered, at = Stretches(), None
        for batch in batches:
            loaded = []
            for stretch, start, end in zip(*(batch.column(c).to_pylist() for c in ("_stretch", "start", "end"))):
                if stretch != at:
                    covered, at = Stretches(), stretch
                known = start is not None and end is not None
                loaded.append(not (known and covered.holds(start) and covered.holds(end)))
                if known and loaded[-1]:
                    covered.add(start, end)
            yield batch.filter(pa.array(loaded, pa.bool_())).select(kept_columns)

    # stretches are many and short as a rule: a task takes one after the other instead of a call for each
    rows = stretches.repartition("_stretch").sortWithinPartitions("_stretch", "load_seq", "start", "end")
    kept = rows.mapInArrow(fold, narrow.select(kept_columns).schema)
    return transcripts.join(kept, [*group, "load_seq"], "left_semi")


def _stretches(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows (``group``, start, end, load_seq) with ``_stretch``, the connected stretch of their group that they lie in.

    A task numbers the stretches of its part of the range sort while it writes the part. Those that an interval of an
    earlier part still reaches belong to the last stretch before the part, which follows from one summary row per part and group.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, reach, opened, count = None, _NEVER, _NEVER, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in group]
            changed = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
            start, end = (batch.column(c).cast(pa.int64()) for c in ("start", "end"))
            nameless = start.is_null().to_numpy(zero_copy_only=False)
            start, end = start.fill_null(_NEVER).to_numpy(), end.fill_null(_NEVER).to_numpy()
            stretch, opening = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for low, high in zip([0, *changed.tolist()], [*changed.tolist(), batch.num_rows]):
                here = [batch.column(c)[low].as_py() for c in group]
                if here != before:
                    before, reach = here, _NEVER
                reached = np.maximum.accumulate(np.append(reach, end[low:high]))
                opens = nameless[low:high] | (reached[:-1] == _NEVER) | (start[low:high] > reached[:-1])
                stretch[low:high] = count + np.cumsum(opens)
                # starts grow, so the last opening one so far is the largest
                opening[low:high] = np.maximum.accumulate(np.append(opened if not opens[0] else _NEVER, np.where(opens, start[low:high], _NEVER)))[1:]
                reach, opened, count = reached[-1], opening[high - 1], stretch[high - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stretch), pa.array(opening)], [*batch.schema.names, "_local", "_opening"])

    order = [*group, "start", "end", "load_seq"]
    schema = StructType([*rows.schema.fields, StructField("_local", LongType()), StructField("_opening", LongType())])
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema)
    placed = materialise(numbered.withColumn("_local", F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + F.col("_local")).withColumn("_part", F.spark_partition_id()))
    # as many rows as there are parts and groups that begin or end in them
    tails = placed.groupBy(*group, "_part").agg(F.max("end").alias("_end"), F.max("_local").alias("_last"), F.max_by("_opening", "_local").alias("_opening"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reached = tails.withColumn("_reach", F.max("_end").over(earlier))
    # a part whose last stretch is reached from before has no last stretch of its own
    own = F.when(F.coalesce((F.col("_opening") > F.col("_reach")) | (F.col("_opening") == _NEVER), F.lit(True)), F.col("_last"))
    before = F.last("_own", ignorenulls=True).over(earlier).alias("_before")
    carried = reached.withColumn("_own", own).select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_reach", before)
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = (F.col("_opening") <= F.col("_reach")) & (F.col("_opening") != _NEVER)
    stretch = F.when(inside, F.col("_before")).otherwise(F.col("_local")).alias("_stretch")
    return placed.join(carried, same).select(stretch, *order)


class Stretches:
    """A set of letters as sorted, disjoint stretches."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, at: int) -> bool:
        i = bisect_right(self.starts, at) - 1
        return i >= 0 and at <= self.ends[i]

    def add(self, start: int, end: int) -> None:
        low = bisect_left(self.ends, start)
        high = bisect_right(self.starts, end)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]


def housekeeping_genes(listed: DataFrame, genes: DataFrame, keep_listed: bool = False) -> DataFrame:
    """Transcripts under the starts of listed genes: gene, accession, chrom, track_strand, start, end.

    Transcripts are loaded in order (``loaded_in_order``). A listed gene (chrom, strand, start) takes the one lying over
    its start on its own strand, else on the other one; of several, the one loaded last.
    """
    tx = genes.select("chrom", F.col("strand").alias("track_strand"), F.col("tx_start").alias("start"), F.col("tx_end").alias("end"), "load_seq", "gene", "accession")
    # transcripts go through the lookup as numbers, which hash aggregates can hold
    loaded = materialise(loaded_in_order(tx).withColumn("value", F.monotonically_increasing_id()))
    places = listed.select("chrom", "strand", F.col("start").alias("position")).distinct()
    own = F.col("track_strand") == F.col("strand")
    placed = last_loaded(places, loaded, ["chrom", "strand", "position"], ["chrom"], ["track_strand"], F.col("position"), own, "value")
    found = placed.select(F.col("strand").alias("listed_strand"), F.col("position").alias("listed_start"), "value").join(loaded, "value")
    asked = ["listed_strand", "listed_start"] if keep_listed else []
    return found.select(*asked, "gene", "accession", "chrom", "track_strand", "start", "end")


def expression_intervals(regions: DataFrame, expression: DataFrame, missing_to_minus: bool = True) -> DataFrame:
    """Included regions with the gene's expression value, by strand.

    A gene without expression keeps its own value; it is put on the minus strand unless
    ``missing_to_minus`` is off.
    """
    known = F.col("expression").isNotNull()
    elsewhere = F.lit("-") if missing_to_minus else F.col("strand")
    joined = regions.join(expression.select("entrez", "expression"), "entrez", "left")
    return joined.select(
        "chrom", "start", "end", "load_seq", F.lit(0).alias("replicate"),
        F.when(~known, elsewhere).when(F.col("strand") == "-", "-").otherwise("+").alias("track_strand"),
        F.coalesce(F.col("expression").cast("double"), F.col("value").cast("double")).alias("value"),
    )


def genome_features(
    sites: DataFrame, *, gaps: DataFrame, sizes: DataFrame, dnase: DataFrame, nucleosomes: DataFrame,
    subcompartments: DataFrame, expression: DataFrame, genes: DataFrame, expression_replicates: int | None = None,
    cell_line: str | None = None, registry: DataFrame | None = None,
) -> DataFrame:
    """All 13 genome features of sites, in model order.

    Either all sites are of one ``cell_line``, with its ``dnase`` and ``expression`` tables, or sites and these
    two tables carry genome and cell_line, and ``registry`` (genome, cell_line, mark, replicates) says which line has
    which of the marks ``dnase`` and ``expression``: a line without one gets null there. The
    other tracks hold for all lines.

    Sites of up to ``LONGEST_SITE`` letters are annotated tile by tile, with every lookup and both walks in one pass over the
    union of the tracks (``operators.tiles``); longer ones, if there are any, by joins. Only the per-chromosome tables
    are separate. Signals are numbers here, as the model takes them (the text "0" and the number 0 are the same miss).
    """
    columns = sites.columns
    sites, dnase, expression, has_dnase, replicates = _by_line(sites, dnase, expression, expression_replicates, cell_line, registry)
    sites = sites.withColumn("_minus", F.col("strand") == "-")
    locus = [*_PLACE, "_minus", "_line"]
    parts = gene_intervals(genes)

    # track, strand and replicate in one number, and numbers for values
    def layer(df: DataFrame, name: str | Column, value: Column, minus: Column = F.lit(False), replicate: Column = F.lit(0), line: Column = F.lit(0)) -> DataFrame:
        number = F.lit(_TRACKS.index(name)) if isinstance(name, str) else name
        code = number.cast("bigint") + 8 * minus.cast("int") + 16 * line + 16 * (LINES + 1) * replicate.cast("bigint")
        return df.select("chrom", "start", "end", F.col("load_seq").cast("bigint").alias("load_seq"), code.alias("layer"), value.cast("double").alias("value"))

    reverse = F.col("track_strand") == "-"
    gene_part = F.lit(_TRACKS.index("exon"))
    for kind in ("tx", "cds"):
        gene_part = F.when(F.col("kind") == kind, _TRACKS.index(kind)).otherwise(gene_part)
    every = (
        layer(dnase, "dnase", F.col("value"), line=F.col("_line"))
        .unionByName(layer(nucleosomes, "nucleosome", F.col("value")))
        .unionByName(layer(subcompartments, "subcompartment", F.col("value")))
        .unionByName(layer(expression, "expression", F.col("value"), reverse, F.col("replicate"), F.col("_line")))
        .unionByName(layer(parts, gene_part, F.lit(1), F.when(F.col("kind") == "exon", reverse).otherwise(False)))
    ).filter("end >= start and layer is not null")

    known = sites.dropna(subset=locus)
    short = (F.col("end") - F.col("start")).between(0, LONGEST_SITE)
    got = _swept(known.filter(short).select(*locus).distinct(), every)
    if not known.filter(~short).isEmpty():
        got = got.unionByName(_joined(known.filter(~short).select(*locus).distinct(), every, dnase, nucleosomes, has_dnase))
    got = got.fillna(0, [c for c in GENOME_FEATURES if c in got.columns])
    on_peak, on_nucleosome = F.col("DHS_signalValue") != 0, F.col("nucleosome_mapping") != 0
    signals = ("NGG_exon_signalValue", "opposite_exon_signalValue")
    got = got.withColumns({
        "distance_from_DHS": walked_distance(F.col("_dhs_steps"), on_peak, F.col("_dhs_covered"), DNASE_STEP),
        "length_from_nucleosome": walked_distance(F.col("_nucleosome_steps"), on_nucleosome, F.col("_nucleosome_end"), 1),
    })
    got = got.withColumns({c: F.col(c) / replicates for c in signals} | {c: F.when(has_dnase, F.col(c)) for c in ("DHS_signalValue", "distance_from_DHS")})
    got = telomere_distance(centromere_distance(got, gaps), gaps, sizes).select(*locus, *GENOME_FEATURES)
    return sites.join(got, locus, "left").select(*columns, *GENOME_FEATURES)


# the tracks of genome_features by the lowest three bits of their layer's number
_TRACKS = ["dnase", "nucleosome", "subcompartment", "expression", "exon", "tx", "cds"]
_REACH = {"dnase": DNASE_STEP * DNASE_STEPS, "nucleosome": NUCLEOSOME_STEPS}
_SIGNALS = ["DHS_signalValue", "nucleosome_mapping", "genomic_subcompartment", "NGG_exon_signalValue", "opposite_exon_signalValue", "in_NGG_exon", "in_opposite_exon"]
_FOUND = ", ".join([
    "chrom string, start bigint, end bigint, _minus boolean, _line bigint", *[f"{c} double" for c in _SIGNALS],
    "in_tx int, in_cds int, _dhs_covered boolean, _nucleosome_end boolean, _dhs_steps int, _nucleosome_steps int",
])


class _Found:
    """What the layers of ``genome_features`` say about the sites of one tile."""

    def __init__(self, sites: dict[str, np.ndarray]):
        self.start, self.end, self.line, self.minus = sites["start"], sites["end"], sites["load_seq"], sites["value"] == 1
        n = len(self.start)
        self.out = {c: np.zeros(n) for c in _SIGNALS} | {c: np.zeros(n, np.int32) for c in ("in_tx", "in_cds")}
        self.out |= {c: np.zeros(n, bool) for c in ("_dhs_covered", "_nucleosome_end")} | {c: np.full(n, -1, np.int32) for c in ("_dhs_steps", "_nucleosome_steps")}

    def read(self, layer: int, letters: Letters) -> None:
        name, minus, line = _TRACKS[layer % 8], layer // 8 % 2 == 1, layer // 16 % (LINES + 1)
        rows = np.arange(len(self.start)) if line == 0 else np.flatnonzero(self.line == line)
        start, end, out = self.start[rows], self.end[rows], self.out
        (a, has_a), (b, has_b) = letters.at(start), letters.at(end)
        if name == "dnase":
            met = has_a | has_b
            out["DHS_signalValue"][rows], out["_dhs_covered"][rows] = np.where(has_a, a, np.where(has_b, b, 0.0)), met
            off = ~met
            out["_dhs_steps"][rows[off]] = letters.steps(start[off], end[off], DNASE_STEP, DNASE_STEPS)
        elif name in ("nucleosome", "subcompartment"):
            value = np.where(has_a & (a != 0), a, np.where(has_b, b, 0.0))
            if name == "subcompartment":
                out["genomic_subcompartment"][rows] = value
                return
            out["nucleosome_mapping"][rows], out["_nucleosome_end"][rows] = value, has_b
            off = (np.isnan(value) | (value == 0)) & ~has_b
            out["_nucleosome_steps"][rows[off]] = letters.numeric_steps(start[off], end[off], NUCLEOSOME_STEPS)
        elif name in ("expression", "exon"):
            (a, has_a), (b, has_b) = letters.at(start - 1), letters.at(end + 1)
            larger = np.where(has_a & has_b, np.maximum(a, b), np.where(has_a, a, np.where(has_b, b, 0.0)))
            own, other = ("NGG_exon_signalValue", "opposite_exon_signalValue") if name == "expression" else ("in_NGG_exon", "in_opposite_exon")
            same = self.minus[rows] == minus
            out[own][rows] += np.where(same, larger, 0.0)
            out[other][rows] += np.where(same, 0.0, larger)
        else:
            if name == "cds":
                (_, has_a), (_, has_b) = letters.at(start + 6), letters.at(end - 6)
            out["in_" + name][rows] |= has_a | has_b

    def batch(self, chrom: str) -> pa.RecordBatch:
        places = {"chrom": pa.array([chrom]).take(pa.array(np.zeros(len(self.start), np.int64))), "start": self.start, "end": self.end, "_minus": self.minus, "_line": self.line}
        return pa.RecordBatch.from_pydict(places | self.out)


def _swept(loci: DataFrame, every: DataFrame) -> DataFrame:
    """The lookups and walks of distinct short loci, read tile by tile."""
    reaches = np.array([_REACH.get(n, 6) for n in _TRACKS] + [6])
    columns = ["chrom", "layer", *[F.col(c).cast("bigint").alias(c) for c in ("start", "end")], "load_seq", "value"]
    # an interval without a place in the order is covered by any other one
    ordered = F.col("load_seq").isNotNull()
    laid = every.withColumns({"value": F.when(ordered, F.col("value")), "load_seq": F.coalesce("load_seq", F.lit(-(2**63)).cast("bigint"))})
    asked = loci.select(
        "chrom", F.lit(-1).cast("bigint").alias("layer"),
        F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("_line").cast("bigint").alias("load_seq"), F.col("_minus").cast("double").alias("value"),
    )
    rows = asked.unionByName(laid.select(*columns)).withColumnRenamed("layer", "track")
    found = sweep(rows, lambda track: reaches[track % 8], max(_REACH.values()), _FOUND, _Found)
    return found.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("_dhs_steps", "_nucleosome_steps")})


def _joined(loci: DataFrame, every: DataFrame, dnase: DataFrame, nucleosomes: DataFrame, has_dnase: Column) -> DataFrame:
    """What ``_swept`` gives, for distinct loci of any length."""
    locus, place = [*_PLACE, "_minus", "_line"], [*_PLACE, "_line"]

    def of(name: str, value: Column) -> Column:
        return F.max(F.when(F.col("layer") % 8 == _TRACKS.index(name), value))

    def present(name: str) -> Column:
        return of(name, _first_present(F.col("at_start"), F.col("at_end"), numeric=True))

    def beside(name: str, same: bool) -> Column:
        on_minus = F.floor(F.col("layer") / 8) % 2 == 1
        side = on_minus == F.col("_minus")
        picked = (F.col("layer") % 8 == _TRACKS.index(name)) & (side if same else ~side)
        return F.coalesce(F.sum(F.when(picked, F.greatest("before", "after"))), F.lit(0.0))

    line_of = F.floor(F.col("layer") / 16) % (LINES + 1)
    found = annotations(
        loci, every, locus, ["chrom"], ["layer"],
        {
            "at_start": F.col("start"), "at_end": F.col("end"), "before": F.col("start") - 1, "after": F.col("end") + 1,
            "in_start": F.col("start") + 6, "in_end": F.col("end") - 6,
        },
        {
            "DHS_signalValue": of("dnase", F.coalesce("at_start", "at_end")),
            "_dhs_covered": of("dnase", F.when(F.col("at_start").isNotNull() | F.col("at_end").isNotNull(), True)),
            "nucleosome_mapping": present("nucleosome"),
            "_nucleosome_end": of("nucleosome", F.when(F.col("at_end").isNotNull(), True)),
            "genomic_subcompartment": present("subcompartment"),
            "NGG_exon_signalValue": beside("expression", True),
            "opposite_exon_signalValue": beside("expression", False),
            "in_NGG_exon": beside("exon", True),
            "in_opposite_exon": beside("exon", False),
            "in_tx": of("tx", F.coalesce("at_start", "at_end").cast("int")),
            "in_cds": of("cds", F.coalesce("in_start", "in_end").cast("int")),
        },
        keep=(line_of == 0) | (line_of == F.col("_line")),
    )
    located = materialise(loci.join(found, locus, "left").fillna(0, [c for c in GENOME_FEATURES if c in found.columns]))
    off_peak = located.filter((F.col("DHS_signalValue") == 0) & F.col("_dhs_covered").isNull() & has_dnase).select(*place).distinct()
    off_nucleosome = located.filter((F.col("nucleosome_mapping") == 0) & F.col("_nucleosome_end").isNull()).select(*_PLACE).distinct()
    return (
        located.join(walks(off_peak, dnase, ["chrom", "_line"], DNASE_STEP, DNASE_STEPS, "_dhs_steps"), place, "left")
        .join(walks(off_nucleosome, nucleosomes, ["chrom"], 1, NUCLEOSOME_STEPS, "_nucleosome_steps", numeric=True), _PLACE, "left")
    )


def _by_line(sites: DataFrame, dnase: DataFrame, expression: DataFrame, expression_replicates: int | None, cell_line: str | None, registry: DataFrame | None):
    """Sites and the two tables of cell lines with ``_line`` (from 1), whether a line has DNase data, and its expression tables.

    A site of a line that the registry does not know has 0, which no table has.
    """
    if registry is None:
        silent = cell_line in NO_DATA["expression"]
        one = lambda df: df.withColumn("_line", F.lit(1))
        return one(sites), one(dnase), one(expression), F.lit(True), F.lit(None if silent else expression_replicates).cast("double")
    known = registry.filter(F.col("mark").isin("dnase", "expression") & (F.col("replicates") > 0)).groupBy(*_LINE).agg(
        F.max(F.when(F.col("mark") == "dnase", True)).alias("dnase"), F.max(F.when(F.col("mark") == "expression", F.col("replicates"))).alias("n"))
    rows = known.orderBy(*_LINE).limit(LINES + 1).collect()  # names of cell lines, not data
    if len(rows) > LINES:
        raise ValueError(f"the registry has more than {LINES} cell lines")
    number = _literal_map({f"{r.genome}\t{r.cell_line}": i for i, r in enumerate(rows, 1)} or {"": 0})
    numbered = lambda df: df.withColumn("_line", F.coalesce(F.element_at(number, F.concat_ws("\t", *_LINE)), F.lit(0)))
    has_dnase = F.col("_line").isin(*[i for i, r in enumerate(rows, 1) if r.dnase])
    counts = {i: float(r.n) for i, r in enumerate(rows, 1) if r.n and r.cell_line not in NO_DATA["expression"]}
    replicates = F.element_at(_literal_map(counts), F.col("_line")) if counts else F.lit(None).cast("double")
    held = lambda df: numbered(df).filter("_line > 0")
    return numbered(sites), held(dnase), held(expression), has_dnase, replicates
