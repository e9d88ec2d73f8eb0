"""Point lookup and capped nearest distance on interval tracks, as equi joins only.

An interval covers the closed range start..end. Where intervals overlap, the one with
the highest ``load_seq`` (read last) decides.

*Point lookup.* The axis is cut into bins of 64 letters. An interval leaves one row in the
bin it starts in and one in the bin it ends in, clipped to the bin; the whole bins between
are tiled by aligned blocks of 1, 8, 64, ... bins. Rows with the same block and bounds are
merged, keeping the highest ``load_seq``, by an aggregate that combines before the shuffle.
So a block holds at most 64 * 65 / 2 rows per track however many intervals pile up there,
and two rows for a short interval are all it usually needs. A locus asks for each bin and block around its positions
once, however many positions lie there, and only for the sizes of block that the longest interval of the
track can fill: on a track of short intervals that is one row per locus as a rule.

*Nearest distance.* Stepping outwards from a miss, the first hit on the left is near the
right end of some interval, on the right near a left end. Of the intervals that share such
an end only the longest matters, so a stretch of ``step * limit`` letters has at most that
many ends. They are gathered into one array per stretch, and a site asks for its own stretch
and the next one on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_BIN_BITS = 6
_LEVEL_BITS = 3
_TOP = 4
_PIECES = "array<struct<block:bigint,low:bigint,high:bigint>>"


def _blocks(low: Column, high: Column, level: int) -> Column:
    """Whole blocks low..high-1 of one size with their keys and bounds; empty when there are none."""
    bits = _BIN_BITS + _LEVEL_BITS * level

    def whole(b: Column) -> Column:
        first = F.shiftleft(b, bits)
        return F.struct((b * 8 + (level + 1)).alias("block"), first.alias("low"), (first + (2**bits - 1)).alias("high"))

    return F.when(low < high, F.transform(F.sequence(low, high - 1, F.lit(1).cast("bigint")), whole)).otherwise(F.array().cast(_PIECES))


def _whole_bins(first: Column, stop: Column, top: int = _TOP) -> Column:
    """The aligned blocks of sizes up to ``top`` that tile the bins first..stop-1; size 0 is a single bin."""

    def bounds(level: int) -> tuple[Column, Column]:
        low = F.shiftright(first + (8**level - 1), _LEVEL_BITS * level)
        return low, F.greatest(low, F.shiftright(stop, _LEVEL_BITS * level))

    parts = []
    for level in range(top + 1):
        low, high = bounds(level)
        if level == top:
            parts.append(_blocks(low, high, level))
            continue
        up_low, up_high = bounds(level + 1)
        parts.append(_blocks(low, F.least(up_low * 8, high), level))
        parts.append(_blocks(F.greatest(up_high * 8, up_low * 8), high, level))
    return F.concat(*parts)


def interval_pieces(start: Column, end: Column, sizes: list[int] | None = None) -> Column:
    """Array of (block, low, high); blocks covered from end to end have their own bounds.

    ``sizes``: the ``block_sizes`` of the table. Where no interval can fill a bin, the two ends are all there is, and the
    expression stays free of array functions.
    """
    start, end = start.cast("bigint"), end.cast("bigint")
    first, last = F.shiftright(start, _BIN_BITS), F.shiftright(end, _BIN_BITS)

    def edge(b: Column, low: Column, high: Column) -> Column:
        return F.struct((b * 8).alias("block"), low.alias("low"), high.alias("high"))

    two = F.array(edge(first, start, (first + 1) * 64 - 1), edge(last, last * 64, end))
    short = F.when(first == last, F.array(edge(first, start, end)))
    if sizes is not None and not sizes:
        return short.otherwise(two)
    return short.when(last == first + 1, two).otherwise(F.concat(two, _whole_bins(first + 1, last, max(sizes or [_TOP]))))


def block_sizes(intervals: DataFrame) -> list[int]:
    """The sizes of whole blocks that the longest interval can fill; one pass over two columns."""
    longest = intervals.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    return [k for k in range(_TOP + 1) if longest is not None and longest + 1 >= 2 ** (_BIN_BITS + _LEVEL_BITS * k)]


def point_keys(positions: list[Column], sizes: list[int]) -> Column:
    """The bins of some positions and the blocks of the given sizes around them, each once."""
    keys = []
    for p in (p.cast("bigint") for p in positions):
        keys += [F.shiftright(p, _BIN_BITS) * 8, *[F.shiftright(p, _BIN_BITS + _LEVEL_BITS * k) * 8 + (k + 1) for k in sizes]]
    return F.array_distinct(F.array(*keys)) if len(keys) > 1 else F.array(*keys)


def block_table(intervals: DataFrame, by: list[str], value: str = "value", load_seq: str = "load_seq", sizes: list[int] | None = None) -> DataFrame:
    """One row per block, bounds and ``by`` key with the value that was loaded last; ``sizes`` as in ``interval_pieces``."""
    return (
        intervals.filter(F.col("end") >= F.col("start"))
        .select(*by, F.col(value).alias("value"), F.col(load_seq).alias("load_seq"), F.explode(interval_pieces(F.col("start"), F.col("end"), sizes)).alias("_p"))
        .select(*by, "value", "load_seq", "_p.block", "_p.low", "_p.high")
        .groupBy(*by, "block", "low", "high")
        .agg(F.max_by("value", "load_seq").alias("value"), F.max("load_seq").alias("load_seq"))
    )


def _hits(asked: DataFrame, positions: list[Column], intervals: DataFrame, share: list[str], by: list[str]) -> DataFrame:
    """Rows of ``asked`` joined with the pieces that cover one of their positions."""
    sizes = block_sizes(intervals)
    probes = asked.withColumn("block", F.explode(point_keys(positions, sizes)))
    covers = F.lit(False)
    for p in positions:
        covers = covers | p.between(F.col("low"), F.col("high"))
    return probes.join(block_table(intervals, share + by, sizes=sizes), share + ["block"]).filter(covers)


def lookup(points: DataFrame, intervals: DataFrame, share: list[str], by: list[str], position: str = "position") -> DataFrame:
    """Values at positions: rows (share..., by..., position, value) for the hits only.

    ``share`` columns (the chromosome, as a rule) are common to both sides; ``by`` are
    further columns of the intervals (track, strand, replicate) that split the answer.
    Points are made distinct first, so a spot that many rows ask for is looked up once.
    """
    asked = points.select(*share, F.col(position).cast("bigint").alias("position")).distinct()
    hits = _hits(asked, [F.col("position")], intervals, share, by)
    return hits.groupBy(*share, *by, "position").agg(F.max_by("value", "load_seq").alias("value"))


def annotations(places: DataFrame, intervals: DataFrame, locus: list[str], share: list[str], by: list[str], probes: dict[str, Column], answers: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """Look several positions of each locus up in several tracks at once and aggregate.

    ``places`` are distinct loci. ``probes`` names the positions; each becomes a column with
    the value found there, one row per locus and ``by`` key. ``answers`` are aggregates over
    those rows. ``keep`` is a condition on locus and ``by`` columns. Loci without any hit are left out.
    """
    positions = {n: p.cast("bigint") for n, p in probes.items()}
    # a locus has few pieces, so its rows are brought together once for both aggregates
    hits = _hits(places.select(*locus), list(positions.values()), intervals, share, by)
    hits = (hits if keep is None else hits.filter(keep)).repartition(*locus)

    def found_at(p: Column) -> Column:
        here = p.between(F.col("low"), F.col("high"))
        return F.max_by(F.when(here, F.col("value")), F.when(here, F.col("load_seq")))

    wide = hits.groupBy(*locus, *by).agg(*[found_at(p).alias(n) for n, p in positions.items()])
    return wide.groupBy(*locus).agg(*[a.alias(n) for n, a in answers.items()])


def last_loaded(places: DataFrame, intervals: DataFrame, locus: list[str], share: list[str], by: list[str], position: Column, preferred: Column, out: str) -> DataFrame:
    """The value of the interval over a position of each locus that was loaded last, of the ``preferred`` ones if there are any.

    ``places`` are distinct loci; those without a hit are left out. ``preferred`` is a condition on locus and ``by`` columns.
    Hits of a locus shrink to one row in the tasks that find them.
    """
    hits = _hits(places.select(*locus), [position.cast("bigint")], intervals, share, by)
    first = F.coalesce(preferred, F.lit(False))
    best = [F.max_by(F.when(c, F.col("value")), F.when(c, F.col("load_seq"))) for c in (first, ~first)]
    return hits.groupBy(*locus).agg(F.coalesce(*best).alias(out))


def annotate(sites: DataFrame, intervals: DataFrame, locus: list[str], share: list[str], by: list[str], probes: dict[str, Column], answers: dict[str, Column]) -> DataFrame:
    """Sites with the ``annotations`` of their loci; each distinct locus is looked up once."""
    return sites.join(annotations(sites.select(*locus).distinct(), intervals, locus, share, by, probes, answers), locus, "left")


def _ends(intervals: DataFrame, share: list[str], step: int, side: str) -> DataFrame:
    """Rows (share, side, edge, reach): ends facing a site on their ``left`` or ``right``.

    ``reach`` is how far the longest interval with that end goes back; beyond one step it
    makes no difference.
    """
    start, end = F.col("start").cast("bigint"), F.col("end").cast("bigint")
    if side == "left":
        # seen from a site to the right of the interval
        edge, reach = end, F.min(F.greatest(start, end - (step - 1)))
    else:
        edge, reach = start, F.max(F.least(end, start + (step - 1)))
    return intervals.groupBy(*share, edge.alias("edge")).agg(reach.alias("reach")).select(*share, F.lit(side).alias("side"), "edge", "reach")


def walks(places: DataFrame, intervals: DataFrame, share: list[str], step: int, limit: int, out: str, numeric: bool = False) -> DataFrame:
    """Steps outwards from both ends of distinct loci until a track is met: (share, start, end, out).

    The smallest k below ``limit`` for which start - k*step or end + k*step is covered, for
    loci whose own ends are not; loci without one are left out. With ``numeric`` tracks
    (step 1 only) a value of 0 stops the walk to the right, but not to the left.
    """
    if numeric and step != 1:
        raise ValueError("numeric tracks are walked one letter at a time")
    track = intervals.filter(F.col("end") >= F.col("start"))
    locus = share + ["start", "end"]
    if numeric:
        # right ends of the non-zero stretches: ends of non-zero intervals and the letter
        # before a zero interval, kept if the value that was loaded last is not zero there
        edges = track.select(*share, F.when(F.col("value") != 0, F.col("end")).otherwise(F.col("start") - 1).cast("bigint").alias("position"))
        solid = lookup(edges, track, share, []).filter("value != 0")
        left_ends = solid.select(*share, F.lit("left").alias("side"), F.col("position").alias("edge"), F.col("position").alias("reach"))
    else:
        left_ends = _ends(track, share, step, "left")
    stretch = step * limit
    edge = F.col("edge")
    stretches = left_ends.unionByName(_ends(track, share, step, "right")).withColumn("stretch", F.floor(edge / stretch))

    def ask(position: str, side: str, away: int) -> Column:
        at = F.col(position).cast("bigint")
        return F.struct(F.lit(side).alias("side"), at.alias("at"), (F.floor(at / stretch) + away).alias("stretch"))

    asks = F.array(ask("start", "left", 0), ask("start", "left", -1), ask("end", "right", 0), ask("end", "right", 1))
    probes = places.select(*locus, F.explode(asks).alias("_a")).select(*locus, "_a.*")

    # signed distance outwards from the site, so both sides are treated alike
    out_edge = F.when(F.col("side") == "left", F.col("at") - edge).otherwise(edge - F.col("at"))
    out_reach = F.when(F.col("side") == "left", F.col("at") - F.col("reach")).otherwise(F.col("reach") - F.col("at"))
    k = F.floor((out_edge + (step - 1)) / step)
    steps = F.when((out_edge >= 0) & (k < limit) & (k * step <= out_reach), k)
    return (
        probes.join(stretches, share + ["side", "stretch"])
        .select(*locus, steps.alias("_k")).filter("_k is not null")
        .groupBy(*locus).agg(F.min("_k").alias(out))
    )


def walked_distance(k: Column, hit: Column, covered: Column, step: int) -> Column:
    """Distance of a walk of ``k`` steps: 0 on the track, one step more than walked, -1 for none.

    ``covered`` is true for sites whose ends are covered by a value that does not count as a
    hit: they stop at k = 0.
    """
    return F.when(hit, F.lit(0)).when(covered, F.lit(step)).otherwise(F.coalesce((k + 1) * step, F.lit(-1))).cast("bigint")
