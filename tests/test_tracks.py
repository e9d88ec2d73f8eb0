import random

import pytest
from pyspark.sql import functions as F

from protoscan.operators import intervals, tracks


def interval_map(rows):
    """Literal reading: later lines overwrite earlier ones, letter by letter."""
    out = {}
    for c, s, e, v, _ in sorted(rows, key=lambda r: r[4]):
        for p in range(s, e + 1):
            out[c, p] = v
    return out


def random_track(rng, n, numeric, span=4000, longest=60):
    order = list(range(n))
    rng.shuffle(order)
    rows = []
    for i in order:
        s = rng.randrange(span)
        v = float(rng.randrange(3)) if numeric else str(rng.randrange(4))
        rows.append((f"chr{rng.randrange(2) + 1}", s, s + rng.randrange(longest), v, i))
    return rows


def frames(spark, rows, numeric):
    return spark.createDataFrame(rows, f"chrom string, start bigint, end bigint, value {'double' if numeric else 'string'}, load_seq bigint")


def sites(spark, rng, n, span=4200):
    rows = []
    for i in range(n):
        s = rng.randrange(span)
        rows.append((i, f"chr{rng.randrange(3) + 1}", rng.choice("+-"), s, s + 22))
    return rows, spark.createDataFrame(rows, "k int, chrom string, strand string, start bigint, end bigint")


@pytest.mark.parametrize("numeric, count, longest", [(False, 80, 60), (True, 80, 60), (True, 12, 40), (False, 10, 9)])
def test_values_and_walks_equal_literal_stepping(spark, numeric, count, longest):
    rng = random.Random(count + longest)
    rows = random_track(rng, count, numeric, longest=longest)
    d = interval_map(rows)
    asked, df = sites(spark, rng, 250)
    track = frames(spark, rows, numeric)
    if numeric:
        got = {r.k: (r.nucleosome_mapping, r.length_from_nucleosome) for r in tracks.nucleosome_signal(df, track).collect()}
    else:
        got = {r.k: (r.DHS_signalValue, r.distance_from_DHS) for r in tracks.dnase_signal(df, track).collect()}
    for k, c, _, a, b in asked:
        inside = d.get((c, a)) or d.get((c, b)) or "0"
        found, walked = (1 if inside != "0" else None), 0
        step, stop = (1, 1000) if numeric else (50, 5000)
        while walked < stop and found is None:
            found = d.get((c, a - walked)) or d.get((c, b + walked))
            walked += step
        want = (float(inside) if numeric else inside, walked if found is not None else -1)
        assert got[k] == want, (k, c, a, b)


def test_long_intervals_are_tiled_by_blocks(spark):
    rows = [("chr1", 5, 3_000_000, "a", 1), ("chr1", 64, 127, "b", 2), ("chr1", 1_000_000, 1_000_064, "c", 3), ("chr1", 500_000, 2_500_000, "d", 0)]
    d = lambda p: next((v for _, s, e, v, _ in sorted(rows, key=lambda r: -r[4]) if s <= p <= e), None)
    points = [0, 4, 5, 63, 64, 127, 128, 499_999, 999_999, 1_000_000, 1_000_064, 1_000_065, 2_999_999, 3_000_000, 3_000_001]
    df = spark.createDataFrame([("chr1", p) for p in points], "chrom string, position bigint")
    got = {r.position: r.value for r in intervals.lookup(df, frames(spark, rows, False), ["chrom"], []).collect()}
    assert got == {p: d(p) for p in points if d(p) is not None}
    assert intervals.block_table(frames(spark, rows, False), ["chrom"]).count() < 200


def test_a_pile_of_intervals_collapses_before_the_join(spark):
    # most rows lie over one spot; the table the points meet stays small and no pair is formed
    pile = spark.range(60_000).selectExpr("'chr1' as chrom", "1000 + id % 3 as start", "1020 + id % 2 as end", "cast(id as string) as value", "id as load_seq")
    table = intervals.block_table(pile, ["chrom"])
    assert table.count() <= 20
    asked = spark.range(20_000).selectExpr("cast(id as int) as k", "'chr1' as chrom", "1010L as start", "1032L as end", "'+' as strand")
    got = tracks.endpoint_value(asked, pile, "v", "0")
    assert got.count() == 20_000 and got.select("v").distinct().collect() == [("59999",)]


def test_strands_and_replicates(spark):
    rng = random.Random(6)
    rows = [(c, s, e, float(rng.randrange(9)), i, rng.choice("+-"), rng.randrange(2)) for i, (c, s, e, _, _) in enumerate(random_track(rng, 150, True))]
    track = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, value double, load_seq bigint, track_strand string, replicate int")
    asked, df = sites(spark, rng, 200)
    got = {r.k: r for r in tracks.replicate_mean(tracks.strand_signal(df, track, 3, "own", "other"), track, 3, "mean", stranded=True).collect()}
    maps = {(st, rep): interval_map([r[:5] for r in rows if r[5] == st and r[6] == rep]) for st in "+-" for rep in range(3)}
    for k, c, strand, a, b in asked:
        other = "-" if strand == "+" else "+"

        def beside(st):
            total = 0
            for rep in range(3):
                vals = [v for v in (maps[st, rep].get((c, a - 1)), maps[st, rep].get((c, b + 1))) if v is not None]
                total += max(vals) if vals else 0
            return total / 3

        mean = sum(next((v for v in (maps[strand, rep].get((c, a)), maps[strand, rep].get((c, b))) if v is not None), 0.0) for rep in range(3)) / 3
        assert (got[k].own, got[k].other, got[k].mean) == (beside(strand), beside(other), mean)


def test_chromosome_ends(spark):
    gaps = spark.createDataFrame([
        ("chr1", 100, 200, "centromere", 0), ("chr1", 300, 400, "centromere", 1), ("chr1", 0, 50, "telomere", 2), ("chr1", 950, 1000, "telomere", 3), ("chr3", 700, 900, "telomere", 4),
    ], "chrom string, start bigint, end bigint, kind string, load_seq bigint")
    sizes = spark.createDataFrame([("chr1", 1000), ("chr2", 500), ("chr3", 900)], "chrom string, length bigint")
    df = spark.createDataFrame([(0, "chr1", 10, 32), (1, "chr1", 290, 312), (2, "chr1", 500, 522), (3, "chr2", 100, 122), (4, "chr2", 460, 482), (5, "chr3", 100, 122), (6, "chr1", 45, 67)], "k int, chrom string, start bigint, end bigint")
    got = {r.k: (r.Distance_from_centromere, r.Distance_from_telomere) for r in tracks.telomere_distance(tracks.centromere_distance(df, gaps), gaps, sizes).collect()}
    assert got == {0: (268, 0), 1: (0, 240), 2: (100, 428), 3: (None, 50), 4: (None, 0), 5: (None, 100), 6: (233, -5)}


def test_unknown_labels_are_null(spark):
    df = spark.createDataFrame([("A1",), ("NA",), ("Z9",)], "l string")
    assert [r[0] for r in df.select(tracks.subcompartment_code(F.col("l"))).collect()] == [1, 0, None]
    assert df.select(tracks.repeat_code(F.lit("LINE?"), F.lit("L1"))).head()[0] == 20


def test_ordered_load_against_a_plain_one(spark):
    rng = random.Random(31)
    rows = []
    for i in range(400):
        start = rng.randrange(0, 3000)
        rows.append((f"t{i}", rng.choice(["chr1", "chr2", "chrUn"]), rng.choice("+-"), start, start + rng.choice([0, 5, 40, 200]), rng.randrange(10**6) * 1000 + i))
    want, covered = set(), {}
    for name, chrom, strand, start, end, _ in sorted(rows, key=lambda r: r[5]):
        letters = covered.setdefault((chrom, strand), set())
        if chrom != "chrUn" and not (start in letters and end in letters):
            letters |= set(range(start, end + 1))
            want.add(name)
    df = spark.createDataFrame(rows, "name string, chrom string, track_strand string, start long, end long, load_seq long")
    got = [r.name for r in tracks.loaded_in_order(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 50 < len(want) < 300
    assert tracks.loaded_in_order(df.limit(0)).count() == 0


def test_cell_lines_without_data_give_null(spark):
    sites = spark.createDataFrame([(1, "hg19", "HEK293", "chr1", "+", 100, 122), (2, "hg19", "K56", "chr1", "+", 100, 122), (3, "hg19", "mESCs", "chr1", "+", 100, 122), (4, "hg19", None, "chr1", "+", 100, 122), (5, "mm9", "HEK293", "chr1", "+", 100, 122), (6, "hg19", "HEK293", "chr9", "-", 5, 27)], "k int, genome string, cell_line string, chrom string, strand string, start long, end long")
    track = spark.createDataFrame([("hg19", "HEK293", "chr1", 90, 110, "4", 1, "+", 0), ("hg19", "K56", "chr1", 90, 110, "9", 2, "-", 0), ("hg19", "mESCs", "chr1", 90, 110, "7", 3, "+", 0)], "genome string, cell_line string, chrom string, start long, end long, value string, load_seq long, track_strand string, replicate int")
    registry = spark.createDataFrame([("hg19", "HEK293", "methylation", 2), ("hg19", "K56", "methylation", 1), ("hg19", "mESCs", "methylation", 1), ("hg19", "HEK293", "H3K9me", 1), ("hg19", "K56", "H3K9me", 1)], "genome string, cell_line string, mark string, replicates int")
    got = {r.k: r.v for r in tracks.replicate_mean_by_line(sites, track, registry, "methylation", "v", stranded=True).collect()}
    assert got == {1: 2.0, 2: 0.0, 3: None, 4: None, 5: None, 6: 0.0}
    got = {r.k: r.v for r in tracks.replicate_mean_by_line(sites, track, registry, "H3K9me", "v").collect()}
    assert got == {1: None, 2: 9.0, 3: None, 4: None, 5: None, 6: None}  # HEK293 has no data of this mark


def test_ordered_load_over_many_stretches_and_batches(spark):
    rng = random.Random(5)
    rows = [("chr1", "+-"[i % 2], 400 * (i // 6) + rng.randint(0, 60), i * 7919 % 1000) for i in range(600)]
    rows = [(c, s, a, a + rng.randint(5, 90), q) for c, s, a, q in rows]
    df = spark.createDataFrame(rows, "chrom string, track_strand string, start long, end long, load_seq long")
    want, covered = [], {"+": set(), "-": set()}
    for _, strand, start, end, seq in sorted(rows, key=lambda r: r[4]):
        if not {start, end} <= covered[strand]:
            covered[strand] |= set(range(start, end + 1))
            want.append(seq)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        kept = tracks.loaded_in_order(df)
        assert sorted(r.load_seq for r in kept.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # one stream per task: a call for each stretch took most of the time
    assert "FlatMapGroups" not in kept._jdf.queryExecution().toString()


def test_several_numbers_from_one_lookup_equal_single_ones(spark):
    rng = random.Random(8)
    rows = [("chr1", a, a + rng.randint(0, 200), q, rng.choice([None, 0, -3, 7]), rng.choice([None, 0, 32767, -32767])) for q, a in enumerate(rng.randrange(4000) for _ in range(150))]
    track = spark.createDataFrame(rows, "chrom string, start long, end long, load_seq long, a int, b int")
    _, asked = sites(spark, rng, 80)
    got = tracks.endpoint_numbers(asked, track, {"a": F.col("a"), "b": F.col("b")})
    one = tracks.endpoint_value(asked, track.withColumn("value", F.col("a")), "a", 0, numeric=True)
    both = tracks.endpoint_value(one, track.withColumn("value", F.col("b")), "b", 0, numeric=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, both.select(got.columns).collect()))


@pytest.mark.parametrize("longest", [62, 70, 600, 40000])
def test_pieces_for_known_sizes_tile_the_interval(spark, longest):
    rng = random.Random(longest)
    rows = [(a, a + rng.randint(0, longest)) for a in (rng.randrange(100000) for _ in range(40))] + [(128, 128 + longest), (63, 63 + longest)]
    df = spark.createDataFrame(rows, "start long, end long")
    sizes = intervals.block_sizes(df)
    pieces = df.withColumn("p", intervals.interval_pieces(F.col("start"), F.col("end"), sizes))
    for r in pieces.collect():
        assert sorted(x for p in r.p for x in range(p.low, p.high + 1)) == list(range(r.start, r.end + 1))
        assert {p.block % 8 for p in r.p} <= {0, *(k + 1 for k in sizes)}
    # short intervals do without array functions, which are interpreted row by row
    assert ("transform" in pieces._jdf.queryExecution().optimizedPlan().toString()) == bool(sizes)


def test_ends_are_met_as_rows(spark):
    track = spark.createDataFrame([("chr1", i * 90, i * 90 + 5, i, "x") for i in range(50)], "chrom string, start long, end long, load_seq long, value string")
    places = spark.createDataFrame([("chr1", 95 + 90 * i, 97 + 90 * i) for i in range(20)], "chrom string, start long, end long")
    got = intervals.walks(places.filter("start % 4 > 0"), track, ["chrom"], 50, 100, "k")
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_tile_travel_packed(spark):
    import numpy as np

    from protoscan.operators import tiles

    n = 6000
    values = "case when id % 5 = 0 then null when id % 7 = 0 then double('NaN') else id / 3 end"
    rows = spark.range(0, n, 1, 2).selectExpr(
        "id % 3 - 1 as tile", "concat('chr', cast(id % 2 as string)) as chrom", "id % 4 - 1 as track",
        "(id * 7919) % 100003 - 50000 as start", "(id * 7919) % 100003 - 50000 + id % 60 as end",
        "if(id % 11 = 0, cast(-9223372036854775808 as bigint), id * 1000000000000) as load_seq", f"{values} as value")
    packs = tiles.packed(rows.unionByName(rows.selectExpr("tile", "cast(null as string) as chrom", "track", "start", "end", "load_seq", "value"))).collect()
    # 12 pairs of tile, chromosome and track in each of two tasks, instead of 6,000 rows to shuffle
    assert len(packs) <= 12 * 2 * 2
    got = []
    for p in packs:
        part = tiles._unpack(p.n, bytes(p.rows))
        assert (np.diff(part["start"]) >= 0).all()
        for i in range(p.n):
            kept = None if part["kind"][i] == 1 else str(float(part["value"][i]))
            got.append((p.tile, p.chrom, p.track, *(int(part[c][i]) for c in ("start", "end", "load_seq")), kept))
    asked = [(r.tile, r.chrom, r.track, r.start, r.end, r.load_seq, None if r.value is None else str(r.value)) for r in rows.collect()]
    assert sorted(got, key=str) == sorted(asked, key=str)


def test_housekeeping_genes_against_a_plain_load(spark):
    rng = random.Random(31)
    rows = []
    for i, seq in enumerate(rng.sample(range(5000), 900)):
        s = rng.randrange(40_000)
        # some reach over several parts of the range sort
        rows.append((f"g{i}", f"n{i}", f"chr{rng.randrange(2) + 1}", rng.choice("+-"), s, s + (rng.randrange(9_000, 15_000) if i % 150 == 0 else rng.randrange(90)), seq))
    loaded, covered = [], {}
    for r in sorted(rows, key=lambda r: r[6]):
        letters = covered.setdefault((r[2], r[3]), set())
        if r[4] not in letters or r[5] not in letters:
            loaded.append(r)
            letters.update(range(r[4], r[5] + 1))
    listed = {(f"chr{rng.randrange(2) + 1}", rng.choice("+-"), rng.randrange(40_000)) for _ in range(400)} | {("chr1", None, rows[0][4] + 1)}
    want = []
    for chrom, strand, start in listed:
        over = [r for r in loaded if r[2] == chrom and r[4] <= start <= r[5]]
        over = [r for r in over if r[3] == strand] or over
        if over:
            want.append((strand, start, *max(over, key=lambda r: r[6])[:6]))
    genes = spark.createDataFrame(rows, "gene string, accession string, chrom string, strand string, tx_start bigint, tx_end bigint, load_seq bigint")
    got = tracks.housekeeping_genes(spark.createDataFrame(list(listed), "chrom string, strand string, start bigint"), genes, keep_listed=True)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    # numbers are aggregated in a hash table, structs would be sorted for it
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_are_laid_to_their_tiles_in_the_tasks(spark, monkeypatch):
    import numpy as np

    from protoscan.operators import tiles

    rng = random.Random(8)
    size = 1 << tiles.TILE_BITS
    rows = [(t, rng.randrange(-2 * size, 9 * size), rng.choice([0, 22, 3 * size])) for t in (-1, 0, 5) for _ in range(40)]
    rows = [(t, s, s + (22 if t < 0 else n)) for t, s, n in rows]
    reach = lambda track: np.where(track == 5, 5000, 6)
    want = []
    for t, s, e in rows:
        low, high = (s, s) if t < 0 else (s - int(reach(np.int64(t))) - tiles.LONGEST_SITE, e + int(reach(np.int64(t))))
        want += [(n, t, s, e) for n in range(low // size, high // size + 1)]
    monkeypatch.setattr(tiles, "_GATHERED", 7)
    parts = list(tiles._in_tiles({c: np.array(v) for c, v in zip(("track", "start", "end"), zip(*rows))}, reach))
    assert max(len(p["tile"]) for p in parts) <= 7
    assert [x for p in parts for x in zip(*(p[c].tolist() for c in ("tile", "track", "start", "end")))] == want
    # no row for each tile and no array of tiles in the plan; a gene's parts are made once
    lines = spark.range(9).selectExpr("'chr1' as chrom", "id * 90 as start", "id * 90 + 30 as end", "id as load_seq", "'+' as track_strand", "0 as replicate", "1.0D as value", "'+' as strand", "id as k")
    genes = lines.selectExpr("chrom", "strand", "start as tx_start", "end as tx_end", "start as cds_start", "end as cds_end", "1 as exon_count", "array(start) as exon_starts", "array(end) as exon_ends", "load_seq")
    got = tracks.genome_features(lines.select("k", "chrom", "strand", "start", "end"), gaps=lines.withColumn("kind", F.lit("clone")), sizes=lines.selectExpr("chrom", "1000 as length").distinct(), dnase=lines, nucleosomes=lines, subcompartments=lines, expression=lines, genes=genes, expression_replicates=1, cell_line="HEK293")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.count("Generate explode") == 1
    assert [r.in_tx for r in got.collect()] == [1] * 9
