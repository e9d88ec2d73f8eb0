import random

import pytest
from pyspark.sql import functions as F

from protoscan.fixed import MODEL_INPUTS, SEQUENCE_FEATURES
from protoscan.operators import metrics, model, ordered, post
from protoscan.plans import offtargets, sequence_scan
from protoscan.plans.api import predict_cleavage_score
from protoscan.streaming.intake import read_pair_stream, start_scoring
from workloads.results import deep_rows, ensemble, stump_rows

GUIDE, CONTEXT = "GAGTCCTAGCAGAAGAAGAA", "CCTGAGTCCGAGCAGAAGAAGAAGGGCTC"


def test_conditions_and_arrays_score_alike(spark):
    rng = random.Random(2)
    rows = [tuple(float(rng.randrange(6)) for _ in SEQUENCE_FEATURES) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in SEQUENCE_FEATURES))
    trees = ensemble(spark, deep_rows(depth=4))
    got = df.select(trees._conditions().alias("a"), trees._arrow().alias("b"))
    assert got.filter("a != b").count() == 0 and got.select("a").distinct().count() > 20
    assert got.agg(F.max("a")).head()[0] <= 1.0


def test_score_has_a_cap_but_no_floor(spark):
    leaf = lambda v: model.TreeEnsemble(spark.createDataFrame([(0, 0, 0, None, None, None, None, v)], model.NODE_SCHEMA), ["pa_score"])
    df = spark.createDataFrame([(1.0,)], "pa_score double")
    assert [model.score(df, leaf(v)).head().score for v in (99.0, 8.22, -8.22)] == [1.0, 1.0, -1.0]


def test_model_checks(spark):
    with pytest.raises(ValueError, match="more than"):
        model.TreeEnsemble(spark.createDataFrame(stump_rows(), model.NODE_SCHEMA), SEQUENCE_FEATURES, max_nodes=5)
    with pytest.raises(ValueError, match="not given"):
        model.TreeEnsemble(spark.createDataFrame(stump_rows(), model.NODE_SCHEMA), ["pa_score"])
    assert len(MODEL_INPUTS["genomic"]) == 62 and len(MODEL_INPUTS["flanking"]) == 48


def test_library_call_pairs_up_its_lists(spark, shape):
    m = ensemble(spark, stump_rows())
    long = predict_cleavage_score(spark, [GUIDE, GUIDE], ["A" * 100 + CONTEXT[3:26] + "C" * 100, CONTEXT], shape, m).collect()
    assert [r.score is None for r in long] == [True, False]  # the model of 29 letters is not for 223
    got = predict_cleavage_score(spark, [GUIDE, GUIDE[:19], "T" * 20], [CONTEXT, CONTEXT, CONTEXT], shape, m).collect()
    assert [r.position for r in got] == [0, 1, 2] and got[1].score is None and got[0].score != got[2].score
    with pytest.raises(ValueError):
        predict_cleavage_score(spark, [GUIDE], [], shape, m)


def test_stream_equals_batch(spark, shape, tmp_path):
    m = {"noflanking": ensemble(spark, stump_rows())}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f"1,{GUIDE},{CONTEXT}\n2,{GUIDE[:5]},{CONTEXT}\n")
    (tmp_path / "in" / "b.csv").write_text(f"3,{'ACGT' * 5},{CONTEXT}\n")
    queries = start_scoring(read_pair_stream(spark, str(tmp_path / "in")), shape, m, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    for q in queries:
        q.awaitTermination(120)
    scored = {r.id: r.score for r in spark.read.parquet(str(tmp_path / "out" / "scored")).collect()}
    assert sorted(scored) == ["1", "3"]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()] == ["2"]
    batch = predict_cleavage_score(spark, [GUIDE, "ACGT" * 5], [CONTEXT, CONTEXT], shape, m["noflanking"]).collect()
    assert [scored["1"], scored["3"]] == [r.score for r in batch]


def test_duplicates_by_start_then_by_end(spark):
    rows = [("g", "chr1", "+", 1, 23, 0.9), ("g", "chr1", "+", 1, 24, 0.5), ("g", "chr1", "+", 2, 23, 0.8), ("g", "chr1", "+", 2, 24, 0.7), ("g", "chr1", "-", 1, 23, 0.1), ("g", None, "+", 5, 27, 0.2), ("g", None, "+", 5, 27, 0.3)]
    df = spark.createDataFrame(rows, "guide string, chrom string, strand string, start int, end int, score double")
    got = sorted((r.start, r.end, r.score) for r in post.drop_duplicates(df).collect())
    assert got == [(1, 23, 0.1), (1, 23, 0.9), (5, 27, 0.3)]


def test_ranks_are_whole_when_one_group_and_one_score_dominate(spark):
    df = spark.range(20_000).selectExpr("case when id % 3 = 0 then 'big' else concat('g', id % 50) end as guide", "'chr1' as chrom", "'+' as strand", "id as start", "id + 22 as end", "case when id % 2 = 0 then 1.0D else (id % 7) / 8D end as score")
    got = post.rank_by_score(df, within=["guide"])
    per = got.groupBy("guide").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.countDistinct("rank").alias("d"))
    assert got.count() == 20_000 and per.filter("n != top or n != d").count() == 0
    assert post.rank_by_score(df).agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).head() == (1, 20_000, 20_000)


def test_row_order_over_partitions(spark):
    df = spark.range(5_000).selectExpr("id as line", "id % 7 as v")
    rows = ordered.in_order(df.repartition(7), [F.col("line").asc()])
    assert rows.select("_part").distinct().count() > 1
    got = ordered.running_sum(ordered.with_previous(rows, ["line", "v"]), F.col("v"), "total").orderBy("line").collect()
    total = 0
    for i, r in enumerate(got):
        total += i % 7
        assert r.total == total and r.prev_line == (i - 1 if i else None)


def test_rank_correlation_with_ties(spark):
    rng = random.Random(7)
    rows = [(float(rng.randrange(5)), float(rng.randrange(9))) for _ in range(400)]

    def ranks(x):
        s = sorted(x)
        return [s.index(v) + (s.count(v) + 1) / 2 for v in x]

    a, b = ranks([r[0] for r in rows]), ranks([r[1] for r in rows])
    ma, mb = sum(a) / 400, sum(b) / 400
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    want = cov**2 / sum((x - ma) ** 2 for x in a) / sum((y - mb) ** 2 for y in b)
    got = metrics.squared_spearman(spark.createDataFrame(rows, "o double, p double"), "o", "p").head()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_entropy_ignores_gaps_and_uses_counts(spark):
    df = spark.createDataFrame([("A-",), ("C-",), ("AG",), ("aN",)], "seq string")
    got = {r.position: r.entropy for r in metrics.column_entropy(df).collect()}
    import math
    assert got[1] == pytest.approx(-(3 * math.log2(0.75) + math.log2(0.25))) and got[2] == 0


def test_scan_report_of_a_sequence(spark, shape):
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGGT") for _ in range(700))
    report = sequence_scan.scan_report(spark.createDataFrame([("s", seq)], "contig string, seq string"), shape, ensemble(spark, stump_rows()), {"nA": "count of A"}).orderBy("rank").collect()
    assert [r["rank"] for r in report] == list(range(1, len(report) + 1))
    assert all(x.score >= y.score for x, y in zip(report, report[1:]))
    assert "count of A" in report[0].asDict() and report[0]["PAM_2_first"] in ("AG", "GG")


def test_offtarget_report_finds_the_planted_site(spark, shape):
    from protoscan.operators.genome import chunk_contigs

    rng = random.Random(14)
    around = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    guide = around(20)
    other = ("A" if guide[3] != "A" else "C")
    seq = around(300) + guide + "TGG" + around(300) + guide[:3] + other + guide[4:] + "AAG" + around(300)
    chunks = chunk_contigs(spark.createDataFrame([("chr1", seq), ("chr1_random", seq)], "contig string, seq string"))
    by_alignment = model.TreeEnsemble(spark.createDataFrame([(0, 0, 0, "pa_score", 18.9, 1, 2, None), (0, 0, 1, None, None, None, None, 1.0), (0, 0, 2, None, None, None, None, 8.0)], model.NODE_SCHEMA), SEQUENCE_FEATURES)
    asked = spark.createDataFrame([(guide.replace("T", "U"),), (guide.lower() + "AGG",)], "guide string")
    got = offtargets.offtarget_report(asked, chunks, shape, by_alignment).collect()
    found = {(r.start, r.end): r for r in got}
    assert {r.chrom for r in got} == {"chr1"} and {r.guide for r in got} == {guide}
    assert found[301, 323].pa_score == 20.0 and found[301, 323].mms_cnt == 0
    assert found[624, 646].mms_cnt == 1 and found[624, 646].pa_score == 19.0


def test_every_given_guide_is_searched_or_rejected(spark, shape):
    from protoscan.operators.genome import chunk_contigs

    rng = random.Random(15)
    around = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    bare = [around(20) for _ in range(4)]
    given = [bare[0], bare[1].lower(), bare[2].replace("T", "U") + "AGG", bare[3] + "tgg", bare[0], bare[0][:19], bare[0] + "A", "N" + bare[0], bare[1] + "NN", bare[2][:10] + "N" + bare[2][11:], "", None]
    seq = around(200) + "".join(g + "CGG" + around(200) for g in bare)
    chunks = chunk_contigs(spark.createDataFrame([("chr1", seq)], "contig string, seq string"))
    asked = spark.createDataFrame([(g,) for g in given], "guide string")
    found = {r.guide for r in offtargets.offtarget_features(asked, chunks, shape).filter("edits = 0").select("guide").collect()}
    rejected = [r.guide for r in offtargets.rejected_offtarget_guides(asked).collect()]
    assert found == set(bare)
    assert sorted(map(str, rejected)) == sorted(map(str, given[5:]))


@pytest.mark.parametrize("small", [True, False])
def test_missing_values_go_right_whatever_the_size(spark, monkeypatch, small):
    from protoscan.operators import model

    monkeypatch.setattr(model, "EXPRESSION_NODES", 256 if small else 0)
    stump = [(0, 0, 0, "a", 1.0, 1, 2, None), (0, 0, 1, None, None, None, None, 1.0), (0, 0, 2, None, None, None, None, 2.0)]
    ensemble = model.TreeEnsemble(spark.createDataFrame(stump, model.NODE_SCHEMA), ["a"])
    rows = spark.createDataFrame([(0, 1.0), (1, 1.5), (2, None), (3, float("nan"))], "k int, a double")
    got = {r.k: round(r.s * 8.22, 9) for r in model.score(rows, ensemble, "s").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 2.0, 3: 2.0}


def test_a_scan_report_reads_its_sequences_once(spark, shape):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    rng = random.Random(4)
    schema = "contig string, seq string"
    contigs = spark.createDataFrame([(f"c{i}", "".join(rng.choice("ACGT") for _ in range(300))) for i in range(12)], schema).mapInArrow(counted, schema)
    assert sequence_scan.scan_report(contigs, shape, ensemble(spark, stump_rows())).count() > 100
    # the sample that the ranking takes must not scan and score them again
    assert rows.value == 12


def test_features_are_computed_in_two_projections(spark, shape):
    from protoscan.operators.features import sequence_features

    df = spark.createDataFrame([("A" * 20 + "TGG", "CAT" + "A" * 20 + "TGG" + "ACG", 3, "A" * 20 + "NGG", "A" * 20 + "TGG", 20.0)], "site string, context string, flank int, aln_rna string, aln_dna string, pa_score double")
    got = sequence_features(df, shape)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # the Arrow function lies between the enthalpies and all other columns
    assert plan.index("AS dna_enthalpy") < plan.index("ArrowEvalPython") < plan.index("AS mms_cnt")
    assert got.columns[-len(SEQUENCE_FEATURES):] == list(SEQUENCE_FEATURES) and got.first()["mms_cnt"] == 0
