import random

import pytest
from pyspark.sql import functions as F

from protoscan.fixed import ENTHALPY_TENTHS, SEQUENCE_FEATURES
from protoscan.functions import aligned, seq as S, validate as V
from protoscan.operators import genome, scan
from protoscan.plans.pair_scoring import pair_features

GOLDEN = {
    "pa_score": 19.0, "total_bulges": 0, "rna_bulges": 0, "dna_bulges": 0, "mms_cnt": 1,
    "PAM_2_first": "33", "PAM_N_id": "3", "last_nucleotide": "3",
    "continuous_inconsistencies_cnt": 1, "continuous_inconsistencies_length": 1.0,
    "mismatches_1_4": 0, "mismatches_5_8": 0, "mismatches_9_12": 0, "mismatches_13_16": 1, "mismatches_17_end": 0,
    "wobble_total": 0, "YY_total": 1, "RR_total": 0, "Tv_total": 0,
    "PamProximalCouple1": "11", "PamProximalCouple2": "13", "PamProximalCouple3": "31", "PamProximalCouple4": "11",
    "id_pos5": "1", "id_pos4": "1", "id_pos3": "3", "id_pos2": "1", "id_pos1": "1",
    "dna_enthalpy": 176.0, "extended_dna_enthalpy": 225.1, "nA": 9, "nC": 3, "nT": 1, "nG": 10,
    "nuc_id_afterPAM1": "2", "nuc_id_afterPAM2": "4", "nuc_id_afterPAM3": "2", "nuc_id_afterPAM4": "0", "nuc_id_afterPAM5": "0",
    "extended_genomic_GC_content": 17 / 29,
}


def letters(n, alphabet="ACGT", rng=random):
    return "".join(rng.choice(alphabet) for _ in range(n))


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).head()[0]


def test_golden_row(spark, shape):
    pair = spark.createDataFrame([("GAGTCCTAGCAGAAGAAGAA", "CCTGAGTCCGAGCAGAAGAAGAAGGGCTC")], "guide string, context string")
    accepted, rejected = V.split_rejects(V.check_pairs(pair))
    row = pair_features(accepted, shape).head().asDict()
    assert rejected.count() == 0
    assert row["aln_rna"] == "GAGTCCTAGCAGAAGAAGAANGG" and row["aln_dna"] == "GAGTCCGAGCAGAAGAAGAAGGG"
    assert {k: row[k] for k in GOLDEN} == GOLDEN
    assert all(c in row for c in SEQUENCE_FEATURES)


def test_enthalpy_counts_doubled_letters(spark):
    rng = random.Random(3)
    texts = ["AAAA", "A", "", "AACCGGTT", "GGGGGGA"] + [letters(rng.randint(2, 60), rng.choice(["AC", "ACGT", "A"]), rng) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for row in df.select("s", S.enthalpy_tenths("s").alias("e")).collect():
        assert row.e == sum(ENTHALPY_TENTHS[row.s[i:i + 2]] for i in range(len(row.s) - 1))


def test_reverse_complement_is_an_involution(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(letters(40, "ACGTRYKMBVDHN", rng),) for _ in range(50)], "s string")
    assert df.filter(S.reverse_complement(S.reverse_complement("s")) != F.col("s")).count() == 0


@pytest.mark.parametrize("guide, sgrna, valid", [
    ("gagtcctagcagaagaagaa", "GAGTCCTAGCAGAAGAAGAANGG", True),
    ("GAGUCCUAGCAGAAGAAGAA", "GAGTCCTAGCAGAAGAAGAANGG", True),
    ("GAGTCCTAGCAGAAGAAGAATGG", "GAGTCCTAGCAGAAGAAGAANGG", True),
    ("GAGTCCTAGCAGAAGAAGA", "GAGTCCTAGCAGAAGAAGANGG", False),
    ("GAGTCCTAGCAGAAGAAGAAC", "GAGTCCTAGCAGAAGAAGAACNGG", False),
    ("GAGTCNTAGCAGAAGAAGAA", "GAGTCNTAGCAGAAGAAGAANGG", False),
])
def test_guides(spark, guide, sgrna, valid):
    assert one(spark, V.normalise_guide("g"), g=guide) == sgrna
    assert one(spark, V.guide_is_valid(V.normalise_guide("g")), g=guide) is valid


@pytest.mark.parametrize("n, ok", [(28, False), (29, True), (30, False), (222, False), (223, True), (58, False)])
def test_context_length_is_exact(spark, n, ok):
    assert one(spark, V.context_is_valid("c"), c="ACGT" * 60 if n == 240 else ("ACGT" * 60)[:n]) is ok
    assert one(spark, V.context_is_valid("c"), c="N" + ("ACGT" * 60)[1:n]) is False


def test_rows_keep_their_own_flank(spark):
    rows = [("a", letters(20), letters(223)), ("b", letters(20), letters(29)), ("c", letters(20), letters(223))]
    checked = V.check_pairs(spark.createDataFrame(rows, "id string, guide string, context string")).orderBy("id").collect()
    assert [(r.flank, r.mode, len(r.site)) for r in checked] == [(100, "flanking", 23), (3, "noflanking", 23), (100, "flanking", 23)]


def test_inconsistency_run_next_to_the_pam_is_not_counted(spark):
    ops = aligned.protospacer(aligned.operations("r", "d"))
    assert one(spark, aligned.inconsistency_runs(ops), r="AAAATTTTAAAANGG", d="AAAACCTTAAACTGG") == 1


def test_mismatch_classes_partition_the_pairs(spark):
    pairs = [(r, d) for r in "ACGT" for d in "ACGT" if r != d]
    df = spark.createDataFrame([(r + "AGG", d + "AGG") for r, d in pairs], "r string, d string")
    got = df.select(F.left(aligned.operations("r", "d"), F.lit(1)).alias("o")).collect()
    assert sorted(x.o for x in got) == sorted("WW" + "VV" + "RRRR" + "YYYY")


def literal_scan(seq, flank):
    out = []
    rc = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for strand, s in (("+", seq), ("-", rc)):
        for i in range(len(s) - 22):
            site = s[i:i + 23]
            end = i + 23
            if set(site[:20]) <= set("ACGT") and site[21] in "AG" and site[22] == "G" and flank + 23 <= end <= len(s) - flank:
                out.append((strand, i + 1, end, site) if strand == "+" else (strand, len(s) - end + 1, len(s) - end + 23, site))
    return sorted(out)


def test_scan_over_chunk_borders(spark):
    rng = random.Random(8)
    seqs = {f"c{i}": letters(n, "ACGGT", rng) for i, n in enumerate([0, 10, 22, 23, 29, 64, 65, 300, 1000])}
    seqs["n"] = letters(100, "ACGGTN", rng)
    chunks = genome.chunk_contigs(spark.createDataFrame(list(seqs.items()), "contig string, seq string"), size=64, halo=64)
    for flank in (0, 3, 15):
        got = scan.scan_sites(chunks, flank, halo=64).collect()
        for name, s in seqs.items():
            mine = sorted((r.strand, r.start, r.end, r.site) for r in got if r.contig == name)
            if "N" not in s:
                assert mine == literal_scan(s, flank)
        for r in got:
            turned = r.context[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
            window = seqs[r.contig][r.start - 1 - flank:r.end + flank]
            assert window in (r.context, turned) and r.site in r.context


def test_region_fetch_short_long_and_outside(spark):
    rng = random.Random(2)
    seqs = {"chr1": letters(500, rng=rng), "2": letters(130, rng=rng)}
    chunks = genome.chunk_contigs(spark.createDataFrame(list(seqs.items()), "contig string, seq string"), size=64, halo=32)
    asks = [(i, c, s, s + n - 1) for i, (c, s, n) in enumerate([("chr1", 1, 20), ("1", 60, 32), ("chr2", 120, 30), ("chr2", 500, 10), ("chr9", 1, 5), ("chr1", -3, 10), ("chr1", 64, 1), ("chr1", 10, 300)])]
    df = spark.createDataFrame(asks, "k int, contig string, start bigint, end bigint")

    def expected(c, s, e):
        seq = seqs.get(c) or seqs.get(c.replace("chr", "")) or seqs.get("chr" + c) or ""
        return seq[max(s, 1) - 1:max(e, 0)]

    short = genome.fetch_regions(df.filter("end - start < 32"), chunks, size=64, halo=32).collect()
    whole = genome.fetch_regions(df, chunks, size=64, halo=32).collect()
    assert len(short) == 7 and len(whole) == 8
    for r in short + whole:
        assert r.seq == expected(r.contig, r.start, r.end), r
    notes = {r.k: r.fetch_warning for r in whole}
    assert notes[3].startswith("no letters") and notes[2].startswith("coordinates run past") and notes[0] is None
