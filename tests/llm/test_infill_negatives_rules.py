"""Fill-in-the-middle, hard negatives and quality rules against plain versions of their contracts."""

import hashlib
import math
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from protoscan.llm import infill, negatives, queries, rules

from .test_operators import ODD, SF, whole, words

SHORT = [(20, "one line"), (21, "a\n"), (22, "\n\n\n"), (23, "holds <S> a marker\nx"), (24, "no end <P\n<S\n<M"), (25, "é\n日本\n🙂🙂\nx"), (26, "x\n" * 20000), (27, "<P"), (28, "a\r\nb\x0bc d\n")]


# --- fill in the middle


def brute_infill(i, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, len(units), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (90, 100)])
def test_infill(spark, rate, spm):
    rows = ODD + SHORT + [(i, "a\nbb\nccc\ndd" * (i % 4)) for i in range(100, 160)]
    df = infill.rearrange(whole(spark, rows), rate=rate, spm=spm)
    got = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restore().alias("back")).collect()
    assert Counter(map(tuple, got)) == Counter(brute_infill(i, t, rate, spm) for i, t in rows)
    assert {"_Text", "n.x", "REMOVED"} <= set(df.columns)


def test_infill_replaces_columns_of_its_names_and_takes_empty_tables(spark):
    df = whole(spark).withColumnsRenamed({"Score": "OUTPUT", "REMOVED": "Form"})
    out = infill.rearrange(df)
    assert [c.lower() for c in out.columns].count("output") == 1 and [c.lower() for c in out.columns].count("form") == 1
    assert infill.rearrange(df.limit(0)).count() == 0


def test_infill_other_units_and_markers(spark):
    df = spark.createDataFrame([(1, "one two  three four"), (2, " lead"), (3, "has [PRE] in it")], "doc_id long, text string")
    out = infill.rearrange(df, unit=r"\s*\S+|\s+", markers=("[PRE]", "[SUF]", "[MID]")).withColumn("back", infill.restore(markers=("[PRE]", "[SUF]", "[MID]"))).collect()
    assert all(r.back == r.text if "text" in r.asDict() else True for r in out)
    assert {r.doc_id: r.back for r in out} == {1: "one two  three four", 2: " lead", 3: "has [PRE] in it"} and {r.doc_id: r.n for r in out} == {1: 4, 2: 1, 3: 5 - 1}


def test_cut_is_linear():
    began = time.time()
    text = "x" * 3_000_000 + "\n" * 300_000 + "y" * 3_000_000
    n, a, b = infill.cut(text, infill.LINES, 1, 299_999)
    assert (n, a, b) == (300_001, 3_000_001, 3_299_999) and time.time() - began < 20
    assert infill.cut("", infill.LINES, 5, 6) == (0, 0, 0)


# --- hard negatives


def brute_negatives(rows, divisor, k=5, low=80):
    usable = sorted({(i, str(label), tuple(min(max(math.floor(256.0 * float(np.float32(x))), -(2**63)), 2**63 - 1024) for x in v)) for i, label, v in rows
                     if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = Counter()
    for a, la, va in usable:
        if a % divisor:
            continue
        found = [(-sum(x * y for x, y in zip(va, vb)), b, lb) for b, lb, vb in usable if b != a and len(vb) == len(va)]
        for minus, p, _ in sorted(x for x in found if x[2] == la)[:k]:
            top = -minus
            hard = sorted((s, b) for s, b, lb in found if lb != la and low * top <= 100 * -s <= 100 * top)[:k]
            for rank, (s, b) in enumerate(hard, 1):
                out[a, p, rank, b, top, -s] += 1
    return out


def mined(df, divisor):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, negatives.mine(df, F.col("id") % divisor == 0).select(*cols).collect()))


def test_negatives_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_SLICE", 50)
    monkeypatch.setattr(negatives, "PART", 7)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.2, (3, 13))
    rows = [(i, int(i % 4), (centres[i % 3] + rng.normal(0, 0.05, 13)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, 1, [0.25] * 13) for i in range(400, 460)]  # equal vectors: ties go by id
    rows += [(470, 2, [0.0] * 13), (480, 2, [float("nan")] + [0.1] * 12), (490, None, [0.1] * 13), (500, 1, None), (510, 1, [None] + [0.1] * 12), (None, 1, [0.1] * 13), (520, 0, [float("inf")] * 13)]
    rows += [(530, 0, [0.3, -0.2]), (531, 0, [0.3, -0.1]), (532, 1, [0.29, -0.1]), (540, 3, []), (541, 3, []), (542, 1, []), (550, 1, [5.0] + [-3.0] * 12), rows[10], rows[20], (20, 2, [0.5] * 13)]
    df = spark.createDataFrame([(*r, "k", 9) for r in rows], "vec_id long, label int, embedding array<float>, key string, `ID2` int")
    want = brute_negatives(rows, 10)
    assert want and mined(df, 10) == want
    assert negatives.mine(df.limit(0), F.lit(True)).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_lookups_give_exact_inner_products():
    rng = np.random.default_rng(8)
    for dims, most in ((1, 3), (8, 200), (20, 2**20), (64, 160), (3, 2**61)):
        x = rng.integers(-most, most, (70, dims))
        x[0], x[1] = 0, -1
        planes = negatives.plane_bytes(negatives.pack(x), dims)
        assert (negatives.unpack(planes, dims) == x).all()
        table = negatives.subset_sums(x[:9], negatives._kind(x[:9], len(planes)))
        with np.errstate(over="ignore"):
            assert (negatives.scores(table, planes) == x[:9] @ x.T).all()


def test_queries_against_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    for name in ("op11_fill_in_middle", "op12_hard_negatives"):
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
        want = con.execute(queries.ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


# --- quality rules


def brute_rules(i, text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    counts, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if counts[x] > 1:
            covered |= set(range(k, k + 5))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_rules(spark, documents_with_odd_rows):
    rows = documents_with_odd_rows
    got = rules.report(whole(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(brute_rules(i, t) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    for r in got:
        assert r.base_failed == bool(r.failed & rules.bits(rules.BASE))


@pytest.fixture(scope="module")
def documents_with_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rng = np.random.default_rng(6)
    loops = [(900 + k, " ".join(rng.choice(list("abc"), 60).tolist())) for k in range(30)]
    return rows + ODD + SHORT + loops + [(990, "a b c d e a b c d e"), (991, "a b c d e x a b c d"), (992, "a a a a a a"), (993, "l\nl\n \n\nl "), (994, "q " * 100_000)]


def test_every_rule_can_fail_and_pass(spark):
    good = "The weather in the small town was mild, and most people walked along the river that evening.\nNobody had planned a long stay."
    bad = {
        "few_words": "too few", "repeated_words": "one two three four five six " * 9, "short_words": " ".join("abcdefghijklmnopqrs"), "long_words": " ".join(chr(97 + k) * 20 for k in range(20)),
        "symbols": good.replace(" ", "### "), "capitals": good.upper(), "repeated_lines": good + "\nx y" * 8, "repeated_line_chars": (good.split("\n")[0] + "\n") * 2,
        "digits": " ".join(str(10**6 + 7 * k) for k in range(30)), "exclamations": good.replace(" ", "!! "), "few_plain_words": " ".join(f"a{k}_b{k}" for k in range(30)),
        "ellipses": "\n".join(f"line number {chr(97 + k)} ends..." for k in range(9)), "bullets": "\n".join(f"- item {chr(97 + k)} of it" for k in range(9)),
        "one_word": " ".join(f"the {chr(97 + k)}" for k in range(26)), "endless_word": good + " " + "z" * 1001, "stutters": " ".join(f"{w} {w}" for w in good.split()),
    }
    assert set(bad) == {r.name for r in rules.RULES}
    got = {r.doc_id: r for r in rules.verdict(rules.ledger(spark.createDataFrame([*bad.items(), ("good", good)], "doc_id string, text string"))).collect()}
    assert got["good"].failed == 0 and got["good"].kept
    for name in bad:
        assert got[name].failed & rules.BIT[name], name
    for name in rules.POLICIES[rules.CURRENT].reject:
        assert not got[name].kept


def test_policies_and_ablations_need_only_the_ledger(spark):
    rng = np.random.default_rng(9)
    failed = [int(rng.choice([0, 1, 2, 4, 6, 3, 256, 1024, 256 + 1024])) for _ in range(400)]
    policy = rules.Policy("t", ("few_words", "repeated_words"), ("digits", "short_words", "few_plain_words"), together=2)
    df = spark.createDataFrame([(x,) for x in failed], "failed long")
    hard, soft = rules.bits(policy.reject), rules.bits(policy.lesser)

    def keeps(x, without=0):
        return not x & hard & ~without and (x & soft & ~without).bit_count() < 2

    assert Counter((r.failed, r.kept) for r in rules.verdict(df, policy).collect()) == Counter((x, keeps(x)) for x in failed)
    got = {r["rule"]: tuple(r)[2:] for r in rules.ablations(df, policy).collect()}
    assert set(got) == {*policy.reject, *policy.lesser}
    for name, numbers in got.items():
        b = rules.BIT[name]
        assert numbers == (400, sum(bool(x & b) for x in failed), sum(bool(x & b) and not keeps(x) for x in failed), sum(not keeps(x) and keeps(x, b) for x in failed), sum(keeps(x, b) for x in failed))
    assert rules.ablations(df.limit(0)).count() == 0 and rules.ledger(whole(spark).limit(0)).count() == 0


def test_rules_part_good_from_bad_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.report(docs).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.95
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.05


def test_ledger_replaces_columns_of_its_names(spark):
    out = rules.ledger(whole(spark).withColumnRenamed("Score", "N_Words"))
    assert [c.lower() for c in out.columns].count("n_words") == 1 and out.count() == len(ODD)
