"""The stages of the corpus pipeline: what goes, what stays, and the columns that pass on."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from protoscan.llm import bpe, simhash

from .test_operators import ITEMS, ODD, brute_lines, brute_simhash, brute_windows, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], SCHEMA)


def test_stages_are_named_and_chain_by_the_columns_of_documents(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "decontamination", "tokens"]
    docs = table(spark, ODD)
    for _, stage in pipeline.STAGES[1:-1]:
        assert stage(spark, docs, SF).columns == pipeline.COLUMNS


def test_line_stage(spark):
    rows = [r for r in ODD if r != (None, "only null id")]
    gone, want = brute_lines(rows), Counter()
    for i, text in rows:
        at = {a for j, t, a in gone if (j, t) == (i, text)}
        left = text if not at else "\n".join(x for a, x in enumerate(text.split("\n")) if a not in at)
        if not at or words(left):
            want[i, left, None if left is None else len(left)] += 1
    got = pipeline.distinct_lines(spark, table(spark, rows), SF).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == want


def test_near_copy_stage_keeps_one_of_each_group(spark):
    got = [r.doc_id for r in pipeline.no_near_copies(spark, table(spark, ODD), SF).collect()]
    groups = {top for _, _, top in brute_simhash(ODD, simhash.WORDS)}
    assert len(got) == len(set(got)) and set(got) == groups


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.95])
def test_near_copy_stage_links_edited_copies(spark, similarity):
    n, rows = 500, []
    for i in range(20):
        text = [f"d{i}w{j}" for j in range(n + 4)]
        tail = round(n * (1 - similarity) / (1 + similarity) - 0.5)  # so many shingles differ on either side
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[: n + 4 - tail], *(f"e{i}w{j}" for j in range(tail))]))]
    rows.append((1000, " ".join([f"d0w{j}" for j in range(400)] + [f"x{j}" for j in range(104)])))  # below 0.8
    got = {r.doc_id for r in pipeline.no_near_copies(spark, table(spark, rows), SF).collect()}
    assert got == {2 * i for i in range(20)} | {1000}


def test_near_copy_stage_decides_by_row(spark):
    rows = [(1, "one clean text of its own"), (1, "another text under the same id"), (None, "a first text without an id"), (None, "a second text without one"), (None, "one clean text of its own"), (None, "a second text without one")]
    got = Counter((r.doc_id, r.text) for r in pipeline.no_near_copies(spark, table(spark, rows), SF).collect())
    assert got == Counter([rows[0], rows[1], rows[2], rows[3]])


def test_decontamination_stage(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = brute_windows(ITEMS)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def clean(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        return not any(tuple(w[a : a + n]) in windows for n in {len(k) for k in windows} for a in range(len(w) - n + 1))

    got = pipeline.no_benchmark(spark, table(spark, ODD), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t in ODD if clean(t))  # row by row, whatever the id


def test_whole_run(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in out}
    assert len(kept) == len(out) and kept <= set(docs)
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in good]) > 0.7  # copies and benchmark passages go, clean documents stay
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.3  # this table has some sixty labels to learn from
    import public_tokenizers

    table = {v: k for k, v in bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).items()}
    for r in out[:20]:
        text = b"".join(table[x] for x in np.frombuffer(r.ids, "<u4").tolist()).decode()
        assert set(text.split("\n")) <= set(docs[r.doc_id].text.split("\n"))


def test_quality_and_token_stages_take_odd_rows(spark):
    rows = [*ODD, (None, None), (None, ""), (70, None), (70, None)]
    docs = table(spark, rows)
    assert pipeline.good(spark, docs, SF).columns == pipeline.COLUMNS
    kept = Counter((r.doc_id, r.text) for r in pipeline.good(spark, docs, SF).collect())
    assert all(kept[row] in (0, n) for row, n in Counter(rows).items()) and not kept - Counter(rows)
    by_text = {}
    for row, n in Counter(rows).items():
        by_text.setdefault(row[1] or "", set()).add(kept[row] > 0)
    assert all(len(x) == 1 for x in by_text.values())  # the text alone decides
    out = pipeline.tokens(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.n_tokens == 0) for r in out) == Counter((i, not t) for i, t in rows)


def test_stages_take_empty_tables(spark):
    docs = table(spark, ODD).limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
