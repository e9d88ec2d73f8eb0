"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from workloads import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = {"rf_train_predict", "locus_scoring_end_to_end"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert rows
    if name in WITHOUT_SQL:
        return
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_ungapped_search_spends_no_edits_on_the_pam(spark, duck):
    from workloads.base import CONTIGS_SQL
    from workloads.results import _GUIDES_SQL

    want = duck.execute(f"""
    with w as (select contig, i as start, substr(seq, i, 20) as p from (select contig, seq, unnest(range(1, length(seq) - 21)) as i from {CONTIGS_SQL}) where regexp_full_match(substr(seq, i + 21, 2), '[AG]{{2}}'))
    select guide, contig, start, hamming(guide, p) as edits from {_GUIDES_SQL} g, w where hamming(guide, p) <= 4""").fetchall()
    got = entry.queries()["offtarget_search_ungapped"](spark, SF).filter("strand = '+'").select("guide", "contig", "start", "edits").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_only_tables_in_few_row_groups_are_dealt_out(spark, tmp_path):
    from workloads.base import table

    whole = spark.range(4000).selectExpr("id as k")
    whole.repartition(8).write.parquet(f"{tmp_path}/spread.parquet")
    whole.coalesce(1).write.parquet(f"{tmp_path}/single.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    try:
        plans = {n: table(spark, str(tmp_path), n)._jdf.queryExecution().optimizedPlan().toString() for n in ("spread", "single")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Repartition" not in plans["spread"] and "Repartition" in plans["single"]
    assert table(spark, str(tmp_path), "spread").count() == table(spark, str(tmp_path), "single").count() == 4000
