"""The driver contract, and some registered queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from siteledger.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    assert {*entry.oracle_sql()} <= {*entry.queries()} and len(catalog.QUERIES) > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["next_batch", "u5_query_parameters", "r1_page_registry", "j1_route_plan", "c3_money", "w7_cart_view", "j12_reconcile", "c8_c9_offers"])
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    names = sorted(got.columns)
    relation = db.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == names
    key = lambda rows: sorted(map(repr, rows))
    want = [tuple(r[relation.columns.index(c)] for c in names) for r in relation.fetchall()]
    assert key(tuple(r[c] for c in names) for r in got.collect()) == key(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_entry_gives_the_next_batch(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["x14_entities", "x20_tiles", "x7_x9_primary_and_blocks"])
def test_queries_that_do_their_whole_job_match_their_sql(spark, name):
    test_queries_match_their_sql(spark, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_all_blocks_of_a_page_are_returned_in_order(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet").filter("p_partkey = 7").first()
    got = entry.queries()["x7_x9_primary_and_blocks"](spark, DATA).filter("p_partkey = 7").orderBy("place").collect()
    assert [(r.primary, r.place, r.type, r.level, r.text, r.more) for r in got] == [
        ("main", 1, "heading", 1, part.p_name, None),
        ("main", 2, "table", None, None, f"Type:,{part.p_type}"),
        ("main", 3, "heading", 3, "One", None),
        ("main", 4, "heading", 3, "Two", None),
    ]
