"""What keeps queries over many small rows within one machine's memory and time: dealt rows, one parse, no guessed broadcasts."""

import re

from pyspark.sql import functions as F

from siteledger.functions import urls
from siteledger.operators import common
from siteledger.plans import catalog, derived
from siteledger.sources import html

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_over_cores_and_more_tasks_as_they_grow(spark):
    one = spark.range(1000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert common.dealt(one, "id").rdd.getNumPartitions() == cores
    assert common.dealt(one, "id", rows=10).rdd.getNumPartitions() == max(cores, 100)
    assert common.dealt(one, "id", rows=10).agg(F.sum("id")).first()[0] == 499500


def test_product_and_loose_pages_are_parsed_in_many_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    for pages in (derived._product_pages(spark, SMALL, "ld"), derived._loose_pages(spark, SMALL, "text"), derived._variant_pages(spark, SMALL)):
        assert pages.rdd.getNumPartitions() >= cores
    for name in ("x12_sanitised", "c6_price_texts", "j16_exact_price"):
        assert catalog.QUERIES[name](spark, SMALL).rdd.getNumPartitions() >= cores


def test_variant_queries_parse_once_and_broadcast_nothing(spark):
    for name in ("c14_variant_prices", "c14_variant_purchases", "c8_c9_offers", "c14_variants"):
        plan = _plan(catalog.QUERIES[name](spark, SMALL))
        assert len(re.findall("MapInArrow", plan)) <= 1 and "Broadcast" not in plan, name
    for name in ("c17_offer_prices", "c11_attributes", "c16_breadcrumbs", "x18_home_logo", "x20_tiles"):
        plan = _plan(catalog.QUERIES[name](spark, SMALL))
        assert "MapInArrow" not in plan and "BroadcastHashJoin" not in plan, name


def test_a_parse_of_one_field_is_that_of_all(spark):
    page = '<title>t</title><main><h2><a href="/x">a</a></h2><img src=i.png><form><input type=search></form><p>b</main>'
    whole = html.parse(page)
    assert all(html.parse(page, (f,)) == {f: whole[f]} for f in html.FIELDS)


def test_facts_of_a_node_come_from_one_parse_dealt_by_rows(spark):
    plan = _plan(catalog.QUERIES["x15_node_facts"](spark, SMALL))
    assert plan.count("MapInArrow") == 1 and len(re.findall("Exchange", plan)) == 2


def test_a_parse_leaves_no_tree_to_the_garbage_collector():
    import gc

    from siteledger.sources.tree import Node

    gc.collect()
    gc.disable()
    try:
        html.parse("<main><p>a<p>b<a href=/x>c</a></main>", ("links", "base"))
        assert not [o for o in gc.get_objects() if isinstance(o, Node)]
    finally:
        gc.enable()


def test_witnesses_of_all_kinds_come_from_one_parse(spark):
    assert "MapInArrow" not in _plan(catalog.QUERIES["r16_witness_kinds"](spark, SMALL))


def test_parts_of_an_identity_are_worked_out_once(spark):
    rows = spark.createDataFrame([("https://A.example:443/x?q#f",), ("http://b.example:80",), ("https://u@c/",), ("http://d.example/é",), (None,)], "url string")
    got = rows.select(urls.identity(F.col("url"))["crawl_key"].alias("key"))
    assert len(re.findall("regexp_extract|RegExpExtract", got._jdf.queryExecution().optimizedPlan().toString())) <= 5
    assert [r.key for r in got.collect()] == ["https://a.example/x?q", "http://b.example/", None, "http://d.example/%C3%A9", None]


def test_content_acceptance_sends_texts_once_and_collapses_them_where_they_are_read(spark):
    plan = _plan(catalog.QUERIES["j22_content_acceptance"](spark, SMALL))
    assert len(re.findall("Exchange", plan)) == 1 and plan.count("split(") == 1 and "regexp_replace" not in plan and "Join" not in plan


def test_collapsed_is_collapse(spark):
    from siteledger.functions.text import collapse, collapsed

    # Each character below U+3100 and the byte order mark, alone, doubled, beside spaces and at both ends.
    odd = [x for c in map(chr, [*range(0x3100), 0xFEFF, 0x1F600]) for x in (f"a{c}b", f"a {c}{c} b", f"{c} a{c}")] + ["", " ", "a", "  a   b\n\n c "]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select("x", collapse(F.col("x")).alias("want")).collect()
    assert len(rows) > 37_000 and not [r for r in rows if collapsed(r.x) != r.want]
