"""Snapshot items, page images, home navigation and accepted pages."""

from siteledger.operators import catalog, registry, structured
from siteledger.sources import html


def test_items_need_a_live_route_and_keep_block_order(spark):
    entities = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "source_id string, title string")
    commerce = spark.createDataFrame([("a", "PRODUCT")], "source_id string, page_kind string")
    routes = spark.createDataFrame([("a", "/a", 200), ("b", "/b", 200), ("c", "/c", 404)], "entity_source_id string, request_target string, expected_status int")
    blocks = spark.createDataFrame([("a", 1, "second"), ("a", 0, "first"), ("a", 2, None)], "source_id string, ord int, text string")
    got = {r.source_id: (r.request_target, r.page_kind, r.body_text) for r in catalog.items(entities, commerce, routes, blocks).collect()}
    assert got == {"a": ("/a", "PRODUCT", "first second"), "b": ("/b", None, "")}


def test_accepted_pages_prefer_rendered_bytes(spark):
    rows = [("FETCHED", 200, "Text/HTML; x", None, "body"), ("RENDERED", 200, "text/html", "dom", "body"), ("FETCHED", 404, "text/html", None, "x"), ("FAILED", 200, "text/html", None, "x"), ("FETCHED", 200, None, None, "x")]
    ledger = spark.createDataFrame(rows, "status string, http_status int, mime string, dom string, body string")
    assert [r.html for r in registry.accepted_pages(ledger).collect()] == ["body", "dom"]


def test_images_and_home_navigation(spark):
    page = '<nav><a href="/a">A</a><a href="/a">A</a><a href="/cart">Cart</a><a href="https://b.example/">B</a></nav><img src="/i.png"><img src="/no.png">'
    parsed = html.parsed(spark.createDataFrame([(1, "https://a.example/", page), (2, "https://a.example/x", page)], "page_id long, url string, html string"))
    assets = spark.createDataFrame([("https://a.example/i.png", "FETCHED", "image/png", "s"), ("https://a.example/no.png", "FAILED", "image/png", "t")], "url string, status string, mime string, sha256 string")
    got = sorted((r.page_id, r.asset_url[-6:], r.sha256) for r in structured.page_images(parsed, assets, "page_id").collect())
    assert got == [(1, "/i.png", "s"), (1, "no.png", None), (2, "/i.png", "s"), (2, "no.png", None)]
    nav = structured.homepage_navigation(parsed, "page_id").collect()
    assert [(r.page_id, r.label, r.request_target) for r in nav] == [(1, "A", "/a")]
