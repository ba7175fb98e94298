"""The HTML parse pass, structured data, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from siteledger.operators import catalog, structured
from siteledger.sources import html, jsonld, readers, tree

PAGE = """<!DOCTYPE html><html lang="ru"><head><title> A  <b>page</b> &amp; more </title><meta name="description" content="Desc"><link rel=canonical href="/canon"><base href="/base/">
<meta name="robots" content="noindex"><script>var t="<a href='/no'>";</script><script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Product","url":"/p","name":"P","sku":"S1","brand":{"name":"B"},
"additionalProperty":[{"name":"Colour","value":"red"}],"offers":[{"@type":"Offer","price":10.50,"priceCurrency":"RUB","sku":"S1","priceSpecification":{"unitText":"м²"}},{"@type":"Offer","price":"7","priceCurrency":"RUB","url":"/other"},{"@type":"AggregateOffer","lowPrice":"5","highPrice":"9","priceCurrency":"RUB"}],
"hasVariant":[{"@type":"Product","sku":"V1","additionalProperty":[{"name":"Size","value":"1"}]},{"@type":"Product","sku":"V2"}]},{"@type":"Product","url":"/foreign","name":"F"}]}</script><script type="application/ld+json">{broken</script></head>
<body><nav><a href="/n1">Nav</a><a href="javascript:void(0)">no</a></nav><main id="content"><h1>Head</h1><p>First <a href="rel?x=1#f">link</a><p>Second<ul><li>one<li>two</ul><table><tr><td>Weight:<td>5 kg<tr><td>a<td>b<td>c</table>
<img src="/i.png" srcset="/i1.png 1x, /i2.png 2x" alt="Alt"><blockquote>Quote</blockquote><div style="background:url('/bg.jpg')" hidden><p>secret</p></div><a href="/doc.pdf">Doc</a><span class="price old">20 RUB</span><span class="price" content="10.50" data-currency="RUB">10.50 RUB/шт.</span>
<div class="list"><div><h3><a href="/c1">Card 1</a></h3><img src="/c1.png"></div><div><h3><a href="/c2">Card 2</a></h3><img src="/c2.png"></div></div><select name="size" required><option>S<option>M</select><form role="search"><input name=q></form></main></body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(1, "https://a.example/p", PAGE), (2, "https://a.example/", None), (3, "https://a.example/x", "<p>un<b>closed <i>x</p></i></td><<>&#xZZ; <a href"), (4, "https://a.example/e", "")]
    return html.parsed(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()


def test_the_parse_pass(parsed):
    p = parsed.filter("page_id = 1").first().parse
    assert (p.title, p.description, p.canonical, p.base, p.lang, p.robots) == ("A page & more", "Desc", "/canon", "/base/", "ru", "noindex")
    assert [(x.href, x.role) for x in p.links][:3] == [("/n1", "navigation"), ("rel?x=1#f", "other"), ("/doc.pdf", "other")]
    assert [x for x in p.media] == ["/i.png", "/i1.png", "/i2.png", "/bg.jpg", "/doc.pdf", "/c1.png", "/c2.png"]
    assert p.h1 == ["Head"] and p.anchors == ["content"] and p.primary == "main"
    blocks = [(b.type, b.text or b["items"] or b.rows or b.source) for b in p.blocks]
    assert blocks[:6] == [("heading", "Head"), ("paragraph", "First link"), ("paragraph", "Second"), ("list", ["one", "two"]), ("table", [["Weight:", "5 kg"], ["a", "b", "c"]]), ("image", "/i.png")]
    assert ("quote", "Quote") in blocks and ("document", "Doc") in blocks and not any("secret" in str(b) for b in blocks)
    assert [(x.role, x.raw) for x in p.prices] == [("OLD", "20 RUB"), ("CURRENT", "10.50 RUB/шт.")]
    assert [(x.name, x.value) for x in p.attributes] == [("Weight", "5 kg")] and [(c.href, c.image) for c in p.cards] == [("/c1", "/c1.png"), ("/c2", "/c2.png")]
    assert p.search_forms == 1 and p.selections[0].options == ["S", "M"]


def test_broken_and_missing_markup_never_fails(parsed):
    rest = {r.page_id: r.parse for r in parsed.filter("page_id > 1").collect()}
    assert rest[2].title is None and rest[2].links == [] and rest[4].blocks == [] and rest[3].text.startswith("un closed" if False else "unclosed")


def test_only_the_pages_own_node_is_bound(spark, parsed):
    bound = structured.bound_nodes(parsed, "page_id").collect()
    assert [(r.page_id, r.node.name, r.node.brand) for r in bound] == [(1, "P", "B")]
    two = [{"@context": "https://schema.org", "@type": "Product", "url": "/d"}, {"@context": "https://schema.org", "@type": "Article", "@id": "/d"}]
    other = html.parsed(spark.createDataFrame([(9, "https://a.example/d", f'<script type="application/ld+json">{json.dumps(two)}</script>')], "page_id long, url string, html string"))
    assert structured.bound_nodes(other, "page_id").count() == 0
    assert {r.page_id: r.classes for r in structured.classes_of(parsed, "page_id").collect()} == {1: ["Product"], 2: [], 3: [], 4: []}


def test_offers_keep_what_does_not_belong_for_review(parsed):
    rows = structured.offer_prices(structured.offers(parsed, "page_id"), structured.visible_prices(parsed, "page_id").filter("price.role = 'CURRENT'").select("page_id", "price.money.minor"), "page_id")
    got = {r.ord: (r.kind, r.money.minor, r.limitations, r.status) for r in rows.collect()}
    assert got == {0: ("exact", 1050, [], "OBSERVED"), 1: ("exact", 700, ["OFFER_URL_FOREIGN"], "REQUIRES_REVIEW"), 2: ("range", 500, [], "OBSERVED")}


def test_variants_attributes_and_cards(parsed):
    assert sorted(r.sku for r in structured.variants(parsed, "page_id").collect()) == ["V1", "V2"]
    assert {(r.name, r.value) for r in structured.attributes(parsed, "page_id").collect()} == {("Weight", "5 kg"), ("Colour", "red")}
    assert [r.selection_required for r in structured.selections(parsed, "page_id").collect()] == [True]
    assert sorted(r.href for r in structured.cards(parsed, "page_id").collect()) == ["/c1", "/c2"]


def test_jsonld_is_flattened_and_numbers_stay_exact():
    got = jsonld.nodes(['[{"@type":"Service","@graph":[{"@graph":{"@type":["Article"],"name":1.10}}]}]', "{", "[" * 100_000, "null"])
    assert [(n["classes"], n["name"]) for n in got] == [(["Service"], None), (["Article"], "1.10")]


def test_sanitising_drops_what_could_act():
    dirty = '<div onclick=x><p style=y>Hi <img src=x alt="A&B"><script>1</script><a href="javascript:x" title="t">q</a><a href="/z?a&amp;b">w</a></p><form><input></form></div>'
    assert html.sanitize_one(dirty) == '<p>Hi A&amp;B<a title="t">q</a><a href="/z?a&amp;b">w</a></p>' and html.sanitize_one(None) is None


def test_selected_fields_and_site_names(spark):
    f = [{"name": "price_note", "locator": "h1", "text": " T "}, {"name": "b", "locator": "p", "text": "x"}]
    rows = spark.createDataFrame([("u", f)], "source_url string, fields array<struct<name:string,locator:string,text:string>>")
    assert [(r.label, r.text, r.is_name) for r in structured.selected_fields(rows).orderBy("ord").collect()] == [("Price Note", "T", True), ("B", "x", False)]
    names = spark.createDataFrame([("a", "N"), ("a", " N "), ("b", "1"), ("b", "2"), ("c", "")], "origin string, name string")
    assert {r.origin: r.name for r in structured.site_name(names).collect()} == {"a": "N", "b": None}


def test_tiles_below_another_are_dropped(spark):
    o, image = "https://a.example", "https://img.example/i.png"
    rows = [("Doors", "/c/doors/", image), ("Inner", "/c/doors/inner", image), ("Doorsets", "/c/doorsets", image), ("Новые акции", "/new", image), ("No", "/no", image), ("Doors again", "/c/doors/", image), ("No image", "/x", None), ("Data image", "/y", "data:x"), ("Own page", "/", image), ("Same with slash", "/c/doorsets/", image)]
    links = spark.createDataFrame([(1, f"{o}/", k, label, o + path, img) for k, (label, path, img) in enumerate(rows)] + [(1, f"{o}/", 20, "Foreign", "https://b.example/q", image)], "page long, page_url string, ord int, label string, url string, image string")
    got = catalog.tiles(links)
    assert sorted(r.label for r in got.collect()) == ["Doors", "Doorsets"]
    pages = spark.createDataFrame([(1, True), (2, True), (3, False)], "page long, catalog_expected boolean")
    shown = spark.createDataFrame([(1, f"{o}/c/doors/", True)], "page long, url string, has_image boolean")
    issues = sorted((r.page, r.issue) for r in catalog.tile_issues(pages, got, shown).collect())
    assert issues == [(1, "CATALOG_COVERAGE_LOST"), (1, "CATALOG_IMAGES_MISSING"), (1, "HTML_CATALOG_STRUCTURE_MISSING"), (2, "HTML_CATALOG_STRUCTURE_MISSING")]


def test_pages_keep_all_their_tiles(spark, tmp_path):
    from siteledger.plans import derived

    page = "<main>" + "".join(f'<a href="/tile-{k}">tile {k}</a><a href="/tile-{k}/below">below</a>' for k in range(150)) + "</main>"
    spark.createDataFrame([(1, "https://a.example/", page), (2, "https://b.example/", '<a href="/x">x</a><a href="/one">one</a>')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page, r.url) for r in derived.x20_tiles(spark, str(tmp_path)).collect())
    # Every fifth link has no image and every seventh advertises; what stands below a tile is none.
    linked = [(k, s) for n, (k, s) in enumerate((k, s) for k in range(150) for s in ("", "/below")) if n % 5 and n % 7]
    want = [(1, f"https://a.example/tile-{k}{s}") for k, s in linked if not s or (k, "") not in linked]
    assert len(want) > 120 and got == sorted([*want, (2, "https://b.example/one")])
    links = spark.range(100).selectExpr("1L page", "'https://a.example/' page_url", "cast(99 - id as int) ord", "concat('tile ', id) label", "concat('https://a.example/t', id) url", "'https://img.example/i.png' image")
    assert [(r.n, r.label) for r in catalog.tiles(links).orderBy("n").collect()] == [(k + 1, f"tile {99 - k}") for k in range(100)]


def test_offers_of_all_kinds_and_conditions(spark):
    def page(i, offers):
        node = {"@context": "https://schema.org", "@type": "Product", "url": "/d", "offers": offers}
        return (i, "https://a.example/d", f'<script type="application/ld+json">{json.dumps(node)}</script>')

    rows = [
        page(1, [{"@type": "Offer", "price": "5.00", "priceCurrency": "RUB", "priceValidUntil": "2027-01-01", "eligibleCustomerType": {"a": 1}, "eligibleRegion": "RU", "priceSpecification": {"valueAddedTaxIncluded": False, "unitText": "m2"}}]),
        page(2, [{"@type": "AggregateOffer", "price": "7", "priceCurrency": "RUB"}, {"@type": "AggregateOffer", "lowPrice": "5", "highPrice": "x", "priceCurrency": "RUB", "url": "/d#2"}]),
        page(3, [{"@type": "Offer", "lowPrice": "5", "highPrice": "9", "priceCurrency": "RUB"}, {"@type": "Demand", "price": "1"}, {"price": "2"}]),
    ]
    parsed = html.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = structured.offer_prices(structured.offers(parsed, "page_id"), spark.createDataFrame([], "page_id long, minor long"), "page_id")
    mine = sorted((r.page_id, r.ord, r.kind, r.conditions, r.unit, r.status) for r in got.collect())
    assert mine == [
        (1, 0, "exact", ['priceValidUntil: "2027-01-01"', 'eligibleCustomerType: {"a":1}', 'eligibleRegion: "RU"', "valueAddedTaxIncluded: false"], "m2", "OBSERVED"),
        (2, 0, "from", [], None, "OBSERVED"),
        (2, 1, "range", [], None, "REQUIRES_REVIEW"),
        (3, 0, "from", [], None, "OBSERVED"),
    ]


def test_raw_exports_and_their_files(spark, tmp_path):
    (tmp_path / "a.raw.json").write_text(json.dumps({"source_url": "u", "document_url": "u", "observed_at": "2026-01-01T00:00:00Z", "html": "<p>é", "links": []}))
    (tmp_path / "a.html").write_bytes("<p>é".encode())
    assert readers.raw_exports(spark, str(tmp_path)).first().source_url == "u"
    (tmp_path / "a.html").write_bytes(b"other")
    with pytest.raises(Exception, match="differs"):
        readers.raw_exports(spark, str(tmp_path)).collect()


def test_manifests_are_strict(spark, tmp_path):
    m = {"schema_version": 1, "kind": "k", "capture_id": "c", "project_id": "p", "source_origin": "o", "captured_at": "2026-01-01T00:00:00Z", "inventory": {"basis": "b", "urls": ["u1", "u2"]}, "observations": [{"source_url": "u1", "document_url": "u1", "observed_at": "2026-01-01T00:00:00Z", "format": "dom-html", "file": {"relative_path": "f", "sha256": "s", "size_bytes": 1}}], "assets": []}
    (tmp_path / "m.json").write_text(json.dumps(m))
    inventory, observations, assets = readers.capture_manifest(spark, str(tmp_path / "m.json"))
    assert [r.raw_url for r in inventory.collect()] == ["u1", "u2"] and observations.first().file.size_bytes == 1 and assets.count() == 0
    (tmp_path / "n.json").write_text(json.dumps({**m, "extra": 1}))
    with pytest.raises(Exception, match="unknown or missing"):
        readers.capture_manifest(spark, str(tmp_path / "n.json"))[0].collect()


def test_results_are_named_by_content(spark, tmp_path):
    df = spark.range(10)
    path = readers.write_named_by_content(df, f"file://{tmp_path}/r")
    assert readers.write_named_by_content(df.orderBy(F.desc("id")), f"file://{tmp_path}/r") == path
    assert readers.write_named_by_content(spark.range(11), f"file://{tmp_path}/r") != path
    readers.export_events(spark.range(3).withColumnRenamed("id", "sequence"), f"{tmp_path}/events")
    assert spark.read.json(f"{tmp_path}/events").count() == 3


@pytest.mark.parametrize("markup", ["<![foo[bar]]>", "<![ x >", "<![if !IE>", "<![CDATA[x>", "<![endif]-->", "<!>", "<!x>", "<![foo[", "&#" + "9" * 5000 + ";", "&#" + "0" * 5000 + "65;"])
def test_unknown_declarations_do_not_end_the_page(markup):
    got = html.parse(f"<a href=/1>x</a>{markup}<h2>h</h2><a href=/2>y</a><!-- a --><p>text</p>")
    assert [x["href"] for x in got["links"]] == ["/1", "/2"]
    assert "text" in got["text"] and ("[foo[" in markup or got["headings"][0]["text"] == "h")


def shape(node):
    return node if isinstance(node, str) else f"<{node.tag}>" + "".join(map(shape, node.children)) + f"</{node.tag}>"


@pytest.mark.parametrize(
    ("markup", "body"),
    [
        ("<p>a<p>b<div>c</p>d", "<p>a</p><p>b</p><div>c<p></p>d</div>"),
        ("<b>1<i>2</b>3</i>4", "<b>1<i>2</i></b><i>3</i>4"),
        ("<b>1<p>2</b>3</p>4", "<b>1</b><p><b>2</b>3</p>4"),
        ("<a>1<div>2<a>3</a>4</div>", "<a>1</a><div><a>2</a><a>3</a>4</div>"),
        ("<table>x<tr><b>y<td>1<td>2<tr><td>3</table>z", "x<b>y</b><table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table><b>z</b>"),
        ("<table><td>1<table><tr><th>2</table>3</table>4", "<table><tbody><tr><td>1<table><tbody><tr><th>2</th></tr></tbody></table>3</td></tr></tbody></table>4"),
        ("<ul><li>1<ul><li>2</ul><li>3</ul>", "<ul><li>1<ul><li>2</li></ul></li><li>3</li></ul>"),
        ("<dl><dt>1<dd>2<dt>3</dl>", "<dl><dt>1</dt><dd>2</dd><dt>3</dt></dl>"),
        ("<h1>1<h2>2</h1>3", "<h1>1</h1><h2>2</h2>3"),
        ("<select><option>1<option>2<div>3</div></select>4", "<select><option>1</option><option>23</option></select>4"),
        ("<svg><path/><p>1", "<svg><path></path></svg><p>1</p>"),
        ("<textarea><p>1</textarea><tr><td>2", "<textarea><p>1</textarea>2"),
        ("<button>1<button>2", "<button>1</button><button>2</button>"),
    ],
)
def test_trees_follow_the_standard(markup, body):
    assert "".join(map(shape, tree.built(markup).body.children)) == body


def ordered(markup, url="https://a.example/p"):
    return [(b["type"], *(b[k] for k in ("text", "level", "items", "rows", "href", "source") if b[k] is not None)) for b in html.parse(markup, ("ordered",), url)["ordered"]]


def test_the_ordered_walk_keeps_loose_text():
    assert ordered("<main>loose <b>text</b><div>more</div>tail<br>end</main>") == [("paragraph", "loose text"), ("paragraph", "more"), ("paragraph", "tail\nend")]
    assert ordered("<main><form>f <input value=x><section>s</section></form><nav>n</nav><span>a<p>b</p>c</span></main>") == [("paragraph", "f"), ("paragraph", "s"), ("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c")]
    assert ordered("<header>out</header>in<footer>out</footer><p style='display : none'>x</p><div hidden>y</div>") == [("paragraph", "in")]


def test_the_ordered_walk_names_links_media_and_whole_blocks():
    got = ordered("<main><h2><a href=/x>X</a></h2><p>see <a href='https://a.example/y'>Y</a> <img src=i.png alt=I><a href=/z><img src=z.png alt=Z></a></p><a href=https://b.example/>foreign</a><a href=/f.pdf?v=1>File</a><ul><li>1<li><a href=/w>2</a></ul><table><tr><th>a<td>b<table><tr><td>in</table></table></main>")
    assert got == [
        ("link", "X", 2, "/x"),  # of a heading, which it is if the link may not be followed
        ("paragraph", "see Y"),
        ("link", "Y", "https://a.example/y"),
        ("image", "I", "i.png"),
        ("link", "Z", "/z", "z.png"),
        ("paragraph", "foreign"),
        ("document", "File", "/f.pdf?v=1"),
        ("list", ["1", "2"]),
        ("link", "2", "/w"),
        ("table", [["a", "bin"]]),
    ]


def test_cards_are_repeated_siblings_with_one_linked_image():
    card = "<div><a href='{0}'><img src={0}.png></a><h3><a href='{0}'>Card {0}</a></h3><p>about {0}</p>from {0}<a href=/cart>Buy</a></div>"
    one, two = card.format("/1"), card.format("/2")
    assert ordered(f"<main>{one}{two}<p>end</p></main>") == [("card", "Card /1", ["about /1", "from /1"], "/1", "/1.png"), ("card", "Card /2", ["about /2", "from /2"], "/2", "/2.png"), ("paragraph", "end")]
    assert [b[0] for b in ordered(f"<main>{one}</main>")] == ["image", "link", "paragraph", "paragraph", "link"]


def test_deep_and_long_pages_are_kept_whole_and_say_so():
    deep = html.parse("<div>" * 300 + "<p>x</p>", ("blocks", "ordered", "limits"))
    assert [b["text"] for b in deep["blocks"]] == [b["text"] for b in deep["ordered"]] == ["x"] and deep["limits"] == ["DOM_DEPTH"]
    long = html.parse("<p>x</p>" * 10_001, ("blocks", "ordered", "limits"))
    assert len(long["blocks"]) == len(long["ordered"]) == 10_001 and long["limits"] == ["DOM_BLOCKS"]
    assert html.parse("<p>x", ("limits",))["limits"] == []
    nested = "<div>" * 5000 + "<b>x</b>" * 5000
    assert html.sanitize_one(nested) == "<b>x</b>" * 5000 and html.parse(nested)["text"] == "x" * 5000


def test_work_follows_the_page():
    import time

    def seconds(n):
        page = "<div>" * 150 + "".join(f"<div><h3><a href=/{k}>C{k}</a></h3><a href=/{k}><img src={k}.png></a></div>" for k in range(n)) + "</div>" * 150
        began = time.process_time()
        assert len(html.parse(page)["cards"]) == n
        return time.process_time() - began

    seconds(50)
    assert seconds(3000) < 10 * seconds(600)


def test_the_primary_region_is_the_one_that_is_usable():
    name = lambda markup: html.parse(markup, ("primary",))["primary"]
    assert name("<main hidden>x</main><main>y</main>") == "main" and name("<main>x</main><main>y</main>") == "body"
    assert name("<main><script>x</script><nav>n</nav></main><div role=main>z</div>") == "[role=main]"
    assert name("<main><img src=i></main>") == "main" and name("<header><main>x</main></header><p id=content>y</p>") == "#content"
    assert name("<article>x<h1>h</h1></article>") == "article" and name("<h1>h</h1><article>x</article>") == "body" and name("<article>x</article>") == "article"
    assert name("<div style='a:b; visibility:hidden !important'><main>x</main></div><div id=main>y</div>") == "#main"
