"""Queries whose inputs (product pages, sitemaps, headers, packages, navigations) Spark derives from parts, events and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteledger.functions import http
from siteledger.operators import catalog, common, importing, queue, registry, reports, routes, structured
from siteledger.plans.commerce import AMOUNT, TEXT, _import, _inventory, _parts, _priced, t
from siteledger.plans.site import TARGETS, links
from siteledger.sources import html, readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _dealt_parts(spark, d):
    return common.dealt(t(spark, d, "part"), "p_partkey")


def _product_pages(spark, d, *fields):
    """A product page for each part: JSON-LD of its own and of a foreign product, price texts, a table and a choice."""
    p = _priced(_dealt_parts(spark, d)).withColumn("id", F.col("p_partkey").cast("string"))
    own = F.concat(F.lit('{"@type":"Product","url":"/p/'), F.col("id"), F.lit('","sku":"S'), F.col("id"), F.lit('","name":"'), F.col("p_name"), F.lit('","additionalProperty":[{"name":"Brand","value":"'), F.col("p_brand"), F.lit('"}],"offers":['), F.lit('{"@type":"Offer","price":"'), F.col("amount"), F.lit('","priceCurrency":"RUB"'), F.when(F.col("p_size") % 4 == 0, F.lit(',"url":"/p/elsewhere"')).otherwise(F.lit("")), F.lit('}],"hasVariant":[{"@type":"Product","sku":"V1","additionalProperty":[{"name":"Size","value":"1"}]},{"@type":"Product","sku":"V2"}]}'))
    ld = F.concat(F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@graph":['), own, F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(","), own)).otherwise(F.lit("")), F.lit(',{"@type":"Product","url":"/p/foreign","name":"F"}]}</script>'))
    body = F.concat(F.lit('<body><main><h1>'), F.col("p_name"), F.lit('</h1><span class="price">'), F.col("amount"), F.lit(' RUB/шт.</span><table><tr><td>Type:<td>'), F.col("p_type"), F.lit('</table><select name=size required><option>S<option>M</select><div><div><h3><a href="/c/'), F.col("id"), F.lit('">One</a></h3></div><div><h3><a href="/c/x">Two</a></h3></div></div></main></body>'))
    page = p.select("p_partkey", F.concat(F.lit("https://shop.example/p/"), F.col("id")).alias("url"), F.concat(F.lit("<html><head>"), ld, F.lit("</head>"), body).alias("html"))
    return html.parsed(page, fields=fields)


@query("SELECT p_partkey, 'S' || p_partkey AS sku FROM part WHERE p_size % 5 <> 0")
def x6_page_bound_nodes(spark, d):
    return structured.bound_nodes(_product_pages(spark, d, "ld"), "p_partkey").select("p_partkey", F.col("node.sku").alias("sku"))


@query(
    """WITH b AS (
        SELECT p_partkey, unnest([
            {'place': 1::BIGINT, 'type': 'heading', 'level': 1, 'text': p_name, 'more': NULL},
            {'place': 2, 'type': 'table', 'level': NULL, 'text': NULL, 'more': 'Type:,' || p_type},
            {'place': 3, 'type': 'heading', 'level': 3, 'text': 'One', 'more': NULL},
            {'place': 4, 'type': 'heading', 'level': 3, 'text': 'Two', 'more': NULL}]) AS b FROM part)
    SELECT p_partkey, 'main' AS "primary", b.place AS place, b.type AS type, b.level AS level, b.text AS text, b.more AS more FROM b"""
)
def x7_x9_primary_and_blocks(spark, d):
    rows = _product_pages(spark, d, "primary", "blocks").select("p_partkey", "parse.primary", F.explode_outer("parse.blocks").alias("b"))
    more = F.nullif(F.concat_ws(",", "b.items", F.flatten("b.rows"), "b.source", "b.alt"), F.lit(""))
    return rows.select("p_partkey", "primary", (F.col("b.ord") + 1).cast("bigint").alias("place"), "b.type", "b.level", "b.text", more.alias("more"))


def _loose_pages(spark, d, *fields):
    """A page for each part, of loose text, broken markup, links of all kinds, repeated links, cards, and what is no content."""
    p = _dealt_parts(spark, d)
    name, link = F.col("p_name"), F.concat(F.lit("/c/"), (F.col("p_partkey") % 100).cast("string"))
    card = lambda n: F.concat(F.lit(f'<div><a href="/k/{n}"><img src="/k{n}.png"></a><h3><a href="/k/{n}">K{n} '), "p_brand", F.lit("</a></h3><p>"), "p_type", F.lit("</p></div>"))
    bare = F.when(F.col("p_size") % 3 == 0, F.lit("<nav>menu</nav><script>no</script><div hidden>no</div><button>no</button><p style='display:none'>no")).otherwise("")
    body = F.concat(
        F.when(F.col("p_size") % 2 == 0, F.lit("<header>top</header><main>")).otherwise(F.lit("<header>top</header>")),
        *(name, F.lit(" <b>is <i>"), "p_type", F.lit("</b></i><div>made by "), "p_brand", F.lit("</div>"), bare, F.lit("<p>see <a href='"), link, F.lit("'>"), name, F.lit("</a><h2><a href='")),
        *(link, F.lit("#part'>"), name, F.lit("</a></h2><a href='/cart/add'>Buy</a><table>"), "p_brand", F.lit("<tr><td>size<td>"), F.col("p_size").cast("string"), F.lit("</table><ul><li>a<li>b</ul>")),
        F.when(F.col("p_size") % 5 == 0, F.concat(card(1), card(2), card(1))).otherwise(""),
        F.lit("end<br>of page"),
    )
    page = p.select("p_partkey", F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string")).alias("url"), body.alias("html"))
    return html.parsed(page, fields=fields)


@query(
    """WITH b AS (
        SELECT p_partkey, unnest([
            {'at': 0, 'type': 'paragraph', 'text': p_name || ' is ' || p_type, 'target': NULL, 'more': NULL},
            {'at': 1, 'type': 'paragraph', 'text': 'made by ' || p_brand, 'target': NULL, 'more': NULL},
            {'at': 2, 'type': 'paragraph', 'text': 'see ' || p_name, 'target': NULL, 'more': NULL},
            {'at': 3, 'type': 'link', 'text': p_name, 'target': '/c/' || p_partkey % 100, 'more': NULL},
            {'at': 4, 'type': 'paragraph', 'text': 'Buy', 'target': NULL, 'more': NULL},
            {'at': 5, 'type': 'paragraph', 'text': p_brand, 'target': NULL, 'more': NULL},
            {'at': 6, 'type': 'table', 'text': NULL, 'target': NULL, 'more': 'size,' || p_size},
            {'at': 7, 'type': 'list', 'text': NULL, 'target': NULL, 'more': 'a,b'},
            {'at': 8, 'type': 'card', 'text': 'K1 ' || p_brand, 'target': '/k/1', 'more': p_type},
            {'at': 9, 'type': 'card', 'text': 'K2 ' || p_brand, 'target': '/k/2', 'more': p_type},
            {'at': 10, 'type': 'paragraph', 'text': 'end' || chr(10) || 'of page', 'target': NULL, 'more': NULL}]) AS b, p_size FROM part)
    SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY b.at) AS place, b.type AS type, b.text AS text, b.target AS target, b.more AS more FROM b WHERE p_size % 5 = 0 OR b.at NOT IN (8, 9)"""
)
def x10_ordered_walk(spark, d):
    blocks = structured.ordered_blocks(_loose_pages(spark, d, "ordered"), "p_partkey")
    more = F.when(F.col("rows").isNotNull(), F.concat_ws(",", F.flatten("rows"))).when(F.col("items").isNotNull(), F.concat_ws(",", "items"))
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy("ord"))
    return blocks.select("p_partkey", place.cast("bigint").alias("place"), "type", "text", F.col("request_target").alias("target"), more.alias("more"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'main' ELSE 'body' END AS region,
        regexp_replace(concat_ws(' ', p_name, 'is', p_type || 'made by', p_brand || 'see', p_name || p_name || 'Buy' || p_brand || 'size' || p_size || 'ab', ''), ' $', '')
        || CASE WHEN p_size % 5 = 0 THEN 'K1 ' || p_brand || p_type || 'K2 ' || p_brand || p_type || 'K1 ' || p_brand || p_type ELSE '' END || 'end of page' AS text FROM part"""
)
def x8_primary_content(spark, d):
    return _loose_pages(spark, d, "primary", "text").select("p_partkey", F.col("parse.primary").alias("region"), F.col("parse.text").alias("text"))


@query("SELECT p_partkey, '/c/' || p_partkey AS href, 'One' AS label FROM part UNION ALL SELECT p_partkey, '/c/x', 'Two' FROM part")
def x11_cards(spark, d):
    return structured.cards(_product_pages(spark, d, "cards"), "p_partkey").select("p_partkey", "href", "label")


@query(f"SELECT p_partkey, 'exact' AS kind, {AMOUNT} AS minor, CASE WHEN p_size % 4 = 0 THEN 'OFFER_URL_FOREIGN' END AS limitation FROM part WHERE p_size % 5 <> 0")
def c8_c9_offers(spark, d):
    rows = structured.offers(_product_pages(spark, d, "ld"), "p_partkey")
    return rows.select("p_partkey", "kind", F.col("money.minor").alias("minor"), F.try_element_at("limitations", F.lit(1)).alias("limitation"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'REQUIRES_REVIEW' ELSE 'OBSERVED' END AS status FROM part WHERE p_size % 5 <> 0")
def c17_offer_prices(spark, d):
    pages = common.written(_product_pages(spark, d, "ld", "prices"), "parsed")
    visible = structured.visible_prices(pages, "p_partkey").select("p_partkey", F.col("price.money.minor").alias("minor"))
    return structured.offer_prices(structured.offers(pages, "p_partkey"), visible, "p_partkey").select("p_partkey", "status")


@query(f"SELECT p_partkey, 'CURRENT' AS role, {AMOUNT} AS minor, 'piece' AS unit, true AS eligible FROM part")
def c7_visible_prices(spark, d):
    rows = structured.visible_prices(_product_pages(spark, d, "prices"), "p_partkey")
    return rows.select("p_partkey", F.col("price.role").alias("role"), F.col("price.money.minor").alias("minor"), F.col("price.unit").alias("unit"), F.col("price.totals_eligible").alias("eligible"))


@query("SELECT p_partkey, 'Type' AS name, p_type AS value FROM part UNION ALL SELECT p_partkey, 'Brand', p_brand FROM part WHERE p_size % 5 <> 0")
def c11_attributes(spark, d):
    return structured.attributes(common.written(_product_pages(spark, d, "ld", "attributes"), "parsed"), "p_partkey")


@query("SELECT p_partkey, unnest(['V1', 'V2']) AS sku FROM part WHERE p_size % 5 <> 0")
def c14_variants(spark, d):
    return structured.variants(_product_pages(spark, d, "ld"), "p_partkey").select("p_partkey", "sku")


@query("SELECT p_partkey, 'size' AS label, 2 AS options, true AS selection_required FROM part")
def c15_selections(spark, d):
    return structured.selections(_product_pages(spark, d, "selections"), "p_partkey").select("p_partkey", "label", F.size("options").alias("options"), "selection_required")


@query(
    """WITH p AS (SELECT l_orderkey AS owner, l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS ord, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_returnflag <> 'R' AND l_linestatus = 'F' AS current,
        concat(CAST(l_quantity AS BIGINT) % 3, ' ', CASE WHEN l_suppkey % 7 <> 0 THEN 'piece' END, ' ', l_discount > 0.08) AS grp, l_suppkey % 7 <> 0 AND NOT l_discount > 0.08 AS eligible,
        CASE WHEN l_linenumber < 6 THEN 2 END AS lo, CASE WHEN l_linenumber < 5 THEN 1 END AS step, CASE WHEN l_tax > 0.06 THEN CAST(l_quantity AS BIGINT) % 4 END AS hi, l_linenumber % 2 = 0 AS given, l_linenumber = 3 AS choose FROM lineitem),
    g AS (SELECT owner, count(DISTINCT grp) FILTER (current) AS n, min_by(id, ord) FILTER (current) AS id, min_by(eligible, ord) FILTER (current) AS eligible, max(lo) AS lo, max(step) AS step, max(hi) AS hi, bool_or(given) AS given, bool_or(choose) AS choose FROM p GROUP BY owner)
    SELECT owner, CASE WHEN n = 1 THEN id END AS price_id, concat_ws(',', CASE WHEN n > 1 THEN 'AMBIGUOUS_CURRENT_PRICE' WHEN n = 0 THEN 'CURRENT_EXACT_PRICE_UNKNOWN' END, CASE WHEN n = 1 AND NOT eligible THEN 'PRICE_UNIT_CURRENCY_OR_CONDITIONS_UNRESOLVED' END,
        CASE WHEN lo IS NULL THEN 'MIN_QUANTITY_UNKNOWN' END, CASE WHEN step IS NULL THEN 'QUANTITY_STEP_UNKNOWN' END, CASE WHEN choose THEN 'VARIANT_SELECTION_REQUIRED' END, CASE WHEN given AND hi IS NULL THEN 'INVALID_MAX_QUANTITY' END, CASE WHEN lo > hi THEN 'INCONSISTENT_QUANTITY_RANGE' END) AS blockers FROM g"""
)
def c12_purchase_rules(spark, d):
    l = t(spark, d, "lineitem")
    n, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    limited = F.col("l_discount") > 0.08
    unit = F.when(F.col("l_suppkey") % 7 != 0, "piece")
    rows = l.select(
        F.col("l_orderkey").alias("owner"),
        (n * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("ord"),
        F.concat_ws("-", n, "l_partkey", "l_suppkey").alias("id"),
        F.when(F.col("l_returnflag") != "R", "CURRENT").otherwise("OLD").alias("role"),
        F.when(F.col("l_linestatus") == "F", "OBSERVED").otherwise("REQUIRES_REVIEW").alias("status"),
        (quantity % 3).alias("minor"),
        F.lit("RUB").alias("currency"),
        unit.alias("unit"),
        F.when(limited, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("conditions"),
        (unit.isNotNull() & ~limited).alias("eligible"),
        F.when(n < 6, 2).cast("bigint").alias("min_quantity"),
        F.when(n < 5, 1).cast("bigint").alias("quantity_step"),
        F.when(F.col("l_tax") > 0.06, quantity % 4).alias("max_quantity"),
        (n % 2 == 0).alias("max_given"),
        (n == 3).alias("selection_required"),
    )
    return catalog.purchase_rule(rows).select("owner", "price_id", F.array_join("blockers", ",").alias("blockers"))


@query("SELECT CASE p_size % 6 WHEN 0 THEN 'HOME' WHEN 1 THEN 'PRODUCT' WHEN 2 THEN 'ARTICLE' WHEN 3 THEN 'SERVICE' WHEN 4 THEN 'CATEGORY' ELSE 'CONTENT' END AS kind, count(*) AS n FROM part GROUP BY 1")
def c13_page_kinds(spark, d):
    m = F.col("p_size") % 6
    classes = F.when(m == 1, F.array(F.lit("Service"), F.lit("Product"))).when(m == 2, F.array(F.lit("NewsArticle"))).when(m == 3, F.array(F.lit("Service"))).otherwise(F.array().cast("array<string>"))
    kind = catalog.page_kind(m == 0, classes, F.when(m == 4, 2).otherwise(1), F.lit(3))
    return t(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Cloudflare' WHEN 1 THEN 'KillBot' END AS provider FROM events")
def u11_access_challenges(spark, d):
    m = F.col("event_id") % 3
    headers = F.when(m == 0, F.create_map(F.lit("cf-mitigated"), F.lit("Challenge"))).otherwise(F.create_map(F.lit("server"), F.col("event_type")))
    title = F.when(m == 1, F.concat(F.lit("KillBot user verification ["), F.col("event_id").cast("string"), F.lit("]..."))).otherwise(F.lit("About KillBot user verification"))
    return t(spark, d, "events").select("event_id", http.access_challenge(headers, title)["provider"].alias("provider"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'dom' END AS evidence_kind FROM events WHERE event_id % 3 = 0")
def r9_stored_challenges(spark, d):
    title = lambda odd: F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") % 2 == odd), "KillBot user verification").otherwise("page")
    pages = t(spark, d, "events").select(F.col("event_id").alias("url"), title(0).alias("body_title"), title(1).alias("dom_title"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"))
    return registry.stored_challenges(pages).select(F.col("url").alias("event_id"), "evidence_kind")


@query("SELECT 'u' || p_partkey AS url, 'page' AS kind, count(*) AS n FROM part GROUP BY 1, 2 UNION ALL SELECT 'missing', 'failed', 1")
def r5_sitemaps(spark, d):
    """Sitemaps of 500 pages each, under indexes of 50 sitemaps each, under one index."""
    p = t(spark, d, "part")
    loc = lambda c: F.concat(F.lit("<loc> "), c, F.lit(" </loc>"))
    listed = lambda c, kind: F.concat(F.lit(f"<{kind}>"), F.concat_ws("", F.collect_list(loc(c))), F.lit(f"</{kind}>"))
    sets = p.groupBy(F.floor(F.col("p_partkey") / 500).alias("k")).agg(listed(F.concat(F.lit("u"), F.col("p_partkey").cast("string")), "urlset").alias("text"))
    sets = sets.select(F.concat(F.lit("set-"), F.col("k").cast("string")).alias("url"), "text", "k")
    middle = sets.groupBy(F.floor(F.col("k") / 50).alias("m")).agg(listed(F.col("url"), "sitemapindex").alias("text")).select(F.concat(F.lit("index-"), F.col("m").cast("string")).alias("url"), "text")
    index = middle.agg(F.concat(F.lit("<sitemapindex><loc>missing</loc><loc>index</loc>"), F.concat_ws("", F.collect_list(loc(F.col("url")))), F.lit("</sitemapindex>")).alias("text")).select(F.lit("index").alias("url"), "text")
    sets = sets.drop("k").unionByName(middle)
    seeds = spark.range(1).select(F.lit("index").alias("url"))
    return registry.expand_sitemaps(seeds, sets.unionByName(index)).groupBy("url", "kind").agg(F.count("*").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'SIZE_MISMATCH' ELSE 'HASH_MISMATCH' END AS reason FROM documents WHERE doc_id % 5 <= 2")
def r7_snapshot_verification(spark, d):
    docs, m = t(spark, d, "documents"), F.col("doc_id") % 5
    raw = F.col("text").cast("binary")
    registered = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(m == 2, "0").otherwise(F.sha2(raw, 256)).alias("sha256"), (F.octet_length("text") + F.when(m == 1, 1).otherwise(0)).cast("bigint").alias("size_bytes"))
    return registry.snapshot_defects(registered, docs.filter(m != 0).select(F.col("doc_id").cast("string").alias("path"), raw.alias("content")))


@query("SELECT DISTINCT user_id AS crawl_key, 'UNOBSERVED' AS observation FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150)")
def r14_inherited_inventory(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("crawl_key"), "value")
    return registry.inherited(e, e.filter("value > 150"))


@query("WITH own AS (SELECT 'u' || user_id AS url, max(ts) AS own_at FROM events WHERE event_type = 'view' GROUP BY 1), asked AS (SELECT 'u' || user_id AS url, ts FROM events WHERE event_type = 'click' AND event_id % 2 = 0) SELECT DISTINCT a.url FROM asked a LEFT JOIN own o ON a.url = o.url WHERE own_at IS NULL OR ts >= own_at")
def r19_pending_navigation(spark, d):
    e = t(spark, d, "events").withColumn("url", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    asked = e.filter("event_type = 'click'").select(F.lit("requested-url").alias("kind"), "url", F.concat(F.lit("final"), F.col("event_id").cast("string")).alias("source_url"), F.col("ts").alias("observed_at"), F.lit("h").alias("html_sha256"), F.lit("i").alias("input_id"))
    final = asked.join(e.filter("event_id % 2 = 0").select(F.concat(F.lit("final"), F.col("event_id").cast("string")).alias("source_url")), "source_url", "left_semi").select("input_id", "source_url", F.col("source_url").alias("document_url"), "observed_at", F.col("html_sha256").alias("snapshot_sha256"), F.lit("DOM_OBSERVED").alias("status"))
    own = e.filter("event_type = 'view'").select(F.lit("i").alias("input_id"), F.col("url").alias("source_url"), F.lit("other").alias("document_url"), F.col("ts").alias("observed_at"), F.lit("x").alias("snapshot_sha256"), F.lit("DOCUMENT_MISMATCH").alias("status"))
    return queue.pending_navigation(asked, final.unionByName(own), queue.latest_status(own))


@query(
    f"""WITH {TARGETS}, l AS (SELECT page_id, ord, origin || request_target AS target, regexp_replace(url, '#.*$', '') AS own, CASE WHEN ord % 7 = 0 THEN 'Все акции ' ELSE '' END || substr(href, 2) AS label FROM targets WHERE ord % 5 <> 0),
    f AS (SELECT page_id, target FROM l WHERE target <> own AND length(label) BETWEEN 3 AND 75 AND NOT contains(label, 'акци') GROUP BY ALL),
    k AS (SELECT page_id, target FROM f WHERE NOT EXISTS (SELECT 1 FROM f p WHERE p.page_id = f.page_id AND p.target <> f.target AND starts_with(f.target, CASE WHEN ends_with(p.target, '/') THEN p.target ELSE p.target || '/' END)))
    SELECT page_id AS page, target AS url FROM k"""
)
def x20_tiles(spark, d):
    from siteledger.functions import urls

    label = F.concat(F.when(F.col("ord") % 7 == 0, F.lit("Все акции ")).otherwise(F.lit("")), F.expr("substring(href, 2)"))
    rows = links(spark, d).select(F.col("page_id").alias("page"), F.regexp_replace("url", "#.*$", "").alias("page_url"), "ord", label.alias("label"), urls.identity(F.col("absolute"))["crawl_key"].alias("url"), F.when(F.col("ord") % 5 != 0, F.lit("https://img.example/i.png")).alias("image"))
    return catalog.tiles(common.written(rows, "links")).select("page", "url")


@query("SELECT CAST(event_id // 3 AS VARCHAR) AS crawl_key, CASE WHEN o = 'UNOBSERVED' THEN 'UNOBSERVED' WHEN k % 2 = 1 THEN 'NOT_SELECTED' WHEN k % 3 = 0 THEN 'NO_ENTITY' ELSE 'CONFLICT' END AS outcome FROM (SELECT event_id // 3 AS k, min(event_id) AS event_id, CASE WHEN bool_or(event_type IN ('purchase', 'signup')) THEN 'SEEN' ELSE 'UNOBSERVED' END AS o FROM events GROUP BY 1)")
def j3_observed_plan(spark, d):
    inventory, k = _inventory(spark, d), F.col("crawl_key").cast("bigint")
    return routes.observed_plan(inventory, inventory.filter(k % 2 == 0), inventory.filter(k % 3 != 0).select(F.col("crawl_key").alias("source_url"), F.col("crawl_key").alias("source_id"))).select("crawl_key", "outcome")


@query("WITH r AS (SELECT '/' || (p_partkey // 2 * 2) AS request_target, p_partkey % 6 AS m FROM part) SELECT DISTINCT request_target, 'DUPLICATE_TARGET' AS reason FROM (SELECT request_target FROM r GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT request_target, CASE m WHEN 0 THEN 'MISSING_ENTITY' WHEN 1 THEN 'MISSING_REDIRECT' ELSE 'UNSUPPORTED_STATUS' END FROM r WHERE m <= 2")
def j6_route_defects(spark, d):
    p, m = t(spark, d, "part"), F.col("p_partkey") % 6
    r = p.select(F.concat(F.lit("/"), (F.floor(F.col("p_partkey") / 2) * 2).cast("string")).alias("request_target"), F.when(m == 0, "no").otherwise("yes").alias("entity_source_id"), F.when(m == 1, 301).when(m == 2, 418).otherwise(200).alias("expected_status"), F.lit(None).cast("string").alias("redirect_to"))
    return routes.route_defects(r, spark.createDataFrame([("yes",)], "source_id string"))


@query(f"WITH {TARGETS} SELECT substring(href, 2) AS label, request_target, min(ord) AS ord FROM targets WHERE request_target IN (SELECT request_target FROM targets WHERE page_id % 2 = 0) AND substring(href, 2) <> '' GROUP BY 1, 2")
def j8_navigation(spark, d):
    from siteledger.functions import urls

    rows = links(spark, d).select("page_id", F.col("ord").cast("bigint").alias("ord"), F.expr("substring(href, 2)").alias("label"), urls.identity(F.col("absolute"))["request_target"].alias("request_target"))
    live = rows.filter("page_id % 2 = 0").select("request_target", F.lit(200).alias("expected_status"))
    return routes.navigation(rows, live).select("label", "request_target", "ord")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 7 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'UNLISTED' ELSE 'HASH_MISMATCH' END AS reason FROM part WHERE p_partkey % 7 <= 2")
def j9_package_integrity(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % 7).alias("m"), F.sha2("p_name", 256).alias("sha256"))
    return reports.package_defects(p.filter("m <> 1").select("path", "sha256"), p.filter("m <> 0").select("path", F.when(F.col("m") == 2, "x").otherwise(F.col("sha256")).alias("sha256")))


@query(
    """WITH e AS (SELECT *, p_partkey % 13 AS m FROM part), d AS (
        SELECT 'f' || p_partkey AS subject, 'MISSING' AS reason FROM e WHERE m = 0 UNION ALL SELECT 'f' || p_partkey, 'UNLISTED' FROM e WHERE m = 1 UNION ALL SELECT 'f' || p_partkey, 'HASH_MISMATCH' FROM e WHERE m = 2
        UNION ALL SELECT '../f' || p_partkey, 'UNSAFE_PACKAGE_PATH_OR_HASH' FROM e WHERE m = 3
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), CASE m WHEN 4 THEN 'ENTITY_INCOMPLETE' ELSE 'ENTITY_KEY_MISMATCH' END FROM e WHERE m IN (4, 5)
        UNION ALL SELECT sha256('part:' || p_partkey), 'ENTITY_KEY_REPEATED' FROM e WHERE m = 6
        UNION ALL SELECT '/p/' || p_partkey, CASE m WHEN 7 THEN 'ROUTE_KEY_MISMATCH' ELSE 'ROUTE_WITHOUT_ENTITY' END FROM e WHERE m IN (5, 7, 8)
        UNION ALL SELECT '/p/' || p_partkey, 'ROUTE_REPEATED' FROM e WHERE m = 9
        UNION ALL SELECT '/upload/' || p_partkey, 'RESERVED_ROUTE_COLLISION' FROM e WHERE m = 10
        UNION ALL SELECT 'routes', 'PACKAGE_COUNT_MISMATCH')
    SELECT subject, reason, count(*) AS rows FROM d GROUP BY ALL"""
)
def j9_package_integrity_all(spark, d):
    p = t(spark, d, "part").withColumn("m", (F.col("p_partkey") % 13).cast("int"))
    m, id_ = F.col("m"), F.col("p_partkey").cast("string")
    again = lambda df, k: df.unionByName(df.filter(m == k))
    path, sha = F.concat(F.when(m == 3, F.lit("../f")).otherwise("f"), id_), F.sha2("p_name", 256)
    listed = p.filter("m <> 1").select(path.alias("path"), sha.alias("sha256"))
    present = p.filter("m <> 0").select(path.alias("path"), F.when(m == 2, F.sha2("p_type", 256)).otherwise(sha).alias("sha256"))
    key = F.sha2(F.concat(F.lit("part:"), id_), 256)
    entities = again(p.select("m", id_.alias("source_id"), F.lit("part").alias("type"), F.when(m == 4, "").otherwise(F.col("p_name")).alias("title"), F.when(m == 5, F.concat(F.lit("old"), id_)).otherwise(key).alias("stable_key")), 6).drop("m")
    target = F.concat(F.when(m == 10, F.lit("/upload/")).otherwise("/p/"), id_)
    routes_ = again(p.select("m", target.alias("request_target"), F.when(m == 7, "old").otherwise(F.sha2(target, 256)).alias("route_key"), F.when(m == 8, F.lit("none")).otherwise(key).alias("entity_key"), F.lit(200).alias("expected_status")), 9).drop("m")
    counts = entities.agg(F.count("*").alias("entities")).withColumn("routes", F.lit(-1))
    return reports.package_integrity(listed, present, counts, entities, routes_, F.sha2(F.concat_ws(":", "type", "source_id"), 256))


@query(
    """WITH e AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Page' WHEN p_size % 4 = 1 THEN 'Article' WHEN p_size % 4 = 2 THEN 'Service' ELSE 'Product' END AS type, p_size FROM part),
    r AS (SELECT * FROM (VALUES ('Page', 'images-if-observed', 3), ('Product', 'observed-prices', 0), ('Product', 'observed-offers', 1), ('Product', 'observed-specifications', 0), ('Product', 'observed-media', 3), ('Article', 'observed-author', 5), ('Article', 'observed-publication-date', 2), ('Service', 'observed-prices', 0)) AS v(type, rule, needs)),
    x AS (SELECT r.type, rule, CASE needs WHEN 0 THEN true WHEN 1 THEN p_size % 5 <> 0 WHEN 2 THEN p_size % 2 = 1 WHEN 3 THEN p_size % 3 = 0 ELSE false END AS applies, p_size % 7 <> 0 AS have FROM r JOIN e ON e.type = r.type)
    SELECT type, rule, count(*) FILTER (applies) AS applies, count(*) FILTER (applies AND have) AS covered FROM x GROUP BY 1, 2"""
)
def a8_conditional_coverage(spark, d):
    p = t(spark, d, "part")
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "Page").when(size % 4 == 1, "Article").when(size % 4 == 2, "Service").otherwise("Product")
    offers = F.when(size % 5 != 0, F.lit(',"offers":[{"@type":"Offer","price":"1"}]')).otherwise("")
    dated = F.when(size % 2 == 1, F.lit(',"datePublished":"2026-01-01"')).otherwise("")
    image = F.when(size % 3 == 0, F.lit("<img src=/i.png>")).otherwise("")
    markup = F.concat(F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@type":"Thing"'), offers, dated, F.lit("}</script><main><span class=price>5 RUB</span><table><tr><td>a<td>b</table>"), image, F.lit("</main>"))
    parsed = html.parsed(_dealt_parts(spark, d).select("p_partkey", markup.alias("html")), fields=("ordered", "media", "prices", "ld", "attributes"))
    names = ("images", "prices", "offers", "specifications", "media", "author", "publication_date")
    facts = p.select(F.col("p_partkey").alias("source_id"), F.explode(F.array(*map(F.lit, names))).alias("name"), F.when(size % 7 != 0, "OBSERVED").otherwise("ABSENT").alias("status"))
    shown = catalog.shown_by_source(parsed, "p_partkey").withColumnRenamed("p_partkey", "source_id")
    return catalog.conditional_coverage(p.select(F.col("p_partkey").alias("source_id"), kind.alias("type")), facts, shown)


@query("SELECT 'UNSAFE_LINK:UNSAFE_ROUTE' AS note, count(*) AS rows FROM part WHERE p_size % 4 = 1 UNION ALL SELECT 'UNSAFE_LINK:RESERVED_ROUTE_COLLISION', count(*) FROM part WHERE p_size % 4 = 2 UNION ALL SELECT 'PRODUCT_WARNING:' || p_brand, count(*) FROM part WHERE p_size % 6 = 0 GROUP BY 1")
def j5_links_and_warnings(spark, d):
    p = t(spark, d, "part")
    m = F.col("p_size") % 4
    targets = p.select(F.when(m == 1, "/a/%2e%2E/b").when(m == 2, "/upload/x").otherwise("/fine?a=b").alias("request_target"))
    warned = p.select("p_partkey", F.when(F.col("p_size") % 6 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("warnings"))
    none = p.filter("false")
    blocks, assets = none.select(F.lit("image").alias("type"), F.lit("x").alias("asset_sha256")), none.select(F.lit("x").alias("sha256"), F.lit("FETCHED").alias("status"))
    return reports.package_blockers(none.select(F.lit("Page").alias("type")), blocks, assets, targets, warned)


def _crumb_pages(spark, d):
    """A page for each part below its brand and type: a trail in the markup, and a structured list that some pages have wrong."""
    p = _dealt_parts(spark, d).withColumn("m", F.col("p_partkey") % 6).withColumn("brand", F.regexp_replace("p_brand", "[^0-9A-Za-z]", "")).withColumn("kind", F.regexp_replace("p_type", "[^A-Za-z]", ""))
    m, path = F.col("m"), F.concat(F.lit("/b/"), "brand", F.lit("/"), "kind", F.lit("/"), F.col("p_partkey").cast("string"))
    entry = lambda pos, name, url: F.concat(F.lit('{"@type":"ListItem","position":'), pos, F.lit(',"name":"'), name, F.lit('","item":"'), url, F.lit('"}'))
    second = F.when(m == 1, F.lit("1")).when(m == 2, F.lit("3")).when(m == 3, F.lit("null")).otherwise("2")
    listed = F.concat_ws(",", entry(second, F.col("kind"), F.concat(F.lit("/b/"), "brand", F.lit("/"), "kind")), entry(F.lit("1"), F.col("brand"), F.when(m == 4, F.lit("https://elsewhere.example/x")).otherwise(F.concat(F.lit("/b/"), "brand"))))
    trail = F.concat(F.lit('<nav aria-label="breadcrumb"><a href="/">Home</a> / <a href="/b/'), "brand", F.lit('">'), "brand", F.lit('</a><a href="/b/'), "brand", F.lit('/gone">?</a><a href="/cart">Cart</a><a href="#x">x</a></nav>'))
    body = F.concat(F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":['), listed, F.lit("]}</script><main>"), F.when(m != 5, trail).otherwise(""), F.lit('<h1>x</h1><a href="/else">Else</a></main>'))
    page = p.select("p_partkey", "p_name", "m", "brand", "kind", path.alias("path"), F.concat(F.lit("https://shop.example"), path).alias("url"), body.alias("html"))
    return common.written(html.parsed(page, fields=("page_links", "ld")), "parsed")


CRUMBS = "p AS (SELECT p_partkey, p_name, p_partkey % 6 AS m, regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g') AS brand, regexp_replace(p_type, '[^A-Za-z]', '', 'g') AS kind FROM part)"


@query(
    f"""WITH {CRUMBS} SELECT p_partkey, 'markup' AS source, 1 AS place, 'Home' AS label, '/' AS target, 'OBSERVED' AS status FROM p WHERE m <> 5
    UNION ALL SELECT p_partkey, 'markup', 2, brand, '/b/' || brand, 'OBSERVED' FROM p WHERE m <> 5 UNION ALL SELECT p_partkey, 'markup', 3, '?', '/b/' || brand || '/gone', 'OBSERVED' FROM p WHERE m <> 5
    UNION ALL SELECT p_partkey, 'list', CASE WHEN m IN (1, 2, 3) THEN 1 ELSE 2 END, kind, '/b/' || brand || '/' || kind, CASE WHEN m IN (1, 2, 3, 4) THEN 'REQUIRES_REVIEW' ELSE 'OBSERVED' END FROM p
    UNION ALL SELECT p_partkey, 'list', CASE WHEN m IN (1, 2, 3) THEN 2 ELSE 1 END, brand, CASE WHEN m <> 4 THEN '/b/' || brand END, CASE WHEN m IN (1, 2, 3, 4) THEN 'REQUIRES_REVIEW' ELSE 'OBSERVED' END FROM p"""
)
def c16_breadcrumbs(spark, d):
    return structured.breadcrumbs(_crumb_pages(spark, d), "p_partkey").select("p_partkey", "source", "place", "label", F.col("request_target").alias("target"), "status")


@query(
    f"""WITH {CRUMBS}, c AS (SELECT 'cb' || brand AS id, '/b/' || brand AS target FROM (SELECT DISTINCT brand FROM p) UNION ALL SELECT 'ck' || brand || kind, '/b/' || brand || '/' || kind FROM (SELECT DISTINCT brand, kind FROM p WHERE m <> 0))
    SELECT 'p' || p_partkey AS id, '/b/' || brand || '/' || kind || '/' || p_partkey AS target, CASE WHEN m = 5 THEN '' ELSE 'cb' || brand END AS observed, coalesce(CASE WHEN m <> 5 THEN 'cb' || brand END, k.id, b.id) AS category
    FROM p LEFT JOIN c k ON k.target = '/b/' || brand || '/' || kind JOIN c b ON b.target = '/b/' || brand"""
)
def j15_categories(spark, d):
    pages = _crumb_pages(spark, d)
    p = pages.drop("parse", "url")
    crumbs = structured.breadcrumbs(pages, "p_partkey").filter("source = 'markup'").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("entity_source_id"), "place", "request_target")
    brands = p.select(F.concat(F.lit("cb"), "brand").alias("entity_source_id"), F.concat(F.lit("/b/"), "brand").alias("request_target")).distinct()
    kinds = p.filter("m <> 0").select(F.concat(F.lit("ck"), "brand", "kind").alias("entity_source_id"), F.concat(F.lit("/b/"), "brand", F.lit("/"), "kind").alias("request_target")).distinct()
    own = p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("entity_source_id"), F.col("path").alias("request_target"))
    known = brands.unionByName(kinds)
    found = catalog.categories_of(crumbs, known.unionByName(own), known.select("entity_source_id", F.lit("CATEGORY").alias("page_kind")))
    return own.join(found.hint("merge"), "entity_source_id").select(F.col("entity_source_id").alias("id"), F.col("request_target").alias("target"), F.concat_ws(",", "category_ids").alias("observed"), "category")


@query(
    f"""WITH x AS (SELECT *, p_partkey % 8 AS m, {AMOUNT} AS cents FROM part)
    SELECT 'p' || p_partkey AS id, CASE WHEN m = 0 THEN NULL ELSE '/p/' || p_partkey END AS target, CASE WHEN m = 1 THEN 'UNKNOWN' ELSE 'PRODUCT' END AS page_kind,
        CASE WHEN m = 1 THEN '' WHEN p_size % 2 = 0 THEN 'Brand=' || p_brand || ';Type=' || p_type ELSE 'Type=' || p_type END AS attributes, CASE WHEN m = 1 THEN NULL ELSE cents END AS price,
        CASE WHEN p_size % 3 = 0 THEN '/media/' || p_partkey || '-1' END AS thumbnail, CASE WHEN m = 1 THEN 'COMMERCE_NOT_OBSERVED' ELSE '' END AS blockers,
        CASE m WHEN 0 THEN 'ENTITY_ROUTE_MISSING,COMMERCE_BINDING' WHEN 2 THEN 'DUPLICATE_COMMERCE' WHEN 3 THEN 'COMMERCE_BINDING' ELSE '' END AS errors FROM x"""
)
def j17_snapshot_details(spark, d):
    p = _parts(spark, d).withColumn("m", (F.col("p_partkey") % 8).cast("int")).withColumn("entity_source_id", F.concat(F.lit("p"), F.col("p_partkey")))
    m, path = F.col("m"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"))
    page = F.concat(F.lit("https://shop.example"), path)
    entities = p.select(F.col("entity_source_id").alias("source_id"), page.alias("source_url"), F.col("p_name").alias("title"))
    routes_ = p.select(path.alias("request_target"), "entity_source_id", F.when(m == 0, 404).otherwise(200).alias("expected_status"))
    seen = p.filter("m <> 1")
    commerce = seen.select("entity_source_id", F.when(m == 3, "https://other.example/").otherwise(page).alias("source_url"), path.alias("request_target"), F.lit("PRODUCT").alias("page_kind"), "m")
    commerce = commerce.unionByName(commerce.filter("m = 2")).drop("m")
    facts = seen.select("entity_source_id", F.explode(F.create_map(F.lit("Type"), F.col("p_type"), F.lit("Brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" "))).alias("name", "value"))
    prices = seen.select("entity_source_id", F.lit(0).alias("ord"), F.col("cents").alias("minor"))
    images = p.select("entity_source_id", F.explode(F.array(F.lit(2), F.lit(1), F.lit(0))).alias("ord"), "p_partkey", "p_size")
    images = images.select("entity_source_id", "ord", F.when((F.col("p_size") % 3 == 0) & (F.col("ord") > 0), F.concat(F.lit("/media/"), F.col("p_partkey"), F.lit("-"), F.col("ord"))).alias("public_path"))
    none = routes_.filter("false").select("entity_source_id", F.lit(1).alias("place"), "request_target")
    got = catalog.snapshot_items(entities, routes_, commerce, none, facts, prices, images)
    shown = F.concat_ws(";", F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return got.select("id", F.col("request_target").alias("target"), "page_kind", shown.alias("attributes"), F.get("prices", F.lit(0)).alias("price"), "thumbnail", F.concat_ws(",", "blockers").alias("blockers"), F.concat_ws(",", "errors").alias("errors"))


def _variant_pages(spark, d):
    """A product of three variants for each part: one with a price and quantities, one with two prices or a limited one, one without."""
    p = _priced(_dealt_parts(spark, d)).withColumn("id", F.col("p_partkey").cast("string"))
    offer = lambda price, more="": F.concat(F.lit('{"@type":"Offer","price":"'), price, F.lit('","priceCurrency":"RUB","priceSpecification":{"unitText":"piece"}' + more + "}"))
    one = offer(F.col("amount"), ',"eligibleQuantity":{"minValue":2,"stepValue":"0.5","maxValue":10}')
    two = F.when(F.col("p_size") % 2 == 0, F.concat(offer(F.col("amount"), ',"sku":"A"'), F.lit(","), offer(F.concat(F.lit("1"), "amount"), ',"sku":"A"'))).otherwise(offer(F.col("amount"), ',"url":"/p/elsewhere"'))
    variant = lambda sku, size, offers: F.concat(F.lit('{"@type":"Product","sku":"' + sku + '","name":"' + sku + '","additionalProperty":[{"name":"Size","value":"' + size + '"}],"offers":['), offers, F.lit("]}"))
    extra = F.concat(F.lit(',"additionalProperty":[{"name":"Weight","value":"'), F.col("p_size").cast("string"), F.lit('","unitText":"kg"},{"name":"Weight","value":"other"},{"name":"Empty","value":" "}]'))
    brand = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(',"brand":{"name":" '), "p_brand", F.lit('"}'))).otherwise("")
    node = F.concat(F.lit('{"@context":"https://schema.org","@type":"Product","url":"/p/'), "id", F.lit('","sku":"S'), "id", F.lit('","name":"'), "p_name", F.lit('"'), brand, extra, F.lit(',"hasVariant":['), variant("V1", "1", one), F.lit(","), variant("V2", "2", two), F.lit(","), variant("V3", "3", F.lit("")), F.lit("]}"))
    page = p.select("p_partkey", F.concat(F.lit("https://shop.example/p/"), "id").alias("url"), F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("</script>")).alias("html"))
    return html.parsed(page, fields=("ld",))


@query(
    f"""WITH v AS (SELECT p_partkey, p_size, unnest(['V1', 'V2', 'V3']) AS sku FROM part)
    SELECT p_partkey, sku, CASE WHEN sku = 'V1' THEN 1 WHEN sku = 'V2' AND p_size % 2 = 0 THEN 0 WHEN sku = 'V2' THEN 0 ELSE 0 END AS chosen,
        CASE WHEN sku = 'V1' THEN '' ELSE 'CURRENT_EXACT_PRICE_UNKNOWN,MIN_QUANTITY_UNKNOWN,QUANTITY_STEP_UNKNOWN' END AS blockers FROM v"""
)
def c14_variant_purchases(spark, d):
    got = structured.variant_purchases(common.written(_variant_pages(spark, d), "parsed"), "p_partkey")
    return got.select("p_partkey", "sku", F.col("price_id").isNotNull().cast("int").alias("chosen"), F.concat_ws(",", "blockers").alias("blockers"))


@query(
    f"""WITH o AS (SELECT p_partkey, 'V1' AS sku, 0 AS ord, {AMOUNT} AS minor, 'OBSERVED' AS status, '' AS limitations FROM part
        UNION ALL SELECT p_partkey, 'V2', 0, {AMOUNT}, 'REQUIRES_REVIEW', CASE WHEN p_size % 2 = 0 THEN 'OFFER_SKU_FOREIGN,DUPLICATE_OFFER_IDENTITY' ELSE 'OFFER_URL_FOREIGN' END FROM part
        UNION ALL SELECT p_partkey, 'V2', 1, CAST('1' || {TEXT.format(AMOUNT)} AS DECIMAL(18, 2)) * 100, 'REQUIRES_REVIEW', 'OFFER_SKU_FOREIGN,DUPLICATE_OFFER_IDENTITY' FROM part WHERE p_size % 2 = 0)
    SELECT p_partkey, sku, ord, CAST(minor AS BIGINT) AS minor, status, limitations FROM o"""
)
def c14_variant_prices(spark, d):
    got = structured.variant_prices(_variant_pages(spark, d), "p_partkey")
    return got.select("p_partkey", "sku", "ord", F.col("money.minor").alias("minor"), "status", F.concat_ws(",", "limitations").alias("limitations"))


@query(
    """SELECT p_partkey, 'name' AS name, p_name AS value, NULL AS unit, 'OBSERVED' AS status, 'ld[0].name' AS evidence FROM part
    UNION ALL SELECT p_partkey, 'sku', 'S' || p_partkey, NULL, 'OBSERVED', 'ld[0].sku' FROM part UNION ALL SELECT p_partkey, 'description', NULL, NULL, 'ABSENT', 'ld[0].description' FROM part
    UNION ALL SELECT p_partkey, 'brand', CASE WHEN p_size % 3 <> 0 THEN p_brand END, NULL, CASE WHEN p_size % 3 <> 0 THEN 'OBSERVED' ELSE 'ABSENT' END, 'ld[0].brand' FROM part
    UNION ALL SELECT p_partkey, 'property:Weight', CAST(p_size AS VARCHAR), 'kg', 'OBSERVED', 'ld[0].additionalProperty[0]' FROM part"""
)
def x15_node_facts(spark, d):
    return structured.node_facts(_variant_pages(spark, d), "p_partkey", common.tasks(t(spark, d, "part")))


@query("SELECT p_partkey, p_brand || ' logo' AS alt FROM part WHERE p_size % 4 = 1")
def x18_home_logo(spark, d):
    """Logos with one text; others have two texts, two own images, or an image that is not the page's."""
    p = _dealt_parts(spark, d)
    m, image = F.col("p_size") % 4, F.lit("/logo.png")
    meta = lambda c: F.concat(F.lit('<meta property="og:image" content="'), c, F.lit('">'))
    logo = lambda alt, src="/logo.png", href="/": F.concat(F.lit(f'<a href="{href}"><img src="{src}" alt="'), alt, F.lit('"></a>'))
    head = F.concat(meta(image), meta(F.lit("https://cdn.example/x.png")), F.when(m == 2, meta(F.lit("/second.png"))).otherwise(""))
    alt = F.concat("p_brand", F.lit(" logo"))
    shown = F.concat(logo(alt), logo(F.lit("not home"), href="/about"), logo(F.lit("anchor"), href="#top"), F.when(m == 3, logo(F.lit("other text"))).otherwise(""))
    body = F.concat(head, F.lit("<body><header>"), F.when(m == 0, F.lit('<a href="/"><img src="/elsewhere.png" alt="x"></a>')).otherwise(shown), F.lit("</header>"), logo(F.lit("outside")))
    page = p.select("p_partkey", F.concat(F.lit("https://home"), F.col("p_partkey").cast("string"), F.lit(".example/")).alias("url"), body.alias("html"))
    return structured.home_logo(common.written(html.parsed(page, fields=("og_images", "logos")), "parsed"), "p_partkey")


@query("SELECT p_partkey, '<p>' || p_name || ' &amp; ' || p_brand || '</p>' || CASE WHEN p_size % 2 = 0 THEN '<a href=\"/p?a&amp;b\">' ELSE '<a>' END || p_type || '</a>alt<ul><li>1</li></ul>' AS html FROM part")
def x12_sanitised(spark, d):
    href = F.when(F.col("p_size") % 2 == 0, "/p?a&amp;b").otherwise("javascript:x")
    raw = F.concat(F.lit("<div onclick=x><p class=c>"), "p_name", F.lit(" &amp; "), "p_brand", F.lit("<script>1</script></p><form><input value=q><a href='"), href, F.lit("' onclick=y>"), "p_type", F.lit("</a></form><img src=i alt=alt><ul><li style=s>1</ul></div><iframe>x</iframe>"))
    return _dealt_parts(spark, d).select("p_partkey", html.sanitize(raw).alias("html"))


@query("SELECT event_id, event_id % 5 IN (0, 4) AS public FROM events")
def u2_public_ipv6(spark, d):
    n = F.lower(F.hex(F.col("event_id") % 65536))
    address = F.concat(F.get(F.array(*map(F.lit, ("2a00:1450:", "fe80::", "fd00:", "2001:db8:", "2606:4700::"))), (F.col("event_id") % 5).cast("int")), n, F.when(F.col("event_id") % 5 == 0, F.lit("::1")).when((F.col("event_id") % 5).isin(2, 3), F.lit("::1")).otherwise(""))
    return t(spark, d, "events").select("event_id", http.public_address(address).alias("public"))


@query(
    """SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN html ELSE 'body of ' || page_id END) AS sha256 FROM pages
    WHERE page_id % 4 IN (0, 1) AND page_id % 5 <> 2 AND page_id % 7 <> 6"""
)
def s1_accepted_pages(spark, d):
    n = F.col("page_id")
    status = F.when(n % 4 == 0, "FETCHED").when(n % 4 == 1, "RENDERED").when(n % 4 == 2, "FAILED").otherwise("EXCLUDED")
    mime = F.when(n % 7 == 6, "text/plain").when(n % 7 == 5, "application/XHTML+xml").otherwise("Text/HTML; charset=utf-8")
    ledger = t(spark, d, "pages").select("page_id", status.alias("status"), F.when(n % 5 == 2, 404).otherwise(200).alias("http_status"), mime.alias("mime"), F.when(n % 3 == 0, F.col("html")).alias("dom"), F.concat(F.lit("body of "), n.cast("string")).alias("body"))
    return registry.accepted_pages(ledger).select("page_id", F.sha2("html", 256).alias("sha256"))


@query("SELECT event_id AS sequence, event_type, user_id FROM events")
def s5_exported_events(spark, d):
    """The log as it comes back from its JSON lines."""
    folder = common.fresh_folder(spark, "events")
    readers.export_events(t(spark, d, "events").select(F.col("event_id").alias("sequence"), "event_type", "user_id"), folder)
    return spark.read.schema("sequence long, event_type string, user_id long").json(folder)


@query("SELECT p_brand, count(*) AS parts, true AS same FROM part GROUP BY 1")
def s6_named_by_content(spark, d):
    """A result is stored under its content: the same rows in another order are there already, other rows go elsewhere."""
    folder, p = common.fresh_folder(spark, "results"), t(spark, d, "part")
    rows = p.groupBy("p_brand").agg(F.count("*").alias("parts"))
    path = readers.write_named_by_content(rows, folder)
    same = readers.write_named_by_content(rows.repartition(3).orderBy(F.desc("p_brand")), folder) == path
    other = readers.write_named_by_content(rows.withColumn("parts", F.col("parts") + 1), folder) != path
    return spark.read.parquet(path).withColumn("same", F.lit(same and other))


@query(
    """SELECT 'file' AS section, 'data/' || p_partkey AS name, sha256(p_name) AS value FROM part UNION ALL SELECT 'count', 'entities', CAST(count(*) AS VARCHAR) FROM part
    UNION ALL SELECT 'count', 'routes', CAST(count(*) AS VARCHAR) FROM part WHERE p_size % 2 = 0 UNION ALL SELECT DISTINCT 'blocker', p_brand, NULL FROM part WHERE p_size % 3 = 0"""
)
def s7_package_manifest(spark, d):
    p = t(spark, d, "part")
    files = p.select(F.concat(F.lit("data/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").cast("binary").alias("content"))
    return reports.package_manifest(files, p, p.filter("p_size % 2 = 0"), p.filter("p_size % 3 = 0").select(F.col("p_brand").alias("note")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_key FROM part WHERE p_partkey % 2 = 1")
def j14_not_reconciled(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_key"), (F.col("p_partkey") % 2).alias("m"))
    desired = p.select("item_key", F.lit("in").alias("input_hash"), F.lit("after").alias("after_hash"))
    current = p.select("item_key", F.when(F.col("m") == 0, "after").otherwise("edited").alias("hash"))
    records = p.select("item_key", F.lit("COMMITTED").alias("state"), F.lit("in").alias("input_hash"), F.lit("before").alias("before_hash"), F.lit("after").alias("after_hash"), F.lit(True).alias("recoverable"))
    return importing.not_reconciled(importing.catalog_plan(desired, current, records)).select("item_key")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'robots' WHEN event_id % 3 = 1 THEN 'no-store' END AS first_failure FROM events")
def j26_privacy_headers(spark, d):
    m = F.col("event_id") % 3
    csp = F.concat_ws("; ", *[F.lit(f"{name} 'self'") for name in http.CSP_DIRECTIVES.split()])
    headers = F.create_map(F.lit("x-robots-tag"), F.when(m == 0, "noindex").otherwise("noindex, nofollow"), F.lit("cache-control"), F.when(m == 1, "private").otherwise("private, no-store"), F.lit("x-content-type-options"), F.lit("nosniff"), F.lit("referrer-policy"), F.lit("no-referrer"), F.lit("content-security-policy"), csp)
    return t(spark, d, "events").select("event_id", F.try_element_at(http.privacy_failures(headers), F.lit(1)).alias("first_failure"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_url FROM part WHERE p_size % 3 = 0")
def j4_selected_subset(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_url"), F.col("p_name").alias("source_id"), "p_size")
    return routes.subset(p.drop("p_size"), p.filter("p_size % 3 = 0").select(F.col("source_url").alias("crawl_key"))).select("source_url")


@query("SELECT 'ASSET_UNAVAILABLE:' || sha256(p_name) AS note, count(*) AS rows FROM part WHERE sha256(p_name) NOT IN (SELECT sha256(p_name) FROM part WHERE p_size % 4 = 0) GROUP BY 1 UNION ALL SELECT 'UNSUPPORTED_BLOCK:video', count(*) FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'UNSUPPORTED_TYPE:Odd', count(*) FROM part WHERE p_size % 9 = 0")
def j5_package_blockers(spark, d):
    p = t(spark, d, "part").withColumn("sha256", F.sha2("p_name", 256))
    entities = p.select("p_partkey", F.when(F.col("p_size") % 9 == 0, "Odd").otherwise("Page").alias("type"))
    blocks = p.select(F.when(F.col("p_size") % 10 == 0, "video").otherwise("image").alias("type"), F.col("sha256").alias("asset_sha256"))
    return reports.package_blockers(entities, blocks, p.filter("p_size % 4 = 0").select("sha256", F.lit("FETCHED").alias("status")))


@query(f"SELECT p_partkey, {TEXT.format(AMOUNT)} AS text, p_size % 2 = 0 AS is_name FROM part")
def x17_selected_fields(spark, d):
    field = lambda name, locator, c: F.struct(F.lit(name).alias("name"), locator.alias("locator"), c.alias("text"))
    captures = _parts(spark, d).select(F.col("p_partkey").alias("source_url"), F.array(field("price", F.when(F.col("p_size") % 2 == 0, "h1").otherwise("p"), F.concat(F.lit(" "), F.col("amount")))).alias("fields"))
    return structured.selected_fields(captures).select(F.col("source_url").alias("p_partkey"), "text", "is_name")


@query("WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 10 AS m, p_name || '|' || p_brand AS v FROM part) SELECT sha256(k) AS route_key, k AS request_target, CASE WHEN m = 0 THEN 200 ELSE 404 END AS status FROM m")
def j11_route_upsert(spark, d):
    desired, _, _ = _import(spark, d)
    none = F.lit(None).cast("string")
    rows = desired.select(F.sha2("entity_key", 256).alias("route_key"), F.col("entity_key").alias("request_target"), "entity_key", F.lit(404).alias("status"), none.alias("redirect_target"))
    fresh = rows.filter(F.col("entity_key").cast("bigint") % 10 == 0).withColumn("status", F.lit(200))
    return importing.upsert_routes(rows, fresh).select("route_key", "request_target", "status")
