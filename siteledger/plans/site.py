"""Queries over pages and documents: identities, links, registry, queue, routes and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions import digest, http, robots, urls
from siteledger.operators import catalog, common, queue, registry, reports, routes, verify
from siteledger.sources import html

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str, parse: bool = True, fields: tuple[str, ...] | None = None, before: Column | None = None) -> DataFrame:
    """page_id, url and the parse (all of it or some fields); the capture time is derived from the id.

    before: markup to be parsed in front of each page's own.
    """
    p = t(spark, d, "pages").withColumn("observed_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    p = p.withColumn("html_sha256", F.sha2(F.col("html").cast("binary"), 256))
    if not parse:
        return p
    if before is not None:
        p = p.withColumn("html", F.concat(before, F.coalesce("html", F.lit(""))))
    # A parse takes far longer than sending its page: a scan of few splits is dealt over all cores.
    cores = spark.sparkContext.defaultParallelism
    return html.parsed(p.repartition(cores) if p.rdd.getNumPartitions() < cores else p, fields=fields)


def links(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d, fields=("links",)).select("page_id", "url", F.explode("parse.links").alias("l"))
    return p.select("page_id", "url", F.col("l.ord").alias("ord"), F.col("l.href").alias("href"), F.col("l.label").alias("label"), urls.resolve(F.col("l.href"), F.col("url")).alias("absolute"))


# SQL over the same tables. All hrefs of the pages are rooted ("/x"), and no host has a port or capitals.
ENCODE = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]') THEN url_encode(c) ELSE c END), '')"
IDENTITY = "ids AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS request_target, regexp_extract(url, '(#.+)$', 1) AS fragment FROM pages)"
HREFS = "raw AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) - 1 AS ord FROM pages), hrefs AS (SELECT page_id, url, origin, replace(href, '&amp;', '&') AS href, ord FROM raw)"
TARGETS = HREFS + ", targets AS (SELECT page_id, url, origin, href, ord, " + ENCODE.format("regexp_replace(href, '#.*$', '')") + " AS request_target FROM hrefs)"


@query(f"WITH {IDENTITY} SELECT page_id, origin, request_target, origin || request_target AS crawl_key, fragment FROM ids")
def u1_identify_url(spark, d):
    me = urls.identity(F.col("url"))
    return pages(spark, d, False).select("page_id", me["origin"].alias("origin"), me["request_target"].alias("request_target"), me["crawl_key"].alias("crawl_key"), me["fragment"].alias("fragment"))


@query(f"WITH {TARGETS} SELECT page_id, ord, origin || request_target AS crawl_key FROM targets")
def u1_resolve_links(spark, d):
    return links(spark, d).select("page_id", F.col("ord").cast("long").alias("ord"), urls.identity(F.col("absolute"))["crawl_key"].alias("crawl_key"))


@query(f"WITH {TARGETS} SELECT origin, count(*) AS links, count(DISTINCT request_target) AS targets FROM targets GROUP BY origin")
def u3_same_origin_links(spark, d):
    me = urls.identity(F.col("absolute"))
    rows = links(spark, d).select(urls.origin_of(F.col("url")).alias("origin"), me["origin"].alias("target_origin"), me["request_target"].alias("request_target"))
    return rows.filter(F.col("origin") == F.col("target_origin")).groupBy("origin").agg(F.count("*").alias("links"), F.count_distinct("request_target").alias("targets"))


@query("SELECT page_id, regexp_matches(url, '#[/!]') AS hash_route FROM pages")
def u4_hash_routes(spark, d):
    return pages(spark, d, False).select("page_id", urls.hash_route(F.col("url")).alias("hash_route"))


@query(
    f"""WITH {IDENTITY}, q AS (SELECT page_id, unnest(string_split(regexp_replace(request_target, '^[^?]*\\?', ''), '&')) AS raw, generate_subscripts(string_split(regexp_replace(request_target, '^[^?]*\\?', ''), '&'), 1) - 1 AS ord FROM ids WHERE contains(request_target, '?'))
    SELECT page_id, ord, raw, split_part(raw, '=', 1) AS name, CASE WHEN split_part(raw, '=', 1) LIKE 'utm_%' THEN 'tracking' WHEN split_part(raw, '=', 1) IN ('page', 'p') THEN 'pagination' WHEN split_part(raw, '=', 1) IN ('sort', 'order') THEN 'sort' ELSE 'unknown-preserved' END AS class FROM q"""
)
def u5_query_parameters(spark, d):
    rows = pages(spark, d, False).select("page_id", F.posexplode(urls.query_parameters(urls.identity(F.col("url"))["request_target"])).alias("ord", "p"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), "p.*")


@query(f"WITH {TARGETS} SELECT page_id, ord, CASE WHEN starts_with(request_target, '//') OR regexp_matches(request_target, '[\\x00-\\x20\\x7f#\\\\]') THEN 'INVALID_REQUEST_TARGET' END AS error FROM targets")
def u6_target_errors(spark, d):
    return links(spark, d).select("page_id", F.col("ord").cast("long").alias("ord"), urls.target_error(urls.identity(F.col("absolute"))["request_target"]).alias("error"))


SAFE = "regexp_matches(url_decode(request_target), '(?i)(^|/)(cart|checkout|payment|payments|order|orders|wishlist|compare|api|add|remove|delete|admin|local|login|logout|register|account)([/.]|$)')"


@query(f"WITH {TARGETS} SELECT page_id, ord, CASE WHEN NOT {SAFE} THEN request_target END AS target FROM targets")
def u7_safe_targets(spark, d):
    return links(spark, d).select("page_id", F.col("ord").cast("long").alias("ord"), urls.safe_target(F.col("absolute"), F.col("href"), urls.origin_of(F.col("url"))).alias("target"))


@query("SELECT regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\\.(jpe?g|png|gif|webp|avif|svg|ico|css|js|woff2?|ttf|zip|mp4|webm|pdf|docx?|xlsx?)$') AS media, count(*) AS pages FROM pages GROUP BY 1")
def u8_media_split(spark, d):
    return pages(spark, d, False).groupBy(urls.is_media(F.col("url")).alias("media")).agg(F.count("*").alias("pages"))


ROBOTS = "# for all\\nUser-agent: other\\nDisallow: /\\n\\nUser-agent: *\\nDisallow: /en/\\nAllow: /en/1\\nDisallow: /*?utm_source=\\nDisallow: /de/*.html$\\nDisallow:\\nSitemap: https://"


@query(
    f"""WITH {IDENTITY} SELECT page_id, regexp_replace(origin, '^https?://', '') AS host, request_target,
    CASE WHEN regexp_matches(request_target, '^/.*\\?utm_source=') THEN false WHEN regexp_matches(request_target, '^/de/.*\\.html$') THEN false WHEN starts_with(request_target, '/en/1') THEN true WHEN starts_with(request_target, '/en/') THEN false ELSE true END AS allowed FROM ids"""
)
def u10_robots_allows(spark, d):
    me = urls.identity(F.col("url"))
    targets = pages(spark, d, False).select("page_id", F.regexp_replace(me["origin"], "^https?://", "").alias("host"), me["request_target"].alias("request_target"))
    text = F.concat(F.lit(ROBOTS.encode().decode("unicode_escape")), F.col("host"), F.lit("/sitemap.xml\n"))
    texts = targets.select("host").distinct().withColumn("text", text)
    return robots.allowed(targets, robots.rules(texts)).select("page_id", "host", "request_target", "allowed")


@query("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/sitemap.xml' AS sitemap FROM pages")
def u9_robots_sitemaps(spark, d):
    hosts = pages(spark, d, False).select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).distinct()
    texts = hosts.withColumn("text", F.concat(F.lit(ROBOTS.encode().decode("unicode_escape")), F.col("host"), F.lit("/sitemap.xml\n")))
    return robots.sitemaps(texts).select("host", F.col("url").alias("sitemap"))


@query("SELECT page_id, page_id % 6 NOT IN (3, 4) AS is_html FROM pages")
def u12_html_responses(spark, d):
    """Typed and untyped HTML, HTML behind comments and space, and what only looks like it or is plain text."""
    m, body = F.col("page_id") % 6, F.col("html")
    typed = F.when(m == 0, "Text/HTML; charset=utf-8").when(m == 1, "application/xhtml+xml").when(m == 5, F.lit(None).cast("string")).otherwise("text/plain")
    shown = F.when(m.isin(0, 1), "no markup").when(m == 2, F.concat(F.lit(" \n<!-- a > b --> <!--x-->\t"), body)).when(m == 3, F.concat(F.lit("text before "), body)).when(m == 4, "< p>1 < 2").otherwise(body)
    return pages(spark, d, False).select("page_id", http.is_html(typed, shown).alias("is_html"))


@query(f"WITH {IDENTITY} SELECT page_id, 'page_' || left(sha256(origin || request_target), 24) AS id, sha256(request_target) AS route_key, sha256('url:' || origin || request_target) AS queue_id, sha256('[\"demo\",\"Page\",\"' || origin || request_target || '\"]') AS entity_key FROM ids")
def u15_stable_ids(spark, d):
    me = urls.identity(F.col("url"))
    return pages(spark, d, False).select("page_id", urls.stable_id("page", me["crawl_key"]).alias("id"), urls.route_key(me["request_target"]).alias("route_key"), F.sha2(F.concat(F.lit("url:"), me["crawl_key"]), 256).alias("queue_id"), urls.entity_key(F.lit("demo"), F.lit("Page"), me["crawl_key"]).alias("entity_key"))


UNESCAPED = "trim(regexp_replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {UNESCAPED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, NULL::VARCHAR AS description FROM pages")
def x1_metadata(spark, d):
    return pages(spark, d).select("page_id", F.col("parse.title").alias("title"), F.col("parse.lang").alias("lang"), F.col("parse.description").alias("description"))


@query(f"WITH {HREFS} SELECT page_id, ord, href FROM hrefs")
def x2_links(spark, d):
    return links(spark, d).select("page_id", F.col("ord").cast("long").alias("ord"), "href")


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<img\\b')) > 0 AS has_media FROM pages")
def x3_media(spark, d):
    return pages(spark, d).select("page_id", (F.size("parse.media") > 0).alias("has_media"))


@query("SELECT page_id, 1 AS level, len(regexp_extract_all(html, '<h1>')) AS headings FROM pages")
def x4_headings(spark, d):
    rows = pages(spark, d).select("page_id", F.explode("parse.headings").alias("h"))
    return rows.groupBy("page_id", F.col("h.level").alias("level")).agg(F.count("*").alias("headings"))


# JSON-LD by page_id % 8, as the given pages have none: one type, two of which one comes first, no type of ours, and no JSON.
ENTITY_LD = (
    '{"@graph":[{"@type":"Service"},{"@type":["Thing","Product"]}]}',
    '{"@type":"BlogPosting"}',
    '{"@type":["Thing","Service"]}',
    '[{"@type":"Service"},{"@type":"NewsArticle"}]',
    '{"@type":"Thing"}',
    '{"@type":"Product"',
)


@query(
    f"""WITH e AS (SELECT page_id, page_id % 8 AS m, {UNESCAPED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages),
    k AS (SELECT *, CASE WHEN m = 0 THEN 'Product' WHEN m IN (1, 3) THEN 'Article' WHEN m = 2 THEN 'Service' ELSE 'Page' END AS type FROM e)
    SELECT page_id, title, type, CASE WHEN type <> 'Page' THEN lower(type) WHEN m = 6 THEN 'home' WHEN m = 7 THEN 'contacts' ELSE 'text' END AS page_type FROM k"""
)
def x14_entities(spark, d):
    m = F.col("page_id") % 8
    scripts = [F.when(m == k, f'<script type="application/ld+json">{ld}</script>') for k, ld in enumerate(ENTITY_LD)]
    p = pages(spark, d, fields=("title", "h1", "ld"), before=F.coalesce(*scripts, F.lit("")))
    kind = catalog.entity_type(F.flatten(F.transform("parse.ld", lambda n: n["classes"])))
    p = p.select("page_id", "url", "parse", kind.alias("type"))
    shown = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(shown(F.col("parse.title")), shown(F.try_element_at("parse.h1", F.lit(1))), catalog.entity_name(F.col("parse.ld"), F.col("type")), F.lit(""))
    url = F.when(m == 6, "https://site.example/").when(m == 7, "https://site.example/de/Kontakte.html").otherwise(F.col("url"))
    return p.select("page_id", title.alias("title"), "type", catalog.page_type(urls.path_of(urls.identity(url)["request_target"]), F.col("type")).alias("page_type"))


@query(f"WITH e AS (SELECT page_id, nullif({UNESCAPED.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '') AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages), f AS (SELECT page_id, 'title' AS name, title AS value FROM e UNION ALL SELECT page_id, 'lang', lang FROM e UNION ALL SELECT page_id, 'description', NULL FROM e) SELECT page_id, name, value, CASE WHEN value IS NULL THEN 'ABSENT' ELSE 'OBSERVED' END AS status FROM f")
def x15_facts(spark, d):
    wide = pages(spark, d).select("page_id", "parse.title", "parse.lang", "parse.description")
    return catalog.long_facts(wide, "page_id", ["title", "lang", "description"])


@query("SELECT 'form' AS feature, count(*) AS pages FROM pages WHERE html LIKE '%<form%' HAVING count(*) > 0")
def x16_features(spark, d):
    p = pages(spark, d).select("page_id", F.explode(F.create_map(*[x for n in ("forms", "search_forms", "cart_controls", "variant_controls") for x in (F.lit(n), F.col(f"parse.{n}"))])).alias("feature", "n"))
    return p.filter("n > 0").groupBy(F.regexp_replace("feature", "s$", "").alias("feature")).agg(F.count_distinct("page_id").alias("pages"))


@query("SELECT 'MISSING_DESCRIPTION' AS note, count(*) AS pages FROM pages UNION ALL SELECT 'NO_IMAGE', count(*) FROM pages WHERE html NOT LIKE '%<img%' HAVING count(*) > 0")
def x19_limitations(spark, d):
    p = pages(spark, d)
    notes = F.array_compact(F.array(F.when(F.coalesce(p["parse.title"], F.lit("")) == "", F.lit("MISSING_TITLE")), F.when(p["parse.description"].isNull(), F.lit("MISSING_DESCRIPTION")), F.when(F.size("parse.blocks") == 0, F.lit("NO_BLOCK")), F.when(F.size("parse.media") == 0, F.lit("NO_IMAGE"))))
    return p.select(F.explode(notes).alias("note")).groupBy("note").agg(F.count("*").alias("pages"))


@query(
    f"""WITH {TARGETS}, k AS (SELECT origin || request_target AS crawl_key, url, page_id, ord, origin || href AS raw_url FROM targets)
    SELECT crawl_key, arg_min(raw_url, (page_id, ord, raw_url)) AS raw_url, count(*) AS "references", count(DISTINCT url) AS sources FROM k GROUP BY crawl_key"""
)
def r1_page_registry(spark, d):
    rows = links(spark, d).select(urls.identity(F.col("absolute"))["crawl_key"].alias("crawl_key"), F.col("absolute").alias("raw_url"), F.col("url").alias("discovered_from"), F.struct("page_id", "ord").alias("ord"))
    return registry.page_registry(rows).select("crawl_key", "raw_url", "references", "sources")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, max(octet_length(encode(text))) AS size_bytes, count(*) AS copies FROM documents GROUP BY 1")
def r8_content_dedup(spark, d):
    return registry.by_content(t(spark, d, "documents"), "doc_id", "text")


def _queue(spark, d):
    p, plain = pages(spark, d, fields=("base", "links")), pages(spark, d, False)
    own = plain.select(F.lit("capture-inventory").alias("kind"), F.lit("pages").alias("input_id"), F.lit(None).cast("string").alias("html_sha256"), F.col("url").alias("source_url"), F.lit(None).cast("timestamp").alias("observed_at"), F.lit("inventory").alias("locator"), F.col("url").alias("raw_reference"), F.lit(None).cast("string").alias("base_url"), F.lit("").alias("label"), F.lit("other").alias("role"), F.lit(False).alias("action_control"), F.lit(False).alias("fragment_only"))
    witnesses = queue.with_identity(queue.link_witnesses(p).unionByName(own))
    key = urls.identity(F.col("url"))["crawl_key"]
    # Every fourth page has been looked at; the others are outstanding.
    seen = plain.filter("page_id % 4 = 0").select(F.lit("pages").alias("input_id"), key.alias("source_url"), key.alias("document_url"), "observed_at", F.col("html_sha256").alias("snapshot_sha256"), F.lit("DOM_OBSERVED").alias("status"))
    return queue.queue(witnesses, seen, F.col("origin"))


@query(
    f"""WITH {HREFS}, o AS (SELECT page_id, url, page_id % 5 <> 4 AS dom, page_id % 11 = 3 AS challenged FROM pages), w AS (
        SELECT 'capture-inventory' AS kind, NULL AS source_url, url AS raw_reference, 'inventory.urls[' || page_id || ']' AS locator FROM o
        UNION ALL SELECT 'observation', url, url, 'source_url' FROM o
        UNION ALL SELECT 'observation', url, regexp_replace(url, '#.*$', '') || 'x', 'document_url' FROM o WHERE page_id % 7 = 2
        UNION ALL SELECT 'requested-url', url, 'https://req.example/' || page_id, 'requested_url' FROM o WHERE page_id % 3 = 0
        UNION ALL SELECT CASE WHEN dom THEN 'raw-link' ELSE 'selected-link' END, url, '/r' || k, 'links[' || k || ']' FROM o, range(2) r(k) WHERE NOT challenged
        UNION ALL SELECT 'dom-link', h.url, href, 'a[' || ord || ']' FROM hrefs h JOIN o ON o.page_id = h.page_id WHERE dom AND NOT challenged)
    SELECT * FROM w"""
)
def r16_witness_kinds(spark, d):
    p = common.written(pages(spark, d, fields=("base", "links", "title")), "parsed")
    n, dom = F.col("page_id"), F.col("page_id") % 5 != 4
    seen = p.select(
        F.lit("pages").alias("input_id"),
        F.col("url").alias("source_url"),
        F.when(n % 7 == 2, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("x"))).otherwise(F.col("url")).alias("document_url"),
        "observed_at",
        F.when(dom, "dom-html").otherwise("selected-fields").alias("format"),
        "html_sha256",
        F.when(n % 11 == 3, "KillBot user verification").otherwise(F.col("parse.title")).alias("title"),
        F.when(n % 3 == 0, F.concat(F.lit("https://req.example/"), n.cast("string"))).alias("requested_url"),
        F.array(F.lit("/r0"), F.lit("/r1")).alias("raw_links"),
        F.when(dom, F.col("parse")).alias("parse"),
    )
    listed = queue.inventory_witnesses(p.select(F.lit("pages").alias("input_id"), n.alias("ord"), "url"))
    return listed.unionByName(queue.observed_witnesses(seen)).select("kind", "source_url", "raw_reference", "locator")


QUEUE = (
    TARGETS
    + f""", {IDENTITY}, seen AS (SELECT DISTINCT origin || request_target AS url FROM ids WHERE page_id % 4 = 0),
    w AS (SELECT origin || request_target AS url, request_target, true AS linked FROM targets UNION ALL SELECT origin || request_target, request_target, false FROM ids),
    e AS (SELECT url, min(request_target) AS request_target, bool_or(linked) AS linked FROM w GROUP BY url),
    c AS (SELECT e.url, e.request_target, linked, s.url IS NOT NULL AS observed, CASE
        WHEN regexp_matches(url_decode(split_part(request_target, '?', 1)), '(?i)(^|/)(admin|local|login|logout|register|account|auth|private)([/.]|$)') THEN 'PROTECTED_REVIEW'
        WHEN regexp_matches(url_decode(split_part(request_target, '?', 1)), '(?i)(^|/)(cart|checkout|payment|payments|order|orders|wishlist|compare|api|add|remove|delete|\\.write_feed)([/.]|$)') THEN 'SOURCE_ACTION_REVIEW'
        WHEN NOT linked AND s.url IS NULL THEN 'UNWITNESSED_INVENTORY_REVIEW'
        WHEN contains(request_target, '?') THEN 'QUERY_VARIANT_REVIEW' ELSE 'CONTENT_CANDIDATE' END AS classification FROM e LEFT JOIN seen s ON e.url = s.url),
    q AS (SELECT *, CASE WHEN observed THEN 'ALREADY_OBSERVED' WHEN classification = 'CONTENT_CANDIDATE' THEN 'OUTSTANDING' ELSE 'REVIEW_REQUIRED' END AS queue_status,
        CASE WHEN linked THEN 10 WHEN regexp_matches(request_target, '(?i)(^|/)(about|contact|kontak|dostav|oplata|garant|instruction|instruk|document|support|news|novosti|article)') THEN 30 WHEN len(string_split(request_target, '/')) > 2 THEN 40 ELSE 50 END AS priority FROM c)"""
)


@query(f"WITH {QUEUE} SELECT url, classification, queue_status, priority FROM q")
def r20_queue(spark, d):
    return _queue(spark, d).select("url", "classification", "queue_status", "priority")


@query(f"WITH {QUEUE} SELECT url, request_target, priority FROM q WHERE queue_status = 'OUTSTANDING' ORDER BY priority, url LIMIT 50")
def next_batch(spark, d):
    return queue.next_batch(_queue(spark, d), 50).select("url", "request_target", "priority")


@query(f"WITH {QUEUE} SELECT classification, count(*) AS entries, count(*) FILTER (queue_status = 'OUTSTANDING') AS outstanding, count(*) FILTER (queue_status = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (observed) AS observed_dom FROM q GROUP BY ROLLUP (classification)")
def a3_queue_summary(spark, d):
    return reports.queue_summary(_queue(spark, d))


@query(f"WITH {HREFS} SELECT count(*) AS witnesses, count(DISTINCT page_id) AS contexts FROM (SELECT DISTINCT page_id, href, ord FROM hrefs)")
def s8_encoded_witnesses(spark, d):
    contexts, encoded = queue.encode_witnesses(queue.link_witnesses(pages(spark, d, fields=("base", "links"))))
    back = queue.decode_witnesses(contexts, encoded)
    return back.agg(F.count("*").alias("witnesses")).join(F.broadcast(contexts.agg(F.count("*").alias("contexts"))))


LEDGER = f"""{IDENTITY}, led AS (SELECT page_id, origin || request_target AS crawl_key, origin, request_target, CASE page_id % 10 WHEN 0 THEN 'EXCLUDED' WHEN 1 THEN 'FAILED' ELSE 'FETCHED' END AS status, CASE page_id % 10 WHEN 2 THEN 404 WHEN 3 THEN 301 ELSE 200 END AS http_status FROM ids)"""


def _ledger(spark, d):
    me, m = urls.identity(F.col("url")), F.col("page_id") % 10
    return pages(spark, d, False).select(
        "page_id",
        me["crawl_key"].alias("crawl_key"),
        me["origin"].alias("origin"),
        me["request_target"].alias("request_target"),
        F.when(m == 0, "EXCLUDED").when(m == 1, "FAILED").otherwise("FETCHED").alias("status"),
        F.when(m == 2, 404).when(m == 3, 301).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("reason"),
        F.when(m == 3, F.concat(me["origin"], F.lit("/moved"))).alias("redirect_location"),
        F.lit(None).cast("string").alias("canonical_url"),
    )


@query(
    f"""WITH {LEDGER}, ent AS (SELECT DISTINCT crawl_key FROM led WHERE page_id % 10 >= 5),
    o AS (SELECT page_id, l.crawl_key, request_target, http_status, status, CASE WHEN status = 'EXCLUDED' THEN 'exclusion' WHEN status = 'FAILED' THEN 'unresolved' WHEN http_status = 200 AND e.crawl_key IS NULL THEN 'unresolved' ELSE 'route' END AS outcome FROM led l LEFT JOIN ent e ON l.crawl_key = e.crawl_key)
    SELECT crawl_key, outcome, CASE outcome WHEN 'exclusion' THEN 'Excluded' WHEN 'unresolved' THEN CASE WHEN status = 'FAILED' THEN 'FAILED' ELSE 'NO_ENTITY' END END AS reason, CASE WHEN outcome = 'route' THEN request_target END AS request_target, CASE WHEN outcome = 'route' AND http_status = 301 THEN '/moved' END AS redirect_to FROM o"""
)
def j1_route_plan(spark, d):
    ledger = _ledger(spark, d)
    entities = ledger.filter("page_id % 10 >= 5").select(F.col("crawl_key").alias("source_url"), urls.stable_id("page", F.col("crawl_key")).alias("source_id"), F.lit("text").alias("page_type"))
    return routes.plan(ledger, entities).select("crawl_key", "outcome", "reason", "request_target", "redirect_to")


@query(f"WITH {LEDGER} SELECT count(*) AS denominator, count(*) FILTER (status <> 'EXCLUDED') AS in_scope, count(*) FILTER (status = 'EXCLUDED') AS excluded, 0::BIGINT AS queued, 0::BIGINT AS requires_access, 0::BIGINT AS rate_limited, count(*) FILTER (status = 'FETCHED' AND page_id % 2 = 0) AS fetched, count(*) FILTER (status = 'FETCHED') AS recorded_fetched, count(*) FILTER (status = 'FETCHED' AND page_id % 2 = 1) AS requires_revalidation, count(*) FILTER (status = 'FAILED') AS failed FROM led")
def a2_registry_summary(spark, d):
    return reports.registry_summary(_ledger(spark, d).withColumn("verified", F.col("page_id") % 2 == 0))


@query(f"WITH {LEDGER} SELECT 0::BIGINT AS queued, count(*) FILTER (status = 'EXCLUDED') AS excluded, count(*) FILTER (status = 'FAILED') AS failed FROM led")
def a1_completeness(spark, d):
    return reports.completeness(_ledger(spark, d))


@query(f"WITH {LEDGER} SELECT crawl_key, CASE WHEN status = 'EXCLUDED' THEN 'excluded' ELSE 'in scope' END AS part FROM led")
def j20_scope(spark, d):
    ledger = _ledger(spark, d)
    return routes.scope(ledger).withColumn("part", F.lit("in scope")).unionByName(routes.exclusions(ledger).select("crawl_key", F.lit("excluded").alias("part")))


@query(f"""WITH {TARGETS}, {IDENTITY}, known AS (SELECT DISTINCT request_target FROM ids UNION SELECT request_target FROM targets WHERE page_id % 3 = 0), c AS (SELECT request_target, count(*) AS n FROM targets GROUP BY 1)
    SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (k.request_target IS NULL), 0)::BIGINT AS uncovered, count(*) FILTER (k.request_target IS NULL) AS unique_uncovered FROM c LEFT JOIN known k ON c.request_target = k.request_target""")
def j25_link_closure(spark, d):
    rows = links(spark, d).select("page_id", urls.identity(F.col("absolute"))["request_target"].alias("request_target"))
    known = pages(spark, d, False).select(urls.identity(F.col("url"))["request_target"].alias("request_target")).unionByName(rows.filter("page_id % 3 = 0").select("request_target"))
    return verify.link_closure(rows, known)


@query(f"""WITH {TARGETS}, u AS (SELECT DISTINCT request_target FROM targets WHERE request_target NOT IN (SELECT request_target FROM targets WHERE page_id % 3 = 0) ORDER BY 1 LIMIT 100), r AS (SELECT request_target, sum(octet_length(encode(request_target))) OVER (ORDER BY request_target) AS b FROM u) SELECT request_target FROM r WHERE b <= 2000""")
def j25_uncovered_sample(spark, d):
    rows = links(spark, d).select("page_id", urls.identity(F.col("absolute"))["request_target"].alias("request_target"))
    return verify.uncovered_sample(rows, rows.filter("page_id % 3 = 0"), 100, 2000)


@query("""WITH f AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS fact FROM documents), o AS (SELECT doc_id, fact FROM f UNION ALL SELECT xor(doc_id, 1), fact FROM f),
    n AS (SELECT DISTINCT doc_id, trim(regexp_replace(fact, '\\s+', ' ', 'g')) AS fact FROM o), t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents), x AS (SELECT doc_id, fact, text FROM n LEFT JOIN t USING (doc_id) WHERE fact <> '')
    SELECT doc_id, count(*) AS facts, count(*) FILTER (NOT coalesce(contains(text, fact), false)) AS missing, count(*) FILTER (NOT coalesce(contains(text, fact), false)) = 0 AS accepted FROM x GROUP BY doc_id""")
def j22_content_acceptance(spark, d):
    docs = t(spark, d, "documents")
    # Facts of a document, and those of its neighbour, which it has only where both repeat a line.
    lines = docs.select("doc_id", F.split("text", "\n").alias("fact"))
    facts = lines.select(F.explode(F.array(F.col("doc_id"), F.col("doc_id").bitwiseXOR(F.lit(1)))).alias("doc_id"), "fact")
    out = verify.content_acceptance(facts, docs, "doc_id")
    return out.select("doc_id", F.col("facts").cast("long"), F.col("missing").cast("long"), "accepted")


#: Host labels in their own script and, a public fact of each, in Punycode.
WIDE_HOSTS = [("b\u00fccher", "xn--bcher-kva"), ("M\u00dcNCHEN", "xn--mnchen-3ya"), ("\u043f\u0440\u0438\u043c\u0435\u0440", "xn--e1afmkfd"), ("\u4f8b\u3048", "xn--r8jz45g"), ("fa\u00df", "xn--fa-hia"), ("%D0%9F%D0%A0%D0%98%D0%9C%D0%95%D0%A0", "xn--e1afmkfd"), ("Plain", "plain")]


@query(
    f"""WITH h AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{w}', '{a}')" for k, (w, a) in enumerate(WIDE_HOSTS))}) AS v(k, wide, ascii))
    SELECT c_custkey, 'HTTPS://' || wide || '.example:443/c/' || c_custkey || '?q=' || wide || '#f' AS raw_url, 'https://' || ascii || '.example' AS origin,
        'https://' || ascii || '.example/c/' || c_custkey || '?q=' || {ENCODE.format("wide")} AS crawl_key FROM customer JOIN h ON c_custkey % 7 = k"""
)
def u1_international_hosts(spark, d):
    k = F.col("c_custkey") % 7
    wide = F.get(F.array(*[F.lit(w) for w, _ in WIDE_HOSTS]), k.cast("int"))
    rows = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("HTTPS://"), wide, F.lit(".example:443/c/"), F.col("c_custkey").cast("string"), F.lit("?q="), wide, F.lit("#f")).alias("url"))
    return urls.with_identity(rows, "url").select("c_custkey", "identity.raw_url", "identity.origin", "identity.crawl_key")


@query("SELECT doc_id, row_number() OVER (ORDER BY k COLLATE de, k, doc_id) - 1 AS locale_rank, row_number() OVER (ORDER BY k, doc_id) - 1 AS byte_rank FROM (SELECT doc_id, left(text, 8) AS k FROM documents)")
def w9_locale_order(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.substring("text", 1, 8).alias("k"))
    by_locale = common.ranked(rows, [*common.locale_order("k", "de"), F.col("doc_id").asc()], "locale_rank")
    return common.ranked(by_locale, [F.col("k").asc(), F.col("doc_id").asc()], "byte_rank").select("doc_id", "locale_rank", "byte_rank")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'SIZE' WHEN doc_id % 7 = 1 THEN 'HASH' END AS reason FROM documents WHERE doc_id % 7 IN (0, 1) AND octet_length(encode(text)) > 0")
def j24_fact_audit(spark, d):
    docs = t(spark, d, "documents")
    expected = docs.select(F.col("doc_id").alias("source_id"), F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    m = F.col("doc_id") % 7
    stored = docs.select(F.col("doc_id").alias("source_id"), F.when(m == 0, F.concat("text", F.lit("x"))).when(m == 1, F.concat(F.lit("\x01"), F.expr("substring(cast(text as binary), 2)").cast("string"))).otherwise(F.col("text")).alias("raw"))
    stored = stored.withColumn("raw", F.col("raw"))
    return verify.fact_audit(expected, stored).select(F.col("source_id").alias("doc_id"), "reason")


@query(f"WITH {LEDGER} SELECT count(*) AS discovered, count(*) FILTER (status <> 'EXCLUDED') AS included, count(*) FILTER (status = 'EXCLUDED') AS excluded, count(*) FILTER (page_id % 10 >= 2) AS planned, count(*) FILTER (page_id % 10 >= 5) AS verified, count(*) FILTER (page_id % 10 IN (2, 3)) AS failed, count(*) FILTER (page_id % 10 IN (0, 1, 4)) AS not_run, count(*) FILTER (page_id % 10 >= 5) / count(*) FILTER (status <> 'EXCLUDED') AS ratio FROM led")
def a5_coverage(spark, d):
    m = F.col("page_id") % 10
    checks = _ledger(spark, d).select((F.col("status") != "EXCLUDED").alias("in_scope"), (m >= 2).alias("planned"), F.when(m >= 5, "PASS").when(m.isin(2, 3), "FAIL").otherwise("NOT_RUN").alias("status"))
    return verify.coverage(checks)


@query(
    """WITH h AS (SELECT sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}) AS VARCHAR)) AS h, count(*) AS n FROM documents GROUP BY 1),
    b AS (SELECT CAST('0x' || substr(h, 1, 8) AS BIGINT) % 4096 AS bucket, sum(n) AS n, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS h FROM h GROUP BY 1)
    SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS digest FROM b"""
)
def a12_table_digest(spark, d):
    return digest.table_digest(t(spark, d, "documents"))
