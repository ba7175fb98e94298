"""The source registry: pages, assets, statuses, captures, discovery and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.functions import http, urls
from siteledger.operators.common import ranked, written

ACCEPTED = ("FETCHED", "RENDERED")


def page_registry(references: DataFrame) -> DataFrame:
    """One row for each crawl_key: first raw spelling, counts of references and of distinct sources.

    references: crawl_key, raw_url, discovered_from, ord. A menu link has a whole site as its sources, so these are
    counted here and listed, one row each, by page_sources.
    """
    counts = page_sources(references).groupBy("crawl_key").agg(F.count("*").alias("sources"))
    firsts = references.groupBy("crawl_key").agg(F.min_by("raw_url", F.struct("ord", "raw_url")).alias("raw_url"), F.count("*").alias("references"))
    return firsts.join(counts, "crawl_key")


def page_sources(references: DataFrame) -> DataFrame:
    """crawl_key, discovered_from: one row for each page that refers to a key."""
    return references.select("crawl_key", "discovered_from").distinct()


def asset_registry(references: DataFrame, origin: str | None = None) -> DataFrame:
    """One row for each asset URL: how many pages refer to it, status and reason. references: url, page_url, origin, allowed, mime."""
    foreign = (F.col("origin") != F.lit(origin)) if origin else (F.col("origin") != urls.origin_of(F.col("page_url")))
    unsafe = F.col("mime").rlike(r"(?i)svg|html|javascript")
    rows = references.groupBy("url").agg(F.count_distinct("page_url").alias("pages"), F.max(F.coalesce(foreign, F.lit(True)).cast("int")).alias("is_foreign"), F.max((~F.col("allowed")).cast("int")).alias("barred"), F.max(F.coalesce(unsafe, F.lit(False)).cast("int")).alias("is_unsafe"))
    reason = F.when(F.col("is_foreign") == 1, "EXTERNAL").when(F.col("barred") == 1, "ROBOTS").when(F.col("is_unsafe") == 1, "UNSAFE_MIME")
    return rows.select("url", "pages", F.when(reason.isNotNull(), "EXCLUDED").otherwise("QUEUED").alias("status"), reason.alias("reason"))


def page_status(allowed: Column, challenge: Column, http_status: Column, rendered: Column, error: Column) -> Column:
    """Status from a response's facts, by fixed precedence; 404 and 410 are observations, so they are FETCHED."""
    return (
        F.when(~allowed, "EXCLUDED")
        .when(error.isNotNull(), "FAILED")
        .when(challenge, "REQUIRES_ACCESS")
        .when(http_status.isin(429, 503), "RATE_LIMITED")
        .when(http_status.isin(401, 403), "REQUIRES_ACCESS")
        .when(http_status >= 500, "UNREACHABLE")
        .when(rendered, "RENDERED")
        .otherwise("FETCHED")
    )


def accepted_pages(ledger: DataFrame) -> DataFrame:
    """HTML of accepted pages: rendered bytes before fetched ones. ledger: status, http_status, mime, dom, body."""
    return ledger.filter(F.col("status").isin(*ACCEPTED) & (F.col("http_status") == 200) & http.mime_of(F.col("mime")).isin("text/html", "application/xhtml+xml")).withColumn("html", F.coalesce("dom", "body"))


def stored_challenges(pages: DataFrame) -> DataFrame:
    """Accepted pages, HTTP or DOM, whose title is a challenge's: evidence_kind says which. pages: url, body_title, dom_title, headers."""
    both = pages.select("url", "headers", F.explode(F.array(F.struct(F.lit("http").alias("evidence_kind"), F.col("body_title").alias("title")), F.struct(F.lit("dom").alias("evidence_kind"), F.col("dom_title").alias("title")))).alias("e"))
    return both.select("url", "e.evidence_kind", http.access_challenge(F.col("headers"), F.col("e.title")).alias("challenge")).filter("challenge is not null")


def snapshot_defects(registered: DataFrame, files: DataFrame) -> DataFrame:
    """path, reason: registered files that are absent, or whose bytes have another digest or size. files: path, content."""
    found = files.select("path", F.sha2("content", 256).alias("got"), F.octet_length("content").cast("long").alias("size"))
    joined = registered.join(found, "path", "left")
    reason = F.when(F.col("got").isNull(), "MISSING").when(F.col("size") != F.col("size_bytes"), "SIZE_MISMATCH").when(F.col("got") != F.col("sha256"), "HASH_MISMATCH")
    return joined.select("path", reason.alias("reason")).filter("reason is not null")


def by_content(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each digest: the smallest key, size, and how many rows have it."""
    hashed = files.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(F.col(content)).cast("long").alias("size_bytes"))
    return hashed.groupBy("sha256").agg(F.min(key).alias(key), F.max("size_bytes").alias("size_bytes"), F.count("*").alias("copies"))


OBSERVATION_RANK = {"UNOBSERVED": 0, "SELECTED_FIELDS": 1, "DOM": 2}


def capture_inventory(rows: DataFrame) -> DataFrame:
    """crawl_key, spellings, sources, observation: counts of all ways a URL came in; the best observation counts.

    rows: crawl_key, raw_url, source, observation (null for mere mentions). The ways themselves are capture_ways.
    """
    ranks = F.create_map(*[F.lit(x) for kv in OBSERVATION_RANK.items() for x in kv])
    names = F.array(*[F.lit(n) for n in OBSERVATION_RANK])
    best = F.max(F.coalesce(F.try_element_at(ranks, F.col("observation")), F.lit(0)))
    facts = rows.groupBy("crawl_key").agg(best.alias("best"))
    ways = capture_ways(rows).groupBy("crawl_key").agg(F.count_if(F.col("way") == "raw_url").alias("spellings"), F.count_if(F.col("way") == "source").alias("sources"))
    return facts.join(ways, "crawl_key").select("crawl_key", "spellings", "sources", F.element_at(names, F.col("best") + 1).alias("observation"))


def capture_ways(rows: DataFrame) -> DataFrame:
    """crawl_key, way (raw_url or source), value: one row for each spelling and each source of a key."""
    ways = F.explode(F.array(*[F.struct(F.lit(c).alias("way"), F.col(c).alias("value")) for c in ("raw_url", "source")]))
    return rows.select("crawl_key", ways.alias("w")).select("crawl_key", "w.*").filter("value is not null").distinct()


def inherited(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Keys of a prior inventory that the current one lacks, as unobserved: a status is never inherited."""
    return prior.select("crawl_key").distinct().join(current.select("crawl_key"), "crawl_key", "left_anti").withColumn("observation", F.lit("UNOBSERVED"))


def missing_assets(observed: DataFrame, verified: DataFrame) -> DataFrame:
    return observed.select("url").distinct().join(verified.select("url"), "url", "left_anti")


def latest_observation(observations: DataFrame, key: str = "url", at: str = "observed_at", ord_: str = "ord") -> DataFrame:
    """The latest row of each key; of equal times the first. Map-side: no window over a key's rows."""
    rest = [c for c in observations.columns if c != key]
    best = observations.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col(ord_).cast("long"))).alias("row"))
    return best.select(key, *[F.col("row")[c].alias(c) for c in rest])


def byte_changes(assets: DataFrame) -> DataFrame:
    """url, before, after, observed_at wherever an asset's digest differs from its last one."""
    seen = Window.partitionBy("url").orderBy("observed_at", "ord")
    rows = assets.withColumn("before", F.lag("sha256").over(seen))
    return rows.filter(F.col("before") != F.col("sha256")).select("url", "before", F.col("sha256").alias("after"), "observed_at")


def combined_registry(crawl: DataFrame, captures: DataFrame) -> DataFrame:
    """crawl_key, crawl_status, captures, verified_captures, latest_capture, stale: both inventories side by side.

    crawl: crawl_key, status, fetched_at. captures: crawl_key, capture_id, verified, observed_at. A capture that is
    older than the crawl's own fetch is stale.
    """
    seen = captures.groupBy("crawl_key").agg(F.count_distinct("capture_id").alias("captures"), F.count_if("verified").alias("verified_captures"), F.max("observed_at").alias("latest_capture"))
    both = crawl.join(seen, "crawl_key", "full")
    return both.select("crawl_key", F.col("status").alias("crawl_status"), F.coalesce("captures", F.lit(0)).alias("captures"), F.coalesce("verified_captures", F.lit(0)).alias("verified_captures"), "latest_capture", F.coalesce(F.col("latest_capture") < F.col("fetched_at"), F.lit(False)).alias("stale"))


def discovery_closure(seeds: DataFrame, links: DataFrame, budget: int | None = 10_000) -> DataFrame:
    """crawl_key, level of every page that links reach from the seeds, level by level, until none is new.

    links: src, dst (already within the origin and allowed). A level that would exceed the page budget is cut in key
    order, which is what a budget is; None sets no budget. Each level joins its frontier only.
    """
    frontier = written(seeds.select("crawl_key").distinct().withColumn("level", F.lit(0)), "frontier")
    edges = written(links.select("src", "dst").distinct(), "links")
    visited, size, level = frontier, frontier.count(), 0
    while budget is None or size < budget:
        reached = edges.join(frontier, edges.src == frontier.crawl_key, "left_semi").select(F.col("dst").alias("crawl_key")).distinct()
        fresh = reached.join(visited, "crawl_key", "left_anti")
        if budget is not None:
            # Numbered range by range: the cut of a large level is no single task.
            fresh = ranked(fresh, [F.col("crawl_key").asc()], "_place").filter(F.col("_place") < budget - size).drop("_place")
        frontier = written(fresh.withColumn("level", F.lit(level + 1)), "frontier")
        n = frontier.count()
        if not n:
            break
        visited, size, level = visited.unionByName(frontier), size + n, level + 1
        if level % 10 == 0:
            visited = written(visited, "visited")
    return visited


def expand_sitemaps(seeds: DataFrame, documents: DataFrame) -> DataFrame:
    """url, kind (page or failed), discovered_from: indexes lead to nested sitemaps, urlsets to pages; each is read once,
    so the levels end when no sitemap is new.

    seeds: url. documents: url, text. Read by pattern, since malformed XML must give a failed row.
    """
    locs = lambda: F.regexp_extract_all(F.col("text"), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    unescaped = F.transform(locs(), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    kind = F.when(F.col("text").rlike("(?is)<(?:\\w+:)?sitemapindex[\\s>]"), "index").when(F.col("text").rlike("(?is)<(?:\\w+:)?urlset[\\s>]"), "urlset").otherwise("failed")
    docs = written(documents.select("url", kind.alias("kind"), unescaped.alias("locs")), "sitemaps")
    visited = written(seeds.select("url").distinct(), "visited")
    frontier, out = visited, None
    while True:
        read = frontier.join(docs, "url", "left").withColumn("kind", F.coalesce("kind", F.lit("failed")))
        pages = read.filter("kind = 'urlset'").select(F.explode("locs").alias("page"), F.concat(F.lit("sitemap:"), F.col("url")).alias("discovered_from")).select(F.col("page").alias("url"), F.lit("page").alias("kind"), "discovered_from")
        failed = read.filter("kind = 'failed'").select("url", F.lit("failed").alias("kind"), F.lit(None).cast("string").alias("discovered_from"))
        rows = written(pages.unionByName(failed), "expanded")
        out = rows if out is None else out.unionByName(rows)
        frontier = written(read.filter("kind = 'index'").select(F.explode("locs").alias("url")).distinct().join(visited, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = written(visited.unionByName(frontier), "visited")
    return out


def resolve_redirects(starts: DataFrame, hops: DataFrame, limit: int = 5) -> DataFrame:
    """url, final_url, hops, outcome (FINAL, LOOP, LIMIT, OFF_ORIGIN). starts: url. hops: url, location (one row a url)."""
    state = starts.select("url", F.col("url").alias("at"), F.array("url").alias("seen"), F.lit(None).cast("string").alias("outcome"))
    step = hops.select(F.col("url").alias("at"), "location")
    for k in range(limit + 1):
        moved = state.join(step, "at", "left")
        open_ = F.col("outcome").isNull()
        outcome = (
            F.when(~open_, F.col("outcome"))
            .when(F.col("location").isNull(), "FINAL")
            .when(F.array_contains("seen", F.col("location")), "LOOP")
            .when(urls.origin_of(F.col("location")) != urls.origin_of(F.col("url")), "OFF_ORIGIN")
            .when(F.lit(k == limit), "LIMIT")
        )
        goes = open_ & outcome.isNull()
        state = moved.select("url", F.when(goes, F.col("location")).otherwise(F.col("at")).alias("at"), F.when(goes, F.array_append("seen", F.col("location"))).otherwise(F.col("seen")).alias("seen"), outcome.alias("outcome"))
    return state.select("url", F.col("at").alias("final_url"), (F.size("seen") - 1).alias("hops"), "outcome")


def redirect_graph_defects(routes: DataFrame, rounds: int = 20) -> DataFrame:
    """request_target, reason (REDIRECT_LOOP, REDIRECT_TARGET_MISSING) of redirecting routes, by pointer doubling.

    routes: request_target, redirect_to (null if it does not redirect). After k rounds a pointer is 2**k hops long, so
    a route that still points somewhere after more hops than there are routes is on, or leads to, a loop.
    """
    known = routes.select("request_target", "redirect_to")
    local = known.filter(F.col("redirect_to").startswith("/"))
    missing = local.join(known.select(F.col("request_target").alias("redirect_to")).distinct(), "redirect_to", "left_anti").select("request_target", F.lit("REDIRECT_TARGET_MISSING").alias("reason"))
    jump = written(local.select("request_target", "redirect_to"), "jump")
    n, k = known.count(), 0
    while (1 << k) <= n and k < rounds + 20:
        ahead = jump.select(F.col("request_target").alias("redirect_to"), F.col("redirect_to").alias("further"))
        jump = written(jump.join(ahead, "redirect_to").select("request_target", F.col("further").alias("redirect_to")), "jump")
        if jump.isEmpty():
            break
        k += 1
    return missing.unionByName(jump.select("request_target", F.lit("REDIRECT_LOOP").alias("reason")))
