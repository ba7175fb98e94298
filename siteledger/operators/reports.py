"""Counts and summaries over the registry, the queue and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.functions import urls


def completeness(ledger: DataFrame) -> DataFrame:
    s = F.col("status")
    return ledger.agg(F.count_if(s == "QUEUED").alias("queued"), F.count_if(s == "EXCLUDED").alias("excluded"), F.count_if(s.isin("FAILED", "UNREACHABLE")).alias("failed"))


def registry_summary(ledger: DataFrame) -> DataFrame:
    """Ten overlapping buckets over the whole registry. ledger: status, verified (its bytes are confirmed)."""
    s, done = F.col("status"), F.col("status").isin("FETCHED", "RENDERED")
    verified = F.coalesce("verified", F.lit(False))
    n = F.count_if
    return ledger.agg(
        F.count("*").alias("denominator"),
        n(s != "EXCLUDED").alias("in_scope"),
        n(s == "EXCLUDED").alias("excluded"),
        n(s == "QUEUED").alias("queued"),
        n(s == "REQUIRES_ACCESS").alias("requires_access"),
        n(s == "RATE_LIMITED").alias("rate_limited"),
        n(done & verified).alias("fetched"),
        n(done).alias("recorded_fetched"),
        n(done & ~verified).alias("requires_revalidation"),
        n(s.isin("FAILED", "UNREACHABLE")).alias("failed"),
    )


def queue_summary(entries: DataFrame) -> DataFrame:
    """classification (null: all), entries, outstanding, review_required, observed_dom."""
    q = F.col("queue_status")
    return entries.rollup("classification").agg(F.count("*").alias("entries"), F.count_if(q == "OUTSTANDING").alias("outstanding"), F.count_if(q == "REVIEW_REQUIRED").alias("review_required"), F.count_if(F.col("observation_status") == "DOM_OBSERVED").alias("observed_dom"))


def capture_coverage(inventory: DataFrame) -> DataFrame:
    o = F.col("observation")
    return inventory.agg(F.count("*").alias("known"), F.count_if(o == "UNOBSERVED").alias("unobserved"), F.count_if(o == "SELECTED_FIELDS").alias("selected"), F.count_if(o == "DOM").alias("dom"))


def by_action(planned: DataFrame, actions: list[str]) -> DataFrame:
    """One row with a count for each action."""
    return planned.agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions])


def latency(samples: DataFrame, keys: list[str], value: str, ok: Column, bound: float = 1000.0) -> DataFrame:
    """keys, n, median (exact), p95 (nearest rank), success, within bound.

    The nearest rank is found on counts of distinct values, which are combined on the map side.
    """
    counts = samples.groupBy(*keys, value).agg(F.count("*").alias("c"), F.count_if(ok).alias("good"))
    up = Window.partitionBy(*keys).orderBy(value)
    rows = counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col(value)))

    agg = rows.groupBy(*keys).agg(F.max("n").alias("n"), at_rank(F.ceil(F.col("n") / 2)).alias("low"), at_rank(F.floor(F.col("n") / 2) + 1).alias("high"), at_rank(F.ceil(F.col("n") * 95 / 100)).alias("p95"), F.sum("good").alias("good"))
    return agg.select(*keys, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", (F.col("good") == F.col("n")).alias("success"), (F.col("p95") < bound).alias("within_bound"))


def distinct_notes(*tables: DataFrame) -> DataFrame:
    """note, first: distinct limitations, warnings or blockers over several tables (note, ord), with the first place."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("note").agg(F.min("ord").alias("first"))


def provenance(observations: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: observations, assets, asset_files (distinct digests), bytes (of distinct files)."""
    files = assets.groupBy("sha256").agg(F.count("*").alias("n"), F.max("size_bytes").alias("b"))
    a = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assets"), F.count("*").alias("asset_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
    return observations.agg(F.count("*").alias("observations")).join(F.broadcast(a))  # one row each


def package_manifest(files: DataFrame, entities: DataFrame, routes: DataFrame, blockers: DataFrame) -> DataFrame:
    """path, sha256 of each file, and rows of counts and distinct blockers: (section, name, value)."""
    rows = files.select(F.lit("file").alias("section"), F.col("path").alias("name"), F.sha2("content", 256).alias("value"))
    counts = entities.agg(F.count("*").alias("n")).select(F.lit("count").alias("section"), F.lit("entities").alias("name"), F.col("n").cast("string").alias("value"))
    counts = counts.unionByName(routes.agg(F.count("*").alias("n")).select(F.lit("count").alias("section"), F.lit("routes").alias("name"), F.col("n").cast("string").alias("value")))
    return rows.unionByName(counts).unionByName(blockers.select("note").distinct().select(F.lit("blocker").alias("section"), F.col("note").alias("name"), F.lit(None).cast("string").alias("value")))


def package_defects(listed: DataFrame, present: DataFrame) -> DataFrame:
    """path, reason: listed but absent, present but not listed, or another hash. listed/present: path, sha256."""
    rows = listed.select("path", F.col("sha256").alias("want")).join(present.select("path", F.col("sha256").alias("got")), "path", "full")
    reason = F.when(F.col("got").isNull(), "MISSING").when(F.col("want").isNull(), "UNLISTED").when(F.col("want") != F.col("got"), "HASH_MISMATCH")
    return rows.select("path", reason.alias("reason")).filter("reason is not null")


def package_integrity(listed: DataFrame, present: DataFrame, counts: DataFrame, entities: DataFrame, routes: DataFrame, key: Column) -> DataFrame:
    """subject, reason, rows: everything that is wrong with a package, each defect of a subject once.

    listed/present: path, sha256. counts: entities, routes (one row, as the manifest claims). entities: source_id, type, title,
    stable_key. routes: request_target, route_key, entity_key, expected_status. key: an entity's key from its own columns.
    Keys are computed anew from their parts, and everything is counted by key, so no table is gathered.
    """
    bad_path = ~F.col("path").rlike("^[a-zA-Z0-9_./-]+$") | F.col("path").startswith("/") | F.exists(F.split("path", "/"), lambda x: x.isin("", ".", ".."))
    unsafe = listed.filter(bad_path | ~F.coalesce(F.col("sha256").rlike("^[a-f0-9]{64}$"), F.lit(False))).select(F.col("path").alias("subject"), F.lit("UNSAFE_PACKAGE_PATH_OR_HASH").alias("reason"))
    files = package_defects(listed, present).select(F.col("path").alias("subject"), "reason")
    counted = entities.agg(F.count("*").alias("n")).select(F.lit("entities").alias("subject"), "n").unionByName(routes.agg(F.count("*").alias("n")).select(F.lit("routes").alias("subject"), "n"))
    claimed = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).cast("long").alias("claimed")) for c in ("entities", "routes")])))
    amounts = counted.join(claimed, "subject", "left").filter(~F.col("n").eqNullSafe(F.col("claimed"))).select("subject", F.lit("PACKAGE_COUNT_MISMATCH").alias("reason"))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    reason = F.when(blank("source_id") | blank("title"), "ENTITY_INCOMPLETE").when(~F.col("stable_key").eqNullSafe(key), "ENTITY_KEY_MISMATCH")
    keys = entities.withColumn("reason", reason)
    own = keys.filter("reason is not null").select(F.coalesce("source_id", F.lit("")).alias("subject"), "reason")
    twice = keys.groupBy("stable_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("stable_key").alias("subject"), F.lit("ENTITY_KEY_REPEATED").alias("reason"))
    known = entities.select(F.col("stable_key").alias("entity_key")).distinct().withColumn("known", F.lit(True))
    matched = routes.join(known, "entity_key", "left")
    lost = (F.col("expected_status") == 200) & F.col("known").isNull()
    reason = F.coalesce(urls.target_error(F.col("request_target")), F.when(~F.col("route_key").eqNullSafe(F.sha2("request_target", 256)), "ROUTE_KEY_MISMATCH"), F.when(lost, "ROUTE_WITHOUT_ENTITY"))
    routed = matched.withColumn("reason", reason).filter("reason is not null").select(F.coalesce("request_target", F.lit("")).alias("subject"), "reason")
    again = routes.groupBy("request_target").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("request_target").alias("subject"), F.lit("ROUTE_REPEATED").alias("reason"))
    out = files
    for more in (unsafe, amounts, own, twice, routed, again):
        out = out.unionByName(more)
    return out.groupBy("subject", "reason").agg(F.count("*").alias("rows"))


def package_blockers(entities: DataFrame, blocks: DataFrame, assets: DataFrame, links: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """note, rows: why a package cannot be applied. entities: source_id, type; blocks: source_id, type, asset_sha256; assets: sha256, status.

    links: request_target of link and card blocks, which have to be safe routes; products: source_id, warnings array<string>.
    """
    kinds = ("heading", "paragraph", "list", "table", "quote", "image", "document", "link", "card")
    have = assets.filter("status = 'FETCHED'").select(F.col("sha256").alias("asset_sha256")).distinct()
    missing = blocks.filter("asset_sha256 is not null").join(have, "asset_sha256", "left_anti").select(F.concat(F.lit("ASSET_UNAVAILABLE:"), F.col("asset_sha256")).alias("note"))
    unknown = blocks.filter(~F.col("type").isin(*kinds)).select(F.concat(F.lit("UNSUPPORTED_BLOCK:"), F.col("type")).alias("note"))
    types = entities.filter(~F.col("type").isin("Page", "Product", "Article", "Service")).select(F.concat(F.lit("UNSUPPORTED_TYPE:"), F.col("type")).alias("note"))
    notes = missing.unionByName(unknown).unionByName(types)
    if links is not None:
        notes = notes.unionByName(links.select(F.concat(F.lit("UNSAFE_LINK:"), urls.target_error(F.col("request_target"))).alias("note")).filter("note is not null"))
    if products is not None:
        notes = notes.unionByName(products.select(F.explode("warnings").alias("w")).select(F.concat(F.lit("PRODUCT_WARNING:"), F.col("w")).alias("note")))
    return notes.groupBy("note").agg(F.count("*").alias("rows"))
