"""Route plans: what each ledger row becomes on the target, and the checks of a planned set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions import urls
from siteledger.operators.common import first_of, ranked, require

#: Path roots that a target keeps for itself; callers add those of their own target.
RESERVED = ("local", "upload", "api")
SUPPORTED_STATUS = (200, 301, 302, 307, 308, 404, 410)


def _relative_to(url: Column, origin: Column, prefix: Column | None = None) -> Column:
    """The request target of a URL of this origin (behind ``prefix``), else its exact key."""
    me = urls.identity(url)
    own = me["request_target"] if prefix is None else F.concat(prefix, me["request_target"])
    return F.when(me["origin"] == origin, own).otherwise(me["crawl_key"])


def plan(ledger: DataFrame, entities: DataFrame, physical_paths: DataFrame | None = None, demo_origin: str = "", reserved_roots: tuple[str, ...] = RESERVED) -> DataFrame:
    """One row for each ledger row with its outcome (exclusion, unresolved, conflict, route) and, for routes, the route.

    ledger: crawl_key, origin, request_target, status, http_status, reason, redirect_location, canonical_url.
    entities: source_url, source_id, page_type. One hash join each for entities and physical paths.
    """
    own = first_of(entities.select("source_url", "source_id", "page_type"), ["source_url"], ["source_id"])
    rows = ledger.join(own, ledger.crawl_key == own.source_url, "left").drop("source_url")
    path = urls.path_of(F.col("request_target"))
    if physical_paths is None:
        physical = F.lit(False)
    else:
        taken = physical_paths.select(F.col("path").alias("_path")).distinct().withColumn("_taken", F.lit(True))
        rows = rows.withColumn("_own_path", path).join(taken, F.col("_own_path") == F.col("_path"), "left")
        physical = F.coalesce("_taken", F.lit(False))
    reserved = F.coalesce(urls.decode_path(path), path).rlike(rf"(?i)^/(?:{urls.alternatives(reserved_roots)})(?:/|$)")
    outcome = (
        F.when(F.col("status") == "EXCLUDED", "exclusion")
        .when(~F.col("status").isin("FETCHED", "RENDERED") | F.col("http_status").isNull(), "unresolved")
        .when(reserved | physical, "conflict")
        .when((F.col("http_status") == 200) & F.col("source_id").isNull(), "unresolved")
        .otherwise("route")
    )
    is_route = outcome == "route"
    ok = lambda c: F.when(is_route, c)
    reason = F.when(outcome == "exclusion", F.coalesce("reason", F.lit("Excluded"))).when(outcome == "conflict", "RESERVED_OR_PHYSICAL_PATH").when((outcome == "unresolved") & (F.col("http_status") == 200) & F.col("status").isin("FETCHED", "RENDERED"), "NO_ENTITY").when(outcome == "unresolved", F.coalesce("reason", "status"))
    kind = F.coalesce("page_type", F.when(F.col("http_status") == 404, "not-found").otherwise("redirect"))
    return rows.select(
        "crawl_key",
        outcome.alias("outcome"),
        reason.alias("reason"),
        ok(F.col("request_target")).alias("request_target"),
        ok(F.col("source_id")).alias("entity_source_id"),
        ok(kind).alias("page_type"),
        ok(F.col("http_status")).alias("expected_status"),
        ok(_relative_to(F.col("redirect_location"), F.col("origin"))).alias("redirect_to"),
        ok(_relative_to(F.col("canonical_url"), F.col("origin"), F.lit(demo_origin))).alias("canonical_url"),
        ok(urls.query_parameters(F.col("request_target"))).alias("query_parameters"),
    )


def observed_plan(inventory: DataFrame, selected: DataFrame, entities: DataFrame) -> DataFrame:
    """crawl_key, outcome: the plan of a capture, where only observed and selected pages with one entity become routes."""
    chosen = selected.select("crawl_key").distinct().withColumn("selected", F.lit(True))
    counts = entities.groupBy(F.col("source_url").alias("crawl_key")).agg(F.count("*").alias("n"), F.min("source_id").alias("source_id"))
    rows = inventory.join(chosen, "crawl_key", "left").join(counts, "crawl_key", "left")
    target = urls.identity(F.col("crawl_key"))["request_target"]
    outcome = (
        F.when(F.col("observation") == "UNOBSERVED", "UNOBSERVED")
        .when(F.col("selected").isNull(), "NOT_SELECTED")
        .when(F.col("n").isNull(), "NO_ENTITY")
        .when((F.col("n") > 1) | urls.target_error(target).isNotNull(), "CONFLICT")
        .otherwise("PLANNED_200")
    )
    return rows.select("crawl_key", outcome.alias("outcome"), F.when(outcome == "PLANNED_200", F.col("source_id")).alias("entity_source_id"))


def subset(entities: DataFrame, selected: DataFrame) -> DataFrame:
    """Entities of selected pages; a page without exactly one entity fails the job."""
    kept = entities.join(selected.select(F.col("crawl_key").alias("source_url")).distinct(), "source_url", "left_semi")
    counts = selected.select(F.col("crawl_key").alias("source_url")).distinct().join(kept.groupBy("source_url").agg(F.count("*").alias("_n")), "source_url", "left")
    checked = require(counts, F.coalesce("_n", F.lit(0)) != 1, "a selected page has no entity, or several")
    return kept.join(checked, "source_url").drop("_n")


def route_defects(routes: DataFrame, entities: DataFrame, source_origin: Column | None = None) -> DataFrame:
    """request_target, reason of routes that cannot be applied."""
    counts = routes.groupBy("request_target").agg(F.count("*").alias("n")).filter("n > 1").select("request_target", F.lit("DUPLICATE_TARGET").alias("reason"))
    known = entities.select(F.col("source_id").alias("entity_source_id")).distinct().withColumn("_known", F.lit(True))
    rows = routes.join(known, "entity_source_id", "left")
    status = F.col("expected_status")
    checks = {
        "UNSUPPORTED_STATUS": ~status.isin(*SUPPORTED_STATUS),
        "MISSING_REDIRECT": status.between(300, 399) & F.col("redirect_to").isNull(),
        "MISSING_ENTITY": (status == 200) & F.col("_known").isNull(),
    }
    if source_origin is not None:
        checks["FOREIGN_ORIGIN"] = F.col("source_origin") != source_origin
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()], urls.target_error(F.col("request_target"))))
    return counts.unionByName(rows.select("request_target", F.explode(reasons).alias("reason")))


def navigation(links: DataFrame, routes: DataFrame) -> DataFrame:
    """ord, label, request_target: distinct labelled links, in their order, whose safe target is a planned 200."""
    live = routes.filter("expected_status = 200").select("request_target").distinct()
    firsts = links.filter("label != '' and request_target is not null").groupBy("label", "request_target").agg(F.min("ord").alias("ord"))
    return firsts.join(live, "request_target", "left_semi").select("ord", "label", "request_target")


def resolve(requests: DataFrame, routes: DataFrame, entities: DataFrame) -> DataFrame:
    """request_target, status, redirect_target, entity_key, active: by the key's hash, then by the text itself."""
    asked = requests.select("request_target").distinct().withColumn("route_key", urls.route_key(F.col("request_target")))
    stored = routes.select("route_key", F.col("request_target").alias("stored_target"), "status", "redirect_target", "entity_key")
    hit = asked.join(stored, "route_key").filter(F.col("stored_target") == F.col("request_target"))
    return hit.join(entities.select("entity_key", "active"), "entity_key", "left").select("request_target", "status", "redirect_target", "entity_key", "active")


def fallback_navigation(routes: DataFrame, entities: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` 200 routes by target, of which those with an active entity are shown."""
    first = routes.filter("status = 200").orderBy("request_target").limit(limit)
    return first.join(entities.select("entity_key", "title", "active"), "entity_key").filter("active = 'Y'").select("request_target", "title")


def scope(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status") != "EXCLUDED").select("crawl_key")


def exclusions(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status") == "EXCLUDED").select("crawl_key", F.coalesce("reason", F.lit("Excluded")).alias("reason"))


def limited(df: DataFrame, order: list[Column], rows: int, bytes_: int, column: str) -> DataFrame:
    """A sample in order: at most ``rows`` rows and ``bytes_`` bytes of the column, with the count of all and whether it is cut."""
    from pyspark.sql import Window

    # At most ``rows`` rows are ever numbered: the top-k comes before the window.
    top = ranked(df.orderBy(*order).limit(rows), order, "_n", buckets=1)
    running = F.sum(F.octet_length(column)).over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    kept = top.withColumn("_bytes", running).filter(F.col("_bytes") <= bytes_)
    return kept.drop("_n", "_bytes")
