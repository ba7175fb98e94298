"""The queue of what to look at next: witnesses, observations, classification, priority and the next batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions import http, urls
from siteledger.functions.text import compact
from siteledger.operators.common import bound, ranked, require, written

LINK_KINDS = ("raw-link", "dom-link", "selected-link")
# Fixed value: what a path to general information begins with.
INFORMATION = ("about", "contact", "kontak", "dostav", "oplata", "garant", "instruction", "instruk", "document", "support", "news", "novosti", "article")
CONTEXT = ["kind", "input_id", "html_sha256", "source_url", "observed_at", "base_url", "role"]


def link_witnesses(parsed: DataFrame, input_id: Column | None = None, source: Column | None = None) -> DataFrame:
    """One witness for each distinct link of a parsed page. parsed: url, observed_at, html_sha256, parse.

    input_id and source: where they are not the digest of the HTML and the page's own URL.

    A page's links are made distinct before anything is shuffled: menus repeat on every page.
    """
    base = F.coalesce(urls.resolve(F.col("parse.base"), F.col("url")), F.col("url"))
    own = [(F.col("html_sha256") if input_id is None else input_id).alias("input_id"), (F.col("url") if source is None else source).alias("source_url")]
    links = parsed.select(*own, "observed_at", "html_sha256", base.alias("base_url"), F.explode("parse.links").alias("l"))
    return links.select(
        F.lit("dom-link").alias("kind"),
        "input_id",
        "html_sha256",
        "source_url",
        "observed_at",
        F.concat(F.lit("a["), F.col("l.ord"), F.lit("]")).alias("locator"),
        F.col("l.href").alias("raw_reference"),
        "base_url",
        F.col("l.label").alias("label"),
        F.col("l.role").alias("role"),
        F.col("l.action_control").alias("action_control"),
        F.col("l.fragment_only").alias("fragment_only"),
    )


WITNESS_KINDS = ("capture-inventory", "observation", "requested-url", "raw-link", "selected-link", "dom-link")


def _witness(rows: DataFrame, kind: Column, reference: Column, locator: Column, base: Column | None = None, html: Column | None = None) -> DataFrame:
    text = lambda c, t="string": (F.lit(None) if c is None else c).cast(t)
    has = lambda c, t: F.col(c) if c in rows.columns else F.lit(None).cast(t)
    return rows.select(
        kind.alias("kind"),
        "input_id",
        text(html).alias("html_sha256"),
        has("source_url", "string").alias("source_url"),
        has("observed_at", "timestamp").alias("observed_at"),
        locator.alias("locator"),
        reference.alias("raw_reference"),
        text(base).alias("base_url"),
        F.lit("").alias("label"),
        F.lit("other").alias("role"),
        F.lit(False).alias("action_control"),
        reference.startswith("#").alias("fragment_only"),
    )


def inventory_witnesses(inventory: DataFrame) -> DataFrame:
    """One witness for each URL that a capture lists. inventory: input_id, ord, url."""
    return _witness(inventory, F.lit("capture-inventory"), F.col("url"), F.concat(F.lit("inventory.urls["), F.col("ord"), F.lit("]")))


def observed_witnesses(observations: DataFrame) -> DataFrame:
    """The witnesses of observed pages: the page itself, where it ended, what was asked for, and the links that it shows.

    observations: input_id, source_url, document_url, observed_at, format (dom-html or selected-fields), html_sha256, title,
    requested_url, raw_links array<string>, parse (null for selected fields). A page whose title is a challenge's is evidence
    of itself, but none of its links is.
    """
    rows = observations.withColumn("_challenged", http.access_challenge(F.lit(None).cast("map<string,string>"), F.col("title")).isNotNull())
    html, key = F.col("html_sha256"), lambda c: urls.identity(F.col(c))["crawl_key"]
    ended = rows.filter(~key("source_url").eqNullSafe(key("document_url")))
    own = _witness(rows, F.lit("observation"), F.col("source_url"), F.lit("source_url"), html=html)
    own = own.unionByName(_witness(ended, F.lit("observation"), F.col("document_url"), F.lit("document_url"), html=html))
    own = own.unionByName(_witness(rows.filter("requested_url is not null"), F.lit("requested-url"), F.col("requested_url"), F.lit("requested_url"), html=html))
    shown = rows.filter("not _challenged")
    dom = F.col("format") == "dom-html"
    base = F.when(dom, F.coalesce(urls.resolve(F.col("parse.base"), F.col("document_url")), F.col("document_url"))).otherwise(F.col("document_url"))
    raw = shown.withColumn("_base", base).select("*", F.posexplode("raw_links").alias("_ord", "_link"))
    links = _witness(raw, F.when(dom, "raw-link").otherwise("selected-link"), F.col("_link"), F.concat(F.lit("links["), F.col("_ord"), F.lit("]")), F.col("_base"), F.when(dom, html))
    seen = shown.filter(dom).select("input_id", F.col("source_url").alias("source"), "observed_at", "html_sha256", F.col("document_url").alias("url"), "parse")
    anchors = link_witnesses(seen, F.col("input_id"), F.col("source"))
    return own.unionByName(links).unionByName(anchors)


def distinct_witnesses(witnesses: DataFrame) -> DataFrame:
    """Each witness once, whichever inputs tell it, with the digest of its content and how many inputs do."""
    content = [c for c in witnesses.columns if c not in ("input_id", "locator")]
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return witnesses.groupBy(digest.alias("witness_id"), *content).agg(F.count_distinct("input_id").alias("inputs"), F.min("locator").alias("locator"))


def with_identity(witnesses: DataFrame) -> DataFrame:
    """Adds queue_key, id, url, origin and request_target; what cannot be resolved keeps a key of its own."""
    spaced = F.trim("raw_reference") != F.col("raw_reference")
    absolute = F.when(spaced | (F.col("raw_reference") == ""), F.lit(None).cast("string")).otherwise(urls.resolve(F.col("raw_reference"), F.col("base_url")))
    rows = bound(bound(witnesses, _absolute=absolute), _id=urls.identity(F.col("_absolute")))
    unresolved = F.concat(F.lit("unresolved:"), F.to_json(F.array("raw_reference", "base_url")))
    key = F.coalesce(F.concat(F.lit("url:"), F.col("_id.crawl_key")), unresolved)
    return rows.select(*witnesses.columns, key.alias("queue_key"), F.sha2(key, 256).alias("id"), F.col("_id.crawl_key").alias("url"), F.col("_id.origin").alias("origin"), F.col("_id.request_target").alias("request_target"))


def observation_status(challenged: Column, source_key: Column, document_key: Column, format_: Column) -> Column:
    return F.when(challenged, "ACCESS_CHALLENGE").when(source_key != document_key, "DOCUMENT_MISMATCH").when(format_ == "dom-html", "DOM_OBSERVED").otherwise("SELECTED_FIELDS_ONLY")


def latest_status(observations: DataFrame) -> DataFrame:
    """url, status, observed_at of the latest observation by (time, digest, input)."""
    last = F.struct("observed_at", "snapshot_sha256", "input_id")
    return observations.groupBy(F.col("source_url").alias("url")).agg(F.max_by("status", last).alias("status"), F.max("observed_at").alias("observed_at"))


def pending_navigation(witnesses: DataFrame, observations: DataFrame, latest: DataFrame) -> DataFrame:
    """url of pages that a navigation was asked for, but that ended elsewhere, no earlier than the page's own last observation.

    The witness has to be bound to the exact final observation: same input, page, document, digest and time.
    """
    asked = witnesses.filter((F.col("kind") == "requested-url") & F.col("url").isNotNull() & (F.col("source_url") != F.col("url")) & F.col("observed_at").isNotNull() & F.col("html_sha256").isNotNull())
    final = observations.filter(F.col("source_url") == F.col("document_url")).select("input_id", "source_url", F.col("snapshot_sha256").alias("html_sha256"), "observed_at").distinct()
    bound = asked.join(final, ["input_id", "source_url", "html_sha256", "observed_at"], "left_semi").select("url", F.col("observed_at").alias("asked_at"))
    own = latest.select("url", F.col("observed_at").alias("own_at"))
    return bound.join(own, "url", "left").filter(F.col("own_at").isNull() | (F.col("asked_at") >= F.col("own_at"))).select("url").distinct()


def queue(witnesses: DataFrame, observations: DataFrame, source_origin: str | Column) -> DataFrame:
    """One row for each identity: classification, queue_status, priority, reasons and witness counts.

    witnesses: as from with_identity. Everything a class depends on is a flag that is combined on the map side, so
    that the witnesses of a menu link are never gathered.
    """
    kind, role = F.col("kind"), F.col("role")
    # Written, so that pages are parsed once: entries and pending navigation both read it.
    deduped = written(witnesses.dropDuplicates(["queue_key", "kind", "source_url", "raw_reference", "label", "role", "observed_at", "html_sha256"]), "witnesses")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    entries = deduped.groupBy("queue_key").agg(
        F.first("id").alias("id"),
        F.min("url").alias("url"),
        F.min("origin").alias("origin"),
        F.min("request_target").alias("request_target"),
        F.min(F.struct("raw_reference", "base_url")).alias("representative"),
        F.count("*").alias("witnesses"),
        any_(kind.isin(*LINK_KINDS)).alias("linked"),
        any_("action_control").alias("controls"),
        F.bool_and("fragment_only").alias("only_fragments"),
        any_(role == "navigation").alias("in_navigation"),
        any_(role == "heading").alias("in_heading"),
        F.min_by(F.struct("source_url", "locator", "label"), F.when(kind.isin(*LINK_KINDS), F.struct("source_url", "locator"))).alias("first_link"),
    )
    latest = written(latest_status(observations), "latest")
    pending = pending_navigation(deduped, observations, latest).withColumn("pending", F.lit(True))
    rows = entries.join(latest.select("url", F.col("status").alias("observation_status")), "url", "left").join(pending, "url", "left")
    return classify(rows, source_origin)


def classify(rows: DataFrame, source_origin: str | Column) -> DataFrame:
    target = F.col("request_target")
    rows = bound(rows, _path=urls.path_of(target))
    rows = bound(rows, _decoded=urls.decode_path(F.col("_path")), _acts=urls.acts(target))
    path, decoded, shown = F.col("_path"), F.col("_decoded"), F.coalesce("_decoded", "_path")
    origin = F.lit(source_origin) if isinstance(source_origin, str) else source_origin
    first = (
        F.when(F.col("url").isNull(), "INVALID_URL_REVIEW")
        .when(F.col("origin") != origin, "FOREIGN_ORIGIN_REVIEW")
        .when(shown.rlike(urls.PROTECTED_PATH), "PROTECTED_REVIEW")
        .when(shown.rlike(urls.ACTION_PATH) | F.col("_acts") | F.col("controls"), "SOURCE_ACTION_REVIEW")
        .when(path.rlike(r"(?i)\.pdf$"), "DOCUMENT_REVIEW")
        .when(path.rlike(urls.RESOURCE), "MEDIA_REVIEW")
        .when(F.col("only_fragments"), "FRAGMENT_REVIEW")
        .when(~F.col("linked") & F.col("observation_status").isNull(), "UNWITNESSED_INVENTORY_REVIEW")
        .when(target.contains("?"), "QUERY_VARIANT_REVIEW")
        .otherwise("CONTENT_CANDIDATE")
    )
    rows = bound(rows, first_class=first)
    pending = F.coalesce("pending", F.lit(False)) & F.col("first_class").isin("CONTENT_CANDIDATE", "QUERY_VARIANT_REVIEW", "UNWITNESSED_INVENTORY_REVIEW")
    rows = bound(rows, classification=F.when(pending, "HTTP_NAVIGATION_UNVERIFIED").otherwise(F.col("first_class")), _pending=pending)
    pending = F.col("_pending")
    seen = F.col("observation_status")
    status = F.when(F.col("classification") == "HTTP_NAVIGATION_UNVERIFIED", "REVIEW_REQUIRED").when(seen == "DOM_OBSERVED", "ALREADY_OBSERVED").when((F.col("classification") == "CONTENT_CANDIDATE") & seen.isNull(), "OUTSTANDING").otherwise("REVIEW_REQUIRED")
    reasons = compact(
        F.when(decoded.isNull() & F.col("url").isNotNull() & (F.col("origin") == origin), F.lit("MALFORMED_PERCENT_ENCODING")),
        F.when(F.col("first_class") != "CONTENT_CANDIDATE", F.col("first_class")),
        F.when(seen.isin("ACCESS_CHALLENGE", "DOCUMENT_MISMATCH", "SELECTED_FIELDS_ONLY"), seen),
        F.when(pending, F.lit("HTTP_NAVIGATION_UNVERIFIED")),
    )
    info = target.rlike(rf"(?i)(?:^|/)(?:{urls.alternatives(INFORMATION)})")
    priority = F.when(F.col("in_navigation"), 10).when(F.col("in_heading"), 20).when(F.coalesce(info, F.lit(False)), 30).when(F.size(F.split(F.coalesce(target, F.lit("")), "/")) > 2, 40).otherwise(50)
    rows = bound(rows, priority=priority, queue_status=status)
    priority = F.col("priority")
    because = F.element_at(F.create_map(*[F.lit(x) for kv in {10: "navigation", 20: "heading", 30: "information path", 40: "nested path", 50: "ordinary link"}.items() for x in kv]), priority)
    return rows.select("queue_key", "id", "url", "origin", "request_target", "classification", "queue_status", F.coalesce(seen, F.lit("NOT_OBSERVED")).alias("observation_status"), "priority", because.alias("priority_reason"), reasons.alias("review_reasons"), "witnesses", "representative", "first_link")


def next_batch(entries: DataFrame, n: int = 50) -> DataFrame:
    """The n outstanding entries of the best priority (a top-k, not a full sort), with their first link."""
    if not 1 <= n <= 500:
        raise ValueError("a batch has 1 to 500 entries")
    return entries.filter("queue_status = 'OUTSTANDING'").orderBy("priority", "url").limit(n).select("id", "url", "request_target", "priority", "priority_reason", F.col("first_link.source_url").alias("witness_url"), F.col("first_link.locator").alias("witness_locator"))


def resume(prior_witnesses: DataFrame, prior_observations: DataFrame, witnesses: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of a prior queue's evidence and new inputs, without repeats; nothing is dropped."""
    return prior_witnesses.unionByName(witnesses).distinct(), prior_observations.unionByName(observations).distinct()


def budget_verdict(entries: DataFrame, limit: int) -> DataFrame:
    """One row: entries, budget, verdict (WITHIN or EXCEEDED)."""
    n = entries.agg(F.count("*").alias("entries"))
    return n.select("entries", F.lit(limit).cast("long").alias("budget"), F.when(F.col("entries") > limit, "EXCEEDED").otherwise("WITHIN").alias("verdict"))


def within_budget(entries: DataFrame, limit: int, what: str = "entries") -> DataFrame:
    """The same rows; more than the limit fails the job instead of being cut."""
    found = budget_verdict(entries, limit).first()
    if found.verdict != "WITHIN":
        raise ValueError(f"{found.entries} {what} exceed the budget of {limit}")
    return entries


def encode_witnesses(witnesses: DataFrame, context: list[str] = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """(contexts, witnesses): distinct contexts get a dense number in sorted order, witnesses keep the number."""
    witnesses = written(witnesses, "witnesses")  # read three times below
    contexts = ranked(witnesses.select(*context).distinct(), [F.col(c).asc_nulls_first() for c in context], "context")
    contexts = written(contexts, "contexts")
    right = contexts.select(*[F.col(c).alias(f"_{c}") for c in context], "context")
    on = F.lit(True)
    for c in context:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return contexts, witnesses.join(right, on).drop(*context, *[f"_{c}" for c in context])


def decode_witnesses(contexts: DataFrame, encoded: DataFrame) -> DataFrame:
    """The witnesses again; a number that no context has fails the job."""
    joined = encoded.join(contexts.withColumn("_known", F.lit(True)), "context", "left")
    return require(joined, F.col("_known").isNull(), "a witness names an unknown context").drop("context", "_known")
