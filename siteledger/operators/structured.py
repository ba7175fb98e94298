"""Structured data, selected fields and page commerce as tables: what belongs to a page, and what only appears on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.functions import money, urls
from siteledger.functions.text import compact, let, trim_wide
from siteledger.operators.common import require

PROPERTY_FACTS = "array<struct<name:string,value:string,unit:string,evidence:string>>"
CLASSES = ("Product", "Article", "BlogPosting", "NewsArticle", "Service")


def _own_key(reference: Column, page_url: Column) -> Column:
    return urls.identity(urls.resolve(reference, page_url))["crawl_key"]


def bound_nodes(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, node: the one schema.org node of a known class whose url or @id is this page; pages with several have none.

    parsed: url, parse. Foreign nodes (related products, listings) never describe the page.
    """
    return _bound(parsed, key).select(key, "node")


def _bound(parsed: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """key, _page, node: bound_nodes with the page's url beside each, so that no join brings it back.

    tasks: into how many the nodes are dealt by their key, for tables whose share of a shuffle partition would be large to sort.
    """
    page = urls.identity(F.col("url"))["crawl_key"]
    kinds = F.array_intersect("node.classes", F.array(*map(F.lit, CLASSES)))
    rows = parsed.select(*dict.fromkeys([key, "url"]), F.explode("parse.ld").alias("node"))
    mine = rows.filter(F.col("node.schema_org") & (F.size(kinds) == 1) & ((_own_key(F.col("node.url"), F.col("url")) == page) | (_own_key(F.col("node.id"), F.col("url")) == page)))
    if tasks:
        mine = mine.repartition(tasks, key)
    one = mine.groupBy(key).agg(F.count("*").alias("n"), F.min_by(F.struct(F.col("url").alias("_page"), "node"), "node.ord").alias("one"))
    return one.filter("n = 1").select(key, "one._page", "one.node")


def offers(parsed: DataFrame, key: str = "url") -> DataFrame:
    """Offers of the page-bound node: identity, kind (exact, from, range), price, conditions and limitations.

    Only nodes of the types Offer and AggregateOffer count. An aggregate, or an offer that has a lowest price only, is
    "from", and an aggregate with a highest price a range. What limits an offer (validity, customers, region, tax) is
    a condition, spelled as a name and the JSON of its value.
    A nested identity (url, sku, offered item) that names something else than the owner is a limitation, and so is an
    identity that several offers share; such offers are kept for review.
    """
    return _offer_rows(_bound(parsed, key).select(key, "_page", F.col("node.sku").alias("owner_sku"), F.posexplode("node.offers").alias("ord", "o")), [key])


def _offer_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The offers of each owner. rows: keys, _page, owner_sku, ord, o."""
    rows = rows.filter(F.arrays_overlap("o.types", F.array(F.lit("Offer"), F.lit("AggregateOffer"))))
    page = urls.identity(F.col("_page"))["crawl_key"]
    foreign = compact(
        F.when(F.col("o.url").isNotNull() & ~_own_key(F.col("o.url"), F.col("_page")).eqNullSafe(page), F.lit("OFFER_URL_FOREIGN")),
        F.when(F.col("o.item_id").isNotNull() & ~_own_key(F.col("o.item_id"), F.col("_page")).eqNullSafe(page), F.lit("OFFERED_ITEM_FOREIGN")),
        F.when(F.col("o.sku") != F.col("owner_sku"), F.lit("OFFER_SKU_FOREIGN")),
    )
    amount = F.coalesce("o.price", "o.low")
    aggregate = F.col("o.kind") == "AggregateOffer"
    kind = F.when(aggregate & F.col("o.high").isNotNull(), "range").when(aggregate | (F.col("o.price").isNull() & F.col("o.low").isNotNull()), "from").otherwise("exact")
    identity = F.coalesce("o.id", "o.url", F.concat(F.lit("sku:"), F.col("o.sku")), F.concat(F.lit("ord:"), F.col("ord").cast("string")))
    named = {"priceValidUntil": "valid_until", "eligibleCustomerType": "customer", "eligibleRegion": "region", "valueAddedTaxIncluded": "vat"}
    conditions = compact(*[F.concat(F.lit(f"{name}: "), F.col(f"o.{c}")) for name, c in named.items()])
    out = rows.select(
        *keys,
        "ord",
        identity.alias("offer_identity"),
        kind.alias("kind"),
        money.money(amount, F.upper(F.col("o.currency"))).alias("money"),
        F.when(kind == "range", money.money(F.col("o.high"), F.upper(F.col("o.currency")))).alias("maximum"),
        F.col("o.unit").alias("unit"),
        conditions.alias("conditions"),
        foreign.alias("limitations"),
        F.struct(money.quantity(F.col("o.least")).alias("least"), money.quantity(F.col("o.step")).alias("step"), money.quantity(F.col("o.most")).alias("most"), F.col("o.most").isNotNull().alias("most_given")).alias("quantities"),
    )
    both = out.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "offer_identity")))
    return both.withColumn("limitations", F.concat("limitations", compact(F.when(F.col("_n") > 1, F.lit("DUPLICATE_OFFER_IDENTITY"))))).drop("_n")


def offer_prices(offer_rows: DataFrame, visible: DataFrame, key: str = "url") -> DataFrame:
    """Offers with status: REQUIRES_REVIEW if limited, without money, or if a visible current price disagrees.

    visible: key, minor of the page's current prices.
    """
    seen = visible.groupBy(key).agg(F.count_distinct("minor").alias("visible_amounts"), F.min("minor").alias("visible_minor"))
    rows = offer_rows.join(seen.hint("merge"), key, "left")
    mismatch = (F.col("kind") == "exact") & (F.col("visible_amounts") == 1) & (F.col("visible_minor") != F.col("money.minor"))
    open_range = (F.col("kind") == "range") & F.col("maximum").isNull()
    review = (F.size("limitations") > 0) | F.col("money").isNull() | open_range | F.coalesce(mismatch, F.lit(False))
    return rows.withColumn("status", F.when(review, "REQUIRES_REVIEW").otherwise("OBSERVED")).drop("visible_amounts", "visible_minor")


def _named_variants(parsed: DataFrame, key: str) -> DataFrame:
    """key, _page, variant_id, attributes, v: the bound node's variants, named by their sorted attributes; a repeated id fails."""
    rows = _bound(parsed, key).select(key, "_page", F.explode("node.variants").alias("v"))
    attributes = F.array_sort(F.transform("v.properties", lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"))))
    named = rows.withColumn("attributes", attributes)
    named = named.withColumn("variant_id", urls.stable_id("variant", F.concat_ws("|", F.col(key).cast("string"), F.coalesce("v.sku", F.lit("")), F.to_json("attributes"))))
    counted = named.withColumn("_n", F.count("*").over(Window.partitionBy(key, "variant_id")))
    return require(counted, F.col("_n") > 1, "two variants have one identity").drop("_n")


def variants(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, variant_id, sku, name, attributes: variants of the bound node, named by their sorted attributes; a repeated id fails."""
    return _named_variants(parsed, key).select(key, "variant_id", F.col("v.sku").alias("sku"), F.col("v.name").alias("name"), "attributes")


def variant_prices(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, variant_id, sku, and the offers of each variant as by offers(), with status: its own prices, never the page's."""
    offered = _named_variants(parsed, key).select(key, "_page", "variant_id", F.col("v.sku").alias("owner_sku"), F.posexplode("v.offers").alias("ord", "o"))
    own = _offer_rows(offered.withColumn("sku", F.col("owner_sku")), [key, "variant_id", "sku"])
    review = (F.size("limitations") > 0) | F.col("money").isNull() | ((F.col("kind") == "range") & F.col("maximum").isNull())
    return own.withColumn("status", F.when(review, "REQUIRES_REVIEW").otherwise("OBSERVED"))


def variant_purchases(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, variant_id, sku, price_id, blockers: whether each variant's own prices and quantities allow an exact total."""
    from siteledger.operators.catalog import purchase_rule

    ids = variants(parsed, key).select(key, "variant_id", "sku")
    p = variant_prices(parsed, key)
    exact = (F.col("kind") == "exact") & (F.size("conditions") == 0) & F.col("unit").isNotNull()
    whole = lambda c: money.scaled(F.col(f"quantities.{c}"), 6)
    rows = p.select("variant_id", "ord", F.col("offer_identity").alias("id"), F.lit("CURRENT").alias("role"), "status", F.col("money.minor").alias("minor"), F.col("money.currency").alias("currency"), "unit", "conditions", exact.alias("eligible"), whole("least").alias("min_quantity"), whole("step").alias("quantity_step"), whole("most").alias("max_quantity"), F.col("quantities.most_given").alias("max_given"))
    joined = ids.select(F.col("variant_id").alias("owner")).join(rows.withColumnRenamed("variant_id", "owner").hint("merge"), "owner", "left").withColumn("selection_required", F.lit(False))
    return ids.join(purchase_rule(joined).hint("merge"), ids["variant_id"] == F.col("owner")).select(key, "variant_id", "sku", "price_id", "blockers")


def node_facts(parsed: DataFrame, key: str = "url", tasks: int | None = None) -> DataFrame:
    """key, name, value, unit, status, evidence: what the page's own node says of itself, in long form.

    Names are name, sku, brand and description, and property:<name> for each property with a value; of a repeated one the first counts.
    """
    at = F.concat(F.lit("ld["), F.col("node.ord").cast("string"), F.lit("]."))
    fact = lambda name, value, unit, evidence: F.struct(name.alias("name"), value.alias("value"), unit.alias("unit"), evidence.alias("evidence"))
    fixed = F.array(*[fact(F.lit(c), F.nullif(trim_wide(F.col(f"node.{c}")), F.lit("")), F.lit(None).cast("string"), F.concat(at, F.lit(c))) for c in ("name", "sku", "brand", "description")])
    listed = F.transform("node.properties", lambda p, k: fact(F.concat(F.lit("property:"), trim_wide(p["name"])), trim_wide(F.coalesce(p["value"], F.lit(""))), p["unit"], F.concat(at, F.lit("additionalProperty["), k.cast("string"), F.lit("]"))))
    given = F.filter(listed, lambda f: f["value"] != "")
    # A page's facts come from one row of it, so the first of a name is known beside it.
    facts = _bound(parsed, key, tasks).select(key, F.posexplode(F.concat(fixed, F.coalesce(given, F.array().cast(PROPERTY_FACTS)))).alias("ord", "f"))
    first = facts.groupBy(key, F.col("f.name").alias("name")).agg(F.min_by("f", "ord").alias("f"))
    rows = first.select(key, "name", "f.value", "f.unit", "f.evidence")
    return rows.select(key, "name", "value", "unit", F.when(F.col("value").isNotNull(), "OBSERVED").otherwise("ABSENT").alias("status"), "evidence")


def home_logo(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, alt: a home page's logo text, only if header images that link home are the page's one image of its own, with one text."""
    me = urls.identity(F.col("url"))
    home = parsed.filter(me["request_target"] == "/").select(*dict.fromkeys([key, "url"]), "parse.og_images", "parse.logos")
    resolved = lambda c: urls.identity(urls.resolve(F.col(c), F.col("url")))
    images = home.select(key, "url", F.explode("og_images").alias("raw")).withColumn("image", resolved("raw"))
    own = images.filter(F.col("image.origin") == urls.origin_of(F.col("url"))).groupBy(key).agg(F.count_distinct("image.crawl_key").alias("n"), F.min("image.crawl_key").alias("expected")).filter("n = 1")
    shown = home.select(key, "url", F.explode("logos").alias("l")).select(key, "url", "l.*").filter(~F.col("href").startswith("#"))
    shown = shown.withColumn("to", resolved("href")).withColumn("image", resolved("source"))
    leads = (F.col("to.origin") == urls.origin_of(F.col("url"))) & (F.col("to.request_target") == "/") & (F.coalesce("to.fragment", F.lit("")) == "")
    fits = shown.filter(leads).join(own.hint("merge"), key).filter(F.col("image.crawl_key") == F.col("expected"))
    return fits.groupBy(key).agg(F.count_distinct("alt").alias("n"), F.min("alt").alias("alt")).filter("n = 1").select(key, "alt")


def attributes(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, name, value: two-cell rows and item properties of the page and its bound node; the last write of a name wins."""
    own = parsed.select(key, F.explode("parse.attributes").alias("a")).select(key, trim_wide(F.col("a.name")).alias("name"), F.col("a.value").alias("value"), F.struct(F.lit(1).alias("source"), F.col("a.ord").alias("ord")).alias("place"))
    node = bound_nodes(parsed, key).select(key, F.posexplode("node.properties").alias("ord", "p")).select(key, trim_wide(F.col("p.name")).alias("name"), F.col("p.value").alias("value"), F.struct(F.lit(0).alias("source"), F.col("ord")).alias("place"))
    return own.unionByName(node).groupBy(key, "name").agg(F.max_by("value", "place").alias("value"))


def selections(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, ord, label, required, options; a page with a required choice of several needs one before it can be priced."""
    s = parsed.select(key, F.explode("parse.selections").alias("s"))
    return s.select(key, "s.ord", "s.label", "s.required", "s.options", (F.col("s.required") & (F.size("s.options") > 1)).alias("selection_required"))


def visible_prices(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, ord, price: the page's price texts read against their metadata."""
    rows = parsed.select(key, F.explode("parse.prices").alias("p"))
    priced = money.with_price(rows, F.col("p.raw"), F.col("p.role"), F.col("p.currency"), F.col("p.amount"), F.lit(None).cast("string"), F.array().cast("array<string>"))
    return priced.select(key, "p.ord", "price")


def selected_fields(captures: DataFrame) -> DataFrame:
    """source_url, ord, name, label, text, is_name: observed fields in order; the one ``h1`` locator names the entity.

    captures: source_url, fields array<struct<name,locator,text>>.
    """
    rows = captures.select("source_url", F.size(F.filter("fields", lambda f: f["locator"] == "h1")).alias("h1s"), F.posexplode("fields").alias("ord", "f"))
    label = F.initcap(F.regexp_replace("f.name", "[_-]+", " "))
    return rows.select("source_url", "ord", "f.name", label.alias("label"), trim_wide(F.col("f.text")).alias("text"), ((F.col("h1s") == 1) & (F.col("f.locator") == "h1")).alias("is_name"))


def homepage_navigation(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, ord, label, request_target: distinct labelled navigation links of home pages, in their first order."""
    me = urls.identity(F.col("url"))
    home = parsed.filter(urls.path_of(me["request_target"]) == "/")
    l = home.select(*dict.fromkeys([key, "url"]), F.explode("parse.links").alias("l")).filter("l.role = 'navigation' and l.label != ''")
    rows = l.select(key, F.col("l.ord").alias("ord"), F.col("l.label").alias("label"), urls.safe_target(urls.resolve(F.col("l.href"), F.col("url")), F.col("l.href"), urls.origin_of(F.col("url"))).alias("request_target"))
    return rows.filter("request_target is not null").groupBy(key, "label", "request_target").agg(F.min("ord").alias("ord"))


def site_name(candidates: DataFrame, key: str = "origin") -> DataFrame:
    """The site name of each origin, only if one distinct name was seen."""
    agg = candidates.select(key, trim_wide(F.col("name")).alias("name")).filter("name != ''").distinct().groupBy(key).agg(F.count("*").alias("n"), F.min("name").alias("name"))
    return agg.select(key, F.when(F.col("n") == 1, F.col("name")).alias("name"))


def page_images(parsed: DataFrame, assets: DataFrame, key: str = "url") -> DataFrame:
    """key, asset_url, sha256: a page's images with their verified bytes (null: not fetched). assets: url, status, mime, sha256."""
    rows = parsed.select(*dict.fromkeys([key, "url"]), F.explode("parse.media").alias("m")).select(key, urls.resolve(F.col("m"), F.col("url")).alias("asset_url")).filter("asset_url is not null").distinct()
    good = assets.filter("status = 'FETCHED' and mime like 'image/%'").select(F.col("url").alias("asset_url"), "sha256")
    return rows.join(good, "asset_url", "left")


def cards(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, ord, href, label, image of repeated sibling cards: at least two of one signature on the page."""
    rows = parsed.select(key, F.explode("parse.cards").alias("c")).select(key, "c.*")
    many = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key, "signature"))).filter("_n >= 2")
    return many.groupBy(key, "href", "label", "image").agg(F.min("ord").alias("ord"))


def classes_of(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, classes of the page's bound node; pages without one have an empty array."""
    bound = bound_nodes(parsed, key).select(key, F.col("node.classes").alias("classes"))
    return parsed.select(key).distinct().join(bound.hint("merge"), key, "left").select(key, let(F.coalesce("classes", F.array().cast("array<string>")), lambda c: c).alias("classes"))


def ordered_blocks(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, ord and the ordered walk's blocks: links and cards with their request target, each payload once a page.

    parsed: key, url, and the parse's ``ordered``.
    """
    rows = parsed.select(*dict.fromkeys([key, "url"]), F.explode("parse.ordered").alias("b")).select(*dict.fromkeys([key, "url"]), "b.*")
    linked = F.col("type").isin("link", "card")
    rows = urls.with_safe_target(rows, "href")
    # What may not be followed is text: of its heading or paragraph, or of the block that has its label already.
    unsafe = linked & F.col("request_target").isNull()
    shown = rows.filter(~unsafe | F.coalesce(F.col("within") != "nested", F.lit(True)))
    shown = shown.withColumn("type", F.when(unsafe, F.coalesce("within", F.lit("paragraph"))).otherwise(F.col("type")))
    shown = shown.withColumn("level", F.when(F.col("type") == "heading", F.col("level")))
    # Links of one target and label are the same whatever image they show; blocks that are no links repeat as they stand.
    repeats = F.when(F.col("type") == "link", F.lit("")).when(F.col("type") == "card", F.col("source")).otherwise(F.col("ord").cast("string"))
    again = Window.partitionBy(key, "type", "text", "request_target", "items", "repeats").orderBy("ord")
    first = shown.withColumn("repeats", repeats).withColumn("n", F.row_number().over(again)).filter("n = 1")
    return first.select(key, "ord", "type", "text", "level", "items", "rows", "request_target", "source")


def limits(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, limit: pages whose content was worked out although it is over a bound of the walk."""
    return parsed.select(key, F.explode("parse.limits").alias("limit"))


def page_links(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, ord, label, request_target, trail: links of the primary region to other pages of the site, repeats kept."""
    rows = parsed.select(*dict.fromkeys([key, "url"]), F.explode("parse.page_links").alias("l")).select(*dict.fromkeys([key, "url"]), "l.*")
    return urls.with_safe_target(rows, "href").select(key, "ord", "label", "request_target", "trail").filter("request_target is not null")


def breadcrumbs(parsed: DataFrame, key: str = "url") -> DataFrame:
    """key, source, chain, place, label, request_target, status: the chains of a page from its root downwards.

    Chains come from trail markup (its links in order) and from structured lists of crumbs, which are put into order by their
    positions. A list whose positions are missing, repeated or not 1 to n is kept in its own order for review; so is a chain with
    a crumb that leads nowhere on the site, but for the last one, which may be the page itself.
    """
    own = page_links(parsed, key).filter("trail is not null")
    place = F.row_number().over(Window.partitionBy(key, "trail").orderBy("ord"))
    marked = own.select(key, F.lit("markup").alias("source"), F.col("trail").alias("chain"), place.alias("place"), "label", "request_target", F.lit("OBSERVED").alias("status"))
    lists = parsed.select(*dict.fromkeys([key, "url"]), F.explode("parse.ld").alias("node")).filter(F.array_contains("node.classes", "BreadcrumbList") & F.col("node.schema_org"))
    entries = lists.select(*dict.fromkeys([key, "url"]), F.col("node.ord").alias("chain"), F.size("node.listed").alias("n"), F.posexplode("node.listed").alias("given", "e"))
    position = F.when(F.col("e.position").rlike("^[1-9][0-9]{0,8}$"), F.col("e.position").cast("int"))
    entries = entries.select(*dict.fromkeys([key, "url"]), "chain", "n", "given", position.alias("position"), F.col("e.name").alias("label"), F.col("e.url").alias("href"))
    entries = urls.with_safe_target(entries, "href")
    # A chain is as long as its page's list; a row for each list tells whether its positions are 1 to n.
    sound = entries.groupBy(key, "chain").agg(((F.count_distinct("position") == F.max("n")) & (F.max("position") == F.max("n"))).alias("sound"), F.count_if(F.col("request_target").isNull() & (F.coalesce("position", F.lit(0)) < F.col("n"))).alias("lost"))
    sound = sound.withColumn("sound", F.coalesce("sound", F.lit(False)))
    joined = entries.join(sound.hint("merge"), [key, "chain"])
    status = F.when(F.col("sound") & (F.col("lost") == 0), "OBSERVED").otherwise("REQUIRES_REVIEW")
    return marked.unionByName(joined.select(key, F.lit("list").alias("source"), "chain", F.when(F.col("sound"), F.col("position")).otherwise(F.col("given") + 1).alias("place"), "label", "request_target", status.alias("status")))
