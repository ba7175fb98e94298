"""Commerce facts to catalog rows: unique facts, purchase rules, exact prices and snapshot items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions import urls
from siteledger.functions.money import scaled
from siteledger.functions.text import compact, trim_wide

# The fields that each type of entity must have.
REQUIRED_FIELDS = {
    "Page": ("source_id", "source_url", "title", "blocks", "seo", "evidence"),
    "Product": ("source_id", "source_url", "title", "evidence"),
    "Article": ("source_id", "source_url", "title", "blocks", "evidence"),
    "Service": ("source_id", "source_url", "title", "blocks", "evidence"),
}
# Fixed value: a label with one of these advertises something and names no category.
PROMOTION = r"(?i)купить|корзин|руб[ .]|₽|подробнее|акци|скидк|логотип"


def unique_facts(candidates: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, value, status: one distinct trimmed value is OBSERVED, several REQUIRES_REVIEW, none UNKNOWN.

    Values are made distinct on the map side; only counts are kept, so a key with many values costs no more.
    """
    text = F.nullif(trim_wide(F.col(value)), F.lit(""))
    agg = candidates.select(*keys, text.alias("v")).distinct().groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("one"))
    return agg.select(*keys, F.when(F.col("n") == 1, F.col("one")).alias("value"), F.when(F.col("n") == 1, "OBSERVED").when(F.col("n") > 1, "REQUIRES_REVIEW").otherwise("UNKNOWN").alias("status"))


def entity_type(classes: Column) -> Column:
    """Product before articles before Service before Page."""
    has = lambda *names: F.arrays_overlap(classes, F.array(*map(F.lit, names)))
    return F.when(has("Product"), "Product").when(has("Article", "BlogPosting", "NewsArticle"), "Article").when(has("Service"), "Service").otherwise("Page")


def entity_name(nodes: Column, kind: Column) -> Column:
    """The name of the first JSON-LD node that gives an entity its type; plain pages take none."""
    own = F.filter(nodes, lambda n: (kind != "Page") & (entity_type(n["classes"]) == kind))
    return F.try_element_at(own, F.lit(1))["name"]


def page_type(path: Column, kind: Column) -> Column:
    """The type of an entity that is more than a page, else what its path says."""
    return F.when(kind != "Page", F.lower(kind)).when(path == "/", "home").when(path.rlike(r"(?i)(?:^|/)(?:contact|kontakt)"), "contacts").otherwise("text")


def page_kind(is_home: Column, classes: Column, heading_links: Column, linked_images: Column) -> Column:
    kind = entity_type(classes)
    return F.when(is_home, "HOME").when(kind == "Product", "PRODUCT").when(kind == "Article", "ARTICLE").when(kind == "Service", "SERVICE").when((heading_links >= 2) & (linked_images >= 2), "CATEGORY").otherwise("CONTENT")


def long_facts(wide: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, name, value, status (OBSERVED or ABSENT): one row for each fact of each entity."""
    facts = F.array(*[F.struct(F.lit(n).alias("name"), F.nullif(trim_wide(F.col(n).cast("string")), F.lit("")).alias("value")) for n in names])
    rows = wide.select(key, F.explode(facts).alias("f"))
    return rows.select(key, "f.name", "f.value", F.when(F.col("f.value").isNotNull(), "OBSERVED").otherwise("ABSENT").alias("status"))


def purchase_rule(prices: DataFrame) -> DataFrame:
    """owner, price_id, blockers: whether an owner's prices and quantities allow an exact total.

    prices: owner, ord, id, role, status, minor, currency, unit, conditions, eligible (the price allows totals),
    min_quantity, quantity_step, max_quantity (scaled integers, null if unknown), max_given, selection_required.
    Observed current prices with money are in one group if money, unit and conditions are equal; one group chooses
    its first price. Blockers keep their order.
    """
    current = (F.col("role") == "CURRENT") & (F.col("status") == "OBSERVED") & F.col("minor").isNotNull()
    group = F.to_json(F.struct("minor", "currency", "unit", "conditions"), {"ignoreNullFields": "false"})
    agg = prices.groupBy("owner").agg(
        F.count_distinct(F.when(current, group)).alias("groups"),
        F.min(F.when(current, F.struct("ord", "id", "eligible"))).alias("first"),
        F.max("min_quantity").alias("lo"),
        F.max("quantity_step").alias("step"),
        F.max("max_quantity").alias("hi"),
        F.bool_or("max_given").alias("given"),
        F.bool_or("selection_required").alias("choose"),
    )
    chosen = F.col("groups") == 1
    blockers = compact(
        F.when(F.col("groups") > 1, F.lit("AMBIGUOUS_CURRENT_PRICE")).when(F.col("groups") == 0, F.lit("CURRENT_EXACT_PRICE_UNKNOWN")),
        F.when(chosen & ~F.coalesce("first.eligible", F.lit(False)), F.lit("PRICE_UNIT_CURRENCY_OR_CONDITIONS_UNRESOLVED")),
        F.when(F.col("lo").isNull(), F.lit("MIN_QUANTITY_UNKNOWN")),
        F.when(F.col("step").isNull(), F.lit("QUANTITY_STEP_UNKNOWN")),
        F.when(F.col("choose"), F.lit("VARIANT_SELECTION_REQUIRED")),
        F.when(F.col("given") & F.col("hi").isNull(), F.lit("INVALID_MAX_QUANTITY")),
        F.when(F.col("lo") > F.col("hi"), F.lit("INCONSISTENT_QUANTITY_RANGE")),
    )
    return agg.select("owner", F.when(chosen, F.col("first.id")).alias("price_id"), blockers.alias("blockers"))


def exact_price_blockers(p: Column, purchase: Column, source_url: Column) -> Column:
    """Why a price cannot be exact, in order. p: role, status, decimal, currency, minor, unit, maximum, conditions,
    eligible, source_url; purchase: min_quantity, quantity_step, max_quantity (decimal strings), source_url, blockers."""
    decimal_ok = p["decimal"].rlike(r"^(0|[1-9]\d{0,10})(?:\.\d{1,2})?$") & p["currency"].isin("RUB", "USD", "EUR") & (p["minor"] >= 0)
    number = lambda c: c.rlike(r"^(?:0|[1-9]\d{0,11})(?:\.\d{1,6})?$")
    lo, step, hi = (scaled(purchase[n], 6) for n in ("min_quantity", "quantity_step", "max_quantity"))
    known = F.coalesce(number(purchase["min_quantity"]) & number(purchase["quantity_step"]) & (step > 0), F.lit(False))
    hi_ok = purchase["max_quantity"].isNull() | number(purchase["max_quantity"])
    return compact(
        F.when(~F.coalesce((p["source_url"] == source_url) & (purchase["source_url"] == source_url), F.lit(False)), F.lit("PRICE_SOURCE_PAGE_MISMATCH")),
        F.when(~F.coalesce((p["role"] == "CURRENT") & (p["status"] == "OBSERVED") & p["eligible"] & p["maximum"].isNull() & (F.size(p["conditions"]) == 0), F.lit(False)), F.lit("PRICE_NOT_UNCONDITIONAL_CURRENT")),
        F.when(~F.coalesce(decimal_ok, F.lit(False)), F.lit("PRICE_MONEY_UNREPRESENTABLE")).when(scaled(p["decimal"], 2) != p["minor"], F.lit("PRICE_MINOR_MISMATCH")),
        F.when(~F.coalesce(p["unit"].rlike(r"^[a-zA-Z0-9_-]{1,32}$"), F.lit(False)), F.lit("PRICE_UNIT_UNKNOWN")),
        F.when(~known | ~hi_ok | (F.size(F.coalesce(purchase["blockers"], F.array().cast("array<string>"))) > 0), F.lit("QUANTITY_EVIDENCE_INCOMPLETE")),
        F.when(known & ((F.pmod(lo, F.when(step > 0, step)) != 0) | F.coalesce(hi < lo, F.lit(False))), F.lit("QUANTITY_CONSTRAINTS_INCONSISTENT")),
    )


def project(products: DataFrame, category_map: DataFrame, breadcrumbs: DataFrame) -> DataFrame:
    """entity_source_id, product_key, categories: products bound to the mapped categories of their breadcrumbs."""
    mapped = breadcrumbs.join(category_map.select("category", "target_category").distinct(), "category")
    cats = mapped.select("entity_source_id", "target_category").distinct().groupBy("entity_source_id").agg(F.array_sort(F.collect_list("target_category")).alias("categories"))
    rows = products.join(cats, "entity_source_id", "left")
    return rows.select("entity_source_id", F.sha2(F.concat(F.lit("product:"), F.col("entity_source_id").cast("string")), 256).alias("product_key"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def items(entities: DataFrame, commerce: DataFrame, routes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Snapshot items: entities with a 200 route and their commerce row, and a search text of their blocks in order."""
    texts = blocks.groupBy("source_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])).alias("body_text"))
    live = routes.filter("expected_status = 200").select(F.col("entity_source_id").alias("source_id"), "request_target")
    joined = entities.join(live, "source_id").join(commerce, "source_id", "left").join(texts, "source_id", "left")
    return joined.withColumn("body_text", F.coalesce("body_text", F.lit("")))


def categories_of(crumbs: DataFrame, routes: DataFrame, kinds: DataFrame) -> DataFrame:
    """entity_source_id, category_ids, category: the categories that a page's crumbs lead to, in order, and the deepest one.

    crumbs: entity_source_id, place, request_target; routes: request_target, entity_source_id (live ones); kinds: entity_source_id,
    page_kind. Only pages that were observed to be categories count. Where no crumb is one, the deepest category whose path
    begins the page's own path is taken as category, but not as one of category_ids, which are observed.
    """
    live = routes.select("request_target", F.col("entity_source_id").alias("category_id"))
    chosen = kinds.filter("page_kind = 'CATEGORY'").select(F.col("entity_source_id").alias("category_id")).distinct()
    known = live.join(chosen, "category_id", "left_semi")
    found = crumbs.join(known, "request_target").groupBy("entity_source_id", "category_id").agg(F.min("place").alias("place"))
    # As many categories as the page has crumbs.
    own = found.groupBy("entity_source_id").agg(F.array_sort(F.collect_list(F.struct("place", "category_id"))).alias("chain"))
    # The path's ancestors are an equi-join key each: /a/b/c has /a/b/, /a/b, /a/, /a.
    path = urls.path_of(F.col("request_target"))
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    above = routes.select("entity_source_id", F.explode(F.array_distinct(F.flatten(F.transform(upto, lambda p: F.array(p, F.concat(p, F.lit("/"))))))).alias("ancestor")).filter("ancestor <> '/'")
    nearest = above.join(known.withColumnRenamed("request_target", "ancestor"), "ancestor").filter("category_id <> entity_source_id")
    nearest = nearest.groupBy("entity_source_id").agg(F.max_by("category_id", F.struct(F.length("ancestor"), "ancestor")).alias("nearest"))
    rows = routes.select("entity_source_id").distinct().join(own.hint("merge"), "entity_source_id", "left").join(nearest.hint("merge"), "entity_source_id", "left")
    ids = F.transform(F.coalesce("chain", F.array().cast(own.schema["chain"].dataType)), lambda c: c["category_id"])
    return rows.select("entity_source_id", ids.alias("category_ids"), F.coalesce(F.get(ids, F.size(ids) - 1), F.col("nearest")).alias("category"))


def snapshot_items(entities: DataFrame, routes: DataFrame, commerce: DataFrame, crumbs: DataFrame, attributes: DataFrame, prices: DataFrame, images: DataFrame) -> DataFrame:
    """id, title, request_target, page_kind, is_product, category_ids, attributes, prices, thumbnail, blockers, errors: an item for each entity.

    entities: source_id, source_url, title. routes: request_target, entity_source_id, expected_status. commerce: entity_source_id,
    source_url, request_target, page_kind (null: not observed). crumbs: entity_source_id, place, request_target. attributes:
    entity_source_id, name, value. prices: entity_source_id, ord, minor. images: entity_source_id, ord, public_path (of verified images).
    An entity without a live route, with two commerce rows, or with a commerce row of another page is an error of its row.
    """
    live = routes.filter("expected_status = 200").select("request_target", "entity_source_id")
    first = live.groupBy("entity_source_id").agg(F.min("request_target").alias("own_target"))
    mine = commerce.groupBy("entity_source_id").agg(F.count("*").alias("n"), F.min(F.struct("request_target", "source_url", "page_kind")).alias("c"))
    bound = mine.select("entity_source_id", "n", "c.request_target", F.col("c.source_url").alias("seen_url"), "c.page_kind")
    routed = bound.join(live.withColumn("live", F.lit(True)), ["entity_source_id", "request_target"], "left").select("entity_source_id", "n", F.col("request_target").alias("seen_target"), "seen_url", "page_kind", F.coalesce("live", F.lit(False)).alias("live"))
    in_order = lambda df, *cols: df.groupBy("entity_source_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("all"))  # noqa: E731 - as many as the page shows
    shown = F.trim(F.coalesce("value", F.lit(""))) != ""
    named = in_order(attributes.filter(shown).dropDuplicates(["entity_source_id", "name"]), "name", "value").select("entity_source_id", F.map_from_entries("all").alias("attributes"))
    priced = in_order(prices, "ord", "minor").select("entity_source_id", F.transform("all", lambda p: p["minor"]).alias("prices"))
    photo = images.filter("public_path is not null").groupBy("entity_source_id").agg(F.min_by("public_path", F.struct("ord", "public_path")).alias("thumbnail"))
    category = categories_of(crumbs, live, commerce.select("entity_source_id", "page_kind")).select("entity_source_id", "category_ids")
    rows = entities.withColumnRenamed("source_id", "entity_source_id")
    for part in (first, routed, named, priced, photo, category):
        rows = rows.join(part, "entity_source_id", "left")
    observed = F.col("n").isNotNull()
    errors = compact(
        F.when(F.col("own_target").isNull(), F.lit("ENTITY_ROUTE_MISSING")),
        F.when(F.col("n") > 1, F.lit("DUPLICATE_COMMERCE")),
        F.when(observed & (~F.col("live") | ~F.col("seen_url").eqNullSafe(F.col("source_url"))), F.lit("COMMERCE_BINDING")),
    )
    kind = F.coalesce("page_kind", F.lit("UNKNOWN"))
    return rows.select(
        F.col("entity_source_id").alias("id"),
        "title",
        F.when(observed & F.col("live"), F.col("seen_target")).otherwise(F.col("own_target")).alias("request_target"),
        kind.alias("page_kind"),
        (kind == "PRODUCT").alias("is_product"),
        F.coalesce("category_ids", F.array().cast(category.schema["category_ids"].dataType)).alias("category_ids"),
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        F.coalesce("prices", F.array().cast("array<bigint>")).alias("prices"),
        "thumbnail",
        F.when(~observed, F.array(F.lit("COMMERCE_NOT_OBSERVED"))).otherwise(F.array().cast("array<string>")).alias("blockers"),
        errors.alias("errors"),
    )


def tiles(links: DataFrame) -> DataFrame:
    """All category tiles of each page, numbered from 1: named linked images of the page's own origin, none below another tile's path.

    links: page, page_url, ord, label, url (absolute), image (absolute, null without one). A label has 3 to 75
    characters and does not advertise; of equal URLs the first counts. The prefix test is an equi-join: each URL is
    expanded to what stands before each of its slashes.
    """
    from pyspark.sql import Window

    http = r"(?i)^https?://"
    own = F.coalesce((urls.origin_of(F.col("url")) == urls.origin_of(F.col("page_url"))) & (F.col("url") != F.col("page_url")), F.lit(False))
    fine = links.filter(own & F.coalesce(F.col("image").rlike(http), F.lit(False)) & F.length("label").between(3, 75) & ~F.col("label").rlike(PROMOTION))
    firsts = fine.groupBy("page", "url").agg(F.min_by(F.struct("label", "image"), "ord").alias("first"), F.min("ord").alias("ord"))
    parts = F.split("url", "/")  # scheme, nothing, host, ...
    before = F.when(F.size(parts) > 3, F.transform(F.sequence(F.lit(3), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))).otherwise(F.array().cast("array<string>"))
    below = firsts.select("page", "url", F.explode(before).alias("prefix"))
    roots = firsts.select("page", F.regexp_replace("url", "/$", "").alias("prefix"), F.col("url").alias("root"))
    under = below.join(roots.hint("merge"), ["page", "prefix"]).filter("url != root").select("page", "url").distinct()
    kept = firsts.join(under.hint("merge"), ["page", "url"], "left_anti").select("page", "ord", "first.label", "url", "first.image")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("ord")))


def tile_issues(pages: DataFrame, tiles_: DataFrame, shown: DataFrame) -> DataFrame:
    """page, issue: a page that promises a catalog but has under three tiles, and tiles that the built page lost.

    pages: page, catalog_expected. tiles_: page, url. shown: page, url, has_image of the cards that were built.
    """
    found = tiles_.groupBy("page").agg(F.count("*").alias("tiles"))
    lost = tiles_.select("page", "url").join(shown.select("page", "url"), ["page", "url"], "left_anti").select("page").distinct().withColumn("lost", F.lit(True))
    images = shown.groupBy("page").agg(F.count_if("has_image").alias("images"))
    rows = pages.join(found, "page", "left").join(lost, "page", "left").join(images, "page", "left")
    n = F.coalesce("tiles", F.lit(0))
    issues = compact(
        F.when(F.col("catalog_expected") & (n < 3), F.lit("HTML_CATALOG_STRUCTURE_MISSING")),
        F.when(F.coalesce("lost", F.lit(False)), F.lit("CATALOG_COVERAGE_LOST")),
        F.when(F.coalesce("images", F.lit(0)) < F.least(n, F.lit(3)), F.lit("CATALOG_IMAGES_MISSING")),
    )
    return rows.select("page", F.explode(issues).alias("issue"))


def coverage(entities: DataFrame, facts: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED_FIELDS) -> DataFrame:
    """type, name, entities, observed: how many entities of a type have each field that the type requires."""
    pairs = F.create_map(*[x for k, names in required.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    wanted = entities.select("source_id", "type", F.explode(F.try_element_at(pairs, F.col("type"))).alias("name"))
    seen = facts.filter("status = 'OBSERVED'").select("source_id", "name").distinct().withColumn("seen", F.lit(1))
    return wanted.join(seen, ["source_id", "name"], "left").groupBy("type", "name").agg(F.count("*").alias("entities"), F.count("seen").alias("observed"))


#: Fields that a type has to have where its source shows them, as (rule, what the source shows, the field).
CONDITIONAL_FIELDS = {
    "Page": (("images-if-observed", "images", "images"),),
    "Product": (("observed-prices", "prices", "prices"), ("observed-offers", "offers", "offers"), ("observed-specifications", "specifications", "specifications"), ("observed-media", "media", "media")),
    "Article": (("observed-author", "author", "author"), ("observed-publication-date", "publication-date", "publication_date")),
    "Service": (("observed-prices", "prices", "prices"),),
}


def shown_by_source(parsed: DataFrame, key: str = "source_id") -> DataFrame:
    """key, shown: what each parsed page shows of that which a field may depend on."""
    any_node = lambda test: F.exists("parse.ld", lambda n: F.coalesce(test(n), F.lit(False)))
    has = {
        "images": F.exists("parse.ordered", lambda b: b["type"] == "image"),
        "media": F.size("parse.media") > 0,
        "prices": F.size("parse.prices") > 0,
        "offers": any_node(lambda n: F.size(n["offers"]) > 0),
        "specifications": F.size("parse.attributes") > 0,
        "author": any_node(lambda n: n["author"] != ""),
        "publication-date": any_node(lambda n: n["date_published"] != ""),
    }
    return parsed.select(key, F.explode(compact(*[F.when(c, F.lit(k)) for k, c in has.items()])).alias("shown"))


def conditional_coverage(entities: DataFrame, facts: DataFrame, shown: DataFrame, rules: dict = CONDITIONAL_FIELDS) -> DataFrame:
    """type, rule, applies, covered: of the entities whose source shows something, how many have the field for it.

    entities: source_id, type; facts: source_id, name, status; shown: source_id, shown. A rule without a case gives a row of 0.
    """
    spark = entities.sparkSession
    triples = spark.createDataFrame([(kind, *rule) for kind, own in rules.items() for rule in own], "type string, rule string, shown string, name string")
    cases = entities.select("source_id", "type").join(F.broadcast(triples), "type").join(shown.distinct().hint("merge"), ["source_id", "shown"])
    have = facts.filter("status = 'OBSERVED'").select("source_id", "name").distinct().withColumn("have", F.lit(1))
    counts = cases.join(have.hint("merge"), ["source_id", "name"], "left").groupBy("type", "rule").agg(F.count("*").alias("applies"), F.count("have").alias("covered"))
    all_rules = triples.select("type", "rule").distinct().join(counts, ["type", "rule"], "left")
    return all_rules.select("type", "rule", F.coalesce("applies", F.lit(0)).alias("applies"), F.coalesce("covered", F.lit(0)).alias("covered"))


def caps(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """key, n, verdict of each key: WITHIN, or OVER if it has more rows than the cap. Nothing is cut."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("verdict", F.when(F.col("n") > cap, "OVER").otherwise("WITHIN"))


def within_caps(rows: DataFrame, key: str, cap: int, what: str) -> DataFrame:
    """Counts by key; more than the cap fails the job instead of being cut."""
    over = F.col("verdict") == "OVER"
    return caps(rows, key, cap).select(key, F.when(over, F.raise_error(F.lit(f"more than {cap} {what}")).cast("long")).otherwise(F.col("n")).alias("n"))
