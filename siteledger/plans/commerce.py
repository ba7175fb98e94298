"""Queries over parts, orders and events: money, prices, catalog, carts, imports, journals and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteledger.functions import http, money
from siteledger.operators import cart, catalog, common, importing, journal, queue, registry, reports, routes, search, verify
from siteledger.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


AMOUNT = "CAST(round(p_retailprice * 100) AS BIGINT)"
TEXT = "CAST({0} // 100 AS VARCHAR) || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"


def _priced(parts):
    """Parts with their price as exact cents and as text."""
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    text = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return parts.withColumn("cents", cents).withColumn("amount", text)


def _parts(spark, d):
    return _priced(t(spark, d, "part"))


@query(
    """WITH o AS (SELECT event_id, user_id % 256 AS a, event_id % 256 AS b, event_id // 256 % 120 AS c FROM events), n AS (SELECT *, a * 65536 + b * 256 + c AS net FROM o)
    SELECT event_id, a, b, c, NOT (a IN (0, 10, 127) OR a >= 224 OR net BETWEEN 100 * 65536 + 64 * 256 AND 100 * 65536 + 127 * 256 + 255 OR net // 256 IN (169 * 256 + 254, 192 * 256 + 168, 198 * 256 + 18, 198 * 256 + 19)
        OR net // 256 BETWEEN 172 * 256 + 16 AND 172 * 256 + 31 OR net IN (192 * 65536, 192 * 65536 + 2, 198 * 65536 + 51 * 256 + 100, 203 * 65536 + 113)) AS public FROM n"""
)
def u2_public_ipv4(spark, d):
    a, b, c = F.col("user_id") % 256, F.col("event_id") % 256, F.floor(F.col("event_id") / 256) % 120
    ip = F.concat_ws(".", a, b, c, F.lit(9))
    return t(spark, d, "events").select("event_id", a.alias("a"), b.alias("b"), c.alias("c"), http.public_ipv4(ip).alias("public"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'text/html' WHEN 'view' THEN 'application/octet-stream' ELSE lower(event_type) || '/x' END AS mime, count(*) AS n FROM events GROUP BY 1, 2")
def u14_mime_normalisation(spark, d):
    e = t(spark, d, "events")
    raw = F.when(e.event_type == "click", F.lit(" Text/HTML ; charset=utf-8")).when(e.event_type == "view", F.lit(" ")).otherwise(F.concat(F.upper("event_type"), F.lit("/X;q=1")))
    return e.groupBy("event_type", http.mime_of(raw).alias("mime")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf' END AS mime FROM events")
def u13_mime_sniff(spark, d):
    m = F.col("event_id") % 4
    head = F.when(m == 0, "89504E470D0A1A0A").when(m == 1, "FFD8FFE0").when(m == 2, "255044462D312E37").otherwise("00")
    return t(spark, d, "events").select("event_id", http.sniff_mime(F.unhex(F.concat(head, F.hex(F.col("event_id").cast("string"))))).alias("mime"))


CANON = "regexp_replace(regexp_replace({0}, '0+$', ''), '\\.$', '')"


@query(f"WITH p AS (SELECT p_partkey, {TEXT.format(AMOUNT)} AS a, p_size FROM part) SELECT p_partkey, {CANON.format('a')} AS exact, CASE WHEN p_size % 3 = 0 THEN NULL ELSE {CANON.format('a')} END AS grouped FROM p")
def c1_decimals(spark, d):
    p = _parts(spark, d)
    whole, part = F.substring_index("amount", ".", 1), F.substring_index("amount", ".", -1)
    spaced = F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", " "), F.lit(","), part)
    odd = F.concat(F.lit("1 "), spaced, F.lit("-"))
    return p.select("p_partkey", money.commerce_decimal(F.col("amount")).alias("exact"), money.commerce_decimal(F.when(F.col("p_size") % 3 == 0, odd).otherwise(spaced)).alias("grouped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 0 AND l_quantity <= 1000000 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '.5' ELSE '' END END AS quantity FROM lineitem")
def c2_quantities(spark, d):
    text = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".50").otherwise(".000"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money.quantity(text).alias("quantity"))


CUR = "CASE p_size % 4 WHEN 0 THEN 'RUB' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' ELSE 'CHF' END"


@query(f"WITH p AS (SELECT p_partkey, {AMOUNT} AS cents, {TEXT.format(AMOUNT)} AS a, {CUR} AS currency FROM part), m AS (SELECT *, {CANON.format('a')} AS decimal FROM p) SELECT p_partkey, CASE WHEN currency = 'JPY' AND (cents % 100 <> 0 OR true) THEN NULL ELSE currency END AS currency, CASE WHEN currency <> 'JPY' THEN decimal END AS decimal, CASE WHEN currency IN ('RUB', 'USD') THEN cents END AS minor FROM m")
def c3_money(spark, d):
    p = _parts(spark, d)
    m = F.col("p_size") % 4
    value = money.money(F.col("amount"), F.when(m == 0, "RUB").when(m == 1, "USD").when(m == 2, "JPY").otherwise("CHF"))
    return p.select("p_partkey", value["currency"].alias("currency"), value["decimal"].alias("decimal"), value["minor"].alias("minor"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'RUB' WHEN 1 THEN 'USD' WHEN 2 THEN NULL ELSE 'EUR' END AS currency, CASE p_size % 3 WHEN 0 THEN 'piece' WHEN 1 THEN 'm2' END AS unit FROM part")
def c4_c5_currency_and_unit(spark, d):
    p = _parts(spark, d)
    m, u = F.col("p_size") % 4, F.col("p_size") % 3
    currency = F.when(m == 0, " руб.").when(m == 1, " USD").when(m == 2, " RUB или 5 EUR").otherwise(" €")
    text = F.concat(F.col("amount"), currency, F.when(u == 0, " за шт.").when(u == 1, " / м²").otherwise(""))
    return p.select("p_partkey", money.currency_in(text).alias("currency"), money.unit_in(text).alias("unit"))


def _price_texts(spark, d):
    p = _priced(common.dealt(t(spark, d, "part"), "p_partkey"))
    k = F.col("p_size") % 5
    text = F.when(k == 0, F.concat("amount", F.lit(" RUB/шт."))).when(k == 1, F.concat(F.lit("от "), F.col("amount"), F.lit(" RUB / м²"))).when(k == 2, F.concat("amount", F.lit(" RUB – 99999.00 RUB"))).when(k == 3, F.concat("amount", F.lit(" RUB/шт. по акции"))).otherwise(F.concat(F.lit("-"), F.col("amount"), F.lit(" RUB/шт.")))
    none = F.lit(None).cast("string")
    return money.with_price(p.select("p_partkey", "p_size", "cents", text.alias("text")), F.col("text"), F.lit("CURRENT"), none, none, none, F.array().cast("array<string>"))


@query(
    f"""SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'FROM' WHEN 2 THEN 'RANGE' ELSE 'CURRENT' END AS role, CASE WHEN p_size % 5 = 4 THEN 'REQUIRES_REVIEW' ELSE 'OBSERVED' END AS status,
    CASE WHEN p_size % 5 <> 4 THEN {AMOUNT} END AS minor, CASE WHEN p_size % 5 = 2 THEN 9999900 END::BIGINT AS maximum, CASE WHEN p_size % 5 IN (0, 3, 4) THEN 'piece' WHEN p_size % 5 = 1 THEN 'm2' END AS unit, p_size % 5 = 0 AS eligible FROM part"""
)
def c6_price_texts(spark, d):
    p = F.col("price")
    return _price_texts(spark, d).select("p_partkey", p["role"].alias("role"), p["status"].alias("status"), p["money"]["minor"].alias("minor"), p["maximum"]["minor"].alias("maximum"), p["unit"].alias("unit"), p["totals_eligible"].alias("eligible"))


@query("WITH c AS (SELECT l_orderkey, count(DISTINCT trim(l_returnflag)) AS n, min(trim(l_returnflag)) AS one FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN n = 1 THEN one END AS value, CASE WHEN n = 1 THEN 'OBSERVED' WHEN n > 1 THEN 'REQUIRES_REVIEW' ELSE 'UNKNOWN' END AS status FROM c")
def c10_unique_facts(spark, d):
    return catalog.unique_facts(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query(f"SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN 'PRICE_NOT_UNCONDITIONAL_CURRENT' WHEN p_size % 2 = 1 THEN 'QUANTITY_CONSTRAINTS_INCONSISTENT' END AS first_blocker FROM part")
def j16_exact_price(spark, d):
    rows = _price_texts(spark, d)
    page = F.concat(F.lit("https://shop.example/"), F.col("p_partkey").cast("string"))
    p = F.col("price")
    price = F.struct(p["role"].alias("role"), p["status"].alias("status"), p["money"]["decimal"].alias("decimal"), p["money"]["currency"].alias("currency"), p["money"]["minor"].alias("minor"), p["unit"].alias("unit"), p["maximum"].alias("maximum"), p["conditions"].alias("conditions"), p["totals_eligible"].alias("eligible"), page.alias("source_url"))
    purchase = F.struct(F.when(F.col("p_size") % 2 == 1, "0.75").otherwise("1").alias("min_quantity"), F.lit("0.5").alias("quantity_step"), F.lit("10").alias("max_quantity"), page.alias("source_url"), F.array().cast("array<string>").alias("blockers"))
    blockers = catalog.exact_price_blockers(price, purchase, page)
    return rows.select("p_partkey", F.try_element_at(blockers, F.lit(1)).alias("first_blocker"))


@query(
    f"""WITH l AS (SELECT o.o_custkey AS session, {AMOUNT} AS minor, CAST(l_quantity * 1000000 AS BIGINT) AS q, CASE WHEN p_size % 7 = 0 THEN 'USD' ELSE 'RUB' END AS currency FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey WHERE o.o_orderkey % 20 = 0)
    SELECT session, count(*) AS lines, count(DISTINCT currency) AS currencies, CASE WHEN count(DISTINCT currency) = 1 THEN sum((minor * q + 500000) // 1000000)::BIGINT END AS total_minor, CASE WHEN count(DISTINCT currency) = 1 THEN 'CALCULATED_FROM_OBSERVED_FACTS' ELSE 'REQUIRES_CONFIRMATION' END AS pricing_status FROM l GROUP BY session"""
)
def w7_cart_view(spark, d):
    o = t(spark, d, "orders").filter("o_orderkey % 20 = 0").select("o_orderkey", F.col("o_custkey").alias("session"))
    lines = t(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("session", F.col("l_partkey").alias("item_id"), F.lit(None).cast("string").alias("variant_id"), (F.col("l_quantity") * 1_000_000).cast("bigint").alias("quantity"))
    none = F.lit(None).cast("bigint")
    prices = _parts(spark, d).select(F.col("p_partkey").alias("item_id"), F.lit(None).cast("string").alias("variant_id"), F.col("cents").alias("minor"), F.when(F.col("p_size") % 7 == 0, "USD").otherwise("RUB").alias("currency"), F.lit("piece").alias("unit"), none.alias("low"), none.alias("high"), none.alias("step"), F.array().cast("array<string>").alias("reasons"))
    return cart.cart_view(cart.line_view(lines, prices))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 2 THEN 'QUANTITY_BELOW_MINIMUM' WHEN l_quantity > 40 THEN 'QUANTITY_ABOVE_MAXIMUM' WHEN (CAST(l_quantity AS BIGINT) - 2) % 3 <> 0 THEN 'QUANTITY_STEP_MISMATCH' END AS error FROM lineitem")
def w4_quantity_errors(spark, d):
    q = (F.col("l_quantity") * cart.SCALE).cast("bigint")
    unit = lambda n: F.lit(n * cart.SCALE)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cart.quantity_error(q, unit(2), unit(40), unit(3)).alias("error"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'PRICE_UNKNOWN_OR_AMBIGUOUS' WHEN p_size % 3 = 0 THEN 'UNIT_UNKNOWN' END AS reason FROM part")
def w3_pricing_reasons(spark, d):
    none = F.array().cast("array<string>")
    one = F.lit(1_000_000)
    reasons = cart.pricing_reasons(none, F.when(F.col("p_size") % 2 == 0, 2).otherwise(1), F.lit(True), F.lit(True), F.when(F.col("p_size") % 3 == 0, " ").otherwise("piece"), one, one, one, F.lit(False))
    return t(spark, d, "part").select("p_partkey", F.try_element_at(reasons, F.lit(1)).alias("reason"))


def _items(spark, d):
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("body_text"), (F.col("p_size") % 2 == 0).alias("is_product"), F.array("p_brand").alias("category_ids"), F.create_map(F.lit("brand"), F.array("p_brand"), F.lit("type"), F.array("p_type")).alias("attributes"), F.when(F.col("p_size") % 3 != 0, F.col("cents")).alias("price_minor"), F.lit("RUB").alias("currency"), F.lit("piece").alias("unit"))


@query("WITH s AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN contains(lower(p_name), 'ring') THEN 10 ELSE 1 END + CASE WHEN contains(lower(p_name), 'brand') THEN 10 ELSE 1 END AS score FROM part WHERE contains(lower(p_name || chr(10) || p_brand || ' ' || p_type), 'ring') AND contains(lower(p_name || chr(10) || p_brand || ' ' || p_type), 'brand') AND p_size % 2 = 0) SELECT id, title, score, (SELECT count(*) FROM s) AS total FROM s ORDER BY score DESC, lower(title), id LIMIT 20")
def w5_search(spark, d):
    found = search.matches(_items(spark, d), "Ring  brand", products_only=True)
    return search.page(found, "relevance", 1, 20).select("id", "title", "score", "total")


@query(f"SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN {AMOUNT} END AS price_minor, (SELECT count(*) FROM part) AS total FROM part ORDER BY price_minor DESC NULLS LAST, lower(p_name), p_partkey LIMIT 50")
def w6_search_by_price(spark, d):
    return search.page(search.matches(_items(spark, d), ""), "price_desc", 1, 50).select("id", "price_minor", "total")


@query("WITH a AS (SELECT 'brand' AS name, p_brand AS value FROM part UNION ALL SELECT 'type', p_type FROM part), c AS (SELECT name, value, count(*) AS items FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value) AS n, count(*) OVER (PARTITION BY name) AS k FROM c) SELECT name, value, items, k > 10 AS limited FROM r WHERE n <= 10")
def a10_facets(spark, d):
    return search.facets(_items(spark, d), 20, 10)


def _import(spark, d):
    """Parts as desired state; current and mapped copies differ by key."""
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entity_key"), F.col("p_partkey").alias("k"), F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("managed_hash"))
    m = F.col("k") % 10
    old = F.sha2(F.concat(F.lit("old"), F.col("entity_key")), 256)
    current = p.filter(m != 0).select("entity_key", F.col("k").alias("id"), F.when(m.isin(1, 2), old).when(m == 3, F.sha2(F.lit("edited"), 256)).otherwise(F.col("managed_hash")).alias("managed_hash"))
    mapped = p.filter(~m.isin(0, 4)).select("entity_key", F.when(m == 5, F.col("k") + 1).otherwise(F.col("k")).alias("target_id"), F.when(m.isin(1, 3), old).when(m == 2, F.sha2(F.lit("other"), 256)).otherwise(F.col("managed_hash")).alias("managed_hash"))
    return p.select("entity_key", "managed_hash"), current, mapped


ACTION = "CASE p_partkey % 10 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' WHEN 2 THEN 'USER_EDIT_CONFLICT' WHEN 3 THEN 'USER_EDIT_CONFLICT' WHEN 4 THEN 'reconciled' WHEN 5 THEN 'MAPPING_DRIFT' ELSE 'skipped' END"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS entity_key, {ACTION} AS action FROM part")
def j10_import_plan(spark, d):
    return importing.plan(*_import(spark, d)).select("entity_key", "action")


@query(f"SELECT {ACTION} AS action, count(*) AS n FROM part GROUP BY 1")
def a7_import_summary(spark, d):
    return importing.summary(importing.plan(*_import(spark, d)))


@query("SELECT CAST(p_partkey AS VARCHAR) AS entity_key, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey END AS target_id, sha256(p_name || '|' || p_brand) AS managed_hash FROM part WHERE p_partkey % 10 NOT IN (2, 3, 5)")
def j11_import_apply(spark, d):
    desired, current, mapped = _import(spark, d)
    fine = ~(F.col("entity_key").cast("bigint") % 10).isin(2, 3, 5)
    desired, current, mapped = (x.filter(fine) for x in (desired, current, mapped))
    operations = spark.createDataFrame([], "operation_key string, package_hash string, entity_key string, result string")
    return importing.apply(importing.plan(desired, current, mapped), mapped, operations, "package")[0]


@query(
    """WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey % 10 AS m FROM part) SELECT 'entity' AS kind, key, 'ENTITY_MISSING' AS reason FROM m WHERE m = 0 UNION ALL SELECT 'entity', key, 'ENTITY_CHANGED' FROM m WHERE m IN (1, 2, 3)
    UNION ALL SELECT 'entity', key, 'MAPPING_MISSING' FROM m WHERE m IN (0, 4) UNION ALL SELECT 'entity', key, 'MAPPING_DRIFT' FROM m WHERE m = 5 UNION ALL SELECT 'entity', key, 'MAPPING_HASH_STALE' FROM m WHERE m IN (1, 2, 3)
    UNION ALL SELECT 'asset', sha256(key), 'ASSET_MISSING' FROM m WHERE m = 6 UNION ALL SELECT 'asset', sha256(key), 'FILE_UNREFERENCED' FROM m WHERE m = 7"""
)
def j12_reconcile(spark, d):
    desired, current, mapped = _import(spark, d)
    route = desired.select(F.sha2("entity_key", 256).alias("route_key"), F.lit(200).alias("status"), "entity_key", F.lit(None).cast("string").alias("redirect_target"))
    m = F.col("entity_key").cast("bigint") % 10
    sums = desired.select(F.sha2("entity_key", 256).alias("sha256"), m.alias("m"))
    return importing.reconcile(desired, current, mapped, route, route, sums.filter("m <> 7").select("sha256"), sums.filter("m <> 6").select("sha256"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_key, CASE p_partkey % 8 WHEN 0 THEN 'created' WHEN 1 THEN 'UNOWNED_DATA_CONFLICT' WHEN 2 THEN 'PENDING_INTENT_CONFLICT' WHEN 3 THEN 'reconciled' WHEN 4 THEN 'recovered-before-write' WHEN 5 THEN 'skipped' WHEN 6 THEN 'updated' ELSE 'USER_EDIT_CONFLICT' END AS action FROM part")
def j13_catalog_plan(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_key"), (F.col("p_partkey") % 8).alias("m"))
    m = F.col("m")
    desired = p.select("item_key", F.lit("in").alias("input_hash"), F.lit("after").alias("after_hash"))
    current = p.filter("m <> 0").select("item_key", F.when(m.isin(3, 5, 6), "after").when(m == 4, "before").otherwise("edited").alias("hash"))
    records = p.filter("m >= 2").select("item_key", F.when(m.isin(2, 3, 4), "PENDING").otherwise("COMMITTED").alias("state"), F.when(m.isin(2, 6), "else").otherwise("in").alias("input_hash"), F.lit("before").alias("before_hash"), F.lit("after").alias("after_hash"), F.lit(True).alias("recoverable"))
    return importing.catalog_plan(desired, current, records)


@query("SELECT 'p' AS project, p_brand AS type, CAST(p_partkey AS VARCHAR) AS source_id, CASE p_partkey % 5 WHEN 2 THEN 'edited' ELSE p_name END AS fields, CASE p_partkey % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'skipped' WHEN 2 THEN 'conflict' WHEN 3 THEN 'updated' ELSE 'kept' END AS action FROM part")
def j27_keyed_upsert(spark, d):
    p = t(spark, d, "part").select(F.lit("p").alias("project"), F.col("p_brand").alias("type"), F.col("p_partkey").cast("string").alias("source_id"), (F.col("p_partkey") % 5).alias("m"), "p_name")
    m = F.col("m")
    stored = p.filter("m <> 0").select("project", "type", "source_id", F.when(m == 2, "edited").when(m == 3, "old").otherwise(F.col("p_name")).alias("fields"), F.when(m == 3, "old").otherwise(F.col("p_name")).alias("baseline"))
    return importing.upsert(stored, p.filter("m <> 4").select("project", "type", "source_id", F.col("p_name").alias("fields"))).drop("baseline")


@query("SELECT CAST(p_partkey AS VARCHAR) AS request_target, 200 AS status, CASE WHEN p_partkey % 3 = 0 THEN 'Y' END AS active FROM part WHERE p_partkey % 2 = 0")
def j18_resolve_routes(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("request_target"), "p_partkey")
    stored = p.filter("p_partkey % 2 = 0").select(F.sha2("request_target", 256).alias("route_key"), "request_target", F.lit(200).alias("status"), F.lit(None).cast("string").alias("redirect_target"), F.col("request_target").alias("entity_key"))
    entities = p.filter("p_partkey % 3 = 0").select(F.col("request_target").alias("entity_key"), F.lit("Y").alias("active"))
    return routes.resolve(p, stored, entities).select("request_target", "status", "active")


@query("WITH f AS (SELECT p_partkey, p_name FROM part ORDER BY lpad(CAST(p_partkey AS VARCHAR), 9, '0') LIMIT 50) SELECT '/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS request_target, p_name AS title FROM f WHERE p_partkey % 3 = 0")
def j19_fallback_navigation(spark, d):
    p = t(spark, d, "part").withColumn("k", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    stored = p.select(F.concat(F.lit("/"), F.col("k")).alias("request_target"), F.lit(200).alias("status"), F.col("k").alias("entity_key"))
    entities = p.select(F.col("k").alias("entity_key"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, "Y").otherwise("N").alias("active"))
    return routes.fallback_navigation(stored, entities, 50)


@query("SELECT o_orderkey AS crawl_key, CASE WHEN o_orderkey % 6 = 0 THEN 'FAIL' WHEN o_orderkey % 6 = 1 THEN 'NOT_RUN' WHEN o_orderkey % 6 IN (2, 3) THEN 'FAIL' ELSE 'PASS' END AS status, CASE o_orderkey % 6 WHEN 0 THEN 'ROUTE_MISSING' WHEN 1 THEN 'NOT_RUN' WHEN 2 THEN 'STATUS_MISMATCH' WHEN 3 THEN 'TITLE_MISMATCH' END AS reason FROM orders")
def j21_verify_routes(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("crawl_key"), (F.col("o_orderkey") % 6).alias("m"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("text"))
    m, target = F.col("m"), F.concat(F.lit("/"), F.col("crawl_key").cast("string"))
    r = o.filter("m <> 0").select(F.col("crawl_key").alias("source_url"), target.alias("target_route"), F.lit(200).alias("expected_status"), F.lit(None).cast("string").alias("redirect_to"), F.col("crawl_key").alias("entity_source_id"))
    got = o.filter("m > 1").select(target.alias("target"), F.when(m == 2, 500).otherwise(200).alias("status"), F.lit(None).cast("string").alias("location"), F.when(m == 3, "other").otherwise(F.concat(F.lit(" "), F.col("title"))).alias("title"), F.concat(F.lit("text: "), F.col("text")).alias("main_text"))
    return verify.verify_routes(o, r, got, o.select(F.col("crawl_key").alias("source_id"), "title", "text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 9 WHEN 0 THEN 'NOT_SERVED' WHEN 1 THEN 'STATUS' WHEN 2 THEN 'HASH' ELSE 'UNEXPECTED' END AS reason FROM part WHERE p_partkey % 9 <= 3")
def j23_media_acceptance(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % 9).alias("m"), F.sha2("p_name", 256).alias("sha256"))
    m = F.col("m")
    return verify.media_acceptance(p.filter("m <> 3").select("path", "sha256"), p.filter("m <> 0").select("path", F.when(m == 1, 404).otherwise(200).alias("status"), F.when(m == 2, "x").otherwise(F.col("sha256")).alias("sha256")))


@query("WITH a AS (SELECT p_brand, p_type FROM part), b AS (SELECT p_brand, CASE WHEN p_partkey % 50 = 0 THEN 'NEW' ELSE p_type END AS p_type FROM part), x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), y AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a) SELECT *, 'before' AS side FROM x UNION ALL SELECT *, 'after' FROM y")
def j24_changed_rows(spark, d):
    p = t(spark, d, "part")
    return verify.changed_rows(p.select("p_brand", "p_type"), p.select("p_brand", F.when(F.col("p_partkey") % 50 == 0, "NEW").otherwise(F.col("p_type")).alias("p_type")))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS value, max(event_id) AS sequence FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def w1_journal_replay(spark, d):
    changes = t(spark, d, "events").select("user_id", F.col("event_id").alias("sequence"), (F.col("event_type") != "error").alias("present"), F.col("event_type").alias("value"))
    return journal.replay(changes, ["user_id"])


@query(
    """WITH e AS (SELECT user_id AS generation, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, event_id FROM events), n AS (SELECT generation, max(sequence) AS n FROM e GROUP BY 1)
    SELECT e.generation, sequence, 'CHECKSUM_MISMATCH' AS reason FROM e WHERE event_id % 100 = 7"""
)
def w2_journal_audit(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("generation").orderBy("event_id")
    e = t(spark, d, "events").select(F.col("user_id").alias("generation"), "event_id", F.concat_ws("|", "event_type", F.col("event_id").cast("string")).alias("body")).withColumn("sequence", F.row_number().over(own).cast("bigint"))
    # A chain over every row: what a row hands on is the digest of its own body, so each can be made by itself.
    link = e.withColumn("mark", F.sha2("body", 256)).withColumn("previous", F.coalesce(F.lag("mark").over(own), F.lit("")))
    bad = F.col("event_id") % 100 == 7
    rows = link.select("generation", "sequence", "previous", F.col("mark").alias("checksum"), F.when(bad, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"))
    return journal.audit(rows, body_only=True)


@query("SELECT user_id AS url, arg_max(event_type, (ts, -event_id)) AS status, max(ts) AS observed_at FROM events GROUP BY user_id")
def r12_latest_observation(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("url"), F.col("ts").alias("observed_at"), F.col("event_id").alias("ord"), F.col("event_type").alias("status"))
    return registry.latest_observation(e).select("url", "status", "observed_at")


@query("WITH l AS (SELECT user_id AS url, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after, ts AS observed_at FROM events) SELECT * FROM l WHERE before <> after")
def r13_byte_changes(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("url"), F.col("event_type").alias("sha256"), F.col("ts").alias("observed_at"), F.col("event_id").alias("ord"))
    return registry.byte_changes(e)


@query("SELECT user_id AS url, arg_max(event_type, (ts, event_type, event_id)) AS status, max(ts) AS observed_at FROM events GROUP BY user_id")
def r18_latest_status(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("source_url"), F.col("ts").alias("observed_at"), F.col("event_type").alias("snapshot_sha256"), F.col("event_id").alias("input_id"), F.col("event_type").alias("status"))
    return queue.latest_status(e)


@query("SELECT CASE WHEN user_id % 20 = 0 THEN 'EXCLUDED' WHEN event_type = 'error' THEN 'FAILED' WHEN value > 200 THEN 'UNREACHABLE' WHEN value > 150 THEN 'REQUIRES_ACCESS' WHEN value > 100 THEN 'RATE_LIMITED' ELSE 'FETCHED' END AS status, count(*) AS n FROM events GROUP BY 1")
def r3_page_status(spark, d):
    code = F.when(F.col("value") > 200, 502).when(F.col("value") > 150, 403).when(F.col("value") > 100, 429).otherwise(404)
    status = registry.page_status(F.col("user_id") % 20 != 0, F.lit(False), code, F.lit(False), F.when(F.col("event_type") == "error", "timeout"))
    return t(spark, d, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS url, count(DISTINCT user_id) AS pages, CASE event_type WHEN 'click' THEN 'EXCLUDED' WHEN 'view' THEN 'EXCLUDED' WHEN 'error' THEN 'EXCLUDED' ELSE 'QUEUED' END AS status, CASE event_type WHEN 'click' THEN 'EXTERNAL' WHEN 'view' THEN 'ROBOTS' WHEN 'error' THEN 'UNSAFE_MIME' END AS reason FROM events GROUP BY 1")
def r2_asset_registry(spark, d):
    kind = F.col("event_type")
    rows = t(spark, d, "events").select(kind.alias("url"), F.col("user_id").alias("page_url"), F.when(kind == "click", "https://cdn.example").otherwise("https://shop.example").alias("origin"), (kind != "view").alias("allowed"), F.when(kind == "error", "image/svg+xml").otherwise("image/png").alias("mime"))
    return registry.asset_registry(rows, "https://shop.example")


OBSERVED = "CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 2 THEN 'DOM' WHEN max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 THEN 'SELECTED_FIELDS' ELSE 'UNOBSERVED' END"


def _inventory(spark, d):
    e = t(spark, d, "events")
    kind = F.col("event_type")
    return registry.capture_inventory(e.select(F.floor(F.col("event_id") / 3).cast("string").alias("crawl_key"), F.concat(F.lit("/"), F.col("user_id").cast("string")).alias("raw_url"), kind.alias("source"), F.when(kind == "purchase", "DOM").when(kind == "signup", "SELECTED_FIELDS").alias("observation")))


@query(f"SELECT CAST(event_id // 3 AS VARCHAR) AS crawl_key, count(DISTINCT user_id) AS spellings, count(DISTINCT event_type) AS sources, {OBSERVED} AS observation FROM events GROUP BY 1")
def r10_capture_inventory(spark, d):
    return _inventory(spark, d).select("crawl_key", "spellings", "sources", "observation")


@query(f"WITH i AS (SELECT event_id // 3 AS k, {OBSERVED} AS o FROM events GROUP BY 1) SELECT count(*) AS known, count(*) FILTER (o = 'UNOBSERVED') AS unobserved, count(*) FILTER (o = 'SELECTED_FIELDS') AS selected, count(*) FILTER (o = 'DOM') AS dom FROM i")
def a4_capture_coverage(spark, d):
    return reports.capture_coverage(_inventory(spark, d))


@query("SELECT DISTINCT event_id AS url FROM events WHERE event_id % 7 = 0")
def r11_missing_assets(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("url"))
    return registry.missing_assets(e, e.filter("url % 7 <> 0"))


@query("WITH c AS (SELECT user_id AS crawl_key, count(DISTINCT event_type) AS captures, count(*) FILTER (value > 50) AS verified_captures, max(ts) AS latest_capture FROM events GROUP BY 1) SELECT coalesce(c.crawl_key, k.c_custkey) AS crawl_key, coalesce(captures, 0) AS captures, coalesce(verified_captures, 0) AS verified_captures, latest_capture, coalesce(latest_capture < TIMESTAMP '2024-01-30', false) AND c_custkey IS NOT NULL AS stale FROM customer k FULL JOIN c ON c.crawl_key = k.c_custkey")
def r15_combined_registry(spark, d):
    crawl = t(spark, d, "customer").select(F.col("c_custkey").alias("crawl_key"), F.lit("FETCHED").alias("status"), F.lit("2024-01-30").cast("timestamp").alias("fetched_at"))
    captures = t(spark, d, "events").select(F.col("user_id").alias("crawl_key"), F.col("event_type").alias("capture_id"), (F.col("value") > 50).alias("verified"), F.col("ts").alias("observed_at"))
    return registry.combined_registry(crawl, captures).drop("crawl_status")


@query("WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 + 1 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 3 + 2 FROM part), v AS (SELECT p_partkey AS k, 0 AS level FROM part WHERE p_size = 1 UNION SELECT dst, level + 1 FROM v JOIN e ON v.k = e.src) SELECT k AS crawl_key, min(level) AS level FROM v GROUP BY k")
def r4_discovery_closure(spark, d):
    """From all parts of size 1, to the last page that links reach."""
    p = F.col("p_partkey")
    links = t(spark, d, "part").select(p.alias("src"), F.explode(F.array(p * 2 + 1, p * 3 + 2)).alias("dst"))
    seeds = t(spark, d, "part").filter("p_size = 1").select(p.alias("crawl_key"))
    return registry.discovery_closure(seeds, links, budget=None)


@query("WITH RECURSIVE h AS (SELECT p_partkey AS url, p_partkey AS cur, 0 AS hops FROM part UNION ALL SELECT url, cur // 4, hops + 1 FROM h WHERE cur % 4 = 0 AND cur > 0 AND hops < 5) SELECT 'https://a.example/' || url AS url, 'https://a.example/' || arg_max(cur, hops) AS final_url, max(hops) AS hops FROM h GROUP BY url")
def r6_redirects(spark, d):
    name = lambda c: F.concat(F.lit("https://a.example/"), c.cast("string"))
    p = F.col("p_partkey")
    hops = t(spark, d, "part").filter("p_partkey % 4 = 0 and p_partkey > 0").select(name(p).alias("url"), name(F.floor(p / 4)).alias("location"))
    return registry.resolve_redirects(t(spark, d, "part").select(name(p).alias("url")), hops).select("url", "final_url", "hops")


@query("SELECT '/' || p_partkey AS request_target, 'REDIRECT_LOOP' AS reason FROM part WHERE p_partkey % 10 IN (1, 2, 3) AND p_partkey + 3 < (SELECT count(*) FROM part) UNION ALL SELECT '/' || p_partkey, 'REDIRECT_TARGET_MISSING' FROM part WHERE p_partkey % 10 = 5 UNION ALL SELECT '/' || p_partkey, 'REDIRECT_TARGET_MISSING' FROM part WHERE p_partkey % 10 IN (1, 2, 3) AND NOT (p_partkey + 3 < (SELECT count(*) FROM part)) AND false")
def j7_redirect_graph(spark, d):
    p, m = F.col("p_partkey"), F.col("p_partkey") % 10
    name = lambda c: F.concat(F.lit("/"), c.cast("string"))
    to = F.when(m == 1, name(p + 1)).when(m == 2, name(p + 1)).when(m == 3, name(p - 2)).when(m == 4, name(p + 2)).when(m == 5, F.lit("/nowhere"))
    return registry.redirect_graph_defects(t(spark, d, "part").select(name(p).alias("request_target"), to.alias("redirect_to")))


@query("WITH r AS (SELECT event_type AS host, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT host, max(c) AS n, (SELECT median(value) FROM events e WHERE e.event_type = host) AS median, max(value) FILTER (n = (c * 95 + 99) // 100) AS p95, false AS success, max(value) FILTER (n = (c * 95 + 99) // 100) < 1000 AS within_bound FROM r GROUP BY host")
def a9_latency(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("host"), "value")
    return reports.latency(e, ["host"], "value", F.col("value") < 100)


@query("SELECT event_type AS note, min(event_id) AS first FROM events GROUP BY 1")
def a11_distinct_notes(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("note"), F.col("event_id").alias("ord"))
    return reports.distinct_notes(e.filter("ord % 2 = 0"), e.filter("ord % 2 = 1"))


@query("SELECT (SELECT count(*) FROM events) AS observations, count(*) AS assets, count(DISTINCT sha256(p_name)) AS asset_files, (SELECT sum(b)::BIGINT FROM (SELECT max(length(p_name)) AS b FROM part GROUP BY p_name)) AS bytes FROM part")
def a13_provenance(spark, d):
    return reports.provenance(t(spark, d, "events"), t(spark, d, "part").select(F.sha2("p_name", 256).alias("sha256"), F.length("p_name").cast("long").alias("size_bytes")))


@query(
    """WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'Page' WHEN 'view' THEN 'Article' WHEN 'error' THEN 'Service' ELSE 'Product' END AS type, value, user_id FROM events),
    w AS (SELECT *, unnest(CASE type WHEN 'Page' THEN ['source_id', 'source_url', 'title', 'blocks', 'seo', 'evidence'] WHEN 'Product' THEN ['source_id', 'source_url', 'title', 'evidence'] ELSE ['source_id', 'source_url', 'title', 'blocks', 'evidence'] END) AS name FROM e)
    SELECT type, name, count(*) AS entities, count(*) FILTER (CASE name WHEN 'title' THEN value > 50 WHEN 'blocks' THEN value > 25 WHEN 'seo' THEN user_id % 2 = 0 WHEN 'source_url' THEN value > 10 ELSE name = 'source_id' END) AS observed FROM w GROUP BY 1, 2"""
)
def a8_field_coverage(spark, d):
    kinds = {"click": "Page", "view": "Article", "error": "Service"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("Product"))
    e = t(spark, d, "events").select(F.col("event_id").alias("source_id"), kind.alias("type"), "value", "user_id")
    seen = {"source_id": F.lit(True), "title": F.col("value") > 50, "blocks": F.col("value") > 25, "seo": F.col("user_id") % 2 == 0, "source_url": F.col("value") > 10, "evidence": F.lit(False)}
    facts = e.select("source_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.when(c, "OBSERVED").otherwise("ABSENT").alias("status")) for n, c in seen.items()])).alias("f")).select("source_id", "f.*")
    return catalog.coverage(e, facts)


@query("SELECT user_id, count(*) AS checks, count(*) FILTER (event_type = 'error' AND value > 40 OR value > 300) = 0 AS ready FROM events GROUP BY 1")
def a6_readiness(spark, d):
    failed, unknown = (F.col("event_type") == "error") & (F.col("value") > 40), F.col("value") > 300
    status = F.when(unknown, F.lit(None).cast("string")).when(failed, "FAIL").otherwise("PASS")
    return verify.readiness(t(spark, d, "events").select("user_id", status.alias("status")), "user_id")


@query("SELECT event_type AS host, date_trunc('hour', ts) AS window_start, count(*) AS requests, sum(CAST(value * 1000 AS BIGINT))::BIGINT AS bytes, count(*) > 5 OR sum(CAST(value * 1000 AS BIGINT)) > 300000 AS over FROM events GROUP BY 1, 2")
def t4_request_pacing(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("host"), "ts", F.round(F.col("value") * 1000).cast("bigint").alias("bytes"))
    return jobs.request_pacing(e, "1 hour", most_requests=5, most_bytes=300_000)


@query("WITH f AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, first_value(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS first FROM events) SELECT user_id AS session, event_type AS idempotency_key, CASE WHEN n = 1 THEN 'APPLIED' WHEN value = first THEN 'REPLAYED' ELSE 'IDEMPOTENCY_CONFLICT' END AS outcome, count(*) AS n FROM f GROUP BY ALL")
def t2_idempotency(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("idempotency_key"), F.col("value").cast("string").alias("request_sha256"), "ts", F.col("event_id").alias("seq"))
    return cart.idempotency_outcomes(e).groupBy("session", "idempotency_key", "outcome").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT user_id AS session, event_type AS item_id, event_id, CAST(round(value) AS BIGINT) AS q FROM events WHERE event_type <> 'error'),
    r AS (SELECT user_id AS session, max(event_id) AS emptied FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT m.session, item_id, sum(q * 1000000)::BIGINT AS quantity FROM m LEFT JOIN r ON m.session = r.session WHERE q > 0 AND (item_id <> 'click' OR emptied IS NULL OR event_id > emptied) GROUP BY 1, 2"""
)
def w8_cart_fold(spark, d):
    """Every event adds its own type to the session's cart, but an error takes out all clicks."""
    e, out = t(spark, d, "events"), F.col("event_type") == "error"
    none = F.lit(None).cast("bigint")
    rows = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("idempotency_key"), F.when(out, "cart.remove").otherwise("cart.add").alias("action"), F.when(~out, F.col("event_type")).alias("item_id"), F.lit(None).cast("string").alias("variant_id"), F.when(out, F.lit("click\x1f")).alias("line_id"), (F.round("value").cast("bigint") * cart.SCALE).alias("quantity"), F.lit("x").alias("request_sha256"), none.alias("low"), none.alias("high"), none.alias("step"))
    return cart.fold(rows).select(F.col("session").cast("bigint").alias("session"), "item_id", "quantity")


@query("SELECT p_partkey AS entity_source_id, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_brand LIKE '%5' THEN 1 ELSE 2 END AS categories, sha256('product:' || p_partkey) AS product_key FROM part")
def j15_catalog_projection(spark, d):
    p = t(spark, d, "part")
    brands = p.select("p_brand").distinct()
    category_map = brands.select(F.col("p_brand").alias("category"), F.concat(F.lit("B/"), F.col("p_brand")).alias("target_category")).unionByName(brands.filter("p_brand not like '%5'").select(F.col("p_brand").alias("category"), F.lit("all").alias("target_category")))
    crumbs = p.select(F.col("p_partkey").alias("entity_source_id"), F.when(F.col("p_size") % 3 == 0, F.lit("unmapped")).otherwise(F.col("p_brand")).alias("category"))
    return catalog.project(p.select(F.col("p_partkey").alias("entity_source_id")), category_map, crumbs).select("entity_source_id", F.size("categories").alias("categories"), "product_key")


@query("SELECT p_brand, count(*) AS n, CASE WHEN count(*) > (SELECT count(*) // 25 FROM part) THEN 'OVER' ELSE 'WITHIN' END AS verdict FROM part GROUP BY 1")
def c18_caps(spark, d):
    """Some brands have more parts than a brand has on average, which is the cap."""
    p = t(spark, d, "part")
    return catalog.caps(p, "p_brand", p.count() // 25)


@query("SELECT user_id AS source_url, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS observed_at FROM events GROUP BY 1")
def t5_latest_observations(spark, d):
    """The state of the queue's stream after five batches, in no order of time, one of which came twice."""
    e = t(spark, d, "events").select(F.col("user_id").alias("source_url"), F.col("ts").alias("observed_at"), F.col("event_id").alias("input_id"), F.col("event_type").alias("status"))
    folder = common.fresh_folder(spark, "observations")
    for epoch, part in enumerate((3, 1, 4, 0, 2)):
        for _ in range(1 + (part == 4)):
            jobs.apply_batch(e.filter(F.pmod(F.xxhash64("input_id"), F.lit(5)) == part), folder, epoch, ["source_url"], ["observed_at", "input_id"], least=0)
    return jobs.current_state(spark, folder).select("source_url", "status", "observed_at")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0")
def r23_resume(spark, d):
    """A prior queue's evidence and new inputs that overlap it."""
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    seen = e.select("event_id")
    witnesses, _ = queue.resume(e.filter("event_id % 3 <> 0"), seen, e.filter("event_id % 2 = 0"), seen)
    return witnesses


@query("SELECT count(*) AS entries, count(*) AS budget, 'WITHIN' AS verdict FROM events UNION ALL SELECT count(*), count(*) - 1, 'EXCEEDED' FROM events")
def r24_budget(spark, d):
    """A budget that all events meet, and one that is a row too small."""
    e = t(spark, d, "events").select("event_id")
    n = e.count()
    return queue.budget_verdict(queue.within_budget(e, n), n).unionByName(queue.budget_verdict(e, n - 1))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Product' WHEN 1 THEN 'Article' WHEN 2 THEN 'Article' WHEN 3 THEN 'Service' ELSE 'Page' END AS type FROM part")
def x13_entity_types(spark, d):
    sets = [("Service", "Product", "Article"), ("Service", "NewsArticle"), ("BlogPosting",), ("Service",), ("WebPage",), ()]
    classes = F.element_at(F.array(*[F.array(*map(F.lit, names)).cast("array<string>") for names in sets]), (F.col("p_size") % 6 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", catalog.entity_type(classes).alias("type"))


@query("SELECT p_partkey AS source_id, '/p/' || p_partkey AS request_target, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS brand, CASE WHEN p_size % 5 <> 0 THEN p_name || ' ' || p_type ELSE '' END AS body_text FROM part WHERE p_size % 3 <> 0")
def j17_snapshot_items(spark, d):
    p = t(spark, d, "part").withColumnRenamed("p_partkey", "source_id")
    commerce = p.filter("p_size % 4 <> 0").select("source_id", F.col("p_brand").alias("brand"))
    live = p.select(F.col("source_id").alias("entity_source_id"), F.concat(F.lit("/p/"), F.col("source_id").cast("string")).alias("request_target"), F.when(F.col("p_size") % 3 == 0, 404).otherwise(200).alias("expected_status"))
    blocks = p.filter("p_size % 5 <> 0").select("source_id", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.col("p_type").alias("text")), F.struct(F.lit(0).alias("ord"), F.col("p_name").alias("text")))).alias("b")).select("source_id", "b.*")
    return catalog.items(p.select("source_id"), commerce, live, blocks).select("source_id", "request_target", "brand", "body_text")
