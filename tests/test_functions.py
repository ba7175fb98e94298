"""URL, address, robots, response and money functions: hand-written cases."""

import pytest
from pyspark.sql import functions as F

from siteledger.functions import digest, http, money, robots, urls
from siteledger.functions.text import let


def test_identities_are_exact(spark):
    base = "https://shop.example"
    spelled = ["/Case", "/case", "/case/", "/a%2Fb.html", "/a%2fb.html", "/a/b.html", "/x.php?a=1&a=2&empty=", "/x.php?a=2&a=1&empty="]
    df = spark.createDataFrame([(base + s,) for s in spelled], "raw string").select(urls.identity(F.col("raw")).alias("i"))
    assert [r.i.request_target for r in df.collect()] == spelled
    assert df.select("i.crawl_key").distinct().count() == 8


@pytest.mark.parametrize(
    ("raw", "base", "key"),
    [
        ("/контакт", "https://a.example/x", "https://a.example/%D0%BA%D0%BE%D0%BD%D1%82%D0%B0%D0%BA%D1%82"),
        ("x#part", "https://a.example/", "https://a.example/x"),
        ("HTTP://A.example:80?q", None, "http://a.example/?q"),
        ("https://a.example", None, "https://a.example/"),
        ("https://a.example:8443/x", None, "https://a.example:8443/x"),
        ("../b/./c?d=/../e", "https://a.example/x/y/z", "https://a.example/x/b/c?d=/../e"),
        ("?only=query", "https://a.example/x/y?z", "https://a.example/x/y?only=query"),
        ("//b.example/x", "https://a.example/", "https://b.example/x"),
        ("", "https://a.example/x?y", "https://a.example/x?y"),
        ("file:///etc/passwd", "https://a.example/", None),
        ("https://user:pw@a.example/", None, None),
        ("/a\\b", "https://a.example/", None),
        ("/a\r\nb", "https://a.example/", None),
        ("/relative", None, None),
        (None, "https://a.example/", None),
    ],
)
def test_references_resolve_or_are_refused(spark, raw, base, key):
    df = spark.createDataFrame([(raw, base)], "raw string, base string")
    row = df.select(urls.identity(urls.resolve(F.col("raw"), F.col("base"))).alias("i")).first().i
    assert row.crawl_key == key and (row.error is None) == (key is not None)


def test_public_addresses(spark):
    denied = "127.0.0.1 10.1.2.3 172.16.0.1 192.168.1.1 169.254.1.1 100.64.0.1 198.18.0.1 198.51.100.7 203.0.113.9 224.0.0.1 0.1.2.3 ::1 fc00::1 ::ffff:8.8.8.8 2001:db8::1 2002::1 fe80::1 nonsense 256.1.1.1 1.2.3".split()
    public = "8.8.8.8 172.32.0.1 100.128.0.1 2606:4700::1111".split()
    df = spark.createDataFrame([(x, x in public) for x in denied + public], "ip string, want boolean")
    assert df.filter(http.public_address(F.col("ip")) != F.col("want")).count() == 0


def test_robots_groups_patterns_and_ties(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: SiteLedger # us\nuser-agent: other\nDisallow: /private\nAllow: /private/public\nDisallow: /x?secret\nDisallow: /*.pdf$\nAllow: /tie\nDisallow: /tie\nDisallow:\nSitemap: https://h/s.xml"
    texts = spark.createDataFrame([("h", text), ("open", "# nothing\n")], "host string, text string")
    want = {"/private": False, "/private/public": True, "/x?secret=value": False, "/x?a=1": True, "/a.pdf": False, "/a.pdf?x": True, "/tie": True, "/": True}
    targets = spark.createDataFrame([("h", k) for k in want] + [("open", "/any"), ("unknown", "/any")], "host string, request_target string")
    got = {(r.host, r.request_target): r.allowed for r in robots.allowed(targets, robots.rules(texts)).collect()}
    assert got == {**{("h", k): v for k, v in want.items()}, ("open", "/any"): True, ("unknown", "/any"): True}
    assert [r.url for r in robots.sitemaps(texts).collect()] == ["https://h/s.xml"]


def test_targets_and_parameters(spark):
    cases = {"/ok?x=%zz": None, "//x": "INVALID_REQUEST_TARGET", "/a#b": "INVALID_REQUEST_TARGET", "/%zz": "INVALID_PERCENT_ENCODING", "/%ff": "INVALID_PERCENT_ENCODING", "/a/%2e%2e/b": "UNSAFE_ROUTE", "/Upload/x": "RESERVED_ROUTE_COLLISION", "/robots.txt": "RESERVED_ROUTE_COLLISION", "/a+b": None, "/" + "x" * 8192: "INVALID_REQUEST_TARGET"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [(r.t[:20], r.got) for r in df.select("t", "want", urls.target_error(F.col("t")).alias("got")).collect() if r.got != cases[r.t]] == []
    row = spark.createDataFrame([("/x?utm_a=1&p=2&p=3&sort=a%20b&co+lor&color=%ff&%zz=1",)], "t string").select(urls.query_parameters(F.col("t")).alias("q")).first().q
    assert [(p.raw, p.name, p["class"]) for p in row] == [("utm_a=1", "utm_a", "tracking"), ("p=2", "p", "pagination"), ("p=3", "p", "pagination"), ("sort=a%20b", "sort", "sort"), ("co+lor", "co lor", "unknown-preserved"), ("color=%ff", "color", "variant"), ("%zz=1", "%zz", "unknown-preserved")]


def test_safe_targets(spark):
    cases = {"/a/b": "/a/b", "/cart": None, "/x/Checkout.php": None, "/x?action=add": None, "/x?route=account/login": None, "/x?route=news": "/x?route=news", "#x": None, " ": None, "/pic.PNG?x": None, "https://b.example/": None, "/c%61rt": None, "/a+b": "/a+b"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    got = df.select("raw", urls.safe_target(urls.resolve(F.col("raw"), F.lit("https://a.example/")), F.col("raw"), F.lit("https://a.example")).alias("got")).collect()
    assert {r.raw: r.got for r in got} == cases


def test_responses(spark):
    df = spark.createDataFrame([({"cf-mitigated": " Challenge "}, "x"), ({}, " KillBot user verification [1] [2]..."), ({}, "About KillBot user verification"), ({}, None)], "h map<string,string>, t string")
    assert [r.c and r.c.provider for r in df.select(http.access_challenge(F.col("h"), F.col("t")).alias("c")).collect()] == ["Cloudflare", "KillBot", None, None]
    html = spark.createDataFrame([(None, "<!-- c --> <DIV >x"), ("text/html; x", ""), (None, "User-agent: * <div>"), (None, None), (None, "<!doctype html>")], "t string, b string")
    assert [r.h for r in html.select(http.is_html(F.col("t"), F.col("b")).alias("h")).collect()] == [True, True, False, False, True]
    good = {"x-robots-tag": "noindex, nofollow", "cache-control": "private, no-store", "x-content-type-options": "nosniff", "referrer-policy": "no-referrer", "content-security-policy": "; ".join(f"{d} 'self'" for d in http.CSP_DIRECTIVES.split())}
    bad = {**good, "x-robots-tag": "noindex", "content-security-policy": good["content-security-policy"] + "; default-src x"}
    got = spark.createDataFrame([(good,), (bad,)], "h map<string,string>").select(http.privacy_failures(F.col("h")).alias("f")).collect()
    assert [r.f for r in got] == [[], ["robots", "csp-duplicate"]]


def test_decimals_and_quantities(spark):
    cases = {"1 234,50": "1234.5", "007": "7", "0.10": "0.1", "1 000 000": "1000000", "12 34": None, "1,2345678": None, "": None, "-1": None, "1.": None, " 5 ": "5", "1e3": None}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert {r.raw: r.got for r in df.select("raw", money.commerce_decimal(F.col("raw")).alias("got")).collect()} == cases
    quantities = {"0": None, "0.000001": "0.000001", "1000000": "1000000", "1000000.1": None}
    df = spark.createDataFrame(list(quantities.items()), "raw string, want string")
    assert {r.raw: r.got for r in df.select("raw", money.quantity(F.col("raw")).alias("got")).collect()} == quantities


def test_money(spark):
    cases = [("10.5", "RUB", "10.5", 1050), ("10.555", "RUB", None, None), ("10", "JPY", "10", 10), ("10.5", "JPY", None, None), ("1.123456", "CHF", "1.123456", None), ("9" * 20, "USD", "9" * 20, None), ("1", "rub", None, None), ("1", None, None, None)]
    df = spark.createDataFrame(cases, "a string, c string, d string, m long").select("d", "m", money.money(F.col("a"), F.col("c")).alias("got"))
    assert all((r.got.decimal, r.got.minor) == (r.d, r.m) if r.d else r.got is None for r in df.collect())


@pytest.mark.parametrize(
    ("raw", "role", "currency", "amount", "unit", "want"),
    [
        ("1 000 ₽/шт.", "CURRENT", None, None, None, ("CURRENT", "OBSERVED", 100000, "piece", 0, True)),
        ("от 5 € / м²", "CURRENT", None, None, None, ("FROM", "OBSERVED", 500, "m2", 0, False)),
        ("от 5 €", "OLD", None, None, None, ("OLD", "OBSERVED", 500, None, 0, False)),
        ("5 USD – 7 USD", "CURRENT", None, None, None, ("RANGE", "OBSERVED", 500, None, 0, False)),
        ("5 USD 7 USD", "CURRENT", None, None, None, ("CURRENT", "REQUIRES_REVIEW", None, None, 0, False)),
        ("-5 USD", "CURRENT", None, None, None, ("CURRENT", "REQUIRES_REVIEW", None, None, 0, False)),
        ("5", "CURRENT", "rub", "5.00", "piece", ("CURRENT", "OBSERVED", 500, "piece", 0, True)),
        ("5 USD", "CURRENT", "RUB", None, None, ("CURRENT", "REQUIRES_REVIEW", 500, None, 1, False)),
        ("5 USD", "CURRENT", None, "6", None, ("CURRENT", "REQUIRES_REVIEW", 500, None, 1, False)),
        ("5 USD с картой", "CURRENT", None, None, "piece", ("CURRENT", "OBSERVED", 500, "piece", 1, False)),
        ("5 USD", "UNKNOWN", None, None, None, ("UNKNOWN", "REQUIRES_REVIEW", 500, None, 0, False)),
    ],
)
def test_price_texts(spark, raw, role, currency, amount, unit, want):
    df = spark.createDataFrame([(raw, role, currency, amount, unit)], "raw string, role string, c string, a string, u string")
    p = money.with_price(df, F.col("raw"), F.col("role"), F.col("c"), F.col("a"), F.col("u"), F.array().cast("array<string>"), "p").first().p
    assert (p.role, p.status, p.money and p.money.minor, p.unit, len(p.conditions), p.totals_eligible) == want


def test_subtotals_are_half_up(spark):
    df = spark.createDataFrame([(250, 1_500_000, 375), (1, 500_000, 1), (1, 499_999, 0), (100_000_000, 10_000_000_000, 1_000_000_000_000)], "m long, q long, want long")
    assert df.filter(money.subtotal_minor(F.col("m"), F.col("q")) != F.col("want")).count() == 0


def test_digest_ignores_order_and_partitions(spark):
    rows = [(i, None if i % 7 == 0 else str(i)) for i in range(200)] + [(1, "1")]
    one = digest.table_digest(spark.createDataFrame(rows, "a long, b string").coalesce(1)).first()
    other = digest.table_digest(spark.createDataFrame(rows[::-1], "a long, b string").select("b", "a").repartition(7), buckets=4096).first()
    assert one == other and one.rows == 201
    assert digest.table_digest(spark.createDataFrame(rows[1:], "a long, b string")).first().digest != one.digest


def test_let_binds_once(spark):
    assert spark.range(1).select(let(F.col("id") + 1, lambda x: x * x).alias("v")).first().v == 1


def test_international_hosts():
    hosts = {"BÜCHER.example": "xn--bcher-kva.example", "faß.de": "xn--fa-hia.de", "例え。テスト": "xn--r8jz45g.xn--zckzah", "ｅｘ­ample.com": "example.com", "%E4%BE%8B.jp": "xn--fsq.jp", "ok.example": "ok.example", "xn--bcher-kva": "xn--bcher-kva"}
    assert {h: urls.ascii_host(h) for h in hosts} == hosts
    assert [urls.ascii_host(h) for h in (None, "", "a b", "ü/x", "́a.com", "xn--a-", "xn--aü", "%FF.com", "%2e", "a\uffff.com")] == [None] * 10


def test_identities_of_international_hosts(spark):
    rows = [(1, "http://bücher.example:80/ä", "x"), (2, "https://u@bücher.example/", "x"), (3, "https://plain.example/a?b", "x"), (4, None, "x"), (5, "https://́.example/", "x"), (6, "https://BÜCHER.example:8443", "x")]
    got = {r.id: r.identity for r in urls.with_identity(spark.createDataFrame(rows, "id int, url string, identity_ string"), "url").collect()}
    assert [got[k].crawl_key for k in range(1, 7)] == ["http://xn--bcher-kva.example/%C3%A4", None, "https://plain.example/a?b", None, None, "https://xn--bcher-kva.example:8443/"]
    assert got[1].raw_url == rows[0][1] and [got[k].error for k in (2, 4, 5)] == ["INVALID_URL"] * 3


def test_robots_patterns_without_regexes(spark):
    import re

    patterns = ["/", "/a", "/a*", "*", "*b", "/a*b", "/a*b$", "/a$", "/*a*a$", "$", "", "/a**b", "*$", "/a.b", "/a*bb$", "/é*", "/ab*ab$"]
    targets = ["/", "/a", "/ab", "/abb", "/axbxb", "/axb/", "/aa", "/a.b", "/axb", "/éb", "/abab", "/ab", "/aab", "/baa"]
    quoted = lambda p: "^" + ".*".join(map(re.escape, p.removesuffix("$").split("*"))) + ("$" if p.endswith("$") else "")
    df = spark.createDataFrame([(p, t) for p in patterns for t in targets], "p string, t string")
    for r in df.select("p", "t", robots.fits(F.col("t"), F.col("p")).alias("fits")).collect():
        assert r.fits == bool(re.search(quoted(r.p), r.t)), r


def test_a_host_of_many_rules_costs_what_fits(spark):
    rules = [("h", k % 2 == 0, f"/p{k}/") for k in range(3000)] + [("h", False, "/p7/x*y$"), ("h", True, "/")]
    targets = [("h", f"/p{k}/page{k % 5}") for k in range(0, 3000, 50)] + [("h", "/p7/x1y"), ("h", "/p7/x1z"), ("other", "/p1/")]
    got = {(r.host, r.request_target): r.allowed for r in robots.allowed(spark.createDataFrame(targets, "host string, request_target string"), spark.createDataFrame(rules, "host string, allow boolean, pattern string")).collect()}
    assert all(got[("h", f"/p{k}/page{k % 5}")] == (k % 2 == 0) for k in range(0, 3000, 50))
    assert not got[("h", "/p7/x1y")] and not got[("h", "/p7/x1z")] and got[("other", "/p1/")]
