"""URL filters and WARC archives."""

import hashlib

import pytest

from siteledger.llm import urlfilter, warc
from siteledger.llm.common import fresh_path

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.example", "/x", "block"), ("a.b.example", "/", "allow")]
URLS = ["http://EXAMPLE.net/en/1", "https://www.example.net/de/", "http://example.com/de/x?q#f", "http://notexample.com/de/", "http://x.org/fr/", "http://foo.net", "http://foo.net?x", "mailto:a@b", None, "", "http:///path", "http://a.b.example/x/1", "http://u@a.b.example/x", "x://h/p://q", "http://ж.net/"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail.split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"))
    return host, path, best[0] + best[1], best[2]


@pytest.mark.parametrize("limit", [100, 0])
def test_url_rules_match_brute_force(spark, limit):
    pages = spark.createDataFrame([*[(i, u, 1) for i, u in enumerate(URLS)], (1, URLS[1], 2), (None, URLS[0], 3)], "page_id long, url string, rule int")
    got = sorted((tuple(r) for r in urlfilter.judge(pages, urlfilter.rules(spark, RULES), broadcast_limit=limit).collect()), key=repr)
    want = sorted([*((i, *brute(u)) for i, u in enumerate(URLS)), (1, *brute(URLS[1])), (None, *brute(URLS[0]))], key=repr)
    assert got == want
    assert urlfilter.judge(pages.filter("false"), urlfilter.rules(spark, RULES)).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, urlfilter.rules(spark, RULES).filter("false")).collect()} == {"allow"}


def nested():
    """A payload that holds a whole record of its own, and bare magic."""
    inner = warc.record(99, "http://inner/", b"inner payload", 13, "0" * 64, "response", None)
    return "text " + inner.decode("latin-1") + " WARC/1.1\r\nContent-Length: 5\r\n\r\n and more"


PAGES = [(1, "http://a/ b\r\nX: y", "x" * 150), (2, "http://a/2", "x" * 150), (0, None, None), (3, "http://a/3", ""), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "http://a/6", "ж" * 60), (7, "http://a/7", "ж" * 60), (7, "http://a/7b", "ж" * 60), (None, "http://a/8", "x" * 150)]


def expected():
    rows = [*PAGES, (20, "http://n/", nested()), (21, "http://n/", nested())]
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        n = sum(1 for r in rows if (r[2] or "").encode() == raw)
        kind = "revisit" if n > 1 and raw in first and first[raw] != i else "response"
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), kind, first[raw] if kind == "revisit" else None))
    return rows, sorted(out, key=repr)


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    rows, want = expected()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr) == want
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_records_inside_payloads_are_candidates_but_not_reachable(spark):
    rows, _ = expected()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = warc.write(pages, fresh_path(spark, "w"))
    found = warc.candidates(archives)
    assert found.count() > len(rows)
    assert warc.reachable(found, archives).count() == len(rows)


def test_a_torn_archive_is_an_error(spark, tmp_path):
    raw = b"".join(warc.record(i, "u", b"p" * 10, 10, hashlib.sha256(b"p" * 10).hexdigest(), "response", None) for i in range(3))
    (tmp_path / "t.warc").write_bytes(raw[:-40])
    archives = spark.createDataFrame([(f"file://{tmp_path}/t.warc", len(raw) - 40)], "uri string, size long")
    with pytest.raises(ValueError, match="chain"):
        warc.reachable(warc.candidates(archives), archives)
