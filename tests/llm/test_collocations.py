"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from siteledger.llm import collocations

SCHEMA = "doc_id long, text string, lang string, next string, words int, N int"
OUT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least=10, subsumed=50, first=2000):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    around[part] = max(around[part], a)
        kept = []
        for p, a in candidates.items():
            if len(p) == 2 and around[p] and 100 * around[p] >= subsumed * a:
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = [*"the of The OF it's a-b c|d É é ß 東京 ÑU".split(), "x\x1fy", "no gap", *[f"w{i}" for i in range(4)]]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 120)), rng.choice(["en", "de", "und", None]), "n", 1, 2) for i in range(150)]
    rows += [(200, None, "en", None, None, None), (201, "", None, None, None, None), (202, " \t.,\n", "en", None, None, None), (None, "new york city " * 30, "en", None, None, None)]
    rows += [(203, "hot pair follows " + " ".join(f"hot pair v{i % 40}" for i in range(600)), "hot", None, None, None)] * 2
    return [*rows, (204, "one " * 12 + "two", "fr", None, None, None), (205, text(9000), "en", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def found(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).select(*OUT).collect())


def test_equals_a_plain_count(docs):
    want = brute(corpus())
    assert {r[0] for r in want} == {"en", "de", "und", "hot", "fr"} and any(len(r[2].split(" ")) == 3 for r in want)
    assert found(docs) == want


def test_small_parts_small_counts_and_split_stripes_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH", 50)
    monkeypatch.setattr(collocations, "PART", 37)
    monkeypatch.setattr(collocations, "HOT", 20)
    assert found(docs, least=3, subsumed=80, first=100) == brute(corpus(), least=3, subsumed=80, first=100)


def test_counts_of_billions_are_scored_exactly(spark):
    """Products beyond 64 bits, from stripes of made-up counts."""
    big = 7_000_000_019
    sent = [("x", "a", "b ", f"{big} {big}", 2, big), ("x", "b", "", str(big + 5), 1, big + 5)]
    stripes = spark.createDataFrame(sent, collocations.STRIPES)
    got = collocations.scored(stripes, 10, 50, 2000).collect()
    assert [(r.a, r.l, r.r, r.n, r.score) for r in got] == [(big, big, big + 5, 2 * big + 5, 1_000_000 * big * big // (big * (big + 5)))]


def test_empty(spark):
    got = collocations.collocations(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and tuple(got.columns) == OUT
    assert found(spark.createDataFrame([(1, None, None, None, 1, 1)], SCHEMA)) == []
