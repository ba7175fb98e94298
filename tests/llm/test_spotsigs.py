"""SpotSigs against a plain Python version, with Spark's 32-bit hash written out."""

import hashlib
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from siteledger.llm import spotsigs

SCHEMA = "doc_id long, text string, lang string, digest string, share int, signs int"
MASK = 0xFFFFFFFF


def spark_hash(*words, seed=42):
    """Murmur3 as Spark chains it over strings; nulls leave it unchanged."""
    rotl = lambda x, r: (x << r | x >> 32 - r) & MASK
    h = seed
    for word in words:
        if word is None:
            continue
        data = word.encode()
        whole = len(data) // 4 * 4
        blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)]
        blocks += [(b - 256 if b > 127 else b) & MASK for b in data[whole:]]
        for k in blocks:
            k = rotl(k * 0xCC9E2D51 & MASK, 15) * 0x1B873593 & MASK
            h = (rotl(h ^ k, 13) * 5 + 0xE6546B64) & MASK
        h ^= len(data)
        h = (h ^ h >> 16) * 0x85EBCA6B & MASK
        h = (h ^ h >> 13) * 0xC2B2AE35 & MASK
        h ^= h >> 16
    return h


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", text.lower()) if w]


def brute_anchors(rows):
    counts = {}
    for _, text, lang, *_ in rows:
        counts.setdefault(lang, Counter()).update(words(text or ""))
    whole = sum(sum(c.values()) for c in counts.values())
    return {w for c in counts.values() if 100 * sum(c.values()) >= whole for w, n in c.items() if 200 * n >= sum(c.values())}


def brute_signs(text, anchors):
    own = words(text)
    content = [w for w in own if w not in anchors]
    out, before = set(), 0
    for w in own:
        if w not in anchors:
            before += 1
        elif before < len(content):
            out.add(spark_hash(w, *content[before : before + 3]))
    if not out:
        out = {spark_hash("", *content[k : k + 3]) for k in range(len(content))}
    return out or ({spark_hash(" ".join(own))} if own else set())


def brute_likeness(a, b):
    near = len(a & b) / len(a | b) if a | b else 1.0
    return near if near >= 0.1 else 0.0


def show(signs):
    return "".join(f"{s:08x}" for s in sorted(signs, key=lambda s: s - (s >> 31 << 32)))


def brute(rows):
    anchors = brute_anchors(rows)
    place = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    order = sorted({(place(r), r[1] or "") for r in rows})
    out = []
    for r in rows:
        text = r[1] or ""
        after = order[([p for p, _ in order].index(place(r)) + 1) % len(order)][1]
        share = len(text) // 4
        edited = text[: len(text) - share] + after[:share]
        a, b, c = (brute_signs(t, anchors) for t in (text, edited, after))
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), brute_likeness(a, b), brute_likeness(a, c)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(11)
    common, rare = "the of und a é 和".split(), [f"w{i}x" for i in range(300)] + ["Œuvre", "straße", "naïve", "áb", "𝔘nit"]
    text = lambda n: "".join(rng.choice(common if rng.random() < 0.4 else rare) + rng.choice([" ", " ", ", ", ".\n", "\t"]) for _ in range(n))
    rows = [(3 * i, text(rng.randint(0, 90)), rng.choice(["en", "de", None]), "d", 1, 2) for i in range(60)]
    rows += [(1000, None, "en", None, None, None), (1001, "", "en", None, None, None), (1002, " ,.\n", None, None, None, None), (1003, "the of", "en", None, None, None), (1004, "solitary", "en", None, None, None)]
    rows += [(1005, "w1x w2x w3x w4x w5x", "en", None, None, None), (None, text(30), "en", None, None, None), (None, "of no id", "en", None, None, None), (30, text(20), "en", None, None, None)]
    return [*rows, rows[4], rows[4], (2000, text(6000), "de", None, None, None), (2001, rows[10][1], "de", None, None, None)]


def found(docs):
    out = spotsigs.edits(docs)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_a_plain_version(spark):
    rows = corpus()
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == brute(rows)
    prints = {}
    for r, g in zip(sorted(rows, key=lambda r: repr(r[0])), sorted(got, key=lambda r: repr(r[0])), strict=True):
        assert r[0] == g[0]
    for doc_id, _, _, fingerprint, *_ in got:
        prints.setdefault(fingerprint, set()).add(doc_id)
    assert {30, 2001} <= set().union(*(ids for ids in prints.values() if 2001 in ids))
    long = [g for g in got if g[1] > 300]
    assert min(g[5] for g in long) > 0.4 and sum(g[6] for g in long) / len(long) < 0.1


def test_a_single_document_and_an_empty_table(spark):
    rows = [(7, "the one and only text, the last of all", "en", None, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("least", [0.1, 0.5, 0.8])
def test_pruning_by_partitions_loses_nothing(spark, least):
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(60), rng.randint(0, 50))) for _ in range(400)]
    sets += [s[: max(1, int(len(s) * least))] for s in sets]
    pairs = [(rng.choice(sets), rng.choice(sets)) for _ in range(1500)] + list(zip(sets[:400], sets[400:], strict=True))
    df = spark.createDataFrame(pairs, "a array<int>, b array<int>")
    for a, b, near in df.select("a", "b", spotsigs.likeness(F.col("a"), F.col("b"), least)).collect():
        exact = len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
        assert near == (exact if exact >= least else 0.0)


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(14)
    common, rare = "the of und a".split(), [f"w{i}x" for i in range(400)]
    make = lambda n: [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(n)]
    rows = [(i, " ".join(make(rng.randint(60, 160) if i < 12 else rng.randint(1, 60)))) for i in range(60)]
    for k in range(30):  # copies with a few words changed, at the end and in between
        words = rows[k % 12][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(rare)
        rows.append((100 + k, " ".join(words + make(rng.randint(0, 3)))))
    rows += [(200, None), (201, ""), (202, "!"), (203, rows[3][1]), (None, rows[4][1])]
    table = [(i, t, "en", None, None, None) for i, t in rows]
    anchors = brute_anchors(table)
    signs = [brute_signs(t or "", anchors) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if not signs[a] | signs[b] or signs[a] and signs[b] and len(signs[a] & signs[b]) >= 0.8 * len(signs[a] | signs[b]):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    want = sorted(((i, smallest[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)
    assert 55 < len(set(smallest.values())) < 80
    assert sorted(map(tuple, spotsigs.near_duplicates(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()), key=repr) == want
