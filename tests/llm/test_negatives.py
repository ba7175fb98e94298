"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from siteledger.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>, anchor_id int, q string, Shard string"
OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=100, positives=5, k=10, low=30, high=90):
    own = {}
    for i, label, x, *_ in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            own.setdefault(i, []).append((label, x))
    own = {i: min(r) for i, r in own.items()}
    whole = {i: (label, [math.floor(256 * v) for v in x]) for i, (label, x) in own.items()}
    score = lambda a, b: sum(p * q for p, q in zip(whole[a][1], whole[b][1], strict=False))
    out = []
    for a in whole:
        if a % every == 0:
            ranked = sorted((-score(a, b), b) for b in whole if b != a)
            for s, b in [(s, b) for s, b in ranked if whole[b][0] == whole[a][0]][:positives]:
                fits = [(t, c) for t, c in ranked if whole[c][0] != whole[a][0] and low * -s <= 100 * -t <= high * -s][:k]
                out += [(a, b, n, c, -s, -t) for n, (t, c) in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, dims, seed, labels=4):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(labels)]
    return [(i, i % labels, [m + rng.gauss(0, 0.1) for m in middle[(i // 3) % labels]], None, "q", "s") for i in range(n)]


def found(spark, rows, **options):
    return sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).select(*OUT).collect())


def test_all_defined_cases(spark):
    rows = vectors(420, 6, 1)
    rows += [(i, 1, rows[100][2], None, None, None) for i in range(1000, 1120)]  # ties: one vector over and over
    rows += [rows[5]] * 40 + [(7, 0, [0.5] * 6, None, "other row", "of one id")]
    rows += [(2000, None, [1.0] * 6, 1, "", ""), (None, 1, [1.0] * 6, 1, "", ""), (2100, 1, None, 1, "", ""), (2200, 1, [1.0, None] * 3, 1, "", "")]
    rows += [(2300, 2, [float("nan")] * 6, 1, "", ""), (2400, 2, [float("inf")] * 6, 1, "", ""), (2500, 2, [], 1, "", ""), (2600, 3, [0.7, -0.2], 1, "", ""), (-100, 3, [0.1] * 6, 1, "", "")]
    want = brute(rows)
    assert {r[0] for r in want} >= {0, 100, -100, 1000} and len(want) > 200
    assert found(spark, rows) == want


def test_several_shards_and_blocks(spark, monkeypatch):
    rows = vectors(900, 5, 2)
    want = brute(rows, every=20, positives=3, k=4)
    monkeypatch.setattr(negatives, "SHARD", 500)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 400)
    assert found(spark, rows, every=20, positives=3, negatives=4) == want


def test_sums_beyond_doubles_are_exact(spark):
    rng = random.Random(4)
    for size in (1e4, 3e6, 1e7):  # sums over 2^24, near 2^62
        rows = [(i, i % 2, [rng.uniform(0.9, 1) * size, rng.uniform(-1, 1) * size * (i % 2) / 3], None, "", "") for i in range(120)]
        assert found(spark, rows, every=50) == brute(rows, every=50)


def test_an_anchor_without_partners_and_an_empty_table(spark):
    assert found(spark, [(0, 1, [1.0], None, "", ""), (1, 2, [0.5], None, "", "")]) == []
    empty = negatives.hard_negatives(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and tuple(empty.columns) == OUT
    assert found(spark, [(5, 1, [1.0], None, "", "")]) == []


def test_the_threshold_stops_the_search(spark):
    """Where one list tells the best rows, few others are ever scored."""
    rng = np.random.default_rng(5)
    q = np.floor(rng.normal(0, 2, (8000, 8)))
    q[:, 0] = np.arange(8000) % 1000
    lists = np.ascontiguousarray(np.argsort(q, axis=0, kind="stable").T.astype(np.int32))
    shard = negatives.Shard(np.arange(8000), np.zeros(8000, int), q, lists)
    scored, whole = [], shard.scores
    shard.scores = lambda rows, anchor: scored.append(len(rows)) or whole(rows, anchor)
    anchor, none = np.array([9.0, 1, -1, 0, 0, 0, 0, 0]), (np.empty(0, np.int64), np.empty(0, np.int64))
    scores, ids = negatives.search(shard, anchor, np.ones(8000, bool), [negatives.Span(None, None, None)], 5, none)
    every = whole(np.arange(8000), anchor)
    order = np.lexsort((np.arange(8000), -every))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == every[order].tolist() and sum(scored) < 2000


def test_other_labels_come_from_an_expression(spark):
    rows = vectors(300, 6, 6)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    other = [(i, (y + 1) % 10 if i % 7 == 0 else y, *more) for i, y, *more in rows]
    assert found(spark, rows, label=label) == brute(other)
