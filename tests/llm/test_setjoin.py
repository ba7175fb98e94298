"""Links between similar sets: all components of brute force, and rows that do not grow with the square of a group."""

import random

import pytest
from pyspark.sql import functions as F

from siteledger.llm import setjoin, simhash
from siteledger.llm.common import materialise
from siteledger.llm.components import components


def brute(rows, least):
    """node -> the smallest node of its component."""
    parent = {node: node for _, node, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (label, a, x) in enumerate(rows):
        for other, b, y in rows[:k]:
            if label == other and (not x and not y or x and y and len(set(x) & set(y)) >= least * len(set(x) | set(y)) - 1e-9):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {node: find(node) for node in parent}


def found(spark, rows, least, join=setjoin.linked):
    sets = materialise(spark.createDataFrame(rows, "label string, node long, members array<long>").repartition(3), "sets")
    labels = {r.node: r.label for r in components(join(sets, least)).collect()}
    return {node: labels.get(node, node) for _, node, _ in rows}


def chain(n, width=100, step=2, base=0):
    return [("chain", base + k, [*range(base * 1000 + k * step, base * 1000 + k * step + width)]) for k in range(n)]


def families(seed, n, least):
    rng = random.Random(seed)
    out = []
    for family in range(12):
        core = rng.sample(range(family * 1000, family * 1000 + 400), rng.randint(1, 60))
        for _ in range(n // 12):
            own = [x for x in core if rng.random() > (1 - least) / 2]
            own += [rng.randrange(10**6) for _ in range(rng.randint(0, max(1, int(len(core) * (1 - least) / 2))))]
            out.append((f"l{family % 3}", len(out), sorted(set(own))))
    return out


@pytest.mark.parametrize("least", [0.3, 0.8, 0.95])
def test_families_have_the_components_of_brute_force(spark, least):
    rows = families(3, 240, least) + [("l0", 900 + k, []) for k in range(3)] + [("l9", 990, [5]), ("l9", 991, [5]), ("l9", 992, [6])]
    want = brute(rows, least)
    assert 5 < len(set(want.values())) < len(rows) - 20
    assert found(spark, rows, least) == want
    assert found(spark, rows, least, lambda sets, t: setjoin.linked(sets, t, partitioned=True)) == want


def test_chains_and_stars_lose_no_link(spark):
    rows = chain(120) + chain(120, 100, 5, 500)  # neighbours of 0.96 and 0.905
    hub = [*range(-100, 0)]
    rows += [("star", 2000 + k, hub if not k else [*hub[5:], *range(7000 + 9 * k, 7005 + 9 * k)]) for k in range(60)]  # 0.905 to the hub only, two rays 0.83
    rows += [("far", 3000 + k, hub if not k else [*hub[10:], *range(17000 + 9 * k, 17009 + 9 * k)]) for k in range(60)]  # rays under 0.8 to each other
    want = brute(rows, 0.8)
    assert len(set(want.values())) == 4
    assert found(spark, rows, 0.8) == want


@pytest.mark.parametrize("size", [2, 30, 1000])
def test_the_size_of_a_task_changes_nothing(spark, size):
    rows = chain(100) + families(4, 120, 0.8)

    def join(sets, least):
        sizes = sets.select("label", "node", F.size("members").alias("words"))
        return simhash.verified_links(sets.withColumnRenamed("members", "shingles"), sizes, least, size, 10**9)

    assert found(spark, rows, 0.8, join) == brute(rows, 0.8)


def test_what_is_compared_grows_with_the_sets(spark, monkeypatch):
    compared, similar = [], setjoin._similar
    monkeypatch.setattr(setjoin, "_similar", lambda pairs, sets, least: compared.append(pairs.count()) or similar(pairs, sets, least))
    rng, made = random.Random(6), []
    for n in (200, 800):
        copies = [("c", k, sorted({*range(200)} - {rng.randrange(200)} | {10**6 + k})) for k in range(n)]
        unlike = [("u", 10**5 + k, [*range(5), *(rng.randrange(10**7, 10**9) for _ in range(60))]) for k in range(n)]
        got = found(spark, copies + unlike, 0.8)
        assert len({got[k] for k in range(n)}) == 1 and all(got[10**5 + k] == 10**5 + k for k in range(n))
        made.append(sum(compared))
        compared.clear()
    assert made[1] < 6 * made[0] and made[1] < 800 * 30


def test_no_sets(spark):
    assert found(spark, [], 0.8) == {}
