"""Operators on documents against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siteledger.llm import decontaminate, langid, packing, quality, shards, simhash, substrings, tokens, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", "."]) for _ in range(n))


def documents():
    rng = random.Random(3)
    out = [(i, text(rng, rng.randint(1, 60)), "en", "s") for i in range(60)]
    base = text(rng, 120)
    for i in range(60, 75):  # near copies
        words = base.split()
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append((i, " ".join(words), "en", None))
    out += [(75, base, None, "s"), (76, base, "en", "s"), (77, None, "en", "s"), (78, "", None, None), (79, "   \n\t ", "en", "s"), (80, "word", "en", "s"), (81, text(rng, 20_000), "en", "s"), (81, "another row of one id", "en", "s"), (None, base, "en", "s"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    # n, key, g, closed, fp0, part: names that operators use for themselves
    rows = [(*r, 1, "k", 2, True, 3, 4) for r in documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, key string, g int, closed boolean, fp0 int, part int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    units = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, limits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if all((a ^ b).bit_count() <= m for a, b, m in zip(prints[i], prints[j], limits)):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(docs, empty):
    got = sorted(simhash.near_duplicates(docs).collect(), key=repr)
    source = documents()
    prints = [(brute_fingerprint(r[1]),) for r in source]
    roots = brute_components(prints, [2])
    least = {}
    for r, root in zip(source, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted([(r[0], f"{p[0]:016x}", least.get(root)) for r, p, root in zip(source, prints, roots)], key=repr)
    assert [tuple(r) for r in got] == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_deduplicates_near_copies(docs, empty):
    kept = [r.doc_id for r in simhash.deduplicate(docs).collect()]
    assert len([k for k in kept if k is not None and 60 <= k <= 76]) == 1
    assert {*range(60)} - {*kept} == set()
    assert simhash.deduplicate(docs).columns == docs.columns
    assert simhash.deduplicate(empty).count() == 0


def test_deduplicate_keeps_one_row_of_repeated_ones(spark):
    rng = random.Random(8)
    one, two = text(rng, 60), text(rng, 60)
    names = "doc_id long, text string, digest string, of_id long, of_text string, Kept_ID string, node long, label string"
    rows = [(5, one), (5, one), (5, two), (3, two), (9, one), (None, one), (None, "nobody else has these words at all here"), (7, None), (8, "")]
    table = spark.createDataFrame([(*r, "a", 1, "b", "c", 2, "d") for r in rows], names).repartition(2)
    got = simhash.deduplicate(table)
    assert got.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(5, one), (3, two), (None, rows[6][1]), (7, None)], key=repr)
    assert all(tuple(r)[2:] == ("a", 1, "b", "c", 2, "d") for r in got.collect())


def test_deduplicate_keeps_texts_below_the_similarity(spark):
    rng = random.Random(12)
    rows = [(1, "same " * 300 + "one"), (2, "same " * 300 + "two"), (3, "same " * 300 + "two")]  # equal fingerprints
    for c in range(12):
        base = [f"w{c}x{i}" for i in range(400)]
        rows.append((1000 * c + 10, " ".join(base)))
        for k in range(24):  # close in words, and for odd k far in five-word shingles
            words = list(base)
            for at in rng.sample(range(400), 14 if k % 2 else 2):
                words[at] = f"n{rng.random()}"
            rows.append((1000 * c + 11 + k, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.deduplicate(table).collect()}
    dropped = {*sets} - kept
    assert {1, 2} <= kept and 3 in dropped and len(dropped) > 20
    assert all(any(alike(i, j) for j in sets if j != i) for i in dropped)


def test_similarity_is_that_of_the_sets():
    rng = random.Random(1)
    sets = [set(rng.sample(range(12), rng.randint(0, 12))) for _ in range(40)]
    got = simhash.similar([np.array(sorted(s), np.uint64) for s in sets], 0.5, chunk=5)
    assert got.tolist() == [[2 * len(a & b) >= len(a | b) for b in sets] for a in sets]


@pytest.mark.parametrize(("distance", "group", "block"), [(2, 16, 1024), (2, 4, 8), (1, 2, 4), (3, 3, 60), (4, 16, 200)])
def test_links_have_the_components_of_all_pairs(spark, distance, group, block):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(6)]
    nodes = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    nodes |= {centres[0] ^ sum(1 << b for b in rng.sample(range(9), rng.randint(0, 6))) for _ in range(150)}  # values that many share
    nodes = sorted(nodes)
    signed = [(seed, int(np.uint64(x).astype(np.int64))) for x in nodes for seed in (0, 1)]
    df = simhash.materialise(spark.createDataFrame(signed, "seed int, fp long").repartition(4), "t")
    name = lambda c: F.concat_ws(":", "seed", F.col(c).cast("string"))
    edges = simhash.links(df, distance, group, block).select(name("a").alias("src"), name("b").alias("dst"))
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    roots = brute_components([(x,) for x in nodes], [distance])
    for seed in (0, 1):
        mine = [labels.get(f"{seed}:{n}", n) for _, n in signed[::2]]
        assert len({*zip(roots, mine)}) == len({*roots}) == len({*mine})


def test_distances_out_of_range_are_told(spark):
    nodes = simhash.materialise(spark.createDataFrame([(0, 5)], "seed int, fp long"), "t")
    for distance in (-1, 5, 10):
        with pytest.raises(ValueError, match="distance"):
            simhash.links(nodes, distance)


def test_links_grow_with_the_nodes_of_a_hot_value(spark):
    made = []
    for n in (200, 400):
        rows = [(0, x << 3) for x in range(n)]  # all within a few bits of each other
        df = simhash.materialise(spark.createDataFrame(rows, "seed int, fp long"), "t")
        made.append(simhash.links(df, 2, group=4, block=64).count())
    assert made[1] <= 2.5 * made[0]


def test_large_classes_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(90):  # one large group of near copies
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rng.sample(base, 200))) for i in range(40)]  # the same words in other orders
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash.deduplicate(table, size=16).collect()}
    assert kept == {0, *range(1000, 1040)}


def test_sketches_estimate_second_moments(spark):
    rng = np.random.default_rng(1)
    values = rng.zipf(1.5, 20_000) % 5000
    df = spark.createDataFrame([(0, int(v)) for v in values], "seed int, fp long").repartition(3)
    n, f2 = simhash.second_moments(df, {0: [-1]})[0, 0]
    exact = float((np.unique(values, return_counts=True)[1].astype(float) ** 2).sum())
    assert n == 20_000 and abs(f2 - exact) < 0.1 * exact


def test_thresholds_are_allocated_by_least_cost():
    costs = [{-1: 0, 0: 10, 1: 100}, {-1: 0, 0: 1, 1: 5}, {-1: 0, 0: 1, 1: 50}]
    assert simhash.allocate(costs, 0) == (6, [-1, 1, 0])
    assert simhash.allocate(costs, 5)[0] == float("inf")


def pieces_by_library(t, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary()).encode(t or "", add_special_tokens=False).ids + [end]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    lib, enc, rng = Tokenizer.from_file(tokens.default_vocabulary()), tokens.Encoder(tokens.default_vocabulary(), entries=50), random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "1", "²", "é", "日本", "\t", "\xa0", "\u200b", "\x1f", "!?", "<|endoftext|>", "Ω", "ß", "😀", "\r\n", "\x85", "ª", "×", "don't", "x" * 300]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_whole_and_tight(docs, empty):
    got = packing.pack(docs, group=20).collect()
    want = []
    for r in documents():
        ids = np.array(pieces_by_library(r[1], 2), "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want.append((r[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_seq) <= -(-sum(w[3] for w in want) // 1024) + 2
    assert packing.pack(empty).count() == 0


def test_cut_puts_the_short_piece_first():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 3, 2, 4, 4])
    bins = packing.local_search([[0], [1, 2], [3, 4], [5]], lengths, 12)
    assert sorted(i for b in bins for i in b) == [*range(6)] and all(lengths[b].sum() <= 12 for b in bins) and len(bins) == 2


def test_packing_ends_when_no_two_pieces_fit(spark, monkeypatch):
    rows = [(i, 0, 0, 600, 1) for i in range(20_000)]
    table = spark.createDataFrame(rows, packing.PIECES)
    monkeypatch.setattr(packing, "pieces", lambda docs, *_: docs)
    rounds, real = [], packing._round
    monkeypatch.setattr(packing, "_round", lambda rest, groups, *a, **k: (rounds.append(groups), pytest.fail("no progress") if len(rounds) > 3 else None, real(rest, groups, *a, **k))[2])
    got = packing.pack(table).collect()
    assert len({r.sequence_id for r in got}) == len(got) == len(rows) and {r.doc_id for r in got} == {*range(20_000)}
    assert rounds == sorted({*rounds}, reverse=True)


def test_shards_round_trip_and_keyed_access(spark, docs, empty):
    manifest = shards.write(docs, shards.fresh_path(spark, "t"), shards=3, max_ids=3000, max_rows=11)
    assert manifest.count() > 6
    got = sorted(shards.read(manifest).collect(), key=lambda r: r.start)
    source = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for r in source:
        ids = np.array(pieces_by_library(r[1], 0), "<u4")
        want.append((r[0], len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert [r.doc_id for r in got] == [r[0] for r in source]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    found = shards.lookup(manifest, spark.createDataFrame([(80,), (81,), (5000,), (-1,)], "doc_id long")).collect()
    assert Counter(r.doc_id for r in found) == {80: 1, 81: 2}
    assert [r.ids for r in found if r.doc_id == 80] == [pieces_by_library("word", 0)]
    assert shards.encode_and_read(empty).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    h = shards.PerfectHash.build(keys)
    assert sorted(h.find(keys).tolist()) == [*range(len(np.unique(keys)))]


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    counts = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if counts[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_base_rules_match_brute_force(docs, empty):
    got = quality.judge(docs).collect()
    mine = sorted((tuple(r)[:7] for r in got), key=repr)
    assert mine == sorted(((r[0], *brute_quality(r[1])) for r in documents()), key=repr)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(empty).count() == 0


def plain_quantile(values, share):
    """The smallest bin that at least this share of the values reach."""
    bins = sorted(np.floor(values))
    return bins[max(0, int(np.ceil(share * len(bins) - 1e-9)) - 1)]


def plain_estimate(x):
    """Mean, Cholesky factor and log determinant by concentration steps from four starts, in numpy."""
    n, d = x.shape
    med = np.array([(plain_quantile(x[:, i] * 200, 0.5) + 0.5) / 200 for i in range(d)])
    mad = np.array([max(1.4826 * (plain_quantile(abs(x[:, i] - med[i]) * 200, 0.5) + 0.5) / 200, quality.FLOOR) for i in range(d)])
    best = None
    for start in range(-1, d):
        m, low, det = med, np.diag([mad[i] * (1000 if start >= 0 and start != i else 1) for i in range(d)]), np.inf
        while True:
            dist = plain_distance(x, m, low)
            bins = np.floor(np.clip(np.log2(dist + 1e-9) * quality.BINS, -30 * quality.BINS, 40 * quality.BINS))
            near = x[bins <= plain_quantile(bins, 0.5)]
            m, cov, low = near.mean(0), 2.5 * np.cov(near.T, bias=True), np.zeros((d, d))
            for i in range(d):
                for j in range(i + 1):
                    rest = cov[i, j] - low[i, :j] @ low[j, :j]
                    low[i, j] = np.sqrt(max(rest, quality.FLOOR**2)) if i == j else rest / low[j, j]
            was, det = det, 2 * np.log(np.diag(low)).sum()
            if not det < was + np.log1p(-quality.STILL):
                break
        if best is None or (det, start) < best[0]:
            best = (det, start), m, low
    return best[1:]


def plain_distance(x, m, low):
    return (np.linalg.solve(low, (x - m).T) ** 2).sum(0)


def test_quality_distances_match_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for cell, n in (("a", 300), ("b", 81)):
        x = rng.normal(0, [0.3, 1.0, 0.1], (n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
        x[: n // 5] += [2, 8, 0.5]
        x[:10] = x[10]  # ties
        rows += [(cell, *map(float, v)) for v in x]
    table = quality.materialise(spark.createDataFrame(rows, "cell string, x0 double, x1 double, x2 double").repartition(3), "t")
    fitted = {r.cell: r for r in quality.estimates(table).collect()}
    limits = {r.cell: r.cut for r in quality.cuts(table, quality.estimates(table)).collect()}
    for cell in "ab":
        x = np.array([r[1:] for r in rows if r[0] == cell])
        m, low = plain_estimate(x)
        got = fitted[cell]
        assert np.allclose([got[f"m{i}"] for i in range(3)], m, atol=1e-6)
        assert np.allclose([[got[f"l{i}{j}"] if j <= i else 0 for j in range(3)] for i in range(3)], low, atol=1e-6)
        dist = np.sqrt(plain_distance(x, m, low)) * quality.BINS
        middle = plain_quantile(dist, 0.5)
        cut = (middle + 0.5 + quality.SPREADS * 1.4826 * (plain_quantile(abs(dist - middle - 0.5), 0.5) + 0.5)) / quality.BINS
        assert np.isclose(limits[cell], cut**2)
        assert (plain_distance(x, m, low)[: len(x) // 5] > plain_distance(x, m, low)[len(x) // 5 :].max()).mean() > 0.9


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randint(30, 300)), ["en", "fr"][i % 2], "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%&&&" for w in text(rng, 80).split()), "en", "s") for i in range(8)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(8))


def test_repeats_are_found_with_their_offsets(spark, docs, empty):
    a, b = "The first passage runs on for quite a few words more. It has a second sentence with many other words in it.", "Nothing of this text stands anywhere else in the table at all."
    rows = [(3, b), (5, f"Own start here\n{a}\nOwn end"), (2, f"{a} Then something new."), (9, f"Before it all. {a.upper()}"), (9, f"Before it all. {a.upper()}"), (11, None), (12, ""), (None, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted({tuple(r) for r in substrings.repeats(table).collect()})
    assert [(r[0], r[2], r[3]) for r in got] == [(5, 15, len(a)), (9, 15, len(a))]
    texts = sorted(substrings.remove(table).collect(), key=repr)
    assert [r.text for r in texts if r.doc_id == 5] == ["Own start here\n\nOwn end"]
    assert [r.text for r in texts if r.doc_id == 2] == [rows[2][1]] and [r.text for r in texts if r.doc_id is None] == [a]
    assert len(texts) == len(rows)
    assert substrings.remove(docs).columns == docs.columns and substrings.remove(empty).count() == 0


def test_constant_texts_are_tiled_in_time_that_follows_their_length():
    import time

    rng = np.random.default_rng(3)
    for n, m in ((20_000, 300), (30, 12), (700, 90)):
        for words in (1, 2):
            item, t = rng.integers(1, words + 1, m).astype(np.uint64), rng.integers(1, words + 1, n).astype(np.uint64)
            began = time.process_time()
            got = decontaminate.tiles(item, t, 5)
            assert time.process_time() - began < 2
            marked_i, marked_t = np.zeros(m, int), np.zeros(n, int)
            for i, at, size in got:
                assert size >= 5 and (item[i : i + size] == t[at : at + size]).all()
                marked_i[i : i + size] += 1
                marked_t[at : at + size] += 1
            assert marked_i.max() == 1 and marked_t.max() == 1
            if words == 1:
                assert marked_i.sum() == m if n > m else n
    item, t = rng.integers(1, 3, 60).astype(np.uint64), rng.integers(1, 3, 300).astype(np.uint64)
    plain = decontaminate.tiles(item, t, 5)
    was, decontaminate.PLACES = decontaminate.PLACES, 0
    try:
        assert sorted(n for *_, n in decontaminate.tiles(item, t, 5)) == sorted(n for *_, n in plain)
    finally:
        decontaminate.PLACES = was


def test_blocks_of_the_benchmark_are_bounded_by_what_is_read_as_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1000)
    rows = [(k, "\u4e2d\u6587" * 150) for k in range(40)] + [(100 + k, "some words here " * 60) for k in range(30)] + [(500, "x " * 5000), (501, None), (502, "")]
    got = list(decontaminate.blocks(spark.createDataFrame(rows, "item_id long, text string")))
    assert sorted(i for block in got for i, _ in block) == sorted(i for i, t in rows if t)
    sizes = [sum(len(decontaminate.words_of(t)) for _, t in block) for block in got]
    assert [n for n in sizes if n > 1000] == [5000] and len(got) < 60


def brute_lines(rows, min_words):
    """What stays of every text if each line that stood before is cut, by plain loops."""
    texts = sorted({(i, zlib.crc32(t.encode()), t) for i, t in rows if i is not None and t})
    first, owners, out = {}, {}, {}
    key = lambda line: " ".join(line.lower().split()).rstrip(".!?")
    for i, c, t in texts:
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(key(line), (i, c, k))
                owners.setdefault(key(line), set()).add((i, c))
    for i, c, t in texts:
        lines, run, gone = list(re.finditer(r"[^\n]+", t)), [], set()
        at = {m.start(): k for k, m in enumerate(re.finditer(r"(?m)^.*$", t))}
        for m in [*(m for m in lines if m[0].strip()), None]:
            if m is not None and len(owners[key(m[0])]) > 1 and first[key(m[0])] != (i, c, at[m.start()]):
                run.append(m)
                continue
            if run and sum(len(x[0].split()) for x in run) >= min_words:
                tail = run[-1][0].rstrip()  # white space behind a closing mark belongs to no unit
                gone |= set(range(run[0].start() + len(run[0][0]) - len(run[0][0].lstrip()), run[-1].start() + len(tail if tail[-1] in ".!?" else run[-1][0])))
            run = []
        out[i, c] = "".join(x for k, x in enumerate(t) if k not in gone)
    return out


@pytest.mark.parametrize("min_words", [0, 6])
def test_lines_are_cut_as_plain_loops_cut_them(spark, min_words):
    rng = random.Random(31)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 9]))) + rng.choice([".", "", "! Go on"]) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(["", "  ", "\t"]) + (rng.choice(pool) if rng.random() < 0.6 else text(rng, 7)) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows += [(7, rows[7][1]), (60, rows[8][1].upper()), (61, "\n\n \n"), (62, None)]
    want = brute_lines(rows, min_words)
    got = substrings.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=min_words, by=("line",)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, want.get((i, zlib.crc32((t or "").encode())), t)) for i, t in rows), key=repr)


def test_lines_and_sentences_give_the_spans_of_both(spark):
    whole = "A line of several sentences. Each is new here, but not there! So the whole line goes as it stands once more"
    inner = "This sentence stands inside of other lines and has more than twenty words, which is what it takes to be cut out of them today."
    rows = [(1, f"{whole}\n{inner} First."), (2, f"top\n{whole.upper()}.\nend"), (3, f"Here before. {inner} And after.")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda by: sorted((r.doc_id, r.start, r.length, r.words) for r in substrings.repeats(table, by=by).collect())
    line, sentence = (2, 4, len(whole) + 1, len(whole.split())), (3, 13, len(inner), len(inner.split()))
    assert spans(("line",)) == [line] and spans(("sentence",)) == spans(substrings.BOTH) == [line, sentence]
    # Sentences that stand in other orders are no line; a line of short sentences is.
    rows = [(1, "One two. Three four. Five six."), (2, "x\nOne two. Three four. Five six.\ny"), (3, "Five six. One two. Three four.")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.text for r in substrings.remove(table, min_words=0, by=("line",)).orderBy("doc_id").collect()] == [rows[0][1], "x\n\ny", rows[2][1]]


def brute_cut(rows, min_words, min_documents):
    """What stays of every text, by plain loops over the units (None ids take no part)."""
    texts = {(i, zlib.crc32(t.encode()), t) for i, t in rows if i is not None and t}
    place, owners = {}, {}
    for i, c, t in sorted(texts):
        for k, (_, _, _, key) in enumerate(brute_units(t)):
            place.setdefault(key, (i, c, k))
            owners.setdefault(key, set()).add((i, c))
    out = {}
    for i, c, t in texts:
        gone, run = set(), []
        for k, (a, b, n, key) in enumerate([*brute_units(t), (0, 0, 0, None)]):
            if key is not None and len(owners[key]) >= min_documents and place[key] != (i, c, k):
                run.append((a, b, n))
                continue
            if run and sum(r[2] for r in run) >= min_words:
                gone |= set(range(run[0][0], run[-1][1]))
            run = []
        out[i, c] = "".join(x for at, x in enumerate(t) if at not in gone)
    return out


def brute_units(t, least=4):
    """(start, stop, words, key): sentences of each line; short ones have their neighbours in their keys."""
    out = []
    for n, line in enumerate(re.finditer(r"[^\n]+", t)):
        alone = len(line[0].split()) < least
        for m in substrings._SENTENCE.finditer(line[0]):
            out.append((line.start() + m.start(), line.start() + m.end(), " ".join(m[0].lower().split()).rstrip(".!?"), n, alone))
    got = []
    for k, (a, b, own, line, alone) in enumerate(out):
        around = ["", ""]
        for side, at in enumerate((k - 1, k + 1)):
            if 0 <= at < len(out) and (alone or out[at][3] == line):
                around[side] = out[at][2]
        words = len(t[a:b].split())
        got.append((a, b, words, own if words >= least else (around[0], own, around[1])))
    return got


@pytest.mark.parametrize(("min_words", "min_documents"), [(20, 2), (0, 2), (0, 1), (8, 3)])
def test_kept_text_is_that_of_brute_force(spark, min_words, min_documents):
    rng = random.Random(21)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))) + rng.choice([".", "!", "", "?.."]) for _ in range(40)]
    rows = []
    for i in range(40):
        parts = [rng.choice(pool) if rng.random() < 0.7 else text(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 25))]
        rows.append((i, "".join(p + rng.choice([" ", "\n", "\n\n", "  \t"]) for p in parts)))
    rows += [(3, rows[3][1]), (4, rows[5][1] + " more"), (50, rows[7][1].upper()), (51, None), (52, ""), (53, " \n\t"), (54, text(rng, 3000) + "\n" + rows[9][1]), (None, rows[6][1])]
    want = brute_cut(rows, min_words, min_documents)
    names = "doc_id long, text string, _id long, _sum long, _spans string, _checksum long, Text_Sum int, cuts int, cut_id int, cut_sum int, n_chars int"
    table = spark.createDataFrame([(i, t, 1, 2, "s", 3, 4, 5, 6, 7, -1) for i, t in rows], names).repartition(3)
    got = substrings.remove(table, min_words=min_words, min_documents=min_documents)
    assert got.columns == table.columns
    mine = got.collect()
    left = {(i, t and zlib.crc32(t.encode())): want.get((i, zlib.crc32((t or "").encode())), t) for i, t in rows}
    assert sorted(((r.doc_id, r.text) for r in mine), key=repr) == sorted(((i, left[i, t and zlib.crc32(t.encode())]) for i, t in rows), key=repr)
    assert all(tuple(r)[2:10] == (1, 2, "s", 3, 4, 5, 6, 7) for r in mine)
    originals = {i: t for i, t in rows}
    assert all(r.n_chars in (-1, len(r.text or "")) and (r.text == originals[r.doc_id]) <= (r.n_chars == -1) for r in mine if r.doc_id not in (3, 4))


def test_unique_text_between_repeats_stays(spark):
    head, foot = "This header of ten words stands on top of pages", "This footer of ten words stands at end of pages"
    body = "\n".join(f"own {i}" for i in range(30))
    short = " ".join(f"W{i}A.!! X{i} B!!" for i in range(20))
    rows = [(1, f"{head}\n{foot}"), (2, f"{head}\n{body}\n{foot}"), (3, f"Something first here now.\n{short}\nThen one more line."), (4, f"Another text begins here.\n{short}\nIt ends."), (5, "go. " * 50)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in substrings.remove(table).collect()}
    assert all(got[i] == t for i, t in rows if i in (1, 2, 3, 5))
    assert got[4] == "Another text begins here.\n\nIt ends."
    ten = spark.createDataFrame([(1, head), (2, f"Other words here now\n{head}")], "doc_id long, text string")
    assert [r.text for r in substrings.remove(ten, min_words=0).orderBy("doc_id").collect()] == [head, "Other words here now\n"]
    inside = [r.text for r in substrings.remove(table, min_documents=1, min_words=0).collect() if r.doc_id == 5]
    assert inside[0].split() == ["go."] * 3  # the first, one between such neighbours, and the last


def brute_tiling(item, doc, least):
    """The textbook greedy tiling: longest common unmarked run first."""
    free_i, free_t, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while i + n < len(item) and t + n < len(doc) and item[i + n] == doc[t + n] and free_i[i + n] and free_t[t + n]:
                    n += 1
                best = max(best, (n, -i, -t))
        n, i, t = best[0], -best[1], -best[2]
        if n < least:
            return total
        for k in range(n):
            free_i[i + k] = free_t[t + k] = False
        total += n


def test_tiling_covers_what_the_textbook_does():
    rng = random.Random(2)
    for _ in range(60):
        item, doc = ([rng.randint(1, 5) for _ in range(rng.randint(5, 25))] for _ in range(2))
        doc += item[len(item) // 2 :] + [9] + item[: len(item) // 2]
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert abs(sum(n for _, _, n in got) - brute_tiling(item, doc, 3)) <= 2  # ties may be marked in another order
        for i, t, n in got:
            assert item[i : i + n] == doc[t : t + n]


def test_contamination_finds_leaks_and_reordered_ones(spark, docs, empty):
    item = "one two three four five six seven eight nine ten eleven twelve"
    swapped = "seven eight nine ten eleven twelve and one two three four five six"
    han = "\u6771\u4eac\u90fd\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3059"
    rows = [(1, f"x y {item.upper()}, z"), (2, swapped), (3, "one two three four five and no more"), (4, None), (5, ""), (None, item), (6, f"before {han} after"), (7, han[:4]), (8, "it is too, short"), (9, "too far short")]
    names = "doc_id long, text string, _id int, _sum int, found_id int, Found_Sum int, checksum int, item int"
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], names).repartition(2)
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short"), (11, han), (12, "?!")], "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contaminated(table, bench).drop("checksum").collect()), key=repr)
    assert got == [(1, 7, 12, 12, 1, 1.0), (2, 7, 12, 12, 2, 1.0), (6, 11, 11, 11, 1, 1.0), (8, 10, 2, 2, 1, 1.0), (None, 7, 12, 12, 1, 1.0)]
    left = decontaminate.remove(table, bench)
    assert left.columns == table.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7, 9]
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0


def test_contamination_matches_brute_force(spark):
    rng = random.Random(17)
    vocabulary = WORDS[:9]
    run = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, run(rng.randint(1, 24))) for k in range(12)]
    docs = []
    for i in range(40):
        words = run(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1]
            at, cut = rng.randint(0, len(words)), rng.randint(0, len(own))
            words[at:at] = own[cut:] + own[:cut]
        docs.append((i, words))
    docs += [(3, docs[3][1]), (100, run(4000) + items[0][1])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect())
    want, near = Counter(), Counter()
    for i, words in docs[:-1]:
        for k, own in items:
            least = min(5, len(own))
            n = brute_tiling(own, words, least)
            want[i, k] += n >= 0.5 * len(own)
            near[i, k] += abs(n - 0.5 * len(own)) <= 2  # ties may be marked in another order
    mine = {key: n for key, n in got.items() if key[0] != 100}
    assert {k: n for k, n in want.items() if n and not near[k]}.items() <= mine.items() and all(want[k] or near[k] for k in mine)
    assert got[100, 0] == 1


def test_toxicity_learns_from_positives_and_unlabelled(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = text(rng, 40).split()
        if toxic:
            words[3:3] = rng.sample(["zorgle", "blarg", "grumph", "snork"], 2)
        rows.append((i, " ".join(words)))
        if toxic and i % 3:
            labels.append((i, 1))
    table, lab = spark.createDataFrame([*rows, (None, "zorgle blarg"), (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(table, lab).collect()}
    assert len(got) == 403
    held = [r for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert got[900].predicted == got[901].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.reject(docs, lab.filter("false")).count() == docs.count()
    assert toxicity.judge(empty, lab).count() == 0
    clash = docs.withColumn("toxicity_score", F.lit(7)).withColumn("_own_score", F.lit(8)).withColumn("slots", F.lit(9)).withColumn("z", F.lit(1))
    assert toxicity.reject(clash, lab).columns == clash.columns


def test_repeated_and_long_texts_train_once(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, 30) + (" zorgle blarg" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 8)], "doc_id long, toxic int")
    plain = {r.doc_id: r.score for r in toxicity.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    model, _ = toxicity.fit(spark.createDataFrame(rows + [rows[8]] * 3, "doc_id long, text string"), labels)
    assert len(model.names) and plain[8] >= 0.5 > plain[9]
    long = [(500, text(rng, 30_000)), (501, text(rng, 30_000) + " zorgle blarg"), (502, rows[9][1])]
    got = {r.doc_id: r for r in toxicity.judge(spark.createDataFrame(rows + long, "doc_id long, text string"), labels).collect()}
    assert got[500].predicted == 0 and got[501].predicted == 1 and got[502].score == got[9].score


def test_risk_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(3)
    p, u = ([np.flatnonzero(rng.random(6) < q) for _ in range(n)] for n, q in ((9, 0.6), (25, 0.3)))
    flat = lambda r: (np.repeat(np.arange(len(r)), [len(x) for x in r]), np.concatenate(r))
    for prior, sign in ((0.1, 1), (0.9, -1)):  # a small prior leaves the second term positive, a large one does not
        w, b = rng.random(6), -1.0 if sign > 0 else -6.0
        at = lambda w, b: toxicity.risk(w, b, *flat(p), len(p), *flat(u), len(u), prior)  # noqa: E731, B023
        positive, negative, g, g_b = at(w, b)
        z_p, z_u = (np.array([b + w[x].sum() for x in r]) for r in (p, u))
        assert np.isclose(positive, prior * np.mean(np.log1p(np.exp(-z_p)))) and np.isclose(negative, np.mean(np.log1p(np.exp(z_u))) - prior * np.mean(np.log1p(np.exp(z_p))))
        target = (lambda w, b: sum(at(w, b)[:2])) if negative >= 0 else (lambda w, b: -at(w, b)[1])  # noqa: B023
        for k in range(6):
            e = np.eye(6)[k] * 1e-6
            assert abs((target(w + e, b) - target(w - e, b)) / 2e-6 - g[k]) < 1e-6
        assert abs((target(w, b + 1e-6) - target(w, b - 1e-6)) / 2e-6 - g_b) < 1e-6


def test_gradients_are_those_of_the_loss():
    net = langid.Network.fresh(["a", "b", "c"], 4, 1)
    for part in (net.forward, net.backward):
        for k in part:
            part[k] = part[k].astype(np.float64)
    net.out = net.out.astype(np.float64)
    rng = np.random.default_rng(0)
    data, target = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5)
    _, d_f, d_g, d_out = net.gradients(data, target)
    for p, g in ((net.forward["u"], d_f["u"]), (net.forward["x"], d_f["x"]), (net.backward["b"], d_g["b"]), (net.out, d_out)):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-3
        up = net.gradients(data, target)[0]
        p[i] = old - 1e-3
        down = net.gradients(data, target)[0]
        p[i] = old
        assert abs(g[i] - (up - down) / 2e-3) < 1e-4


def test_probabilities_do_not_depend_on_padding():
    net = langid.Network.fresh(["a", "b"], 6, 2)
    raw = np.frombuffer(b"a short text", np.uint8)
    padded = np.zeros((2, langid.WINDOW), np.uint8)
    padded[0, : len(raw)], padded[1] = raw, 65
    got = net.probabilities(padded, np.array([len(raw), langid.WINDOW]))
    alone = net.probabilities(raw[None, :], np.array([len(raw)]))
    assert np.allclose(got[0], alone[0], atol=1e-4) and np.isclose(got[0].sum(), len(raw), atol=1e-3)


def plain_network(net, raw):
    """The network's mean language probabilities of one window, byte by byte, in plain Python."""
    import math

    sig = lambda v: 1 / (1 + math.exp(-v))

    def states(p, data):
        dim = len(p["b"])
        h, out = [0.0] * dim, []
        for byte in data:
            a, s = p["x"][byte], [sum(h[j] * float(p["u"][j][k]) for j in range(dim)) for k in range(3 * dim)]
            r, z = ([sig(float(a[g * dim + k]) + s[g * dim + k]) for k in range(dim)] for g in (0, 1))
            new = [math.tanh(float(a[2 * dim + k]) + r[k] * (s[2 * dim + k] + float(p["b"][k]))) for k in range(dim)]
            h = [(1 - z[k]) * new[k] + z[k] * h[k] for k in range(dim)]
            out.append(h)
        return out

    total = [0.0] * len(net.languages)
    for f, g in zip(states(net.forward, raw), states(net.backward, raw[::-1])[::-1]):
        both = [*f, *g, 1.0]
        logits = [sum(v * float(net.out[k][c]) for k, v in enumerate(both)) for c in range(len(total))]
        e = [math.exp(v) for v in logits]
        total = [t + v / sum(e) for t, v in zip(total, e)]
    return total


def test_predictions_match_a_plain_network():
    net, rng = langid.Network.fresh(["a", "b", "c"], 5, 3), random.Random(2)
    texts = [text(rng, n) for n in (1, 7, 30, 400)] + ["é" * 60, "x", None, "123"]
    langs, scores = langid.predict_texts(net, texts)
    for t, lang, score in zip(texts, langs, scores):
        if not t or not re.search("[^\\W\\d_]", t):
            assert (lang, score) == ("und", 0.0)
            continue
        raw = t.encode()
        parts = [plain_network(net, raw[k : k + langid.WINDOW]) for k in range(0, len(raw), langid.WINDOW)]
        total = [sum(p[c] for p in parts) for c in range(3)]
        assert abs(score - max(total) / sum(total)) < 1e-3 and lang == "abc"[total.index(max(total))]


def test_training_takes_each_id_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_DOCS", 10)
    rng = random.Random(1)
    rows = [(i, text(rng, 20), ["en", "fr"][i % 2]) for i in range(300)] + [(0, "zz " * 30, "en")] * 500
    got = langid.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert {lang for lang, _ in got} == {"en", "fr"} and len(got) <= 2 * 10 * langid.WINDOWS_PER_DOC


def test_language_is_learned_and_held_out(spark, empty):
    rng = random.Random(6)
    alphabet = {"aa": "abcdefg", "bb": "nopqrst"}
    rows = [(i, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(2, 8))) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "123 456", "bb"), (502, "", None), (None, rows[0][1], "bb")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(table).collect()}
    assert len(got) == 124
    held = [r for i, r in got.items() if i is not None and i < 120 and r.held_out]
    assert held and all(r.lang_pred == ["aa", "bb"][r.doc_id % 2] for r in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502)) and got[None].lang_pred == "aa"
    assert all(r.lang_pred == "und" for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify(empty).count() == 0


def test_units_are_sent_once_to_those_of_their_digest_and_spans_are_not_broadcast(spark):
    line = " ".join(f"word{k}" for k in range(30)) + "."
    docs = spark.createDataFrame([(k, f"{line} own {k} here now.") for k in range(4)], "doc_id long, text string")
    plan = substrings.repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(h1") == 1
    assert "BroadcastHashJoin" not in substrings.remove(docs)._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.start, r.words) for r in substrings.repeats(docs, min_documents=3).collect()) == [(1, 0, 30), (2, 0, 30), (3, 0, 30)]
