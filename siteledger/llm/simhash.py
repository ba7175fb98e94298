"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A fingerprint of 64 majority bits is computed for each whole text in one pass; equal fingerprints are one node.
2. Bits that go together are grouped into partitions (greedily, by the correlation matrix of all fingerprints).
3. If thresholds t_i over m partitions add up to d - m + 1, two fingerprints within d bits agree within t_i bits
   in some partition i (t_i = -1 leaves a partition out). The thresholds, and m, are those of the least
   estimated number of candidates, by dynamic programming over second-moment sketches of all partition values.
4. Fingerprints probe the partition tables (with every variant of up to t_i bits); candidates are verified on all
   bits. What a value's fingerprints hand on grows with their number, never with its square: a few are joined, up to
   BLOCK are compared in one task that returns a spanning forest, and more are linked through the points between them
   (two fingerprints are within 2r bits of each other just if some point is within r bits of both).
5. Components come from label propagation with pointer jumping on the links.

Distances go from 0 to MAX_DISTANCE; others raise ValueError.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; very long texts are read
whole; repeated rows share their fingerprint; ties (equal fingerprints, equal texts) are one node, and the smallest id
names or survives it; rows with a null id are part of the groups, whose id is the smallest id that is not null; an
empty table gives an empty result; other columns are ignored, or passed through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm import setjoin
from siteledger.llm.common import fresh_name, frugal, materialise, temporary
from siteledger.llm.components import components

ALL_BITS = 64
MAX_DISTANCE = 4
#: More variants of a partition's value than this are never sent.
MAX_VARIANTS = 300
#: Fingerprints of one value that one task compares.
BLOCK = 1024
#: Counters of a partition's sketch.
SKETCH = 2048


# -- fingerprints -------------------------------------------------------------------------------------------


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is 1 if over half of the hashes have it."""
    total = np.zeros(ALL_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def shingles(text: str | None, n: int) -> list[bytes]:
    """The n-word shingles of the text with A-Z lower-cased, repeats included; fewer words are one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return words
    line = b" ".join(words)
    if len(words) <= n:
        return [line]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [line[a : b - 1] for a, b in zip(starts, starts[n:], strict=False)]


def shingle_fingerprint(text: str | None, n: int, seed: int) -> int:
    from xxhash import xxh64_intdigest

    return majority_bits(np.array([xxh64_intdigest(s, seed) for s in shingles(text, n)], np.uint64))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Another hash, by the seed, of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 100_000:
            self.clear()
        got = self[word] = xxh64_intdigest(word)
        return got


def word_fingerprints(text: str | None, seeds: int, hash_of: dict[bytes, int]) -> list[int]:
    """A fingerprint for each seed, of single words; a word that occurs c times weighs 1 + log c."""
    tally = Counter((text or "").encode().lower().split())
    if not tally:
        return [0] * seeds
    hashes = np.fromiter(map(hash_of.__getitem__, tally), np.uint64, len(tally))
    weights = 1 + np.log(np.fromiter(tally.values(), np.float32, len(tally)))
    half = weights.sum() / 2
    out = []
    for seed in range(seeds):
        total = np.zeros(ALL_BITS, np.float32)
        mixed = mix(hashes, seed)
        for at in range(0, len(mixed), 1 << 16):
            total += weights[at : at + (1 << 16)] @ np.unpackbits(mixed[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(int.from_bytes(np.packbits(total > half).tobytes(), "big"))
    return out


def _fingerprints(rows: DataFrame, count: int, of) -> DataFrame:
    """rows: text first, then columns to keep; of(): a function from text to ``count`` fingerprints. Adds fp0, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = of()
        for batch in batches:
            got = np.array([make(text.as_py()) for text in batch.column(0)], np.uint64).reshape(-1, count)
            cols = [pa.array(np.ascontiguousarray(got[:, k]).view(np.int64)) for k in range(count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names)

    kept = rows.schema.fields[1:]
    names = [*(f.name for f in kept), *(f"fp{k}" for k in range(count))]
    return rows.mapInArrow(frugal(run), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), *(f"fp{k} long" for k in range(count))]))


def _id_and_text(docs: DataFrame) -> list[Column]:
    return [F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")]


# -- partitions and thresholds ------------------------------------------------------------------------------


def correlations(nodes: DataFrame) -> dict[int, np.ndarray]:
    """seed -> correlation of all 64 bits over all its fingerprints; tasks send 65 x 65 sums, whatever they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            seeds, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for seed in np.unique(seeds).tolist():
                fp = fps[seeds == seed]
                for at in range(0, len(fp), 1 << 14):
                    bits = np.unpackbits(fp[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    x = np.ones((len(bits), ALL_BITS + 1), np.float64)
                    x[:, :ALL_BITS] = bits
                    sums[seed] = sums.get(seed, 0) + x.T @ x
        for seed, total in sums.items():
            i, j = np.nonzero(np.triu(total))
            cols = [np.full(len(i), seed, np.int32), i.astype(np.int32), j.astype(np.int32), total[i, j].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["seed", "i", "j", "n"])

    out: dict[int, np.ndarray] = {}
    for r in nodes.mapInArrow(frugal(run), "seed int, i int, j int, n long").groupBy("seed", "i", "j").agg(F.sum("n").alias("n")).collect():
        got = out.setdefault(r.seed, np.zeros((ALL_BITS + 1, ALL_BITS + 1)))  # 65 x 65 / 2 a seed at most
        got[r.i, r.j] = got[r.j, r.i] = r.n
    for seed, sums in out.items():
        n = max(sums[-1, -1], 1)
        mean = sums[-1, :-1] / n
        cov = sums[:-1, :-1] / n - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        out[seed] = cov / np.outer(sd, sd)
    return out


def correlated_partitions(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each grows from the free bit most tied to the others by the bits most tied to it."""
    tied = np.abs(corr) - np.eye(len(corr)) * np.abs(corr)
    free, out = list(range(len(corr))), []
    for k in range(m):
        width = (len(corr) - sum(map(len, out))) // (m - k)
        group = [max(free, key=lambda b: (tied[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            nxt = max(free, key=lambda b: (tied[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the least summed cost that add up to total, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, more in cost.items():
                if s + t not in nxt or c + more < nxt[s + t][0]:
                    nxt[s + t] = (c + more, [*ts, t])
        best = nxt
    return best.get(total, (float("inf"), []))


def mask_of(bits: list[int] | tuple[int, ...]) -> int:
    """As a signed long."""
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of all ways to flip up to ``most`` of the bits, none first."""
    return [mask_of(c) for n in range(most + 1) for c in combinations(bits, n)]


def second_moments(nodes: DataFrame, masks: dict[int, list[int]]) -> dict[tuple[int, int], tuple[float, float]]:
    """(seed, number of the mask) -> fingerprints, and the sum of squared counts of their masked values.

    Every task adds a random sign a value to one of SKETCH counters; the squares of the counters' sums over all tasks
    add up to an estimate of the second moment (with an error of some 3 %) of all values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            seeds, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for seed in np.unique(seeds).tolist():
                fp = fps[seeds == seed]
                for k, mask in enumerate(masks[seed]):
                    h = mix(fp & np.array(mask, np.int64).view(np.uint64), k)
                    got = sums.setdefault((seed, k), np.zeros(SKETCH + 1, np.int64))
                    signs = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
                    got[:-1] += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), signs, SKETCH).astype(np.int64)
                    got[-1] += len(fp)
        for (seed, k), got in sums.items():
            at = np.nonzero(got)[0]
            cols = [np.full(len(at), seed, np.int32), np.full(len(at), k, np.int32), at.astype(np.int32), got[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["seed", "k", "slot", "n"])

    added = nodes.mapInArrow(frugal(run), "seed int, k int, slot int, n long").groupBy("seed", "k", "slot").agg(F.sum("n").alias("n"))
    squares = F.sum(F.when(F.col("slot") < SKETCH, F.col("n").cast("double") * F.col("n")))
    found = added.groupBy("seed", "k").agg(F.max(F.when(F.col("slot") == SKETCH, F.col("n"))).alias("n"), squares.alias("f2")).collect()
    return {(r.seed, r.k): (float(r.n or 0), float(r.f2 or 0)) for r in found}


def plan(nodes: DataFrame, distance: int) -> dict[int, list[tuple[list[int], int]]]:
    """seed -> (bits, threshold) of each partition that is probed. nodes: seed, fp."""
    corr = correlations(nodes)
    groups = {seed: {m: correlated_partitions(c, m) for m in range(2, distance + 4)} for seed, c in corr.items()}
    numbered = {seed: [(m, i) for m, parts in g.items() for i in range(len(parts))] for seed, g in groups.items()}
    measured = second_moments(nodes, {seed: [mask_of(groups[seed][m][i]) for m, i in at] for seed, at in numbered.items()})
    out = {}
    for seed, g in groups.items():
        best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
        for m, parts in g.items():
            costs = []
            for i, bits in enumerate(parts):
                n, f2 = measured.get((seed, numbered[seed].index((m, i))), (0.0, 0.0))
                pairs = max(f2 - n, 0.0) / 2
                spread = n * n / 2.0 ** len(bits) / 2  # of a neighbouring value, as if values were spread evenly
                cost = {-1: 0.0}
                for t in range(distance + 1):
                    variants = len(flips(bits, t)) if t < 3 else MAX_VARIANTS + 1
                    if variants > MAX_VARIANTS:
                        break
                    # A candidate costs 1, a row that is sent to a partition's table 20.
                    cost[t] = 20.0 * n * variants + pairs + (variants - 1) * max(spread, pairs / 4)
                costs.append(cost)
            cost, ts = allocate(costs, distance - m + 1)
            if ts and cost < best[0]:
                best = cost, [(bits, t) for bits, t in zip(parts, ts, strict=True) if t >= 0]
        out[seed] = best[1]
    return out


# -- probe and verify ---------------------------------------------------------------------------------------


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def labels_of(near: np.ndarray) -> np.ndarray:
    """The smallest place that links reach from each place; near: a symmetric matrix, true on its diagonal."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(distance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy()).view(np.uint64)  # a node may come as itself and as a variant
        label = labels_of(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance)
        at = np.nonzero(label != np.arange(len(fp)))[0]
        return pd.DataFrame({"seed": pdf["seed"].iloc[0], "a": fp.view(np.int64)[at], "b": fp.view(np.int64)[label[at]]})

    return run


def stars(nodes: DataFrame, distance: int) -> DataFrame:
    """seed, a, b: links with the components of all pairs of nodes (seed, fp) within the distance, through points.

    For 2r bits the points are those within r bits of a node; for 2r + 1 bits they are the edges between neighbouring
    points, one end of which is within r bits of a node. Each node is linked to the least node at each of its points.
    """
    masks = F.array(*[F.lit(m) for m in flips(list(range(ALL_BITS)), distance // 2)])
    sent = nodes.select("seed", "fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"), F.lit(-1).alias("edge"))
    if distance % 2:
        sent = sent.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(ALL_BITS - 1))))
        sent = sent.withColumn("at", F.expr("at & ~shiftleft(1L, edge)"))
    least = sent.groupBy("seed", "at", "edge").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).filter("b < last").drop("last")
    return sent.join(least, ["seed", "at", "edge"]).filter("fp != b").select("seed", F.col("fp").alias("a"), "b").distinct()


def links(nodes: DataFrame, distance: int, group: int = 16, block: int = BLOCK) -> DataFrame:
    """seed, a, b: links whose components are those of all pairs of fingerprints of a seed within the distance.

    nodes: distinct (seed, fp), a written table. Values that up to ``group`` fingerprints share are joined; up to
    ``block`` are compared in one task; beyond that points link them.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"a distance of 0 to {MAX_DISTANCE} bits is supported, not {distance}")
    probes = None
    for seed, parts in sorted(plan(nodes, distance).items()):
        keys = []
        for p, (bits, t) in enumerate(parts):
            value = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
            keys += [F.struct(F.lit(p).alias("part"), value.bitwiseXOR(F.lit(m)).alias("value"), F.lit(m == 0).alias("home")) for m in flips(bits, t)]
        probes = F.when(F.col("seed") == seed, F.array(*keys)) if probes is None else probes.when(F.col("seed") == seed, F.array(*keys))
    empty = nodes.sparkSession.createDataFrame([], "seed int, a long, b long")
    if probes is None:
        return empty
    sent = nodes.select("seed", "fp", F.explode(probes).alias("k")).select("seed", "fp", "k.*")
    key = ["seed", "part", "value"]
    sizes = sent.groupBy(*key).agg(F.count("*").alias("n"), F.max("home").alias("any_home")).filter("n >= 2 and any_home").drop("any_home")
    members = materialise(sent.join(sizes, key), "members")
    few = members.filter(F.col("n") <= group)
    a, b = few.filter("home").alias("a"), few.alias("b")
    same = (F.col("a.seed") == F.col("b.seed")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value"))
    same &= F.when(F.col("b.home"), F.col("a.fp") < F.col("b.fp")).otherwise(F.col("a.fp") != F.col("b.fp"))
    pairs = a.join(b, same & (differing(F.col("a.fp"), F.col("b.fp")) <= distance)).select("a.seed", F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    forest = members.filter((F.col("n") > group) & (F.col("n") <= block)).groupBy(*key).applyInPandas(_forest(distance), "seed int, a long, b long")
    many = members.filter(F.col("n") > block).select("seed", "fp").distinct()
    return pairs.unionByName(forest).unionByName(stars(many, distance)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach from a row."""
    rows = materialise(_fingerprints(docs.select(*_id_and_text(docs)), 1, lambda: lambda text: [shingle_fingerprint(text, shingle, 42)]), "fingerprints")
    nodes = materialise(rows.groupBy(F.lit(0).alias("seed"), F.col("fp0").alias("fp")).agg(F.min("doc_id").alias("least")), "nodes")
    labels = components(links(nodes.select("seed", "fp"), distance).select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "fp")
    labelled = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = materialise(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
    classes = materialise(labelled.join(smallest, "label").select(F.col("fp").alias("fp0"), "component_id"), "classes")
    return rows.join(classes, "fp0").select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies by the similarity of their texts -----------------------------------------------------------


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(s) for s in shingles(text, n)], np.uint64))


def similar(sets: list[np.ndarray], least: float, chunk: int = 4096) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of at least ``least``; two empty sets are the same."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, n = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    owner, at = owner[shared], (np.cumsum(n > 1) - 1)[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, chunk):
        a, b = np.searchsorted(at, [low, low + chunk])
        has = np.zeros((len(sets), chunk), np.float32)
        has[owner[a:b], at[a:b] - low] = 1
        both += has @ has.T
    np.fill_diagonal(both, sizes)
    return both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-9


def candidate_classes(prints: DataFrame, distance: int) -> DataFrame:
    """node, label: texts that fingerprints within the distance, of whichever seed, join. prints: node, seed, fp."""
    nodes = materialise(prints.groupBy("seed", "fp").agg(F.count("*").alias("n")), "nodes")
    found = materialise(links(nodes.select("seed", "fp"), distance), "links")
    used = found.select("seed", F.col("a").alias("fp")).union(found.select("seed", F.col("b").alias("fp"))).union(nodes.filter("n > 1").select("seed", "fp")).distinct()
    name = lambda fp: F.concat_ws(":", F.col("seed"), F.hex(fp))
    of_text = prints.join(used, ["seed", "fp"]).select(F.concat(F.lit("="), F.col("node").cast("string")).alias("src"), name("fp").alias("dst"))
    labels = components(found.select(name("a").alias("src"), name("b").alias("dst")).union(of_text))
    return labels.filter("node like '=%'").select(F.substring("node", 2, 30).cast("long").alias("node"), "label")


def verified_links(sets: DataFrame, sizes: DataFrame, least: float, size: int, weight: int) -> DataFrame:
    """src, dst: links with the components of all pairs in a class with a similarity of ``least`` and more.

    sets: label, node, shingles; sizes: label, node, words. Classes of up to ``size`` texts (and ``weight`` words) are
    compared in one task each, larger ones by the join of setjoin, which loses no pair either.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        nodes = pdf["node"].to_numpy()
        root = nodes[labels_of(similar([x.view(np.uint64) for x in pdf["shingles"]], least))]
        return pd.DataFrame({"src": nodes, "dst": root})[nodes != root]

    of_class = sizes.groupBy("label").agg(((F.count("*") <= size) & (F.sum("words") <= weight)).alias("small"))
    of_class = materialise(of_class, "classes")
    small = sets.join(of_class.filter("small"), "label").select("label", "node", "shingles").groupBy("label").applyInPandas(run, "src long, dst long")
    large = materialise(sets.join(of_class.filter("not small"), "label").select("label", "node", F.col("shingles").alias("members")), "large")
    return materialise(small, "compared").unionByName(setjoin.linked(large, least))


def digest() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


@temporary
def deduplicate(docs: DataFrame, seeds: int = 6, distance: int = 2, least: float = 0.8, size: int = 512, weight: int = 1_000_000) -> DataFrame:
    """The documents without all but one of each group: its row with the smallest doc_id stays.

    Near copies have a five-word Jaccard similarity of ``least`` and more. A single fingerprint of shingles puts them
    up to a dozen bits apart, too far to probe. So ``seeds`` independent fingerprints of single words are probed within
    ``distance`` bits each; what any of them joins is a class of candidates, and in a class all texts are compared
    by their sets of five-word shingles. Texts, not rows, are the nodes, so that copies cost nothing.
    Of repeated rows (same id and text) one stays; rows with a null id stay only if their group has no other.
    """

    def of():
        hash_of = _WordHashes()
        return lambda text: word_fingerprints(text, seeds, hash_of)

    chars = F.length(F.col("text").cast("string")).alias("chars")
    rows = materialise(_fingerprints(docs.select(*_id_and_text(docs), digest().alias("digest"), chars), seeds, of), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    fps = [F.min(f"fp{k}").alias(f"fp{k}") for k in range(seeds)]
    texts = rows.groupBy("digest").agg(F.min(first).alias("least"), F.max(F.coalesce(F.col("chars"), F.lit(0)) / 5).cast("long").alias("words"), *fps)
    texts = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    prints = texts.select("node", F.posexplode(F.array(*[f"fp{k}" for k in range(seeds)])).alias("seed", "fp"))
    classes = candidate_classes(prints, distance)
    several = classes.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    wanted = materialise(classes.join(several, "label").join(texts, "node").select("label", "node", "words", "digest", F.col("least.doc_id").alias("least_id")), "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = pa.array([shingle_set(t.as_py(), 5).view(np.int64) for t in part.column(2)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], ["label", "node", "shingles"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.col("text").cast("string").alias("text"))
    chosen = own.join(wanted.withColumnRenamed("digest", "of"), F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("digest") == F.col("of")))
    sets = materialise(chosen.select("label", "node", "text").mapInArrow(frugal(read), "label string, node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    labels = components(verified_links(sets, wanted.select("label", "node", "words"), least, size, weight))
    labelled = materialise(texts.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), F.struct("least.none", "least.doc_id", "digest").alias("first")), "labelled")
    kept = labelled.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    return _rows_of(docs, materialise(kept, "kept"), rows)


def _rows_of(docs: DataFrame, kept: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of the documents for each kept (doc_id, digest). rows: doc_id and digest of all of them."""
    key, of_id, of_text = (fresh_name(docs, n) for n in ("digest", "of_id", "of_text"))
    keyed = docs.withColumn(key, digest())
    twice = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "digest")
    twice = materialise(kept.join(twice, kept["doc_id"].eqNullSafe(twice["doc_id"]) & (kept["digest"] == twice["digest"]), "left_semi"), "twice")
    once = kept.join(twice, kept["doc_id"].eqNullSafe(twice["doc_id"]) & (kept["digest"] == twice["digest"]), "left_anti")

    def of(some: DataFrame) -> DataFrame:
        some = some.toDF(of_id, of_text)
        return keyed.join(some, F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_text)), "left_semi")

    # Repeated rows are combined in the tasks that read them; of rows that differ elsewhere that of the least hash stays.
    everything = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    single = of(twice).groupBy(F.col("doc_id").alias(of_id), F.col(key).alias(of_text)).agg(F.min_by(everything, F.xxhash64(F.to_json(everything))).alias(key)).select(f"{key}.*")
    return of(once).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(single)
