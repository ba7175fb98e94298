"""Benchmark decontamination by greedy string tiling.

1. Documents and benchmark items are read as words (lower case, letters and digits); scripts without spaces between
   words are read character by character. Every run of ``min_match`` words of an item is a seed; an item of fewer
   words is a seed as a whole. A task hashes all windows of a document (Karp-Rabin, over the benchmark's own
   vocabulary) and joins them to the seeds, which are broadcast: the benchmark is dealt into blocks of at most
   BLOCK_WORDS words, each of which is held against all documents in turn.
2. Only the document's words around shared seeds are passed on, and only if the seeds cover enough of the item:
   tiles are made of seeds, so what the seeds leave uncovered no tiling can cover.
3. Candidates are joined to their item's words and tiled: the longest common runs of words not yet marked are
   found by running Karp-Rabin over falling lengths, marked, and so on down to ``min_match``. Tiles may lie in any
   order, so reordered passages are found. The share of the item's words in tiles is its coverage.

Defined cases: null and empty texts, and items without a word, match nothing; very long texts are read whole; ties of
equally long matches go to the first place of the item, then of the text; repeated rows give repeated results; rows
with a null id are judged too; empty tables give empty results; other columns are ignored, or passed through, whatever
their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import fresh_name, frugal

BLOCK_WORDS = 2_000_000
#: Pairs of equal windows that are looked at one by one; texts that repeat themselves have more.
PLACES = 20_000
#: Thai, Lao, Burmese, Khmer, kana, Han: no spaces between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_BASE = 0x9E3779B97F4A7C15 | 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n ids, modulo 2**64."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, base = np.zeros(m, np.uint64), np.uint64(_BASE)
        for k in range(n):
            out = out * base + ids[k : k + m]
    return out


def tiles(item: np.ndarray, text: np.ndarray, min_match: int, first: int = 20) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of a greedy tiling; id 0 never matches."""
    free_i, free_t = item > 0, text > 0
    out: list[tuple[int, int, int]] = []
    length = max(min_match, min(first, len(item)))
    while free_i.any() and free_t.any():
        queues = defaultdict(list)
        longest = _scan(item, text, free_i, free_t, length, queues)
        if longest > 2 * length:
            length = longest  # long matches: start anew with their length
            continue
        for n in sorted(queues, reverse=True):
            for i, t in queues[n]:
                if free_i[i] and free_t[t] and free_i[i : i + n].all() and free_t[t : t + n].all() and (item[i : i + n] == text[t : t + n]).all():
                    free_i[i : i + n] = free_t[t : t + n] = False
                    out.append((i, t, n))
        if longest:
            continue  # what a longer tile has left of a match may still be long enough
        if length == min_match:
            return out
        length = max(min_match, length // 2)
    return out


def _scan(item, text, free_i, free_t, length: int, queues) -> int:
    """Maximal matches of at least ``length`` unmarked words, by their length; the longest one's length."""
    at = defaultdict(list)
    run = np.convolve(free_t, np.ones(length, np.int64), "valid") == length if len(text) >= length else np.zeros(0, bool)
    hashes = rolling(text, length)
    for t in np.nonzero(run)[0].tolist():
        at[int(hashes[t])].append(t)
    own = rolling(item, length)
    if sum(len(at[h]) for h in own.tolist() if h in at) > PLACES:
        return _scan_repeats(own, np.where(run, hashes, ~hashes), np.convolve(free_i, np.ones(length, np.int64), "valid") == length, run, length, queues)
    longest = 0
    for i, h in enumerate(own.tolist()):
        if h not in at or not free_i[i : i + length].all():
            continue
        for t in at[h]:
            if not (item[i : i + length] == text[t : t + length]).all():
                continue
            if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                continue  # part of a match that began earlier
            n = length
            while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                n += 1
            queues[n].append((i, t))
            longest = max(longest, n)
    return longest


def _scan_repeats(own: np.ndarray, hashes: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, length: int, queues) -> int:
    """As _scan, for texts that repeat themselves: matches grow along their diagonals, for all places of the text at once."""
    grown = np.zeros(len(hashes) + 1, np.int64)  # windows of the match that ends at each place, one to the right
    longest = 0
    for i in range(len(own) + 1):
        if i < len(own) and free_i[i]:
            equal = (hashes == own[i]) & free_t
        else:
            equal = np.zeros(len(hashes), bool)
        going = np.append(equal, False)
        for t in np.flatnonzero((grown > 0) & ~going).tolist():
            n = int(grown[t])
            queues[n + length - 1].append((i - n, t - n))
            longest = max(longest, n + length - 1)
        grown = np.append(0, np.where(equal, grown[:-1] + 1, 0))
    return longest


class Seeds:
    """The seeds of one block of the benchmark, for lookups by arrays of hashes."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, owner, place = [], [], []
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint64)
            h = rolling(ids, min_match)
            if len(h):
                hashes.append(h)
                owner.append(np.full(len(h), len(self.items)))
                place.append(np.arange(len(h)))
                self.items.append((item_id, ids))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.sizes = np.array([len(ids) for _, ids in self.items], np.int64)

    def candidates(self, words: list[str], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the item, the text's word ids around the seeds it shares)."""
        get, m = self.vocabulary.get, self.min_match
        ids = np.array([get(w, 0) for w in words], np.uint64)
        h = rolling(ids, m)
        seen = np.unique(h)  # each seed once, however often the text has it
        lo, hi = np.searchsorted(self.hashes, seen, "left"), np.searchsorted(self.hashes, seen, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if not len(at):
            return
        # Seeds of m words cover m words each at most: items that cannot reach the threshold end here.
        shared = np.bincount(self.owner[at], minlength=len(self.items))
        may = shared * m >= threshold * self.sizes
        at = at[may[self.owner[at]]]
        for own in np.split(at[np.argsort(self.owner[at], kind="stable")], np.flatnonzero(np.diff(np.sort(self.owner[at]))) + 1):
            if not len(own):
                continue
            item = int(self.owner[own[0]])
            covered = np.zeros(int(self.sizes[item]), bool)
            in_text = np.flatnonzero(np.isin(h, self.hashes[own]))
            keep = np.zeros(len(ids), bool)
            for k in range(m):
                covered[self.place[own] + k] = True
                keep[in_text + k] = True
            if covered.sum() < threshold * len(covered):
                continue
            # Tiles are made of shared seeds, so the words between can go; a 0 keeps the parts apart.
            edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
            parts = [np.append(ids[a:b], np.uint64(0)) for a, b in edges.reshape(-1, 2)]
            yield item, np.concatenate(parts)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks that fit a broadcast: of at most BLOCK_WORDS words, or of one item with more.

    Items are dealt by hashes; a block that turns out too large is dealt once more. Only counts are known before a block is read.
    """
    unspaced = "[\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{3ffff}]"
    # Runs of letters and digits, and two more (itself and what follows) for each character of an unspaced script.
    words = F.regexp_count("text", F.lit(r"(?U)\w+")) + 2 * F.regexp_count("text", F.lit(unspaced))
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text != ''").withColumn("words", F.greatest(words, F.lit(1)))
    todo = [(sized, 0)]
    while todo:
        some, turn = todo.pop()
        whole = some.agg(F.sum("words").alias("words"), F.count("*").alias("n")).first()
        if not whole.n:
            continue
        if whole.words <= BLOCK_WORDS or whole.n == 1 or turn > 20:
            yield sorted((r.item_id, r.text) for r in some.select("item_id", "text").collect())
            continue
        n = -(-2 * whole.words // BLOCK_WORDS)
        part = F.pmod(F.xxhash64("item_id", "text", F.lit(turn)), F.lit(n))
        sums = some.groupBy(part.alias("part")).agg(F.sum("words").alias("words")).collect()  # a row a block
        # Neighbouring parts are read together as long as they fit.
        low, held = 0, 0
        for r in [*sorted(sums, key=lambda r: r.part), None]:
            if r is None or held and held + r.words > BLOCK_WORDS:
                todo.append((some.filter((part >= low) & (part < (r.part if r is not None else n))), turn + 1))
                low, held = (r.part if r is not None else n), 0
            held += r.words if r is not None else 0


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5) -> DataFrame:
    """doc_id, checksum (of the text), item_id, item_words, matched_words, tiles, coverage of each pair at or over the threshold."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("text").cast("string").cast("binary")).alias("checksum"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, checksum long, item_id long, item_words int, matched_words int, tiles int, coverage double")
    for block in blocks(benchmark):
        # Items shorter than min_match are seeds of their own length.
        by_length: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for item_id, text in block:
            by_length[min(min_match, len(words_of(text)))].append((item_id, text))
        seeds = [Seeds(items, n) for n, items in sorted(by_length.items()) if n]
        if seeds:
            out = out.unionByName(_against(rows, seeds, threshold))
    return out


def _against(rows: DataFrame, seeds: list[Seeds], threshold: float) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(seeds)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, checksum, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(text.as_py())
                for some in shared.value:
                    for item, ids in some.candidates(words, threshold):
                        out.append((doc_id, checksum, some.min_match, item, ids.astype("<u4").tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "checksum", "seed", "item", "found"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, checksum, seed, found, item_id, words in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "checksum", "seed", "found", "item_id", "words")), strict=True):
                item, text = (np.frombuffer(x, "<u4").astype(np.uint64) for x in (words, found))
                got = tiles(item, text, seed)
                matched = sum(n for _, _, n in got)
                if matched >= threshold * len(item):
                    out.append((doc_id, checksum, item_id, len(item), matched, len(got), matched / len(item)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            names = ["doc_id", "checksum", "item_id", "item_words", "matched_words", "tiles", "coverage"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    candidates = rows.mapInArrow(frugal(find), "doc_id long, checksum long, seed int, item long, found binary")
    listed = [(some.min_match, k, item_id, ids.astype("<u4").tobytes()) for some in seeds for k, (item_id, ids) in enumerate(some.items)]
    items = spark.createDataFrame(listed, "seed int, item long, item_id long, words binary")
    joined = candidates.join(F.broadcast(items), ["seed", "item"])  # a block's words are bounded by BLOCK_WORDS
    return joined.mapInArrow(frugal(tile), "doc_id long, checksum long, item_id long, item_words int, matched_words int, tiles int, coverage double")


def remove(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_match: int = 5) -> DataFrame:
    """The documents that hold no benchmark item."""
    of_id, of_text = fresh_name(docs, "found_id"), fresh_name(docs, "found_sum")
    found = contaminated(docs, benchmark, threshold, min_match).select(F.col("doc_id").alias(of_id), F.col("checksum").alias(of_text)).distinct()
    text_sum = F.crc32(docs["text"].cast("string").cast("binary"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(of_id)) & (text_sum == F.col(of_text)), "left_anti")
