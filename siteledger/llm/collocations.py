"""Phrase collocations by stripes.

Every word keys a stripe: a counter of the words that follow it, each with a counter of its own next words; the empty word
stands for the end of a piece. Tasks count FLUSH words at a time and emit one stripe a word; stripes of a word are shuffled
whole and merged elementwise. The stripes hold everything that is asked for: their entries are the phrases of two and of
three words, the sum of a stripe is how often its word occurs (whatever follows), an inner counter gives a phrase's most
frequent extension to the right, and the inner entries, taken by their last two words, that to the left.

A word that is followed by very many different words is a hot key. The entries sent are counted (by a hash of the word,
in slots of a few bytes), and stripes in slots of over HOT entries are split by the next word, so that no key
brings more than about HOT entries to a task.

Only entries of ``least`` occurrences go on after the merge: a phrase occurs no more often than its parts.
Scores are integers, from products of decimals of 38 digits; counts over 15 digits would raise an error.

Defined cases: null, empty and blank texts have no words; very long texts are counted whole, a part at a time, and phrases
across parts are not lost; repeated rows count each; ties in score go by the count and then by the phrase's
bytes; a null lang is ``und``, like the string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.common import frugal, materialise, shuffle_partitions

#: Words, different words, or bytes, that a task counts before it emits stripes; three numbers of words fit 63 bits.
FLUSH, FLUSH_WORDS, FLUSH_BYTES = 1_000_000, 400_000, 16 << 20
#: Bytes of a text that are split at once.
PART = 1 << 20
#: Entries of a key that one task merges.
HOT = 1 << 21
END = b"\xff"  # stands in no UTF-8 text
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_GAP = re.compile(rb"[ \xff]")
#: next: a line for each next word, with the words that follow both behind it; counts: a number for each of these.
STRIPES = "lang string, word string, next string, counts string, entries int, total long"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def parts(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text with A-Z lower-cased, END after each piece, a part at a time; and the bytes of the part."""
    plain, at = text.translate(_TO_WORDS), 0
    while at < len(plain):
        gap = _GAP.search(plain, at + PART) if at + PART < len(plain) else None
        stop = gap.start() if gap else len(plain)
        yield plain[at:stop].replace(END, b" \xff ").split(), stop - at
        at = stop
    yield [END], 0


def _counted(ids: np.ndarray, context: int, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the runs of n numbers that do not stand in ``context`` alone, with an END at most at their end."""
    last = max(len(ids) - n + 1, 0)
    fresh = np.arange(last) + n > context
    for k in range(n - 1):
        fresh &= ids[k : k + last] != 0
    key = np.zeros(int(fresh.sum()), np.int64)
    for k in range(n):
        key = key * base + ids[k : k + last][fresh]
    return np.unique(key, return_counts=True)


def _joined(lengths: np.ndarray, values: pa.Array, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values), by)


def count_stripes(ids: np.ndarray, context: int, words: pa.Array) -> list[pa.Array]:
    """The columns of STRIPES but lang, of an array of word numbers, where 0 is END.

    The first ``context`` numbers, two at most, were counted before.
    """
    base = len(words)
    pair, n_pair = _counted(ids, context, 2, base)
    triple, n_triple = _counted(ids, context, 3, base)
    inner = triple // base
    outer = np.union1d(pair, inner)  # where a count begins or ends, one may lack
    n_outer = np.zeros(len(outer), np.int64)
    n_outer[np.searchsorted(outer, pair)] = n_pair
    lengths = 1 + np.searchsorted(inner, outer, "right") - np.searchsorted(inner, outer, "left")
    head = np.zeros(len(outer) + len(triple), bool)
    head[np.cumsum(lengths) - lengths] = True
    number, count = np.empty(len(head), np.int64), np.empty(len(head), np.int64)
    number[head], number[~head] = outer % base, triple % base
    count[head], count[~head] = n_outer, n_triple
    lines, n_lines = _joined(lengths, words.take(pa.array(number)), " "), _joined(lengths, pa.array(count).cast(pa.string()), " ")
    word, start = np.unique(outer // base, return_index=True)
    sizes = np.diff(np.append(start, len(outer)))
    added = lambda x: np.add.reduceat(x, start) if len(start) else x
    return [words.take(pa.array(word)), _joined(sizes, lines, "\n"), _joined(sizes, n_lines, "\n"), pa.array(added(lengths).astype(np.int32)), pa.array(added(n_outer))]


def stripes(docs: DataFrame) -> DataFrame:
    """STRIPES: the stripes that tasks have counted, several a word."""

    names = [f.split()[0] for f in STRIPES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size, read = _Numbers({END: 0}), {}, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = pa.array(["", *(w.decode() for w in list(numbers)[1:])])
            for lang, lists in held.items():
                ids = np.concatenate(lists).astype(np.int64)
                columns = count_stripes(ids, context.get(lang, 0), words)
                for at in range(0, len(columns[0]), 10_000):
                    own = [c[at : at + 10_000] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own[0]), pa.string()), *own], names)

        context: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words, taken in parts(text.as_py() or b""):
                    if words:
                        held.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    size, read = size + len(words), read + taken
                    if size >= FLUSH or len(numbers) >= FLUSH_WORDS or read >= FLUSH_BYTES:
                        yield from flush()
                        known = list(numbers)
                        numbers, size, read = _Numbers({END: 0}), 0, 0
                        # Of the text that goes on, the last two words are known to the next count.
                        tail = [known[i] for i in np.concatenate(held[lang][-2:])[-2:].tolist()]
                        held = {lang: [np.fromiter(map(numbers.__getitem__, tail), np.int32, len(tail))]}
                        context = {lang: len(tail)}
        if held:
            yield from flush()

    text, lang = F.col("text").cast("string").cast("binary"), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(frugal(run), STRIPES)


def merged(sent: DataFrame, least: int) -> DataFrame:
    """lang, word, second, third, n: phrases of ``least`` and more; third is null for those of two words. sent: STRIPES, a written table."""
    slots = 4096 * shuffle_partitions(sent.sparkSession)
    slot = F.pmod(F.xxhash64("lang", "word"), F.lit(slots)).cast("int")
    load = sent.groupBy(slot.alias("slot")).agg(F.sum("entries").alias("load")).filter(F.col("load") > HOT)
    load = materialise(load.select("slot", F.ceil(2 * F.col("load") / HOT).cast("int").alias("split")), "hot")

    def lines(df: DataFrame, by: str, *keep: str) -> DataFrame:
        return df.select(*keep, F.inline(F.arrays_zip(F.split("next", by, -1).alias("next"), F.split("counts", by, -1).alias("counts"))))

    slotted = sent.select("lang", "word", "next", "counts", slot.alias("slot")).join(load, "slot", "left").drop("slot")
    whole = slotted.filter("split is null").drop("split").withColumn("part", F.lit(0))
    parts = lines(slotted.filter("split is not null"), "\n", "lang", "word", "split")
    parts = parts.select("lang", "word", "next", "counts", F.pmod(F.xxhash64(F.substring_index("next", " ", 1)), "split").cast("int").alias("part"))
    # Merging stays with the stripes' partitioning.
    dealt = whole.unionByName(parts).repartition("lang", "word", "part")
    line = lines(dealt, "\n", "lang", "word", "part").withColumn("second", F.substring_index("next", " ", 1)).filter("second != ''")
    entry = line.select("lang", "word", "part", "second", F.posexplode(F.arrays_zip(F.split("next", " ", -1).alias("w"), F.split("counts", " ", -1).alias("n"))).alias("at", "e"))
    entry = entry.select("lang", "word", "part", "second", F.when(F.col("at") > 0, F.col("e.w")).alias("third"), F.col("e.n").cast("long").alias("n")).filter("third is null or third != ''")
    return entry.groupBy("lang", "word", "part", "second", "third").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).drop("part")


def collocations(docs: DataFrame, least: int = 10, subsumed: int = 50, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of two or three words of each lang.

    Phrases occur ``least`` times or more. Those that stand inside a longer one with at least ``subsumed`` hundredths of
    their count are left out.
    """
    return scored(materialise(stripes(docs), "stripes"), least, subsumed, first)


def scored(sent: DataFrame, least: int, subsumed: int, first: int) -> DataFrame:
    """What collocations() returns, from the stripes (a written table)."""
    one = sent.groupBy("lang", "word").agg(F.sum("total").alias("f"))
    one = materialise(one, "totals")
    size = one.groupBy("lang").agg(F.sum("f").alias("n"))
    kept = materialise(merged(sent, least), "merged")
    pair = kept.filter("third is null").select("lang", F.concat_ws(" ", "word", "second").alias("phrase"), F.col("n").alias("f"))
    total = one.filter(F.col("f") >= least).withColumnRenamed("word", "phrase").unionByName(pair)
    two = F.col("third").isNull()
    found = kept.select(
        "lang",
        F.col("n").alias("a"),
        F.concat_ws(" ", "word", "second", "third").alias("phrase"),
        F.col("word").alias("head"),
        F.when(two, F.col("second")).otherwise(F.concat_ws(" ", "second", "third")).alias("suffix"),
        F.when(two, F.col("word")).otherwise(F.concat_ws(" ", "word", "second")).alias("prefix"),
        F.coalesce("third", "second").alias("next"),
        two.alias("two"),
    )
    longer = found.filter("not two")
    around = longer.select("lang", F.col("prefix").alias("phrase"), "a").unionByName(longer.select("lang", F.col("suffix").alias("phrase"), "a"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    parted = found.join(around, ["lang", "phrase"], "left").filter(~F.col("two") | F.coalesce(100 * F.col("around") < subsumed * F.col("a"), F.lit(True)))
    for part in ("head", "suffix", "prefix", "next"):
        parted = parted.join(total.select("lang", F.col("phrase").alias(part), F.col("f").alias(f"f_{part}")), ["lang", part])

    def cut(k, left: str, right: str) -> Column:
        exact = [f"cast({c} as decimal(15,0))" for c in ("a", left, right)]
        score = F.expr(f"(1000000BD * ({exact[0]} * {exact[0]})) div ({exact[1]} * {exact[2]})")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    after_one, before_last = cut(1, "f_head", "f_suffix"), cut(2, "f_prefix", "f_next")
    cuts = parted.select("lang", "phrase", "a", F.least(after_one, before_last).alias("cut"))
    phrases = cuts.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task ranks a whole one.
    near = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
