"""Repeated passages across documents, by hashing lines and their sentences.

Units are lines and, since passages also stand inside lines, the sentences of each line, which part a text without gaps. A
unit is normalised (lower case, white space collapsed, closing punctuation dropped) and digested to 128 bits; lines and sentences have digests apart. A sentence of fewer than ``min_unit`` words is digested with its neighbours
in the line, or, if the whole line has so few, with those around it. Digests are grouped globally. A digest that stands
in ``min_documents`` documents is repeated: the occurrence that comes first by (doc_id, place) stays and every other
one is a repeat. A repeated line is a repeat of all its sentences. A run of neighbouring repeats of at least ``min_words`` words
is cut out. Only units that were compared are cut, and each of them stays somewhere before. Results hold the original
offsets, in code points. ``by`` names the units that are compared: line, sentence, or both. ``min_words=0`` cuts every
repeat (as many more spans as there are short repeated lines, at the same cost of hashing); ``min_documents=1`` also those
inside one document, which are otherwise left to the quality rules.

Defined cases: null, empty and blank texts have no unit and stay as they are; very long texts are read whole; rows with
a null id take no part and stay whole; ties (equal units of one document) rank by their place; repeated rows (same id
and text) are one document, so neither loses what the other has; rows of one id with other texts are documents of
their own and rank by the text's checksum; an empty table gives an empty result; other columns pass through, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.common import fresh_name, frugal, materialise, temporary

#: From a character that is not white space to the end of the sentence or line.
_SENTENCE = re.compile(r"\S[^.!?\n]*(?:[.!?]+(?=[^\s.!?])[^.!?\n]*)*[.!?]*")
#: idx and n: the first sentence of a unit, and how many it has.
UNITS = "doc_id long, checksum long, idx int, n int, start int, stop int, words int, h1 long, h2 long"
BOTH = ("line", "sentence")


def units_of(text: str, min_unit: int, by: tuple[str, ...]) -> list[tuple[int, int, int, int, int, str]]:
    """(first sentence, sentences, start, stop, words, what is digested) of each unit."""
    spans = [m.span() for m in _SENTENCE.finditer(text)]
    own = [text[a:b].lower().split() for a, b in spans]
    plain = [" ".join(words).rstrip(".!?") for words in own]
    lines = []  # the number of the first sentence of each line
    stop = -1
    for i, (a, _) in enumerate(spans):
        if a > stop:
            lines.append(i)
            stop = text.find("\n", a)
            stop = len(text) if stop < 0 else stop
    lines.append(len(spans))
    out = []
    for first, end in zip(lines, lines[1:], strict=False):
        if "line" in by:
            words = [w for i in range(first, end) for w in own[i]]
            out.append((first, end - first, spans[first][0], spans[end - 1][1], len(words), "\x00" + " ".join(words).rstrip(".!?")))
        if "sentence" not in by:
            continue
        alone = sum(len(own[i]) for i in range(first, end)) < min_unit
        for i in range(first, end):
            key = plain[i]
            if len(own[i]) < min_unit:
                left = plain[i - 1] if i and (alone or i > first) else ""
                right = plain[i + 1] if i + 1 < len(spans) and (alone or i + 1 < end) else ""
                key = f"{left}\n{key}\n{right}"
            out.append((i, 1, *spans[i], len(own[i]), key))
    return out


def units(docs: DataFrame, min_unit: int, by: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            size, rows, digests = 0, [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text or doc_id is None:
                    continue
                checksum = zlib.crc32(text.encode())
                for *unit, key in units_of(text, min_unit, by):
                    rows.append((doc_id, checksum, *unit))
                    digests.append(xxh3_128_digest(key))
                size += len(text)
                if size > 1_000_000:
                    yield pack(rows, digests)
                    size, rows, digests = 0, [], []
            yield pack(rows, digests)

    def pack(rows: list[tuple], digests: list[bytes]) -> pa.RecordBatch:
        at = np.array(rows, np.int64).reshape(-1, 7)
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        cols = [pa.array(np.ascontiguousarray(at[:, k])) for k in range(2)] + [pa.array(at[:, k].astype(np.int32)) for k in range(2, 7)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], names)

    names = [f.split()[0] for f in UNITS.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), UNITS)


def repeats(docs: DataFrame, min_unit: int = 4, min_words: int = 20, min_documents: int = 2, by: tuple[str, ...] = ("sentence",)) -> DataFrame:
    """doc_id, checksum (of the text), start, length, words: the passages to cut out."""
    # Units are sent once, to the others of their digest; the rows of one that is frequent wait in a buffer that spills.
    digest, place = Window.partitionBy("h1", "h2"), F.struct("doc_id", "checksum", "idx")
    placed = units(docs, min_unit, by).withColumn("first", F.min(place).over(digest)).withColumn("last", F.max(place).over(digest))
    # Repeated rows of a document count once: a digest is repeated if its first and last places differ.
    other = F.struct("first.doc_id", "first.checksum") != F.struct("last.doc_id", "last.checksum")
    repeated = placed.filter("first != last" if min_documents < 2 else other)
    if min_documents > 2:
        numbered = repeated.withColumn("number", F.dense_rank().over(digest.orderBy("doc_id", "checksum")))
        repeated = numbered.withColumn("documents", F.max("number").over(digest)).filter(F.col("documents") >= min_documents)
    found = repeated.filter(place != F.col("first"))
    # One row a document: as large as the document at most.
    own = found.groupBy("doc_id", "checksum").agg(F.sort_array(F.collect_set(F.struct("idx", (-F.col("n")).alias("less"), "start", "stop", "words"))).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, checksum, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                flat = found.values
                idx, less, start, stop, words = (flat.field(k).to_numpy() for k in range(5))
                n = -less
                # A sentence of a repeated line is part of it: what ends no later than something before it goes.
                reach = np.maximum.accumulate(np.append(0, (idx + n)[:-1]))
                top = np.flatnonzero((idx + n > reach) | (np.arange(len(idx)) == 0))
                idx, n, start, stop, words = (x[top] for x in (idx, n, start, stop, words))
                head = np.flatnonzero(np.append(True, idx[1:] != (idx + n)[:-1]))
                last = np.append(head[1:], len(idx)) - 1
                total = np.add.reduceat(words, head)
                out += [(doc_id, checksum, a, b - a, n) for a, b, n in zip(start[head].tolist(), stop[last].tolist(), total.tolist(), strict=True) if n >= min_words]
            at = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(at[:, k])) for k in range(5)], ["doc_id", "checksum", "start", "length", "words"])

    return own.mapInArrow(frugal(run), "doc_id long, checksum long, start long, length long, words long")


@temporary
def remove(docs: DataFrame, min_unit: int = 4, min_words: int = 20, min_documents: int = 2, by: tuple[str, ...] = ("sentence",)) -> DataFrame:
    """The documents without repeated passages; n_chars, where there is one, is the new length."""
    of_sum, of_id, key, cuts = (fresh_name(docs, n) for n in ("text_sum", "cut_id", "cut_sum", "cuts"))
    spans = materialise(repeats(docs, min_unit, min_words, min_documents, by), "spans").groupBy("doc_id", "checksum").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(cuts))
    keyed = docs.withColumn(of_sum, F.crc32(F.col("text").cast("string").cast("binary")))
    cut = spans.select(F.col("doc_id").alias(of_id), F.col("checksum").alias(key), cuts)
    # Spans grow with the documents, so they are not broadcast at any size.
    joined = keyed.join(cut.hint("merge"), (F.col("doc_id").cast("long") == F.col(of_id)) & (F.col(of_sum) == F.col(key)), "left")
    # What lies between spans, in code points: SQL substring counts from 1.
    stops = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda s: s["start"] + s["length"]))
    starts = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.length("text").cast("long")))
    kept = F.zip_with(stops, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    none = F.col(cuts).isNull()
    new = {"text": F.when(none, F.col("text")).otherwise(F.concat_ws("", kept))}
    out = joined.withColumns(new)
    for c in docs.columns:
        if c.lower() == "n_chars":
            out = out.withColumn(c, F.when(none, F.col(c)).otherwise(F.length("text")).cast(docs.schema[c].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
