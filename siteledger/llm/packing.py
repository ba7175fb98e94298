"""Best-fit packing of token sequences, improved by a swap-based local search.

Tokenising tasks cut every document into pieces of at most ``capacity`` tokens and pass on lengths and digests only.
Pieces are dealt at random into groups of a bounded size. Each group is packed best-fit, largest first; then bins
that are not full exchange pieces (move, one for one, two for one) wherever that raises the sum of squared fills,
until a pass changes nothing. Bins that stay underfull are dissolved and dealt anew into fewer groups, round by
round, until one group is left, so that the loss does not grow with the number of groups. A group passes on half of
its pieces at most and closes its fullest bins beyond that, so every round has fewer groups than the one before.

Defined cases: null text packs as an empty document (its end token alone); very long texts are cut into pieces, none is
lost; ties (equal lengths) are packed in the order of their keys; repeated rows are packed each for
itself; rows with a null id are packed too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import frugal, materialise
from siteledger.llm.tokens import Encoder, default_vocabulary, encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first shorter one."""
    head = n % capacity or capacity
    return [(0, min(n, head))] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, memo: int = 350_000, keep: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, memo) if keep else Encoder(vocabulary, memo)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(enc.encode(text.as_py()), f"<u{enc.width}").astype("<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Largest first, each piece into the fullest bin that still takes it; bins are kept by free room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the sorted amounts of room that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        if not by_room[left]:
            bisect.insort(rooms, left)
        by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, donors: int = 24) -> list[list[int]]:
    """Exchanges between underfull bins that raise the squared fill, until a pass changes nothing.

    For the receiver a and the donor b, fill(a) >= fill(b), every exchange raises fill(a) by a gain of 1 to its free
    room and lowers fill(b) by as much, so the sum of squares rises. A receiver takes the exchange of the largest
    gain: one piece for nothing (move), one for a shorter one, or two for one. It looks at the ``donors`` emptiest
    bins only (the README has what that costs).
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        order = sorted((k for k, f in enumerate(fill) if 0 < f < capacity), key=lambda k: -fill[k])
        # Donors: the emptiest bins first; as many as one receiver can be served from.
        for at, a in enumerate(order):
            room = capacity - fill[a]
            if not room or not fill[a]:
                continue
            best: tuple[int, int, list[int], list[int]] | None = None
            for b in order[: at : -1][:donors]:
                if b == a or not fill[b] or fill[b] > fill[a]:
                    continue
                found = _exchange(bins[a], bins[b], size, room)
                if found and (best is None or found[0] > best[0]):
                    best = (found[0], b, found[1], found[2])
                    if best[0] == room:
                        break
            if best:
                gain, b, give, take = best
                bins[a] = [i for i in bins[a] if i not in give] + take
                bins[b] = [i for i in bins[b] if i not in take] + give
                fill[a] += gain
                fill[b] -= gain
                changed = True
    return [b for b in bins if b]


def _exchange(a: list[int], b: list[int], size: list[int], room: int) -> tuple[int, list[int], list[int]] | None:
    """The largest gain of at most ``room`` for a: (gain, what a gives, what a takes)."""
    donors = sorted((size[i], i) for i in b)
    ones = [d[0] for d in donors]
    best: tuple[int, list[int], list[int]] | None = None
    for give in [None, *a]:
        limit = room + (size[give] if give is not None else 0)
        at = bisect.bisect_right(ones, limit) - 1
        floor = limit - room
        if at >= 0 and ones[at] > floor and (best is None or ones[at] - floor > best[0]):
            best = (ones[at] - floor, [] if give is None else [give], [donors[at][1]])
        if best and best[0] == room:
            return best
    for give in a:  # two of b's for one of a's
        limit = room + size[give]
        lo, hi = 0, len(ones) - 1
        while lo < hi:
            s = ones[lo] + ones[hi]
            if s > limit:
                hi -= 1
                continue
            if s > size[give] and (best is None or s - size[give] > best[0]):
                best = (s - size[give], [give], [donors[lo][1], donors[hi][1]])
            lo += 1
        if best and best[0] == room:
            return best
    return best


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end_id: int = 2, group: int = 16384, memo: int = 350_000, keep: bool = True) -> DataFrame:
    """One row per piece with the sequence it is in and its place there.

    memo: units that a tokenising worker remembers; keep: whether it does so from task to task.
    """
    spark = docs.sparkSession
    all_pieces = materialise(pieces(docs, vocabulary or default_vocabulary(), capacity, end_id, memo, keep), "pieces")
    numbered = all_pieces.withColumn("key", F.monotonically_increasing_id())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = numbered.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("key") * 2).withColumn("offset", F.lit(0).cast("long"))
    rest, done, rounds = materialise(numbered.filter(F.col("length") < capacity), "open"), [full.select(columns)], 0
    while True:
        n = rest.count()
        if not n:
            break
        groups = -(-n // group)
        packed = materialise(_round(rest, groups, rounds, capacity, closing=groups == 1), f"packed{rounds}")
        done.append(packed.filter("closed").select(columns))
        if groups == 1:
            break
        rest, rounds = packed.filter("not closed").select(rest.columns), rounds + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("length", F.col("length").cast("long"))


def _round(rest: DataFrame, groups: int, round_: int, capacity: int, closing: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)  # the same packing whatever order the rows came in
        lengths = pdf["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        keys, seq, off, closed = pdf["key"].to_numpy(), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        left = len(pdf)
        for b in sorted(bins, key=lambda b: -int(lengths[b].sum())):  # the fullest first
            at = np.array(b)
            ends = np.cumsum(lengths[at])
            off[at] = ends - lengths[at]
            seq[at] = keys[at].min() * 2 + 1  # a piece is in one sequence only, so its key names the sequence
            if closing or ends[-1] >= capacity - capacity // 128 or 2 * left > len(pdf):
                closed[at] = True
                left -= len(b)
        return pdf.drop(columns="g").assign(sequence_id=seq, offset=off, closed=closed)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(run, f"{fields}, sequence_id long, offset long, closed boolean")
