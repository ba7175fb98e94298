"""Hard negatives by Fagin's threshold algorithm, over shards of sorted candidate lists.

Vectors become integers, floor(scale * x). A row's score is its integer inner product with the anchor. Rows are dealt
by a hash of their id into shards of a bounded size; each shard keeps, for every dimension, the list of its rows sorted
by that component. For an anchor all lists of a shard are read together, each from the end that the sign of the
anchor's component asks for. A row that any list delivers is scored by random access. What the last row of each list
adds, summed, is the threshold: no row that is still unseen scores more. A window is done once the threshold falls
strictly below its kth score (ties are broken by the id, so an equal score may still count) or below its lower bound.

There are two such searches: the best rows of an anchor's own label are its positives, and each positive spans a
window of scores, ``low`` to ``high`` hundredths of its own, for rows of other labels. What a task has found in one shard
also bounds its search in the next; what tasks return, at most k rows a window, is ranked once more.

Anchors are taken in blocks of at most BLOCK_BYTES, which the driver hands to the tasks of a job over all shards. So
memory is bounded by a block and a shard, whatever the number of anchors, rows or labels.

Scores are exact: sums are taken in 32-bit floats while they stay under 2^24, in 64-bit floats under 2^53, beyond that in
Python's integers. Scores outside 64 bits cannot be returned: such a search raises OverflowError.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; an
empty vector scores 0; shorter vectors count as filled up with zeros; of rows with one id one takes part, that with the
least label and then the least vector; ties go to the smaller id; anchors without positives, and windows without rows,
give no row; an empty table gives an empty result; other columns, long texts among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.common import materialise

#: Components in a shard: 8,192 rows of 64 dimensions.
SHARD = 1 << 19
#: Bytes of anchors that one job searches for.
BLOCK_BYTES = 8 << 20
#: Rows that each list delivers before the threshold is first looked at; then four times as many each time.
FIRST_DEPTH = 48
SHARDS = "ids binary, labels binary, q binary, lists binary"
FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


class Span(NamedTuple):
    """A window of scores; None is open. positive: (id, score) of the row that spans it."""

    low: int | None
    high: int | None
    positive: tuple[int, int] | None


class Shard:
    """Rows and, for each dimension, their places sorted by the component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, lists: np.ndarray):
        self.ids, self.labels, self.q, self.lists = ids, labels, q, lists
        self.most = float(np.abs(q).max(initial=0))
        self.single = q.astype(np.float32) if self.most < 1 << 24 else None

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        reach = float(np.abs(anchor).sum()) * self.most  # no partial sum is larger
        if reach < 1 << 24 and self.single is not None:
            return (self.single[rows] @ anchor.astype(np.float32)).astype(np.int64)
        if reach < 1 << 53:
            return (self.q[rows] @ anchor).astype(np.int64)
        whole = [int(x) for x in anchor]
        return np.array([sum(int(x) * y for x, y in zip(self.q[r].tolist(), whole, strict=True)) for r in rows.tolist()], np.int64)


def search(shard: Shard, anchor: np.ndarray, wanted: np.ndarray, spans: list[Span], k: int, pool: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pool (scores, ids) with this shard's rows that may be among the best k of a span.

    wanted: which rows of the shard may be returned. The pool holds at most k rows a span, and bounds the search.
    """
    n = len(shard.ids)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen, scored, depth = np.zeros(n, bool), ~wanted, 0
    floor = min((s.low for s in spans), default=None) if all(s.low is not None for s in spans) else None
    while True:
        upto = min(n, max(FIRST_DEPTH, 4 * depth)) if len(up) + len(down) else n
        seen[shard.lists[up, n - upto : n - depth]] = True
        seen[shard.lists[down, depth:upto]] = True
        if upto == n:
            seen[:] = True
        rows = np.flatnonzero(seen & ~scored)
        scored |= seen
        scores = shard.scores(rows, anchor)
        if floor is not None:
            rows, scores = rows[scores >= floor], scores[scores >= floor]
        pool = best(np.concatenate([pool[0], scores]), np.concatenate([pool[1], shard.ids[rows]]), spans, k)
        if upto == n:
            return pool
        last = np.concatenate([shard.q[shard.lists[up, n - upto], up], shard.q[shard.lists[down, upto - 1], down]])
        threshold = sum(int(x) * int(y) for x, y in zip(last.tolist(), np.concatenate([anchor[up], anchor[down]]).tolist(), strict=True))
        if all((s.low is not None and threshold < s.low) or (at := kth(pool[0], s, k)) is not None and threshold < at for s in spans):
            return pool
        depth = upto


def _between(scores: np.ndarray, span: Span) -> tuple[int, int]:
    """Where the scores (highest first) of a span begin and end."""
    start = 0 if span.high is None else int(np.searchsorted(-scores, -span.high, "left"))
    return start, len(scores) if span.low is None else int(np.searchsorted(-scores, -span.low, "right"))


def kth(scores: np.ndarray, span: Span, k: int) -> int | None:
    start, stop = _between(scores, span)
    return int(scores[start + k - 1]) if start + k <= stop else None


def best(scores: np.ndarray, ids: np.ndarray, spans: list[Span], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows those among the first k of any span, highest score first, ties by id."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    keep = np.zeros(len(ids), bool)
    for span in spans:
        start, stop = _between(scores, span)
        keep[start : min(stop, start + k)] = True
    return scores[keep], ids[keep]


# -- jobs ---------------------------------------------------------------------------------------------------


def shards(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """A row for each shard: ids, labels, integer components (row by row) and sorted lists (dimension by dimension)."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    dims = max(size.dims or 0, 1)
    count = max(1, -(-size.n * dims // SHARD))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row"))
    dealt = one.select("vec_id", "row.label", "row.x", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        vectors = table.column("x").combine_chunks()
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        q = np.zeros((len(lengths), dims))
        row = np.repeat(np.arange(len(lengths)), lengths)
        q[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(scale * vectors.flatten().to_numpy())
        lists = np.ascontiguousarray(np.argsort(q, axis=0, kind="stable").T.astype(np.int32))
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label")] + [q, lists]
        return pa.table([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "labels", "q", "lists"])

    return materialise(dealt.groupBy("shard").applyInArrow(run, SHARDS), "shards")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels, q, lists = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in enumerate((np.int64, np.int64, np.float64, np.int32)))
            yield Shard(ids, labels, q.reshape(len(ids), -1), lists.reshape(-1, len(ids)))


def anchors_of(sharded: DataFrame, every: int) -> DataFrame:
    """vec_id, label, q of the rows whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in opened(batches):
            at = np.flatnonzero(shard.ids % every == 0)
            vectors = [shard.q[k].tobytes() for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard.ids[at]), pa.array(shard.labels[at]), pa.array(vectors, pa.binary())], ["vec_id", "label", "q"])

    return materialise(sharded.mapInArrow(run, "vec_id long, label long, q binary"), "anchors")


def _searched(sharded: DataFrame, anchors: list, spans: dict[int, list[Span]], k: int, same: bool) -> DataFrame:
    """FOUND: at most k rows a span from each task. same: rows of the anchor's label, without itself; else of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools = {a: (np.empty(0, np.int64), np.empty(0, np.int64)) for a, _, _ in anchors}
        for shard in opened(batches):
            for anchor_id, label, q in anchors:
                wanted = (shard.labels == label) & (shard.ids != anchor_id) if same else shard.labels != label
                pools[anchor_id] = search(shard, np.frombuffer(q), wanted, spans[anchor_id], k, pools[anchor_id])
        out = []
        for anchor_id, (scores, ids) in pools.items():
            for span in spans[anchor_id]:
                start, stop = _between(scores, span)
                out += [(anchor_id, *(span.positive or (None, None)), i, s) for i, s in zip(ids[start : min(stop, start + k)].tolist(), scores[start : min(stop, start + k)].tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return sharded.mapInArrow(run, FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    label: Column | None = None,
    scale: int = 256,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; label: another column in its place. Anchors are rows whose id is divisible by
    ``every``. Their positives are the first ``positives`` rows of their label. The negatives of a pair are the first
    rows of other labels that score from ``low`` to ``high`` hundredths of the positive.
    """
    sharded = shards(vectors, F.col("label") if label is None else label, scale)
    anchors = anchors_of(sharded, every)
    size = anchors.agg(F.count("*").alias("n"), F.max(F.octet_length("q")).alias("bytes")).first()
    blocks = -(-size.n * (size.bytes or 0) // BLOCK_BYTES)
    out = None
    for block in range(blocks):
        own = [(r.vec_id, r.label, bytes(r.q)) for r in anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()]
        near = _searched(sharded, own, {a: [Span(None, None, None)] for a, _, _ in own}, positives, same=True)
        spans: dict[int, list[Span]] = {}
        for r in _first(near, ["anchor_id"], positives).collect():  # a handful for each anchor of the block
            a, b = -(-low * r.score // 100), high * r.score // 100
            if a <= b:
                spans.setdefault(r.anchor_id, []).append(Span(a, b, (r.vec_id, r.score)))
        found = _searched(sharded, [a for a in own if a[0] in spans], spans, negatives, same=False)
        ranked = materialise(_first(found, ["anchor_id", "positive_id"], negatives), "negatives")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
