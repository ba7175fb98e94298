"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts of the training part, whatever their label, are the unlabelled ones,
that is a sample of the marginal distribution. With the class prior p, the risk of a classifier g over positives P and
unlabelled U is

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

where the second term, an estimate of the negatives' risk, is kept from going below zero (when it does, a step
goes the other way, to undo overfitting). The classifier is linear over hashed word and word-prefix presence, with
weights kept to features whose share among positives exceeds that among unlabelled texts.

Features are counted over all training texts, and the class prior and the threshold come from the scores of all of them
(counts of score bins). Only the gradient steps use bounded samples: MAX_POSITIVES labelled texts, whose features are
the candidates, and MAX_UNLABELLED others, those with the smallest hashes of their ids, one row an id. Of texts the
driver sees the chosen features only. Everything is seeded, so that equal input gives equal scores.

Defined cases: null and empty texts have no features and get the score of the bias; very long texts are read whole;
repeated rows are scored each, and train once; ties (equal texts) have equal scores; rows with a null id are scored but
never trained on; labels without a document and documents without a label are fine; without any positive every score
is 0; an empty table gives an empty result; other columns are ignored, or passed through, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.llm.common import crc_mod, fresh_name, frugal, materialise, temporary

MAX_POSITIVES = 5_000
MAX_UNLABELLED = 10_000
#: A feature is one if so many standard deviations lie between its share among positives and that of all texts.
CLEAR = 4.0
#: Score bins for each unit of the logit.
BINS = 64
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (6, 7, 8)


def features(word: str) -> list[int]:
    """Hashes of a lower-cased word: itself, and its first letters if it is longer."""
    out = [zlib.crc32(b"w" + word.encode())]
    return out + [zlib.crc32(b"p" + word[:n].encode()) for n in PREFIXES if len(word) > n]


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        got = self[key] = self.make(key)
        if len(self) > 100_000:
            self.clear()
        return got


def slots_of(known: np.ndarray) -> Callable[[str | None], set[int]]:
    """A function from a text to the places of its features in ``known``, which is sorted."""
    place = {f: k for k, f in enumerate(known.tolist())}
    memo = _Memo(lambda word: tuple(place[f] for f in features(word) if f in place))

    def run(text: str | None) -> set[int]:
        found: set[int] = set()
        for slots in map(memo.__getitem__, set(_WORD.findall((text or "").lower()))):
            found.update(slots)
        return found

    return run


@dataclass
class Model:
    names: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: each text's distinct places."""
        sizes = [len(r) for r in rows]
        at = np.repeat(np.arange(len(rows)), sizes)
        places = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        return self.bias + np.bincount(at, self.weights[places] if len(places) else None, len(rows))


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def choose(known: np.ndarray, k_p: np.ndarray, n_p: int, k_u: np.ndarray, n_u: int) -> tuple[np.ndarray, np.ndarray]:
    """Features, and their starting weights, whose share among positives clearly exceeds that among all texts."""
    a, b = k_p / n_p, (k_u + 0.5) / (n_u + 1)
    spread = np.sqrt((a * (1 - a) + 0.25 / n_p) / n_p + b * (1 - b) / n_u)
    ratio = (k_p + 0.5) / (n_p + 1) / b
    # How unlikely the positives' count is at the share of all texts: the root of the deviance, which also holds for few positives.
    part = lambda k, p, q: np.where(k > 0, k * np.log(np.maximum(p, 1e-12) / q), 0.0)
    root = np.sqrt(np.maximum(2 * (part(k_p, a, b) + part(n_p - k_p, 1 - a, 1 - b)), 0))
    clear = (root > CLEAR) & (ratio > 3)
    score = np.where(clear, np.maximum((a - b) / spread, 2.5) * np.minimum(np.log(ratio), 6), 0.0)
    return known[score > 0], np.minimum(np.log1p(score[score > 0]), 3.0) * 0.3


def risk(w: np.ndarray, b: float, p_row, p_col, n_p: int, u_row, u_col, n_u: int, prior: float) -> tuple[float, float, np.ndarray, float]:
    """The corrected risk's two terms, and the gradient of the step: of their sum, or away from a negative second term.

    Logistic loss l(z) = log(1 + exp(-z)): derivatives s - 1 for a positive, s for a negative.
    """
    z_p = b + np.bincount(p_row, w[p_col], n_p)
    z_u = b + np.bincount(u_row, w[u_col], n_u)
    s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
    positive = prior * np.logaddexp(0, -z_p).mean()
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    if negative >= 0:
        g_p, g_u = (prior * (s_p - 1) - prior * s_p) / n_p, s_u / n_u
    else:
        g_p, g_u = prior * s_p / n_p, -s_u / n_u
    return positive, negative, np.bincount(p_col, g_p[p_row], len(w)) + np.bincount(u_col, g_u[u_row], len(w)), g_p.sum() + g_u.sum()


def _descend(start, p: list[np.ndarray], u: list[np.ndarray], prior, epochs):
    """Adam on the non-negative risk; weights stay at zero or above, so that no text gets less toxic by its length."""
    (p_row, p_col), (u_row, u_col) = ((np.repeat(np.arange(len(r)), [len(x) for x in r]), np.concatenate([*r, np.empty(0, np.int64)]).astype(np.int64)) for r in (p, u))
    w, b = start.copy(), -1.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rate, decay = 0.05, 1e-4
    for step in range(1, epochs + 1):
        _, _, g_w, g_b = risk(w, b, p_row, p_col, len(p), u_row, u_col, len(u), prior)
        grad = np.append(g_w + decay * w, g_b)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, b


def _at_least(scores: tuple[np.ndarray, np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """The share of the scores (sorted values, counts) that reach each cut."""
    values, counts = scores
    after = np.append(np.cumsum(counts[::-1])[::-1], 0)
    return after[np.searchsorted(values, cuts)] / counts.sum()


def _prior_bound(p, u) -> float:
    """The smallest P_U(z >= c) / P_P(z >= c): no larger share of all texts can be like the positives."""
    cuts = np.quantile(np.repeat(*p), np.linspace(0.05, 0.7, 66), method="inverted_cdf")
    share_p, share_u = _at_least(p, cuts), _at_least(u, cuts)
    # Two standard errors, of either share, keep the smallest of many ratios from being too small.
    high = (share_u + 2 * np.sqrt(share_u / u[1].sum())) / np.maximum(share_p - 2 * np.sqrt(share_p * (1 - share_p) / p[1].sum()), 0.05)
    return float(np.clip(high.min(), 0.005, 0.5))


def _balance(p, u, prior: float) -> float:
    """The cut c that makes prior * P(z < c | toxic) + P(z >= c, not toxic) smallest, by the corrected estimate."""
    values = np.unique(np.concatenate([p[0], u[0]]))
    cuts = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
    found = _at_least(p, cuts)
    lost = prior * (1 - found) + np.maximum(0, _at_least(u, cuts) - prior * found)
    return float(cuts[np.nonzero(lost <= lost.min() + 1e-12)[0][-1]])


def _sums(names, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64())], ["feature", "n"])


def feature_counts(texts: DataFrame) -> DataFrame:
    """feature, n: in how many texts each feature is; feature null: all texts. texts: one column. A task sends sums of what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(np.fromiter({f for w in set(_WORD.findall((text.as_py() or "").lower())) for f in features(w)}, np.int64))
                size += len(held[-1])
                if size > 200_000:  # what a task holds does not grow with what it reads
                    yield _sums(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
            yield _sums([None], [batch.num_rows])
        yield _sums(*np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True))

    return texts.mapInArrow(frugal(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def slot_counts(found: DataFrame, size: int) -> DataFrame:
    """feature, n: in how many rows each of the ``size`` places is; feature null: all rows. found: slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for slots in batch.column(0):
                total[np.frombuffer(slots.as_buffer(), "<u4")] += 1  # distinct places
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield _sums(at, total[at])
        yield _sums([None], [n])

    return found.select("slots").mapInArrow(frugal(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def hits(rows: DataFrame, names: np.ndarray) -> DataFrame:
    """The rows with the places of their text's features in ``names`` for the text, as little-endian 32-bit numbers. rows: the text is last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = slots_of(names)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                *kept, texts = batch.slice(low, 1024).columns
                slots = [np.array(sorted(find(t.as_py())), "<u4").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(slots, pa.binary())], out)

    fields = [*rows.schema.fields[:-1], T.StructField("slots", T.BinaryType())]
    out = [f.name for f in fields]
    return rows.mapInArrow(frugal(run), T.StructType(fields))


def chosen(rows: DataFrame, place: np.ndarray) -> DataFrame:
    """The rows with their slots turned into the places that ``place`` names (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("slots")
            moved = [place[np.frombuffer(x.as_buffer(), "<u4")] for x in batch.column(at)]
            yield batch.set_column(at, "slots", pa.array([x[x >= 0].astype("<u4").tobytes() for x in moved], pa.binary()))

    return rows.mapInArrow(frugal(run), rows.schema)


def logits(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, digest, z of each row of hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.logits([np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.float64())], ["doc_id", "digest", "z"])

    return found.select("doc_id", "digest", "slots").mapInArrow(frugal(run), "doc_id long, digest string, z double")


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, epochs: int = 400) -> tuple[Model, DataFrame]:
    """The model, and doc_id, digest (of the text) and the places of each text's features in it. prior: the share of toxic texts; estimated if not given.

    Texts are read once: the places of all features that a positive has are written down, and all else comes from that table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    trains = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)
    part = rows.filter(trains)
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    order = F.xxhash64("doc_id")
    ids = part.select("doc_id").distinct()
    positives = materialise(ids.join(toxic, "doc_id", "left_semi").orderBy(order, "doc_id").limit(MAX_POSITIVES), "positives")
    sample = materialise(ids.orderBy(order, "doc_id").limit(MAX_UNLABELLED), "unlabelled")

    # Both samples are bounded by their limits, so they can be broadcast. One row an id: that of the least text.
    confirmed = materialise(part.join(F.broadcast(positives), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text"), "confirmed")
    in_p = {r.feature: r.n for r in feature_counts(confirmed).filter("feature is null or n > 1").collect()}
    n_p = in_p.pop(None, 0)
    known = np.array(sorted(f for f, n in in_p.items() if n >= max(2, n_p // 1000)), np.int64)
    keyed = rows.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")
    wide = materialise(hits(keyed, known), "features")
    in_u = {r.feature: r.n for r in slot_counts(wide.filter(trains), len(known)).collect()} if n_p else {}
    n_u = in_u.pop(None, 0)
    if not n_p or not n_u:
        model = Model(np.zeros(0, np.int64), np.zeros(0), -100.0)
        return model, chosen(wide, np.full(len(known), -1))
    names, start = choose(known, np.array([in_p[f] for f in known.tolist()]), n_p, np.array([in_u.get(k, 0) for k in range(len(known))]), n_u)
    place = np.full(len(known), -1)
    place[np.searchsorted(known, names)] = np.arange(len(names))
    found = materialise(chosen(wide, place), "hits")
    trained = found.filter(trains)
    of = lambda some: [np.frombuffer(r.slots, "<u4") for r in sorted(trained.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("slots").alias("slots")).collect())]
    p, u = of(positives), of(sample)

    def scores(model: Model):
        """Sorted bins and counts of the positives' and of all training texts' logits."""
        mine = np.unique(np.floor(model.logits(p) * BINS) / BINS, return_counts=True)
        rows = logits(trained, model).groupBy(F.floor(F.col("z") * BINS).alias("bin")).count().collect()
        rows = sorted((r["bin"], r["count"]) for r in rows)
        return mine, (np.array([b / BINS for b, _ in rows]), np.array([n for _, n in rows]))

    if prior is None:
        # Toxic texts are hit as often among all texts as among the positives, so the hit rates bound the prior;
        # a first classifier gives a tighter bound.
        hit_u = trained.agg(F.avg((F.octet_length("slots") > 0).cast("double"))).first()[0]
        hit_p = np.mean([len(x) > 0 for x in p])
        first = float(np.clip(hit_u / max(hit_p, 1e-3), 0.01, 0.5))
        prior = min(first, _prior_bound(*scores(Model(names, *_descend(start, p, u, first, epochs // 2)))))
    w, b = _descend(start, p, u, prior, epochs)
    # The threshold of 0.5 is put where, by the same estimate, precision and recall of the training texts balance.
    shift = _balance(*scores(Model(names, w, b)), prior)
    return Model(names, w, float(b - shift)), found


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model, found = fit(docs, labels)
    value = 1 / (1 + F.exp(-F.col("z")))
    rows = logits(found, model).select("doc_id", value.alias("score"))
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """The documents' columns, and a score (double, 0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = slots_of(model.names)
        for batch in batches:
            z = model.logits([np.array(sorted(find(t.as_py())), np.int64) for t in batch.column("text")])
            yield batch.append_column(name, pa.array(_sigmoid(z), pa.float64()))

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


@temporary
def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5. Verdicts are joined by the id and the digest of the text."""
    model, found = fit(docs, labels)
    of_id, of_text, key = (fresh_name(docs, n) for n in ("toxic_id", "toxic_text", "text_digest"))
    toxic = logits(found, model).filter("z >= 0").select(F.col("doc_id").alias(of_id), F.col("digest").alias(of_text)).distinct()
    toxic = materialise(toxic, "toxic")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_text))
    # Dealt by the key whatever the size, so that a small table costs what a large one does.
    return keyed.join(toxic.hint("merge"), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
