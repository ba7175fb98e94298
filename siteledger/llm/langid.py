"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Texts are cut into windows of WINDOW bytes. A forward and a backward GRU read each window, every byte gets language
probabilities from both states, and a document's probabilities are the mean over all its bytes. The network is
trained in numpy by backpropagation through time (every position is a labelled example) on a bounded sample: up to
MAX_DOCS documents of each language, by the smallest hashes of their ids, and WINDOWS_PER_DOC windows of each.
Training is seeded and sorted, so that equal input gives equal predictions. Prediction reads whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled text all are;
very long texts are read whole, in windows; ties of two languages go to the first by name; repeated rows are predicted
each, and train once; rows with a null id are predicted but never trained on, as are those with a null language; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.common import crc_mod, materialise

WINDOW = 48
HIDDEN = 6
MAX_DOCS = 800
WINDOWS_PER_DOC = 6
ROWS = 1024  # windows that go through the network at once
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """One direction has: x (256, 3h) input to gates r, z, n; u (h, 3h) state to gates; b (h,) inside the reset."""

    forward: dict[str, np.ndarray]
    backward: dict[str, np.ndarray]
    out: np.ndarray  # (2h + 1, languages)
    languages: list[str]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        one = lambda: {"x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32), "u": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32), "b": np.zeros(hidden, np.float32)}
        return cls(one(), one(), rng.normal(0, 0.3, (2 * hidden + 1, len(languages))).astype(np.float32), languages)

    def states(self, data: np.ndarray, p: dict[str, np.ndarray], keep: bool = False):
        """data (t, n) bytes: states (t + 1, n, h) in reading order; with keep also what backpropagation needs."""
        h_dim, (steps, n) = len(p["b"]), data.shape
        x, u, b = p["x"].copy(), p["u"].copy(), p["b"]
        x[:, : 2 * h_dim] *= 0.5  # sigmoid(v) = (1 + tanh(v / 2)) / 2, so that one tanh serves both gates
        u[:, : 2 * h_dim] *= 0.5
        h, saved = np.zeros((steps + 1, n, h_dim), np.float32), []
        for t in range(steps):
            a, s = x[data[t]], h[t] @ u
            g = np.tanh(a[:, : 2 * h_dim] + s[:, : 2 * h_dim])
            g *= 0.5
            g += 0.5
            r, z = g[:, :h_dim], g[:, h_dim:]
            inner = s[:, 2 * h_dim :] + b
            new = np.tanh(a[:, 2 * h_dim :] + r * inner)
            np.subtract(h[t], new, out=h[t + 1])
            h[t + 1] *= z
            h[t + 1] += new
            if keep:
                saved.append((r, z, new, inner))
        return h, saved

    def probabilities(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """data (n, t): for each window the sum of its bytes' language probabilities; lengths: how many bytes are real.

        The same recurrence as states(), laid out with windows last so that every slice is contiguous.
        """
        n, steps = data.shape
        rows = np.ascontiguousarray(data.T)
        real = np.arange(steps)[:, None] < lengths
        whole = real.all(1)
        h_dim = len(self.forward["b"])
        logits = np.empty((steps, len(self.languages), n), np.float32)
        for p, out, order in ((self.forward, self.out[:h_dim], range(steps)), (self.backward, self.out[h_dim : 2 * h_dim], range(steps - 1, -1, -1))):
            x, u, b, w = (np.ascontiguousarray(v, np.float32) for v in (p["x"].T.copy(), p["u"].T.copy(), p["b"][:, None], out.T))
            x[: 2 * h_dim] *= 0.5  # sigmoid(v) = (1 + tanh(v / 2)) / 2, so that one tanh serves both gates
            u[: 2 * h_dim] *= 0.5
            h, s, a, new = np.zeros((h_dim, n), np.float32), np.empty((3 * h_dim, n), np.float32), np.empty((3 * h_dim, n), np.float32), np.empty((h_dim, n), np.float32)
            gates, r, z, inner = s[: 2 * h_dim], s[:h_dim], s[h_dim : 2 * h_dim], s[2 * h_dim :]
            for t in order:
                np.take(x, rows[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=s)
                gates += a[: 2 * h_dim]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                inner += b
                np.multiply(r, inner, out=new)
                new += a[2 * h_dim :]
                np.tanh(new, out=new)
                h -= new
                h *= z
                h += new
                if p is self.forward:
                    np.matmul(w, h, out=logits[t])
                else:
                    if not whole[t]:
                        h *= real[t]  # a short window's backward reader starts at the text's own end
                    logits[t] += w @ h
        logits += self.out[-1][:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (real / logits.sum(1))[:, None, :].astype(np.float32)
        return logits.sum(0, dtype=np.float64).T

    def gradients(self, data: np.ndarray, target: np.ndarray):
        """data (t, n) full windows, target (n,): mean cross-entropy over all positions and its gradients, by BPTT."""
        steps, n = data.shape
        h = len(self.forward["b"])
        f, f_saved = self.states(data, self.forward, keep=True)
        g, g_saved = self.states(data[::-1], self.backward, keep=True)
        both = np.concatenate([f[1:], g[1:][::-1], np.ones((steps, n, 1), np.float32)], 2)
        logits = both @ self.out
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        loss = -np.log(p[:, np.arange(n), target] + 1e-12).mean()
        p[:, np.arange(n), target] -= 1
        p /= steps * n
        d_out = both.reshape(-1, 2 * h + 1).T @ p.reshape(-1, p.shape[2])
        d_both = p @ self.out.T
        d_f = self._through_time(data, self.forward, f, f_saved, d_both[:, :, :h])
        d_g = self._through_time(data[::-1], self.backward, g, g_saved, d_both[::-1, :, h : 2 * h])
        return loss, d_f, d_g, d_out

    @staticmethod
    def _through_time(data, p, h, saved, d_h):
        dim = len(p["b"])
        d = {k: np.zeros_like(v) for k, v in p.items()}
        carry = np.zeros_like(h[0])
        for t in range(len(data) - 1, -1, -1):
            r, z, new, inner = saved[t]
            dh = carry + d_h[t]
            d_new = dh * (1 - z) * (1 - new * new)
            d_r = d_new * inner * r * (1 - r)
            d_z = dh * (h[t] - new) * z * (1 - z)
            gates = np.concatenate([d_r, d_z, d_new], 1)
            through = np.concatenate([d_r, d_z, d_new * r], 1)
            np.add.at(d["x"], data[t], gates)
            d["u"] += h[t].T @ through
            d["b"] += (d_new * r).sum(0)
            carry = dh * z + through @ p["u"].T
        return d

    def parts(self) -> list[np.ndarray]:
        return [*(self.forward[k] for k in "xub"), *(self.backward[k] for k in "xub"), self.out]


def train(windows: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = 500, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network | None:
    """windows: (language, WINDOW bytes). Every language is drawn equally often."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, w in windows:
        by_lang.setdefault(lang, []).append(w)
    if not by_lang:
        return None
    languages = sorted(by_lang)
    net, rng = Network.fresh(languages, hidden, seed), np.random.default_rng(seed)
    data = [np.frombuffer(b"".join(by_lang[x]), np.uint8).reshape(-1, WINDOW) for x in languages]
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        target = rng.integers(len(languages), size=batch)
        rows = np.stack([data[k][rng.integers(len(data[k]))] for k in target])
        _, d_f, d_g, d_out = net.gradients(np.ascontiguousarray(rows.T), target)
        grads = [*(d_f[k] for k in "xub"), *(d_g[k] for k in "xub"), d_out]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1, step / 20) * (0.1 ** (step / steps))
        for p, g, a, b in zip(net.parts(), grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def training_windows(docs: DataFrame) -> list[tuple[str, bytes]]:
    """A bounded sample of the training part (crc32 of the id modulo 3 is not 1), cut in the tasks."""
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1)
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(usable)
    ids = part.select("doc_id", "lang").distinct().withColumn("order", F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(2.0**63))
    # A share of each language that holds three times MAX_DOCS ids on average is ranked, so that no task gets more.
    share = materialise(ids.groupBy("lang").agg((F.lit(3.0 * MAX_DOCS) / F.count("*")).alias("share")), "share")
    few = ids.join(share, "lang").filter(F.col("order") < F.col("share"))
    first = Window.partitionBy("lang").orderBy("order", "doc_id")
    chosen = few.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= MAX_DOCS).select("doc_id", "lang")
    # MAX_DOCS rows for each language; a written table, so that Spark knows its size and broadcasts it only if small.
    # Of repeated rows one trains: that of the least text.
    texts = part.join(materialise(chosen, "sample"), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "lang", "text")), strict=True):
                raw = text.encode()
                if not _LETTER.search(text):
                    continue
                rng = np.random.default_rng(doc_id & 0xFFFFFFFF)
                for at in rng.integers(max(1, len(raw) - WINDOW + 1), size=min(WINDOWS_PER_DOC, 1 + len(raw) // WINDOW)):
                    # A short text is repeated to the window's length, so that it counts as much.
                    w = raw[at : at + WINDOW]
                    out.append((doc_id, lang, (w * (WINDOW // len(w) + 1))[:WINDOW]))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "lang", "window"])

    rows = texts.mapInArrow(run, "doc_id long, lang string, window binary").collect()
    return [(lang, w) for _, lang, w in sorted((r.doc_id, r.lang, bytes(r.window)) for r in rows)]


def predict_texts(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    total = np.zeros((len(texts), len(net.languages)))
    rows, owners, lengths, held = [], [], [], 0

    def flush() -> None:
        nonlocal rows, owners, lengths, held
        if rows:
            data, own, size = np.concatenate(rows), np.concatenate(owners), np.concatenate(lengths)
            for at in range(0, len(data), ROWS):
                some = slice(at, at + ROWS)
                np.add.at(total, own[some], net.probabilities(data[some], size[some]))
        rows, owners, lengths, held = [], [], [], 0

    for k, text in enumerate(texts):
        if not text or not _LETTER.search(text):
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        n = -(-len(raw) // WINDOW)
        padded = np.zeros(n * WINDOW, np.uint8)
        padded[: len(raw)] = raw
        size = np.full(n, WINDOW)
        size[-1] = len(raw) - (n - 1) * WINDOW
        rows.append(padded.reshape(n, WINDOW))
        owners.append(np.full(n, k))
        lengths.append(size)
        held += n
        if held >= 8 * ROWS:
            flush()
    flush()
    mass = total.sum(1)
    best = total.argmax(1)
    langs = [net.languages[b] if s > 0 else "und" for b, s in zip(best, mass, strict=True)]
    scores = [float(min(1.0, total[k, b] / s)) if s > 0 else 0.0 for k, (b, s) in enumerate(zip(best, mass, strict=True))]
    return langs, scores


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document; trains on the documents' own labels if no network is given."""
    net = net or train(training_windows(docs))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = predict_texts(shared.value, texts) if shared.value else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
