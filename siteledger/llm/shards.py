"""Token ids as raw binary shards with a minimal perfect hash index.

A shard file is: the ids of its documents one after another (little-endian, 2 bytes each if the vocabulary allows
it, else 4), then the index arrays, then a JSON footer and its length. The index of a shard is a minimal perfect
hash over its distinct document keys (levels of bit arrays in which a key's position must be unique, with ranks);
a slot stores a 32-bit fingerprint of the key, the offset and length of the document's ids, and how many rows have
that key. A lookup hashes the key once a level, so it takes constant time, and the fingerprint rejects a key that
is not there. Shards hold ascending ranges of doc_id, so the manifest's bounds name the shards of a key.

Defined cases: null text is empty (its end id alone); very long texts are encoded whole; ties (rows of one id) are in the
order of their texts' hashes; rows with a null id come first and are kept under a key of
their own; repeated rows of an id lie side by side and are all counted; an empty table gives no shard and an empty
result; other columns are ignored. A task that runs twice writes a file of another name; only the file that its
successful attempt reports is in the manifest.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import fresh_path, frugal, materialise, shuffle_partitions
from siteledger.llm.tokens import default_vocabulary, encoder

#: Ids that are read from a shard at once.
READ_IDS = 1 << 20
MAGIC = b"IDSHARD1"
#: The key under which rows with a null id are indexed.
NULL_KEY = -(1 << 63)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """levels[k] marks the positions at which exactly one of the keys left at level k lies."""

    levels: list[np.ndarray]
    ranks: list[np.ndarray]  # how many marks come before each position, the levels before included

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, levels, ranks, before = np.unique(keys), [], [], 0
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            ranks.append(before + np.cumsum(alone) - alone)
            before += int(alone.sum())
            left = left[~alone[at]]
        return cls(levels, ranks)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it surely has none; a key outside the set may get any slot."""
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mix(keys[left], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            slot[left[hit]] = rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return slot


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    def __init__(self, uri: str, width: int):
        self.uri, self.width, self.keys, self.counts, self.ids = uri, width, [], [], 0
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)

    def add(self, key: int, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.counts.append(len(ids) // self.width)
        self.ids += self.counts[-1]

    def close(self) -> None:
        keys, counts = np.array(self.keys, np.int64), np.array(self.counts, np.int64)
        offsets = np.cumsum(counts) - counts
        distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
        hash_ = PerfectHash.build(distinct)
        slot = hash_.find(distinct)
        prints, start, row = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8")
        prints[slot], start[slot], row[slot] = fingerprint(distinct), offsets[first], first
        parts = {"prints": prints, "start": start, "row": row, "counts": counts.astype("<i8"), "keys": keys.astype("<i8")}
        parts |= {f"level{k}": np.packbits(x) for k, x in enumerate(hash_.levels)}
        footer: dict = {"width": self.width, "ids": int(counts.sum()), "sizes": [len(x) for x in hash_.levels], "parts": {}}
        at = int(counts.sum()) * self.width
        for name, part in parts.items():
            raw = part.tobytes()
            footer["parts"][name] = [at, len(raw)]
            self.out.write(raw)
            at += len(raw)
        tail = json.dumps(footer).encode()
        self.out.write(tail + struct.pack("<I", len(tail)) + MAGIC)
        self.out.close()


class ShardReader:
    """Random access to one shard: a lookup reads the document's ids and nothing else of the payload."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        end = self.file.size()
        n, magic = struct.unpack("<I8s", self.file.read_at(12, end - 12))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard of token ids")
        self.footer = json.loads(self.file.read_at(n, end - 12 - n))
        self.width = self.footer["width"]
        part = lambda name, kind: np.frombuffer(self.file.read_at(*self.footer["parts"][name][::-1]), kind)
        self.prints, self.start, self.row = part("prints", "<u4"), part("start", "<i8"), part("row", "<i8")
        self.counts, self.keys = part("counts", "<i8"), part("keys", "<i8")
        levels = [np.unpackbits(part(f"level{k}", np.uint8))[:size].astype(bool) for k, size in enumerate(self.footer["sizes"])]
        before, ranks = 0, []
        for x in levels:
            ranks.append(before + np.cumsum(x) - x)
            before += int(x.sum())
        self.hash = PerfectHash(levels, ranks)

    def locate(self, keys: np.ndarray) -> np.ndarray:
        """The number in the shard of each key's first row, -1 for a key that is not there."""
        slot = self.hash.find(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.row[slot[ok]]
        return out

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every row with this key."""
        first = int(self.locate(np.array([key], np.int64))[0])
        out: list[np.ndarray] = []
        while 0 <= first + len(out) < len(self.keys) and self.keys[first + len(out)] == key:
            k = first + len(out)
            start = int(self.start[self.hash.find(np.array([key], np.int64))[0]]) + int(self.counts[first:k].sum())
            out.append(self.read(start, int(self.counts[k])))
        return out

    def read(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * self.width, start * self.width), f"<u{self.width}")

    def checksum(self, start: int, n: int) -> int:
        """The CRC-32 of n ids as 32-bit numbers, READ_IDS at a time."""
        crc = 0
        for at in range(0, n, READ_IDS):
            crc = zlib.crc32(self.read(start + at, min(READ_IDS, n - at)).astype("<u4").tobytes(), crc)
        return crc

    def payload(self, block: int = 1 << 20) -> Iterator[np.ndarray]:
        for at in range(0, self.footer["ids"], block):
            yield self.read(at, min(block, self.footer["ids"] - at))


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0, shards: int | None = None, max_ids: int = 1 << 27, max_rows: int = 1 << 20) -> DataFrame:
    """Write the shards; the manifest (one row a shard): uri, low, high (keys), documents, ids, start (ids before it).

    A task begins another shard after ``max_ids`` ids or ``max_rows`` rows, so a shard's index always fits in memory.
    """
    vocabulary, spark = vocabulary or default_vocabulary(), docs.sparkSession
    schema = pa.schema([("uri", pa.string()), *((n, pa.int64()) for n in ("low", "high", "documents", "ids"))])

    def closed(out: ShardWriter) -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_pylist([{"uri": out.uri, "low": out.keys[0], "high": out.keys[-1], "documents": len(out.keys), "ids": out.ids}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(vocabulary), None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    out = ShardWriter(f"{folder}/shard-{uuid.uuid4().hex}.ids", enc.width)
                end = int(end_id).to_bytes(enc.width, "little")
                out.add(NULL_KEY if doc_id is None else doc_id, enc.encode(text.as_py()) + end)
                if out.ids >= max_ids or len(out.keys) >= max_rows:
                    yield closed(out)
                    out = None
        if out is not None:
            yield closed(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The text's hash only breaks ties, so that even the rows of one id can be dealt to several shards.
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(shards or shuffle_partitions(spark), *key).sortWithinPartitions(*key)
    written = materialise(ranged.mapInArrow(frugal(run), "uri string, low long, high long, documents long, ids long"), "manifest")
    # One row a shard: their starts are a running sum over the shards.
    manifest, start = [], 0
    for m in sorted(written.collect(), key=lambda m: (m.low, m.high)):
        manifest.append((*m, start))
        start += m.ids
    return spark.createDataFrame(manifest, "uri string, low long, high long, documents long, ids long, start long")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document, from the files, each located through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                shard = ShardReader(m["uri"])
                first = shard.locate(shard.keys)
                if len(first) and (first < 0).any():
                    raise ValueError(f"{m['uri']}: a key is missing from the index")
                # The index gives the offset of a key's first row; the others of the key follow by their counts.
                before = np.cumsum(shard.counts) - shard.counts
                starts = shard.start[shard.hash.find(shard.keys)] + before - before[first]
                total, at = np.cumsum(shard.counts), 0
                while at < len(starts):
                    # As many documents as READ_IDS ids allow, at least one.
                    end = max(at + 1, int(np.searchsorted(total, total[at] - shard.counts[at] + READ_IDS, "right")))
                    some, lo = slice(at, end), int(starts[at])
                    if (starts[some] != lo + np.append(0, np.cumsum(shard.counts[some])[:-1])).any():
                        raise ValueError(f"{m['uri']}: the index and the order of the documents differ")
                    if end == at + 1:
                        crcs = [shard.checksum(lo, int(shard.counts[at]))]
                    else:
                        ids = shard.read(lo, int(shard.counts[some].sum())).astype("<u4")
                        crcs = [zlib.crc32(ids[s - lo : s - lo + n].tobytes()) for s, n in zip(starts[some].tolist(), shard.counts[some].tolist(), strict=True)]
                    keys = [None if k == NULL_KEY else k for k in shard.keys[some].tolist()]
                    cols = [pa.array(keys, pa.int64()), pa.array(m["start"] + starts[some]), pa.array(shard.counts[some]), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = end

    n = max(1, min(manifest.count(), 4 * shuffle_partitions(manifest.sparkSession)))
    return manifest.repartition(n).mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, ids (array) for each asked doc_id that the shards hold: keyed access, one index probe a key and shard.

    The bounds of the manifest (one row a shard) are searched in the tasks; keys go to the shards that may have them.
    """
    bounds = sorted(((m.uri, m.low, m.high) for m in manifest.collect()), key=lambda b: b[1:])

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shards are ranges one after another: only the rows of one key can stand in several.
        low, high = np.array([b[1] for b in bounds]), np.array([b[2] for b in bounds])
        for batch in batches:
            asked = np.array([k for k in batch.column(0).to_pylist() if k is not None], np.int64)
            first, end = np.searchsorted(high, asked, "left"), np.searchsorted(low, asked, "right")
            rows = [{"doc_id": k, "uri": bounds[i][0]} for k, a, b in zip(asked.tolist(), first.tolist(), end.tolist(), strict=True) for i in range(a, b)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("uri", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, shard = None, None
        for batch in batches:
            rows = []
            for key, u in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if u != uri:
                    uri, shard = u, ShardReader(u)
                rows += [{"doc_id": key, "ids": ids.astype(np.int64).tolist()} for ids in shard.get(key)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(frugal(shards_of), "doc_id long, uri string")
    spread = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(8)))  # a shard's keys may go to eight tasks
    return spread.repartition("uri", "salt").sortWithinPartitions("uri").drop("salt").mapInArrow(frugal(run), "doc_id long, ids array<long>")


def encode_and_read(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    return read(write(docs, fresh_path(docs.sparkSession, "shards"), vocabulary, end_id))
