"""WARC archives of pages, and reading them back by boundary-chain verification.

Writing: one record for each page. Equal payloads of at least MIN_REVISIT bytes are stored once, as the response of
the smallest page_id; the others are revisits that name it.

Reading: archives are cut into byte ranges. A task finds every place in its range where a record may begin, wherever
the magic occurs, and emits (offset, offset of the successor by the header's length). Payloads may hold the magic, or
whole records, so candidates alone prove nothing: pointer jumping from each file's start, doubling the distance
every round, retains the offsets on the chain. The chain of a whole file ends at its size; another end is an error.

Defined cases: a null html is an empty payload; very long payloads are written whole; of equal payloads (ties) that of the
smallest page_id is the response; null URLs are written as empty; control characters and white space in
URLs are percent-encoded; rows with a null page_id are written without one, and rank after all others when a response is chosen; repeated rows of the
smallest page_id are all responses; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.common import fresh_path, materialise, shuffle_partitions

MIN_REVISIT = 100
MAGIC = b"WARC/1.1\r\n"
FILE_BYTES = 32 << 20  # a task begins another file beyond this
RANGE_BYTES = 4 << 20
MAX_HEADER = 1 << 20
#: Up to this many repeated digests are broadcast (about 100 bytes each).
BROADCAST_DIGESTS = 200_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary), payload_bytes, payload_digest, record_type, refers_to."""
    html = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    large = rows.filter(F.col("payload_bytes") >= MIN_REVISIT)
    firsts = large.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = materialise(firsts.filter("n > 1").drop("n"), "repeated")
    small = firsts.count() <= BROADCAST_DIGESTS
    joined = rows.join(F.broadcast(firsts) if small else firsts, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record(page_id, url, html: bytes, payload_bytes: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; the block is an HTTP response, of which a revisit holds the head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + html
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {target}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", "" if page_id is None else page_id), ("Payload-Length", payload_bytes)]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; uri, size of each. A repeated task writes other names; only reported files count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc"
                    out, size = fs.open_output_stream(f"{path}/{name}"), 0
                raw = record(*(v.as_py() for v in row))
                out.write(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["uri", "size"])

    return materialise(decide(pages).mapInArrow(run, "uri string, size long"), "archives")


class _Files:
    """The archive that a task is reading; one open file at a time."""

    def __init__(self):
        self.uri, self.file, self.size = None, None, 0

    def read(self, uri: str, at: int, n: int) -> bytes:
        if uri != self.uri:
            fs, path = pafs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
            self.size = self.file.size()
        return self.file.read_at(max(0, min(n, self.size - at)), at)


def header(raw: bytes, at: int = 0) -> tuple[dict[str, str], int] | None:
    """The named fields of the record that begins here and the header's length; None if it is none."""
    end = raw.find(b"\r\n\r\n", at, at + MAX_HEADER)
    if not raw.startswith(MAGIC, at) or end < 0:
        return None
    fields = {}
    for line in raw[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return (fields, end + 4 - at) if fields.get("content-length", "").isdigit() else None


def candidates(archives: DataFrame) -> DataFrame:
    """uri, off, nxt: every offset at which a record may begin, and where its successor would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # What begins in the range may end its magic, or its header, beyond it.
                tail = 4096
                raw, offs, nxts = files.read(uri, start, RANGE_BYTES + tail), [], []
                at = raw.find(MAGIC)
                while 0 <= at < RANGE_BYTES:
                    found = header(raw, at)
                    if not found and len(raw) - at < MAX_HEADER:  # its header may be cut off by the range's end
                        found = header(files.read(uri, start + at, MAX_HEADER))
                    if found:
                        offs.append(start + at)
                        nxts.append(start + at + found[1] + int(found[0]["content-length"][:18]) + 4)
                    at = raw.find(MAGIC, at + 1)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(offs), pa.string()), pa.array(offs, pa.int64()), pa.array(nxts, pa.int64())], ["uri", "off", "nxt"])

    ranges = archives.select("uri", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))).alias("start"))
    n = max(1, shuffle_partitions(archives.sparkSession))
    return ranges.repartition(n).mapInArrow(run, "uri string, off long, nxt long")


def reachable(found: DataFrame, archives: DataFrame) -> DataFrame:
    """uri, off, nxt of the candidates on the chain from each file's start."""
    found = materialise(found, "candidates")
    # jump: the offset 2**k records on, null where the chain has ended; hit: known to be on the chain.
    state = materialise(found.select("uri", "off", F.col("nxt").alias("jump"), (F.col("off") == 0).alias("hit")), "chain")
    while True:
        reached = state.filter("hit and jump is not null").select("uri", F.col("jump").alias("off"), F.lit(True).alias("now")).distinct()
        ahead = state.select("uri", F.col("off").alias("jump"), F.col("jump").alias("further"))
        moved = state.join(reached, ["uri", "off"], "left").join(ahead, ["uri", "jump"], "left")
        nxt = materialise(moved.select("uri", "off", F.col("further").alias("jump"), (F.col("hit") | F.coalesce("now", F.lit(False))).alias("hit")), "chain")
        more = nxt.filter("hit and jump is not null").limit(1).count()
        state = nxt
        if not more:
            break
    chain = found.join(state.filter("hit").select("uri", "off"), ["uri", "off"])
    ends = chain.groupBy("uri").agg(F.max("nxt").alias("end"))
    torn = archives.filter("size > 0").join(ends, "uri", "left").filter(~F.col("end").eqNullSafe(F.col("size"))).select("uri").limit(3).collect()
    if torn:
        raise ValueError(f"the chain of records does not end where the file does: {[t.uri for t in torn]}")
    return chain


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in batches:
            out = []
            for uri, off, nxt in zip(*(batch.column(n).to_pylist() for n in ("uri", "off", "nxt")), strict=True):
                raw = files.read(uri, off, nxt - off)
                fields, n = header(raw)
                block = raw[n : n + int(fields["content-length"])]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                size, digest, kind = int(fields["payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"{uri} at {off}: the payload is not what its header says")
                number = lambda name: int(fields[name]) if fields.get(name) else None
                out.append((number("page-id"), size, digest, kind, number("refers-to-page-id")))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    part = F.floor(F.col("off") / RANGE_BYTES)
    n = shuffle_partitions(archives.sparkSession)
    near = reachable(candidates(archives), archives).withColumn("part", part).repartition(n, "uri", "part").sortWithinPartitions("uri", "off").drop("part")
    return near.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    return read(write(pages, fresh_path(pages.sparkSession, "warc")))
