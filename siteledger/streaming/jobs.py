"""Structured Streaming forms of the journal, idempotent operations, carts, request pacing and the queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from siteledger.operators import cart as carts
from siteledger.operators.journal import replay


#: Deltas that a state is read from at most; then they are merged into its base.
MOST_DELTAS = 64


def _listed(spark, folder: str) -> tuple[dict[int, int], dict[int, int]]:
    """epoch -> bytes of the complete bases and deltas of a state."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    bases, deltas = {}, {}
    for status in fs.listStatus(path(folder)) if fs.exists(path(folder)) else []:
        name = status.getPath().getName()
        if name[:1] in ("b", "d") and name[1:].isdigit() and fs.exists(path(f"{folder}/{name}/_SUCCESS")):
            (bases if name[0] == "b" else deltas)[int(name[1:])] = fs.getContentSummary(status.getPath()).getLength()
    return bases, deltas


def _latest(rows: DataFrame) -> DataFrame:
    """One row for each key, the last in order; a column's metadata tell what it is."""
    role = {f.name: f.metadata.get("ledger", "") for f in rows.schema.fields}
    keys = [c for c, r in role.items() if r == "key"]
    order = sorted((c for c, r in role.items() if r.startswith("order")), key=role.get)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[_marked(F.col(c) if c in keys else F.col("_row")[c], c, role[c]) for c in rows.columns])


def _marked(value: Column, name: str, role: str) -> Column:
    return value.alias(name, metadata={"ledger": role}) if role else value.alias(name)


def apply_batch(batch: DataFrame, folder: str, epoch: int, keys: list[str], order: list[str], least: int = 16 << 20) -> None:
    """Add a batch to a state: the last row of each of its keys is written as the delta of its epoch.

    What is written follows the batch. Only when the deltas have grown to the size of the base (and to ``least`` bytes), or are
    MOST_DELTAS, are both merged into a new base, after which what it replaces is removed. A batch that comes again writes its delta
    again, or nothing if a base has it already.
    """
    spark = batch.sparkSession
    bases, _ = _listed(spark, folder)
    base = max(bases, default=-1)
    if epoch <= base:
        return
    role = {c: "key" for c in keys} | {c: f"order{n:02}" for n, c in enumerate(order)}
    marked = batch.select(*[_marked(F.col(c), c, role.get(c, "")) for c in batch.columns])
    _latest(marked).write.mode("overwrite").parquet(f"{folder}/d{epoch}")
    _, deltas = _listed(spark, folder)
    open_ = [n for n in deltas if base < n <= epoch]
    size = sum(deltas[n] for n in open_)
    if len(open_) >= MOST_DELTAS or size >= max(least, bases.get(base, 0)):
        _read(spark, folder, base, open_).write.mode("overwrite").parquet(f"{folder}/b{epoch}")
        _remove(spark, folder, [f"b{n}" for n in bases] + [f"d{n}" for n in deltas if n <= epoch])


def _read(spark, folder: str, base: int, deltas: list[int]) -> DataFrame:
    paths = ([f"{folder}/b{base}"] if base >= 0 else []) + [f"{folder}/d{n}" for n in sorted(deltas)]
    return _latest(spark.read.parquet(*paths))


def _remove(spark, folder: str, names: list[str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        fs.delete(path(f"{folder}/{name}"), True)


def current_state(spark, folder: str) -> DataFrame | None:
    """The last row of each key, deleted ones included: the base merged with the deltas after it."""
    bases, deltas = _listed(spark, folder)
    base = max(bases, default=-1)
    after = [n for n in deltas if n > base]
    return _read(spark, folder, base, after) if bases or after else None


def journal_tail(changes: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Ledger state from a stream of changes (keys, sequence, present, value), exactly once, by deltas and a base.

    Tombstones are kept in the state, or a late older write would revive a deleted key.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        apply_batch(batch.select(*keys, "sequence", "present", "value"), folder, epoch, keys, ["sequence"])

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_keys(state: DataFrame, keys: list[str]) -> DataFrame:
    return replay(state, keys)


def first_operations(operations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The operations that take effect: the first of each key within the watermark."""
    return operations.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "idempotency_key"])


RECEIPT = "session string, idempotency_key string, request_sha256 string, outcome string"


def idempotency(operations: DataFrame, idle: str = "24 hours") -> DataFrame:
    """An outcome for each operation: APPLIED, REPLAYED (same request again) or IDEMPOTENCY_CONFLICT (another request).

    State holds the first request's hash of each key until the key has been idle in event time.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        first = state.get[0] if state.exists else None
        out = []
        for digest in rows["request_sha256"]:
            if first is None:
                first, outcome = digest, "APPLIED"
            else:
                outcome = "REPLAYED" if digest == first else "IDEMPOTENCY_CONFLICT"
            out.append((*key, digest, outcome))
        state.update((first,))
        _keep(state, rows["ts"].max(), idle_ms)
        yield pd.DataFrame(out, columns=["session", "idempotency_key", "request_sha256", "outcome"])

    keyed = operations.withWatermark("ts", "10 minutes").groupBy("session", "idempotency_key")
    return keyed.applyInPandasWithState(run, RECEIPT, "request_sha256 string", "append", "EventTimeTimeout")


def _keep(state: GroupState, latest: pd.Timestamp, idle_ms: int) -> None:
    at = max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms
    state.setTimeoutTimestamp(at)


def session_carts(mutations: DataFrame, idle: str = "24 hours") -> DataFrame:
    """The cart of each session after every batch that touches it (update mode); idle sessions are evicted.

    Caps bound a session's state; operations beyond them have no effect.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        cart, operations = ({k: tuple(v) for k, v in json.loads(state.get[0]).items()}, json.loads(state.get[1])) if state.exists else ({}, {})
        clean = rows[carts.MUTATION].astype(object).where(lambda d: d.notna(), None)
        cart, operations, _ = carts.fold_session(clean.itertuples(index=False, name=None), cart, operations)
        state.update((json.dumps(cart), json.dumps(operations)))
        _keep(state, rows["ts"].max(), idle_ms)
        yield pd.DataFrame([(key[0], len(cart), len(operations), json.dumps({k: v[2] for k, v in sorted(cart.items())}))], columns=["session", "lines", "operations", "quantities"])

    keyed = mutations.withWatermark("ts", "10 minutes").groupBy("session")
    return keyed.applyInPandasWithState(run, "session string, lines int, operations int, quantities string", "cart string, operations string", "update", "EventTimeTimeout")


def request_pacing(requests: DataFrame, interval: str = "1 second", delay: str = "10 seconds", most_requests: int = 5, most_bytes: int = 10_000_000) -> DataFrame:
    """host, window, requests, bytes, over: tumbling windows against the limits. Runs on static tables too."""
    rows = requests.withWatermark("ts", delay) if requests.isStreaming else requests
    agg = rows.groupBy("host", F.window("ts", interval)).agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))
    return agg.select("host", F.col("window.start").alias("window_start"), "requests", "bytes", ((F.col("requests") > most_requests) | (F.coalesce("bytes", F.lit(0)) > most_bytes)).alias("over"))


def observation_queue(observations: DataFrame, folder: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """The latest observation of each page: late, older observations never override newer ones. then: gets the state after each batch."""

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("source_url", "observed_at", "snapshot_sha256", "input_id", "status")
        apply_batch(rows, folder, epoch, ["source_url"], ["observed_at", "snapshot_sha256", "input_id"])
        if then:
            then(current_state(batch.sparkSession, folder))

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
