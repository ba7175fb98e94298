"""Streaming forms against their batch forms."""

import datetime as dt

import pytest

from siteledger.streaming import jobs

AT = dt.datetime(2026, 1, 1)


def write(spark, folder, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{n}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(query_df, mode, spark, name, checkpoint):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").collect()


def test_journal_tail_is_exactly_once_and_keeps_tombstones(spark, tmp_path):
    schema = "k string, sequence long, present boolean, value string"
    write(spark, tmp_path / "in", [("a", 1, True, "1"), ("b", 2, True, "2"), ("a", 5, False, None)], schema, 1)
    jobs.journal_tail(stream(spark, tmp_path / "in", schema), f"file://{tmp_path}/state", str(tmp_path / "cp"), ["k"]).awaitTermination()
    write(spark, tmp_path / "in", [("a", 3, True, "late"), ("b", 9, True, "new")], schema, 2)
    for _ in range(2):  # the second run has nothing new and must change nothing
        jobs.journal_tail(stream(spark, tmp_path / "in", schema), f"file://{tmp_path}/state", str(tmp_path / "cp"), ["k"]).awaitTermination()
    state = jobs.current_state(spark, f"file://{tmp_path}/state")
    assert [(r.k, r.value) for r in jobs.live_keys(state, ["k"]).collect()] == [("b", "new")]


def test_operations_are_idempotent_and_conflicts_show(spark, tmp_path):
    schema = "session string, idempotency_key string, request_sha256 string, ts timestamp, seq long"
    write(spark, tmp_path / "in", [("s", "k", "h", AT, 1), ("s", "k", "h", AT, 2), ("s", "m", "x", AT, 3)], schema, 1)
    write(spark, tmp_path / "in", [("s", "k", "other", AT + dt.timedelta(minutes=1), 4)], schema, 2)
    got = run(jobs.idempotency(stream(spark, tmp_path / "in", schema)), "append", spark, "receipts", str(tmp_path / "cp"))
    assert sorted((r.idempotency_key, r.outcome) for r in got) == [("k", "APPLIED"), ("k", "IDEMPOTENCY_CONFLICT"), ("k", "REPLAYED"), ("m", "APPLIED")]
    first = run(jobs.first_operations(stream(spark, tmp_path / "in", schema)), "append", spark, "firsts", str(tmp_path / "cp2"))
    assert sorted(r.idempotency_key for r in first) == ["k", "m"]


def test_session_carts_survive_batches(spark, tmp_path):
    schema = "session string, seq long, ts timestamp, idempotency_key string, action string, item_id string, variant_id string, line_id string, quantity long, request_sha256 string, low long, high long, step long"
    add = lambda k, seq, q, m: ("s", seq, AT + dt.timedelta(minutes=m), k, "cart.add", "i", None, None, q, "h", None, None, None)
    write(spark, tmp_path / "in", [add("1", 1, 2, 0)], schema, 1)
    write(spark, tmp_path / "in", [add("2", 2, 3, 1), add("1", 3, 2, 1)], schema, 2)
    got = run(jobs.session_carts(stream(spark, tmp_path / "in", schema)), "update", spark, "carts", str(tmp_path / "cp"))
    assert [(r.lines, r.operations, r.quantities) for r in got][-1] == (1, 2, '{"i\\u001f": 5}')


def test_pacing_windows(spark, tmp_path):
    schema = "host string, ts timestamp, bytes long"
    rows = [("h", AT + dt.timedelta(milliseconds=100 * k), 10) for k in range(12)]
    write(spark, tmp_path / "in", rows, schema, 1)
    write(spark, tmp_path / "in", [("h", AT + dt.timedelta(minutes=5), 1)], schema, 2)
    got = run(jobs.request_pacing(stream(spark, tmp_path / "in", schema)), "append", spark, "pacing", str(tmp_path / "cp"))
    assert sorted((r.requests, r.over) for r in got) == [(2, False), (10, True)]
    assert jobs.request_pacing(spark.createDataFrame(rows, schema)).count() == 2


def test_late_observations_never_override(spark, tmp_path):
    schema = "source_url string, observed_at timestamp, snapshot_sha256 string, input_id string, status string"
    write(spark, tmp_path / "in", [("u", AT + dt.timedelta(hours=1), "a", "i", "DOM_OBSERVED")], schema, 1)
    jobs.observation_queue(stream(spark, tmp_path / "in", schema), f"file://{tmp_path}/q", str(tmp_path / "cp")).awaitTermination()
    write(spark, tmp_path / "in", [("u", AT, "b", "i", "ACCESS_CHALLENGE"), ("v", AT, "c", "i", "DOM_OBSERVED")], schema, 2)
    jobs.observation_queue(stream(spark, tmp_path / "in", schema), f"file://{tmp_path}/q", str(tmp_path / "cp")).awaitTermination()
    got = {r.source_url: r.status for r in jobs.current_state(spark, f"file://{tmp_path}/q").collect()}
    assert got == {"u": "DOM_OBSERVED", "v": "DOM_OBSERVED"}


@pytest.mark.parametrize("name", ["nothing-there"])
def test_no_state_yet(spark, tmp_path, name):
    assert jobs.current_state(spark, f"file://{tmp_path}/{name}") is None


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    import os

    folder, schema = f"file://{tmp_path}/s", "k string, sequence long, present boolean, value string"
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / "s" / name).rglob("*.parquet"))
    jobs.apply_batch(spark.createDataFrame([(f"k{i}", i, True, f"{i * 7919:x}") for i in range(20_000)], schema), folder, 0, ["k"], ["sequence"], least=0)
    assert os.listdir(tmp_path / "s") == ["b0"]
    small = spark.createDataFrame([("k1", 30_000, True, "new"), ("k2", 1, True, "late"), ("k3", 30_001, False, None)], schema)
    for epoch in (1, 1, 2):
        jobs.apply_batch(small, folder, epoch, ["k"], ["sequence"], least=0)
    assert sorted(os.listdir(tmp_path / "s")) == ["b0", "d1", "d2"] and size("d1") * 20 < size("b0")
    state = {r.k: (r.sequence, r.value) for r in jobs.current_state(spark, folder).collect()}
    assert len(state) == 20_000 and state["k1"] == (30_000, "new") and state["k2"] == (2, f"{2 * 7919:x}") and state["k3"] == (30_001, None)
    jobs.apply_batch(spark.createDataFrame([(f"n{i}", i, True, f"{i * 104729:x}") for i in range(30_000)], schema), folder, 3, ["k"], ["sequence"], least=0)
    assert os.listdir(tmp_path / "s") == ["b3"]
    jobs.apply_batch(small.limit(0), folder, 3, ["k"], ["sequence"], least=0)  # comes again after its base was written
    assert os.listdir(tmp_path / "s") == ["b3"] and jobs.current_state(spark, folder).count() == 50_000
    assert {r.k: r.value for r in jobs.live_keys(jobs.current_state(spark, folder), ["k"]).filter("k in ('k1', 'k3')").collect()} == {"k1": "new"}


def test_many_small_batches_are_merged(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(jobs, "MOST_DELTAS", 4)
    folder = f"file://{tmp_path}/s"
    for epoch in range(9):
        jobs.apply_batch(spark.createDataFrame([("a", epoch, f"v{epoch}"), (f"b{epoch}", 0, "x")], "k string, n int, v string").coalesce(1), folder, epoch, ["k"], ["n"])
    assert sorted(os.listdir(tmp_path / "s")) == ["b7", "d8"]
    assert {r.k: r.v for r in jobs.current_state(spark, folder).collect()} == {"a": "v8"} | {f"b{k}": "x" for k in range(9)}
