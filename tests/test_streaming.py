"""Streams give what their batch forms give."""

import datetime as dt
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import logs, merge, windows
from millrace.plans import filters, registry  # noqa: F401  they register their queries
from millrace.plans.registry import Tables
from millrace.plans.relations import response_log
from millrace.streaming import slo, streams

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def files(spark, tmp_path, parts, schema):
    path = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, spark.read.parquet(path).schema)


def test_upsert_stream_equals_batch(spark, tmp_path):
    schema = "id int, name string, seq int, pushed_at string"
    parts = [[(1, "a", 1, "2024-01-01"), (2, "b", 2, None)], [(1, "c", 3, None), (3, "d", 4, None)]]
    source = files(spark, tmp_path, parts, schema)
    target = str(tmp_path / "target")
    for _ in range(2):  # a second start delivers nothing new
        streams.stream_upsert(source, target, str(tmp_path / "cp"), "id", ["name"], "seq", "pushed_at").awaitTermination()
    batch = merge.dedupe_latest(spark.createDataFrame([r for p in parts for r in p], schema))
    assert {(r.id, r.name) for r in streams.latest(spark, target).collect()} == {(r.id, r.name) for r in batch.collect()}


def test_dedupe_sink_and_late_rows(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    parts = [[(1, at(0), 200, 1.0), (1, at(1), 200, 1.0)], [(2, at(60), 403, 2.0)], [(5, at(61), 200, 2.0)], [(3, at(0), 200, 9.0), (4, at(200), 200, 3.0)]]
    source = files(spark, tmp_path, parts, "id int, ts timestamp, status int, latency_ms double")
    assert sorted(r.id for r in run(streams.stream_dedupe(source, "id", "ts", "10 minutes"), "append", tmp_path, "deduped").collect()) == [1, 2, 4, 5]
    rows = run(slo.stream_slo(source), "append", tmp_path, "slo").collect()
    assert sum(r.n for r in rows) == 10 * 4 and not any(r.mean_latency == 9.0 for r in rows)  # id 3 came too late, id 4 is still open
    out = str(tmp_path / "out")
    for _ in range(2):
        streams.log_sink(source, out, str(tmp_path / "sink")).awaitTermination()
    assert spark.read.parquet(out).count() == 6


@pytest.mark.parametrize("user", [lambda i: i, lambda i: 7, lambda i: None if i % 3 else 4], ids=["both", "odd", "none"])
def test_late_rows_are_cut_in_the_exact_middle(spark, tmp_path, user):
    """The middle is 3600.75 s; rows of that second lie before, on and after it, and users may lack one of the two batches."""
    times = [0, *range(240, 7200, 60), 3600.5, 3600.749999, 3600.75, 3600.9, 7201.5]
    rows = [(i, T0 + dt.timedelta(seconds=s), user(i), 1.0) for i, s in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.sql(f"SELECT start, n FROM ({registry.SQL['t09_late_rows']})").fetchall()
    got = registry.QUERIES["t09_late_rows"](spark, str(tmp_path)).select("start", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40


def test_quota_sessions_progress(spark, tmp_path, sf):
    log = response_log(Tables(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "log")
    log.coalesce(1).write.parquet(path)
    source = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    got = run(streams.stream_quota(source, "search"), "complete", tmp_path, "quota")
    want = logs.quota_windows(log, logs.quota_table(spark)).where("resource = 'search'").drop("resource")
    key = lambda df: sorted((r.token, r.start, r.used, r.remaining, r.exhausted) for r in df.collect())
    assert key(got) == key(want)
    sessions = run(streams.stream_sessions(source, "token"), "complete", tmp_path, "sessions")
    batch = logs.throttle_sessions(log, "token")
    assert sorted((r.token, r.hits, r["first"]) for r in sessions.collect()) == sorted((r.token, r.hits, r["first"]) for r in batch.collect())
    events = spark.createDataFrame([(1, "a", 1, 5, T0), (1, "a", 2, 5, T0 + dt.timedelta(1)), (1, "b", 0, 9, T0 + dt.timedelta(2))], "run int, phase string, done int, total int, ts timestamp")
    r = streams.live_progress(events, "run").first()
    assert (r.phase, r.done, r.total) == ("b", 0, 9)


def test_progress_stream_equals_batch(spark, tmp_path):
    schema = "run int, phase string, done int, total int, ts timestamp"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    parts = [[(1, "a", 1, 5, at(0)), (1, "b", 2, 5, at(1)), (2, "a", 1, 3, at(0))], [(1, "a", 3, 5, at(2)), (2, "a", 2, 3, at(4))], [(1, "a", 4, 5, at(3)), (1, "b", 9, 9, at(1.5))]]
    events = spark.createDataFrame([r for p in parts for r in p], schema)
    want = {(r.run, r.phase, r.done, r.total, r.phase_start) for r in streams.live_progress(events, "run").collect()}
    assert {(r[0], r[1], r[2]) for r in want} == {(1, "a", 4), (2, "a", 2)} and {r[4].minute for r in want} == {2, 0}
    source = files(spark, tmp_path, parts, schema)
    rows = run(streams.live_progress(source, "run"), "update", tmp_path, "progress").collect()
    last = {}
    for r in rows:  # a row of each batch; the newest has the most done here
        last[r.key] = max(last.get(r.key, (0,)), (r.done, r.phase, r.total, r.phase_start))
    assert {(int(k), p, d, n, s) for k, (d, p, n, s) in last.items()} == want


def test_window_states_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, i, rng.choice(["pending", "active", "done", "incomplete"])) for k in "abcdefgh" for i in range(9)] + [("x", 1, "done"), ("x", 2, "active"), ("x", 3, "pending")]
    source = files(spark, tmp_path, [[r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4]], "k string, seq long, state string")
    got = run(streams.stream_window_states(source, "k"), "append", tmp_path, "states_again")
    batch = windows.window_states(spark.createDataFrame(rows, "k string, seq long, state string"), "k", "seq")
    want = {(r.k, r.seq, r.previous, r.state, r.legal) for r in batch.collect()}
    assert {tuple(r) for r in got.collect()} == want and ("x", 2, "pending", "active", True) in want


def test_upsert_stream_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "id int, name string, seq int, pushed_at string"
    parts = [[(i, "a", i, "2024-01-01") for i in range(50)], [(7, "b", 100, None)], [(7, "c", 101, None)]]
    source, target = files(spark, tmp_path, parts, schema), str(tmp_path / "target")
    streams.stream_upsert(source, target, str(tmp_path / "cp"), "id", ["name"], "seq", "pushed_at", buckets=8).awaitTermination()
    table = {r.id: r.name for r in streams.latest(spark, target).collect()}
    assert table == {i: "c" if i == 7 else "a" for i in range(50)}
    kept = [len([n for n in os.listdir(f"{target}/v={v}") if n.startswith("bucket=")]) for v in range(3)]
    assert kept == [7, 1, 1]  # of the bucket that changed twice, the oldest version is gone


def test_window_states_stream(spark, tmp_path):
    rows = [("w", 1, "active"), ("w", 2, "done"), ("w", 3, "active"), ("v", 1, "done"), ("v", 2, "active")]
    source = files(spark, tmp_path, [rows[:2], rows[2:]], "k string, seq long, state string")
    got = run(streams.stream_window_states(source, "k"), "append", tmp_path, "states")
    assert {(r.key, r.seq, r.legal) for r in got.collect()} == {("w", 1, True), ("w", 2, True), ("w", 3, False), ("v", 1, False), ("v", 2, True)}
