"""Quota windows from first use, in batch and stream, and throttled progress with a clock of its own."""

import datetime as dt
import random
import time
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import logs
from millrace.streaming import streams

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def plain_windows(times, seconds):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1][0] + dt.timedelta(seconds=seconds):
            out.append([t, 0])
        out[-1][1] += 1
    return [tuple(w) for w in out]


def uses(n, seed):
    rng, rows = random.Random(seed), []
    at = defaultdict(lambda: T0)
    for _ in range(n):
        token, resource = rng.choice(["hot"] * 6 + ["a", "b"]), rng.choice(["search"] * 5 + ["code_search"])
        at[token] += dt.timedelta(milliseconds=rng.choice([0, 1, 500, 7_000, 60_000, 61_000, 200_000]))
        rows.append((resource, token, at[token]))
    return rows


@pytest.mark.parametrize("block", [5, 10_000])
def test_first_use_windows_equal_plain_python(spark, block):
    rows = uses(700, 6)
    df = spark.createDataFrame([*rows, ("search", None, T0), ("search", "a", None), ("other", "a", T0)], "resource string, token string, ts timestamp").repartition(5)
    by = defaultdict(list)
    for r, k, t in rows:
        by[r, k].append(t)
    want = {(r, k, t, n, max(q - n, 0), n >= q) for (r, k), times in by.items() for q in [{"search": 30, "code_search": 10}[r]] for t, n in plain_windows(times, 60)}
    got = logs.first_use_windows(df, logs.quota_table(spark), block=block)
    found = {(r.resource, r.token, r.s, r.used, r.remaining, r.exhausted) for r in got.withColumn("s", F.unix_micros("start")).collect()}
    assert found == {(r, k, round(t.timestamp() * 1e6), *rest) for r, k, t, *rest in want}
    assert logs.first_use_windows(df.where("false"), logs.quota_table(spark)).count() == 0


def test_first_use_stream_equals_batch(spark, tmp_path):
    rows = sorted((r for r in uses(500, 7) if r[0] == "search"), key=lambda r: r[2])
    schema = "resource string, token string, ts timestamp"
    path = str(tmp_path / "in")
    late = max(r[2] for r in rows) + dt.timedelta(hours=3)
    for k in range(3):
        part = rows[len(rows) * k // 3 : len(rows) * (k + 1) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("search", "closes", late)], schema).coalesce(1).write.mode("append").parquet(path)
    source = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    streams.log_sink(streams.stream_first_use(source, "search"), str(tmp_path / "rows"), str(tmp_path / "log")).awaitTermination()
    read = lambda df: sorted((r.token, r.s, r.used, r.remaining, r.exhausted) for r in df.withColumn("s", F.unix_micros("start")).collect())
    got = read(spark.read.parquet(str(tmp_path / "rows")))
    want = read(logs.first_use_windows(spark.createDataFrame(rows, schema), logs.quota_table(spark)))
    assert got == want and len(got) > 50


class Clock:
    """A store of one value, timers and the time, as a state processor sees them."""

    def __init__(self):
        self.value, self.timers, self.now = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def test_progress_is_throttled_by_the_clock():
    clock, given = Clock(), []
    p = streams.ThrottledProgress("phase string, done long, total long", 1000)
    p.init(clock)

    def at(now, *events):
        clock.now = now
        for timer in sorted(t for t in clock.timers if t <= now):
            clock.timers.remove(timer)
            for out in p.handleExpiredTimer(("r",), clock, None):
                given.extend((now, *x[1:]) for x in out.itertuples(index=False))
        if events:
            rows = pd.DataFrame([(pd.Timestamp(T0) + pd.Timedelta(s, "s"), phase, done, 9) for s, phase, done in events], columns=["ts", "phase", "done", "total"])
            for out in p.handleInputRows(("r",), iter([rows]), clock):
                given.extend((now, *x[1:]) for x in out.itertuples(index=False))

    at(0, (0, "scan", 1))
    at(100, (1, "scan", 2))
    at(200, (2, "scan", 3), (3, "scan", 4))
    at(900, (2.5, "scan", 0))  # older than what is known
    at(1000)
    at(1500, (4, "scan", 5))
    at(1600, (5, "detail", 0))
    at(1700, (6, "detail", 1))
    at(1800, (7, "done", 9))
    at(3000)
    assert [(now, phase, done) for now, phase, done, _ in given] == [(0, "scan", 1), (1000, "scan", 4), (1600, "detail", 0), (1800, "done", 9)]


def test_throttled_progress_stream(spark, tmp_path):
    schema = "run int, phase string, done int, total int, ts timestamp"
    path = str(tmp_path / "in")
    for k, part in enumerate([[(1, "a", 1, 5), (2, "a", 1, 3)], [(1, "b", 2, 5)], [(1, "done", 5, 5), (2, "done", 3, 3)]]):
        spark.createDataFrame([(*r, T0 + dt.timedelta(minutes=k)) for r in part], schema).coalesce(1).write.mode("append").parquet(path)
    source = streams.read_stream(spark, path, spark.read.parquet(path).schema)
    rows = streams.throttled_progress(source, "run")
    q = rows.writeStream.outputMode("update").format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:  # with timers of the clock a query has no end of its own
        until = time.time() + 60
        while time.time() < until and spark.table("throttled").where("phase = 'done'").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert {(r.key, r.phase, r.done) for r in spark.table("throttled").collect()} == {("1", "a", 1), ("2", "a", 1), ("1", "b", 2), ("1", "done", 5), ("2", "done", 3)}
