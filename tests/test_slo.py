"""Streamed service metrics against the snapshot of the whole log."""

import datetime as dt
import math
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.operators import logs
from millrace.plans import analytics, registry  # noqa: F401  analytics registers the query
from millrace.streaming import slo, streams

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "id long, ts timestamp, status int, resource string, remaining int, incomplete boolean, latency_ms double"


def responses(n, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=rng.randrange(7200))
        rows.append((i, at, rng.choice([200] * 6 + [403, 422, 429, 502]), rng.choice(["graphql", "core"]), rng.choice([None, rng.randrange(5000)]), rng.choice([None, True, False, False]), rng.choice([None, rng.random() * 900])))
    return rows


def files(spark, path, rows, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, spark.read.parquet(path).schema)


def test_last_n_equals_snapshot_after_each_batch(spark, tmp_path):
    rows = responses(600)
    source = files(spark, str(tmp_path / "in"), rows, 5)
    target = str(tmp_path / "out")
    states = spark.createDataFrame([("done",), ("pending",)], "state string")
    for _ in range(2):  # a second start folds nothing twice
        slo.stream_last_n(source, target, str(tmp_path / "cp"), 100, lambda s: {"windows": states}).awaitTermination()
    got = {r.v: tuple(r)[:-1] for r in slo.read_last_n(spark, target).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    whole = logs.slo_snapshot(spark.createDataFrame(rows, SCHEMA), states, n=100).first()
    assert got[4] == tuple(whole) and whole.shard_coverage == 0.5 and whole.p95_latency_ms
    assert len({x for x in got.values()}) > 1
    assert spark.read.parquet(f"{target}/newest/v=4").count() == 100 and sorted(slo._versions(spark, f"{target}/newest")) == [3, 4]


def test_sliding_windows_equal_plain_python_in_batch_and_stream(spark, tmp_path):
    rows = sorted(responses(900, 5), key=lambda r: r[1])
    df = spark.createDataFrame(rows, SCHEMA)
    by = defaultdict(list)
    for r in rows:
        minute = int((r[1] - T0).total_seconds() // 60)
        for m in range(minute - 9, minute + 1):
            by[m].append(r)
    want = {}
    for m, found in by.items():
        n, lat = len(found), sorted(r[6] for r in found if r[6] is not None)
        known = [r[5] for r in found if r[5] is not None]
        quota = [(r[1], r[0], r[4]) for r in found if r[3] == "graphql" and r[4] is not None]
        share = lambda *s: sum(r[2] in s for r in found) / n  # noqa: B023, E731
        want[m] = (n, max(quota)[2] if quota else None, sum(known) / len(known) if known else None, share(422), share(403, 429), lat[math.ceil(0.95 * len(lat)) - 1] if lat else None)
    columns = ["n", "graphql_remaining", "incomplete_results_ratio", "rate_422", "rate_403_429", "p95_latency_ms"]
    minute = ((F.unix_timestamp("start") - int(T0.timestamp())) / 60).cast("int")
    read = lambda d: {r[0]: tuple(r)[1:] for r in d.select(minute.alias("m"), *columns).collect()}
    assert read(logs.live_slo(df)) == want
    path = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[300 * k : 300 * k + 300], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = slo.stream_slo(streams.read_stream(spark, path, df.schema))
    streams.log_sink(stream, str(tmp_path / "rows"), str(tmp_path / "log")).awaitTermination()
    got = read(spark.read.parquet(str(tmp_path / "rows")))
    # a window is given once it is over by the delay
    assert got == {m: v for m, v in want.items() if m in got} and len(got) >= max(want) - 25


def test_sketches_are_close_beyond_their_size(spark):
    df = spark.range(100_000).selectExpr("timestamp_seconds(1704067200 + id % 60) as ts", "200 as status", "cast(pmod(id * 7919, 100000) as double) as latency_ms")
    r = logs.live_slo(df).where("n = 100000").first()
    assert abs(r.p95_latency_ms - 95_000) < 300 and r.incomplete_results_ratio is None and r.graphql_remaining is None


def test_means_half_way_between_two_roundings_are_those_of_the_sum_by_id(spark):
    rng = random.Random(6)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randrange(36_000)), 200, rng.choice([None, *[rng.randrange(-9_000, 30_000) / 100] * 9])) for i in range(4000)]
    found, shuffled = defaultdict(list), rng.sample(rows, len(rows))
    for r in rows:
        minute = int((r[1] - T0).total_seconds() // 60)
        for m in range(minute - 9, minute + 1):
            if r[3] is not None:
                found[m].append(r[3])

    def rounded(x):
        y = abs(x) * 1e4
        return math.copysign(math.floor(y) + (y - math.floor(y) >= 0.5), x) / 1e4

    def mean(values):
        total = 0.0
        for v in values:  # not sum(), which corrects its errors
            total += v
        return rounded(total / len(values))

    want = {m: mean(v) for m, v in found.items()}
    assert want != {m: rounded(math.fsum(v) / len(v)) for m, v in found.items()}
    df = spark.createDataFrame(shuffled, "id long, ts timestamp, status int, latency_ms double").repartition(7)
    minute = ((F.unix_timestamp("start") - int(T0.timestamp())) / 60).cast("int")
    got = logs.live_slo(df, digits=4)
    assert got.columns == logs.live_slo(df).columns
    assert {r[0]: r[1] for r in got.select(minute, "mean_latency").collect() if r[1] is not None} == want


# means of 8, 16, ... cents lie half way between two roundings of 4 decimals, 41 of 640 between two of 6
TIES = {"means": [*range(3200)], "shares": sorted([*[i for i in range(0, 4000, 17) if i % 11 and i % 13][:41], *[i for i in range(4000) if i % 17][:599]])}


@pytest.mark.parametrize("name", TIES)
def test_live_slo_query_equals_sql_on_ties(spark, tmp_path, name):
    rng = random.Random(7)
    seconds = {"means": 75, "shares": 0.01}[name]
    rows = [(i, T0 + dt.timedelta(seconds=i * seconds), i % 50, "view", rng.randrange(30_000) / 100, '{"k": 1}') for i in TIES[name]]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.sql(registry.SQL["t05_live_slo"])
    got = registry.QUERIES["t05_live_slo"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
