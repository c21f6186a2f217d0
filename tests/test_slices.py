"""Work in blocks of a key's rows, and ranges, against plain Python."""

import bisect
import math
import random
from collections import defaultdict

import pytest

from millrace.operators import logs, relational, slices


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(2)
    at, rows = defaultdict(int), []
    for i in range(1500):
        token = rng.choice(["hot"] * 8 + ["a", "b", None])
        at[token] += rng.choice([0, 1, 50, 400, 700])
        rows.append((i, token, at[token], rng.choice([200, 304, 403, 429, 429, 403, 500]), rng.randrange(1000)))
    df = spark.createDataFrame(rows, "id long, token string, s long, status int, latency_ms long").selectExpr("*", "timestamp_seconds(s) as ts").repartition(7)
    return rows, df


def by_token(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out[r[1]].append(r)
    return out


@pytest.mark.parametrize("block", [7, 10_000])
def test_hit_streaks_in_blocks(log, block):
    rows, df = log
    want = {}
    for token, found in by_token(rows).items():
        total, streak, before = 0, 0, None
        for i, _, s, status, _ in found:
            if status in (403, 429):
                total += 1
                streak = streak + 1 if before and before[1] and s - before[0] <= 600 else 1
                want[i] = (token, total, streak)
            if status in (403, 429, 200, 304):
                before = (s, status in (403, 429))
    got = logs.hit_streaks(df, "token", ["ts", "id"], block=block)
    assert set(got.columns) == {*df.columns, "total", "streak"}
    assert {r.id: (r.token, r.total, r.streak) for r in got.collect()} == want


@pytest.mark.parametrize("block", [50, 10_000])
def test_sliding_p95_in_blocks(log, block):
    rows, df = log
    want = {}
    for found in by_token(rows).values():
        for k, r in enumerate(found):
            last = sorted(x[4] for x in found[max(0, k - 49) : k + 1])
            want[r[0]] = last[math.ceil(len(last) * 0.95) - 1]
    assert {r.id: r.p95 for r in logs.sliding_p95(df, "token", "latency_ms", ["ts", "id"], block=block).collect()} == want


@pytest.mark.parametrize("block", [3, 10_000])
def test_previous_runs_in_blocks(log, block):
    rows, df = log
    want = {(r[0], found[k - d][0], d) for found in by_token(rows).values() for k, r in enumerate(found) for d in (1, 2, 3) if k >= d}
    assert {tuple(r) for r in relational.previous_runs(df, "token", "s", "id", block=block).collect()} == want


def test_a_large_key_is_in_many_blocks(spark):
    df = spark.range(40_000).selectExpr("id", "'one' as key", "id % 100 as v")
    placed = slices.number_in_key(df, "key", ["id"])
    sizes = slices.blocks(placed, 49, 1000).groupBy("_block").count().collect()
    assert len(sizes) == 41 and max(r["count"] for r in sizes) == 1049  # the last margin stands alone
    total = slices.running(placed, "key", {"n": ("sum", placed.v), "m": ("max", placed.id)}, 1000)
    assert {(r.id, r.n, r.m) for r in total.where("id % 9999 = 0").collect()} == {(i, sum(k % 100 for k in range(i + 1)), i) for i in range(0, 40_000, 9999)}


@pytest.mark.parametrize("most", [100_000, 0])
def test_ranges(spark, most):
    rng = random.Random(3)
    cuts = sorted(rng.sample(range(-50, 1000), 60))
    ranges = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if i % 5]
    keys = [rng.choice([None, 500, 500, rng.randrange(-100, 1100), rng.choice(cuts)]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, k int").repartition(6)
    side = spark.createDataFrame(ranges, "name int, after int, upto int")
    got = {(r.id, r.name) for r in slices.assign_ranges(df, side, "k", most=most).collect()}
    lows = [a for _, a, _ in ranges]
    want = set()
    for i, k in enumerate(keys):
        if k is not None and (at := bisect.bisect_left(lows, k) - 1) >= 0 and k <= ranges[at][2]:
            want.add((i, ranges[at][0]))
    assert got == want
    assert slices.assign_ranges(df, side.where("false"), "k", most=most).count() == 0
    assert slices.assign_ranges(df.where("false"), side, "k", most=most).count() == 0
