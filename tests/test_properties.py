"""Random cases against plain Python."""

import datetime as dt
import fnmatch
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.operators import merge, relational, windows


@settings(max_examples=300, deadline=None)
@given(st.text("ab/.*?[]!-", max_size=8), st.text("ab/.-", max_size=8))
def test_globs_match_as_fnmatch_does(pattern, path):
    try:
        want = bool(re.match(fnmatch.translate(pattern), path))
    except re.error:
        return
    if not re.search(r"\[[^]]*[!-]|\[\]", pattern):  # ranges and negations differ in what is an error
        assert bool(re.search(P.glob_regex(pattern), path)) == want


def test_merge_windows_random(spark):
    rng, day = random.Random(1), dt.date(2020, 1, 1)
    rows = []
    for k in range(40):
        for _ in range(rng.randint(1, 9)):
            a, b = rng.randint(-5, 60), rng.randint(-5, 60)
            rows.append((k, None if rng.random() < 0.05 else day + dt.timedelta(a), None if rng.random() < 0.05 else day + dt.timedelta(b)))
    floor, ceiling = day, day + dt.timedelta(50)
    want = set()
    for k in range(40):
        covered = set()
        for kk, a, b in rows:
            lo, hi = max(a or floor, floor), min(b or ceiling, ceiling)
            if kk == k and lo <= hi:
                covered.update(lo + dt.timedelta(i) for i in range((hi - lo).days + 1))
        for d in sorted(covered):
            if d - dt.timedelta(1) not in covered:
                end = d
                while end + dt.timedelta(1) in covered:
                    end += dt.timedelta(1)
                want.add((k, d, end))
    df = spark.createDataFrame(rows, "k int, lo date, hi date")
    got = windows.merge_windows(df, F.lit(floor), F.lit(ceiling), by="k")
    assert {(r.k, r.lo, r.hi) for r in got.collect()} == want


def test_dedupe_random(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 12), f"v{i}", rng.choice([None, "junk", "2024-01-01", "2024-02-01T00:00:00Z", "2024-03-01"])) for i in range(120)]
    real = {"2024-01-01": 1, "2024-02-01T00:00:00Z": 2, "2024-03-01": 3}
    want = {}
    for seq, key, name, pushed in rows:
        if key not in want:
            want[key] = [name, pushed, seq]
        else:
            kept = want[key][1]
            if pushed in real and (kept not in real or real[pushed] > real[kept]):
                kept = pushed
            want[key][:2] = [name, kept]
    df = spark.createDataFrame(rows, "seq int, id int, name string, pushed_at string").repartition(5)
    got = {r.id: [r.name, r.pushed_at, r.position] for r in merge.dedupe_latest(df).collect()}
    for k, (name, pushed, seq) in want.items():
        assert got[k][0] == name and got[k][2] == seq
        assert got[k][1] == pushed or (pushed not in real and got[k][1] not in real)


def test_segments_random(spark):
    rng = random.Random(3)
    for _ in range(4):
        ids = {rng.randint(0, 999) for _ in range(rng.randint(1, 200))}
        n = rng.randint(1, 9)
        rows = relational.even_segments(spark.createDataFrame([(i,) for i in [*ids, *ids]], "k long"), "k", n).orderBy("segment").collect()
        assert [r.n for r in rows] == [len(ids) // len(rows) + (i < len(ids) % len(rows)) for i in range(len(rows))]
        assert [sum(r.after < i <= r.upto for i in ids) for r in rows] == [r.n for r in rows]
