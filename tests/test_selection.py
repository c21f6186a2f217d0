"""Rows by place, against sorting in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational, selection
from millrace.operators.selection import Order


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 7, 7, 7, rng.randrange(50)]), rng.choice([None, "x", "yy", "z"]), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a int, b string, c double").repartition(5).cache()
    return rows, df


def in_order(rows, keys):
    """Sorted by (index, descending, nulls last) keys."""
    for at, descending, last in reversed(keys):
        null, value = [r for r in rows if r[at] is None], [r for r in rows if r[at] is not None]
        value = sorted(value, key=lambda r: r[at], reverse=descending)
        rows = value + null if last else null + value
    return rows


CASES = [[("c", False, True)], [("a", True, True), ("id", False, True)], [("a", False, False), ("b", True, True), ("id", True, True)], [("b", False, False), ("c", True, True)]]
PLACE = {"id": 0, "a": 1, "b": 2, "c": 3}


@pytest.mark.parametrize("keys", CASES)
def test_slices_equal_sorting(table, keys):
    rows, df = table
    want = in_order(rows, [(PLACE[c], d, last) for c, d, last in keys])
    orders = [Order(c, d, last) for c, d, last in keys]
    for start, stop in ((0, 10), (1490, 1530), (2990, 3000), (2995, 3050), (3000, 3010)):
        assert [tuple(r) for r in selection.slice_rows(df, orders, start, stop, most=100).collect()] == want[start:stop]
    inside, first, n = selection.around(df, orders, 1500, 1510, most=100, sample=500)
    assert n < 3000 and first <= 1500 and first + n >= 1510 and df.where(inside).count() == n
    for n in (0, 1, 1234, 2999, 3000, 4000):
        assert {tuple(r) for r in selection.first_rows(df, orders, n, most=100).collect()} == set(want[:n])


def test_ties_without_a_unique_key(table):
    rows, df = table
    found = selection.first_rows(df, [Order("a")], 1000, most=50).collect()
    assert len(found) == 1000 and sorted(r.a for r in found) == sorted(r[1] for r in rows if r[1] is not None)[:1000]
    page = selection.slice_rows(df, [Order("a")], 700, 720, most=50).collect()
    assert [r.a for r in page] == sorted(r[1] for r in rows if r[1] is not None)[700:720]


def test_expressions_caps_and_deep_pages(table, monkeypatch):
    rows, df = table
    monkeypatch.setattr(relational, "SORTED", 100)
    order = [Order(F.coalesce("a", F.lit(0)), True), Order(F.coalesce("b", F.lit("")), True), Order("id")]
    want = sorted(sorted(sorted(rows, key=lambda r: r[0]), key=lambda r: r[2] or "", reverse=True), key=lambda r: r[1] or 0, reverse=True)
    kept, counts = relational.cap(df, order, 1500, 400)
    assert {r.id for r in kept.collect()} == {r[0] for r in want[:1500]} and tuple(counts.first()) == (1500, 1100)
    page = relational.page_of(df, "c", {"c": "c"}, "id", 20, 100)
    assert [r.id for r in page.collect()] == [r[0] for r in sorted(rows, key=lambda r: -r[3])[1900:2000]]
    assert relational.slice_page(df, ["id"], 50, 100).count() == 0
