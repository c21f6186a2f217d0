"""Scans that go on, and filters that ask and cost."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.predicates import DROP, KEEP
from millrace.operators import runs
from millrace.operators.runs import Handler
from millrace.operators.selection import Order
from millrace.plans import filters, registry  # noqa: F401  they register their queries
from millrace.sources import cursor


def test_a_scan_goes_on_and_repeats_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "scan")
    ids = [i * 3 for i in range(1, 101)]
    df = spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").repartition(4)
    assert cursor.resume_scan(df, "id", path, page_size=10, max_pages=3) == ids[29]
    # a call that is killed before its commit
    with monkeypatch.context() as m:
        m.setattr(cursor, "touch", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cursor.resume_scan(df, "id", path, page_size=10, max_pages=2)
    assert cursor.next_since(spark, path) == ids[29] and cursor.scanned(spark, path).count() == 30
    assert cursor.resume_scan(df, "id", path, page_size=10, max_pages=2) == ids[49]
    assert cursor.commits(spark, path) == [(0, ids[29]), (ids[29], ids[49])]
    # the page that reaches beyond stop_after is whole, and then the scan is over
    assert cursor.resume_scan(df, "id", path, page_size=10, max_pages=9, stop_after=ids[64]) == ids[69]
    assert cursor.resume_scan(df, "id", path, page_size=10, max_pages=9, stop_after=ids[64]) == ids[69]
    while (at := cursor.resume_scan(df, "id", path, page_size=7, max_pages=2)) != ids[-1]:
        assert at in ids
    assert cursor.resume_scan(df, "id", path, page_size=7, max_pages=2) == ids[-1]
    rows = cursor.scanned(spark, path).collect()
    assert sorted(r.id for r in rows) == ids and max(r.page for r in rows if r.since == 0) == 2
    more = df.union(spark.createDataFrame([(1000, "new")], df.schema))  # what comes later is found by the next call
    assert cursor.resume_scan(more, "id", path, page_size=7, max_pages=2) == 1000 and cursor.scanned(spark, path).count() == 101


def test_calls_of_one_write_are_those_one_by_one(spark, tmp_path, monkeypatch):
    ids = [i * 3 for i in range(1, 101)]
    df = spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").repartition(4)
    rows = lambda path: sorted(tuple(r) for r in cursor.scanned(spark, path).select("id", "v", "page", "since").collect())
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    for _ in range(8):  # seven full calls, and a last page of two rows
        cursor.resume_scan(df, "id", one, page_size=7, max_pages=2)
    with monkeypatch.context() as m:  # killed before its commit
        m.setattr(cursor, "touch", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cursor.resume_scan(df, "id", many, page_size=7, max_pages=2, calls=5)
    assert cursor.resume_scan(df, "id", many, page_size=7, max_pages=2, calls=3) == ids[41]
    assert cursor.resume_scan(df, "id", many, page_size=7, max_pages=2, calls=None) == ids[-1]
    assert cursor.resume_scan(df, "id", many, page_size=7, max_pages=2, calls=None) == ids[-1]
    assert rows(many) == rows(one) and len(cursor.commits(spark, many)) == 2
    assert {r[3] for r in rows(many)} == {0, *ids[13:98:14]}
    # the page that reaches beyond stop_after is whole and ends the calls
    assert cursor.resume_scan(df, "id", str(tmp_path / "stopped"), page_size=7, max_pages=2, stop_after=ids[30], calls=9) == ids[34]


def test_the_query_scans_in_a_fixed_number_of_writes(spark, monkeypatch):
    writes, scan = [], cursor.resume_scan
    monkeypatch.setattr(cursor, "resume_scan", lambda *a, **b: writes.append(scan(*a, **b)))
    found = registry.QUERIES["s05_resumed_scan"](spark, "/root/testdata/sf0.01")
    assert len(writes) == 2 and found.count() == 15_000  # 11 calls


def test_handlers_cost_and_stop_at_the_budget(spark):
    df = spark.range(20).withColumn("stars", 100 - F.col("id"))
    asked = []

    def even(rows):
        asked.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", F.when(F.col("id") % 2 == 0, KEEP).otherwise(DROP).alias("status"), F.lit(2).alias("cost")).where("id != 4")

    order = [Order("stars", descending=True)]
    kept, ledger, warnings = runs.run_handlers(df, "id", [Handler("even", even, price=2), Handler("again", even, price=3)], order, budget=52)
    # 40 for all rows, paid for 19 answers; of the 9 left the rest of 14 pays for the first 4
    assert [tuple(r)[1:] for r in ledger.collect()] == [("even", 20, 9, 10, 1, 38, 0), ("again", 9, 4, 0, 5, 8, 0)]
    assert asked == [list(range(20)), [0, 2, 6, 8]] and sorted(r.id for r in kept.collect()) == [0, 2, 6, 8]
    assert warnings == ["again: the budget pays for 4 of 9 rows"]


def test_failing_handlers_are_tried_again(spark):
    tries = []

    def shaky(rows):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("away")
        return rows.select("id", F.lit(KEEP).alias("status"))

    def broken(rows):
        return rows.select("id", F.raise_error(F.lit("no")).alias("status"))

    df = spark.range(5)
    kept, ledger, warnings = runs.run_handlers(df, "id", [Handler("shaky", shaky)], [Order("id")])
    assert kept.count() == 5 and ledger.first().requeues == 1 and not warnings
    kept, ledger, warnings = runs.run_handlers(df, "id", [Handler("broken", broken), Handler("shaky", shaky)], [Order("id")], budget=100)
    assert kept.count() == 0 and [tuple(r)[2:] for r in ledger.collect()] == [(5, 0, 0, 5, 0, 1), (0, 0, 0, 0, 0, 0)] and len(warnings) == 1
