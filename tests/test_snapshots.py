"""Snapshots: replacing, empty and failing runs, repeated attempts, half-written versions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.sources import snapshots
from millrace.sources.shared import listed


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "runs")


def rows(spark, path, *run_ids):
    return sorted((r.run_id, r.k) for r in snapshots.read_snapshots(spark, path, list(run_ids) or None).collect())


def table(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k int")


def test_empty_run_replaces(spark, path):
    snapshots.snapshot_run(table(spark, 1, 2), 7, path)
    snapshots.snapshot_run(table(spark, 3), 8, path)
    assert rows(spark, path) == [(7, 1), (7, 2), (8, 3)]
    snapshots.snapshot_run(table(spark), 7, path)
    assert rows(spark, path) == [(8, 3)] and rows(spark, path, 7) == []
    assert snapshots.read_snapshots(spark, path, [7]).columns == ["k", "run_id"]


def test_failed_write_changes_nothing(spark, path):
    snapshots.snapshot_run(table(spark, 1), 7, path)
    bad = spark.range(1000).repartition(4).select(F.when(F.col("id") == 700, F.raise_error(F.lit("stopped"))).otherwise(F.col("id")).cast("int").alias("k"))
    with pytest.raises(PySparkException):
        snapshots.snapshot_run(bad, 7, path)
    assert rows(spark, path) == [(7, 1)]
    # a version without its commit doesn't count, and goes once newer ones are there
    table(spark, 9).write.parquet(f"{path}/run_id=7/v=00000002-killed")
    assert rows(spark, path) == [(7, 1)]
    for k in (5, 6):
        snapshots.snapshot_run(table(spark, k), 7, path)
    assert rows(spark, path) == [(7, 6)]
    snapshots.snapshot_run(table(spark, 8), 7, path)
    assert not [n for n in listed(spark, f"{path}/run_id=7") if "killed" in n]


def test_attempts_are_idempotent_and_old_versions_go(spark, path):
    first = snapshots.snapshot_run(table(spark, 1), 7, path, "a")
    assert snapshots.snapshot_run(table(spark, 2), 7, path, "a") == first and rows(spark, path) == [(7, 1)]
    reader = snapshots.read_snapshots(spark, path, [7])
    snapshots.snapshot_run(table(spark, 3), 7, path, "b")
    assert [r.k for r in reader.collect()] == [1]  # a reader that has begun still finds its version
    for k in (4, 5):
        snapshots.snapshot_run(table(spark, k), 7, path)
    assert len(snapshots.versions(spark, path, 7)) == 2 and rows(spark, path) == [(7, 5)]


def test_unknown_runs_are_errors(spark, path):
    with pytest.raises(ValueError):
        snapshots.read_snapshots(spark, path)
    snapshots.snapshot_run(table(spark, 1), 7, path)
    with pytest.raises(ValueError):
        snapshots.read_snapshots(spark, path, [7, 9])
