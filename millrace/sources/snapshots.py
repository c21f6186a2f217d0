"""Snapshots of runs: each write is a new version, which counts once its commit is there.

    path/run_id=7/v=00000002-<attempt>/part-...parquet    a version
    path/_commits/run_id=7/00000002-<attempt>             its commit, an empty file

A version is written first and its commit last, as one file that is there or isn't. So readers see the whole new version
or the whole one before, an empty run replaces what was there, and a write that fails, or is killed, changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.shared import listed, remove, touch


def versions(spark: SparkSession, path: str, run_id: int) -> list[str]:
    """Committed versions of a run, oldest first."""
    return listed(spark, f"{path}/_commits/run_id={run_id}")


def snapshot_run(items: DataFrame, run_id: int, path: str, attempt: str | None = None) -> str:
    """Replace the items of one run, and return the version; those of other runs stay.

    A write under an `attempt` that was committed before is not done again. Of versions written at the same time the one
    with the greater name counts. The version before stays for readers that have begun; older ones, and the leavings of
    writes that failed before it, are deleted.
    """
    spark, attempt = items.sparkSession, attempt or uuid.uuid4().hex
    known = versions(spark, path, run_id)
    if done := [v for v in known if v.split("-", 1)[1] == attempt]:
        return done[0]
    number = 1 + max((int(v[:8]) for v in known), default=0)
    version = f"{number:08d}-{attempt}"
    items.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/v={version}")
    touch(spark, f"{path}/_commits/run_id={run_id}/{version}")
    for name in listed(spark, f"{path}/run_id={run_id}"):
        if name.startswith("v=") and int(name[2:10]) < number - 1:
            remove(spark, f"{path}/_commits/run_id={run_id}/{name[2:]}")
            remove(spark, f"{path}/run_id={run_id}/{name}")
    return version


def read_snapshots(spark: SparkSession, path: str, run_ids: list[int] | None = None) -> DataFrame:
    """The items of the newest version of each run (of all runs by default), with run_id. Unknown runs are an error."""
    names = [n[7:] for n in listed(spark, f"{path}/_commits")] if run_ids is None else map(str, run_ids)
    newest = {n: versions(spark, path, n) for n in names}
    if missing := [n for n, v in newest.items() if not v]:
        raise ValueError(f"no snapshot of runs {missing}")
    if not newest:
        raise ValueError(f"no snapshots in {path}")
    folders = [f"{path}/run_id={n}/v={v[-1]}" for n, v in newest.items()]
    return spark.read.option("basePath", path).parquet(*folders).drop("v")
