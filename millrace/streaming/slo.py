"""Service metrics that follow a stream of responses: over its newest n, and over sliding windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.logs import live_slo, slo_snapshot
from millrace.sources.shared import listed, remove


def stream_slo(log: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Metrics of sliding windows, appended when a window is over; rows later than the delay are dropped."""
    return live_slo(log.withWatermark(ts, delay), ts)


def stream_last_n(source: DataFrame, target: str, checkpoint: str, n: int = 1000, tables: Callable[[SparkSession], dict[str, DataFrame]] | None = None) -> StreamingQuery:
    """After each micro-batch, the metrics of slo_snapshot over the newest n responses by (ts, id) of all batches so far.

    The newest n rows are kept in target/newest/v=<batch>, the metrics in target/slo/v=<batch>. A batch adds its own
    newest n to those of the batch before, so it reads n rows besides its own, and one that is delivered again gives the
    same. `tables` gives the tables `windows` and `owners` as they are at that time.
    """
    latest = lambda df: df.orderBy(F.desc("ts"), F.desc("id")).limit(n)

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest, before = latest(batch), [v for v in _versions(spark, f"{target}/newest") if v < batch_id]
        if before:
            newest = latest(newest.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/newest/v={before[-1]}")))
        newest.write.mode("overwrite").parquet(f"{target}/newest/v={batch_id}")
        kept = spark.read.schema(batch.schema).parquet(f"{target}/newest/v={batch_id}")
        slo_snapshot(kept, **(tables(spark) if tables else {}), n=n).write.mode("overwrite").parquet(f"{target}/slo/v={batch_id}")
        for v in before[:-1]:
            remove(spark, f"{target}/newest/v={v}")

    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name[2:]) for name in listed(spark, path) if name.startswith("v="))


def read_last_n(spark: SparkSession, target: str) -> DataFrame:
    """Metrics by batch, as `v`; the greatest is the latest."""
    return spark.read.parquet(f"{target}/slo")
