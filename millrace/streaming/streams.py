"""Structured Streaming forms: upserts by micro-batch, dedupe, quotas, sessions, live metrics, progress, states, log sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators.logs import QUOTAS
from millrace.operators.merge import dedupe_latest, upsert
from millrace.operators.windows import TRANSITIONS
from millrace.sources.shared import listed, materialize, release, remove


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_upsert(source: DataFrame, target: str, checkpoint: str, key: str, fields: list[str], seq: str, pushed: str, buckets: int = 64) -> StreamingQuery:
    """Merge each micro-batch into a table of buckets of the key: target/v=<batch>/bucket=<b>.

    A batch rewrites the buckets that it touches, from their newest version below its own number, so a batch that is
    delivered again gives the same; versions older than that one are deleted. `latest` reads the newest of each bucket.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = staged = materialize(dedupe_latest(batch, key, seq, pushed).select(key, *fields, bucket.alias("bucket")))
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # `buckets` at most
        old = _newest(spark, target, batch_id, touched)
        if old:
            known = spark.read.parquet(*[f"{target}/v={v}/bucket={b}" for b, v in old.items()]).select(key, *fields)
            new = upsert(known, new.drop("bucket"), key, fields).select(key, *fields).withColumn("bucket", bucket)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={batch_id}")
        release(staged)
        for v in [int(n[2:]) for n in listed(spark, target) if n.startswith("v=")]:
            for b, keep in old.items():
                if v < keep:
                    remove(spark, f"{target}/v={v}/bucket={b}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, target: str, below: int | None = None, of: set[int] | None = None) -> dict[int, int]:
    """Newest version of each bucket."""
    out: dict[int, int] = {}
    for v in sorted(int(n[2:]) for n in listed(spark, target) if n.startswith("v=")):
        if below is None or v < below:
            out |= {b: v for n in listed(spark, f"{target}/v={v}") if n.startswith("bucket=") for b in [int(n[7:])] if of is None or b in of}
    return out


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    """The table that stream_upsert keeps."""
    parts = _newest(spark, target)
    return spark.read.parquet(*[f"{target}/v={v}/bucket={b}" for b, v in parts.items()]) if parts else None


def stream_dedupe(source: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Rows whose key wasn't seen within the delay."""
    return source.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_quota(log: DataFrame, resource: str, ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Use of one resource's quota per token in tumbling windows."""
    quota, seconds = next((q, s) for r, q, s in QUOTAS if r == resource)
    used = log.where(F.col("resource") == resource).withWatermark(ts, delay).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), "token").agg(F.count(F.lit(1)).alias("used"))
    return used.select("token", F.col("w.start").alias("start"), "used", F.greatest(F.lit(quota) - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") >= quota).alias("exhausted"))


class FirstUseWindows(StatefulProcessor):
    """One open window for each key: when it began, and its uses. It is given when a later use or the watermark ends it."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "start long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        window, over = tuple(self.open.get()) if self.open.exists() else None, []
        before = window
        for at in sorted(pd.concat(list(rows))["at"].tolist()):
            if window is not None and at >= window[0] + self.seconds * 1_000_000:
                over.append(window)
                window = None
            window = (at, 1) if window is None else (window[0], window[1] + 1)
        self.open.update(window)
        if before is None or before[0] != window[0]:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(window))
        yield self._rows(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        window = tuple(self.open.get()) if self.open.exists() else None
        over = window is not None and self._end(window) <= expiredTimerInfo.getExpiryTimeInMs()
        if over:
            self.open.clear()
        yield self._rows(key, [window] if over else [])

    def _end(self, window: tuple[int, int]) -> int:
        """Milliseconds, at or after the window's end."""
        return -(-(window[0] + self.seconds * 1_000_000) // 1000)

    def _rows(self, key, over: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], start, used) for start, used in over], columns=["token", "start", "used"])

    def close(self) -> None:
        pass


def stream_first_use(log: DataFrame, resource: str, ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Use of one resource's quota per token in windows that begin with their first use, when they are over.

    Uses are taken in order of time inside a batch; those of a later batch should not be earlier, as a window that has
    begun keeps its start. Needs the RocksDB state store.
    """
    quota, seconds = next((q, s) for r, q, s in QUOTAS if r == resource)
    uses = log.where((F.col("resource") == resource) & F.col("token").isNotNull()).withWatermark(ts, delay)
    uses = uses.select(F.col("token").cast("string").alias("token"), F.unix_micros(ts).alias("at"), F.col(ts).alias("_ts"))
    schema = "token string, start long, used long"
    found = uses.groupBy("token").transformWithStateInPandas(FirstUseWindows(seconds), schema, "Append", "EventTime")
    rest = F.greatest(F.lit(quota) - F.col("used"), F.lit(0)).alias("remaining")
    return found.select("token", F.timestamp_micros("start").alias("start"), "used", rest, (F.col("used") >= quota).alias("exhausted"))


def stream_sessions(log: DataFrame, key: str, ts: str = "ts", gap: str = "600 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sessions of throttle hits."""
    hits = log.where(F.col("status").isin(403, 429)).withWatermark(ts, delay)
    return hits.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("hits"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


PROGRESS = ["phase", "done", "total"]


def live_progress(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Latest phase, done and total per run, and when the run entered that phase; a phase that recurs starts anew.

    Rows of one run have different times. A stream gives a run's row after each batch that has events of it.
    """
    if events.isStreaming:
        keyed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), *PROGRESS).groupBy("key")
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*PROGRESS).schema)
        at = events.schema[ts].dataType.simpleString()
        return keyed.transformWithStateInPandas(Progress(f"ts {at}, {fields}, phase_start {at}"), f"key string, {fields}, phase_start {at}", "Update", "None")
    by_phase = events.groupBy(key, "phase").agg(F.max(ts).alias("_last"))
    by_run = by_phase.groupBy(key).agg(F.max_by("phase", "_last").alias("_phase"), F.slice(F.sort_array(F.collect_set("_last"), asc=False), 1, 2).alias("_ends"))
    joined = events.join(by_run, key)
    # since the last event of any other phase
    inside = F.col("phase").eqNullSafe(F.col("_phase")) & (F.get("_ends", 1).isNull() | (F.col(ts) > F.get("_ends", 1)))
    latest_row = F.max_by(F.struct(*PROGRESS), ts).alias("l")
    return joined.where(inside).groupBy(key).agg(latest_row, F.min(ts).alias("phase_start")).select(key, "l.*", "phase_start")


class Progress(StatefulProcessor):
    """Newest row of each run and the time at which its phase began. Rows that are not newer change nothing."""

    def __init__(self, schema: str):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.state.get()) if self.state.exists() else None
        for row in pd.concat(list(rows)).sort_values("ts")[["ts", *PROGRESS]].itertuples(index=False):
            if now is None or row.ts > pd.Timestamp(now[0]):
                same = now is not None and now[1] == row.phase
                now = (*row, now[-1] if same else row.ts)
        self.state.update(now)
        yield pd.DataFrame([(key[0], *now[1:])], columns=["key", *PROGRESS, "phase_start"])

    def close(self) -> None:
        pass


#: Phases that end a run.
ENDED = ("done", "failed", "cancelled", "partial")


class ThrottledProgress(StatefulProcessor):
    """The newest row of each run, given at once where the phase changes or the run ends, else every `interval_ms` at most.

    What comes in between is kept, and given by a timer once the interval is over.
    """

    def __init__(self, schema: str, interval_ms: int):
        self.schema, self.interval = schema, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", f"ts timestamp, {self.schema}, given long, waits boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, state = timerValues.getCurrentProcessingTimeInMs(), tuple(self.state.get()) if self.state.exists() else None
        newest = pd.concat(list(rows)).sort_values("ts")[["ts", *PROGRESS]].iloc[-1]
        row = (newest["ts"], newest["phase"], *(int(newest[c]) for c in PROGRESS[1:]))
        if state is not None and row[0] <= pd.Timestamp(state[0]):
            yield self._rows(key, [])
            return
        at_once = state is None or state[1] != row[1] or row[1] in ENDED or now - state[-2] >= self.interval
        if at_once:
            self.state.update((*row, now, False))
        else:
            if not state[-1]:
                self.handle.registerTimer(state[-2] + self.interval)
            self.state.update((*row, state[-2], True))
        yield self._rows(key, [row] if at_once else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else None
        waits = state is not None and state[-1]
        if waits:
            self.state.update((*state[:-2], timerValues.getCurrentProcessingTimeInMs(), False))
        yield self._rows(key, [state[:-2]] if waits else [])

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r[1:]) for r in rows], columns=["key", *PROGRESS])

    def close(self) -> None:
        pass


def throttled_progress(events: DataFrame, key: str, ts: str = "ts", interval_ms: int = 1000) -> DataFrame:
    """(key, phase, done, total) of a stream of progress events, one row a second for each run at most, and one when it ends.

    Needs the RocksDB state store; rows that wait are given in the batch after their time.
    """
    keyed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col("phase"), F.col("done").cast("long"), F.col("total").cast("long")).groupBy("key")
    fields = "phase string, done long, total long"
    return keyed.transformWithStateInPandas(ThrottledProgress(fields, interval_ms), f"key string, {fields}", "Update", "ProcessingTime")


class WindowStates(StatefulProcessor):
    """State of each window; steps that aren't allowed are reported and leave the state as it is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.state.get()[0] if self.state.exists() else "pending"
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            legal = (now, row.state) in TRANSITIONS
            out.append((key[0], row.seq, now, row.state, legal))
            now = row.state if legal else now
        self.state.update((now,))
        yield pd.DataFrame(out, columns=["key", "seq", "previous", "state", "legal"])

    def close(self) -> None:
        pass


def stream_window_states(events: DataFrame, key: str) -> DataFrame:
    """(key, seq, previous, state, legal) of events (key, seq, state). Needs the RocksDB state store."""
    keyed = events.select(F.col(key).cast("string").alias("key"), "seq", "state").groupBy("key")
    return keyed.transformWithStateInPandas(WindowStates(), "key string, seq long, previous string, state string, legal boolean", "Append", "None")


def log_sink(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the log as Parquet, each row exactly once."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
