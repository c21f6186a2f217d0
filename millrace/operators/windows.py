"""Date windows: merge, histogram, planning by row counts, cursor scans, completeness, states."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.relational import global_rank
from millrace.operators.selection import SORTED, first_rows

# States that a window may go to from each state.
TRANSITIONS = [("pending", "active"), ("active", "done"), ("active", "incomplete"), ("active", "pending")]


def merge_windows(df: DataFrame, floor: Column, ceiling: Column, lo: str = "lo", hi: str = "hi", by: str | None = None) -> DataFrame:
    """Windows clamped to [floor, ceiling], with overlapping and adjacent ones joined. Null bounds are open.

    Windows are first counted by day of start (a bounded calendar), so very many equal windows don't meet in one task.
    """
    keys = [by] if by else []
    start, end = F.greatest(F.coalesce(lo, floor), floor), F.least(F.coalesce(hi, ceiling), ceiling)
    clamped = df.select(*keys, start.cast("date").alias("lo"), end.cast("date").alias("hi")).where("lo <= hi").groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    w = Window.partitionBy(*keys).orderBy("lo") if by else Window.orderBy("lo")  # a row for each day
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = clamped.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > F.date_add(reach, 1)), 1).otherwise(0))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def date_histogram(df: DataFrame, at: str) -> DataFrame:
    """Rows per day."""
    return df.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def plan_windows(
    df: DataFrame, at: str, max_rows: int = 1000, scan_target: int = 4000, max_windows: int = 10_000, windows: list[tuple[dt.date | None, dt.date | None]] | None = None,
    floor: dt.date = dt.date(2008, 1, 1), ceiling: dt.date | None = None,
) -> tuple[DataFrame, bool]:
    """Windows (lo, hi, n, oversized) of fewer than max_rows and at most scan_target rows, and whether the plan was capped.

    The input is read once, for its daily histogram (one row a day, the only thing the driver sees). Windows are halved until
    they fit, empty halves fall away, and one day that is still too large is kept as oversized. A root that fits is one
    window without bounds. Planning goes breadth first; a capped plan keeps the oldest windows.
    """
    spark = df.sparkSession
    ceiling = ceiling or dt.datetime.now(dt.UTC).date()
    if ceiling < floor:
        raise ValueError("floor is after ceiling")
    inside = df.where(F.col(at).isNotNull())
    counts = {r.day: r.n for r in date_histogram(inside, at).collect()}
    schema = "lo date, hi date, n long, oversized boolean"
    fits = lambda n: n < max_rows and n <= scan_target
    days = sorted(counts)
    before = [0, *accumulate(counts[d] for d in days)]
    total = lambda a, b: before[bisect_right(days, b)] - before[bisect_left(days, a)]
    wanted = sorted((max(a or floor, floor), min(b or ceiling, ceiling)) for a, b in windows or [(None, None)])
    merged: list[list[dt.date]] = []
    for a, b in wanted:
        if a > b:
            continue
        if merged and a <= merged[-1][1] + dt.timedelta(days=1):
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    root = total(*map(lambda f: f(d for w in merged for d in w), (min, max))) if len(merged) == 1 else sum(total(a, b) for a, b in merged)
    if not root:
        return spark.createDataFrame([], schema), False
    if fits(root):
        return spark.createDataFrame([(None, None, root, False)], schema), False
    level, leaves, capped = [tuple(w) for w in merged], [], False
    while level and not capped:
        following = []
        for a, b in level:
            n = total(a, b)
            if n and (fits(n) or a == b):
                leaves.append((a, b, n, not fits(n)))
            elif n:
                mid = a + (b - a) // 2
                following += [(a, mid), (mid + dt.timedelta(days=1), b)]
        level = following
        capped = len(leaves) >= max_windows and (len(leaves) > max_windows or bool(level))
    return spark.createDataFrame(sorted(leaves)[:max_windows], schema), capped


def scan_since(df: DataFrame, key: str, since: int, stop_after: int, page_size: int, max_pages: int | None = None) -> DataFrame:
    """Pages (page, n, max_id, next_since) of ids above `since` in ascending order.

    A scan ends with the first page that reaches beyond stop_after; that page is whole. Every page but the last is full, so
    ids that matter are those up to the page_size-th one above stop_after.
    """
    above = df.select(key).where(F.col(key) > since)
    if max_pages is not None:
        above = first_rows(above, [key], page_size * max_pages) if page_size * max_pages > SORTED else above.orderBy(key).limit(page_size * max_pages)
    last = above.where(F.col(key) <= stop_after).count() // page_size
    beyond = above.where(F.col(key) > stop_after).orderBy(key).limit(page_size)
    ranked = global_rank(above.where(F.col(key) <= stop_after).union(beyond), key, "_r")
    pages = ranked.groupBy(F.floor((F.col("_r") - 1) / page_size).cast("long").alias("page")).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("max_id"))
    return pages.where(F.col("page") <= last).withColumn("next_since", F.col("max_id"))


def completeness(windows: DataFrame, pages: DataFrame, key: str, page_cap: int = 10) -> DataFrame:
    """Per window: total, fetched, pages, page_capped, errors and state (done or incomplete)."""
    seen = pages.groupBy(key).agg(F.sum("n").alias("fetched"), F.count(F.lit(1)).alias("pages"), F.bool_or("incomplete").alias("_cut"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    fetched = F.coalesce("fetched", F.lit(0))
    capped = F.coalesce((F.col("pages") >= page_cap) & (fetched < F.col("total")), F.lit(False))
    bad = capped | F.coalesce("_cut", F.lit(False)) | (F.coalesce("errors", F.lit(0)) > 0) | (fetched < F.col("total"))
    return windows.join(seen, key, "left").select(
        key, "total", fetched.alias("fetched"), F.coalesce("pages", F.lit(0)).alias("pages"), capped.alias("page_capped"), F.coalesce("errors", F.lit(0)).alias("errors"),
        F.when(bad, "incomplete").otherwise("done").alias("state"),
    )


def window_states(events: DataFrame, key: str, seq: str, state: str = "state") -> DataFrame:
    """events with the state before (`pending` at first) and whether the step is allowed; a step that isn't leaves the state.

    The first allowed end (`done`, `incomplete`) of a window is final. Until then its state is the last of `pending` and
    `active` that was asked for, for both may follow each other and a step to itself changes nothing. A window's events are
    bounded by the attempts that its plan allows, so one task takes them in order.
    """
    earlier = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.when(F.col(state).isin("pending", "active"), F.col(state))
    out = events.withColumn("_open", F.coalesce(F.last(moved, ignorenulls=True).over(earlier), F.lit("pending")))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    allowed = lambda before: F.array_contains(pairs, F.concat_ws(">", before, state))
    ended = F.when(allowed(F.col("_open")) & moved.isNull(), F.col(state))
    out = out.withColumn("_ended", F.first(ended, ignorenulls=True).over(earlier))
    previous = F.coalesce("_ended", "_open")
    return out.withColumn("previous", previous).withColumn("legal", allowed(F.col("previous"))).drop("_open", "_ended")
