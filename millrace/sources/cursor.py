"""A scan of ascending ids that goes on where it stopped.

    path/items/from=<id>/...                   the items of one write, with their page and the cursor of their call, since
    path/_cursor/<from>-<next since>           its commit, an empty file, written last

A write starts at the greatest committed id and holds one call, or several that follow each other. One that is killed
leaves no commit; the next one writes the same folder anew, so no item is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.slices import assign_ranges
from millrace.operators.windows import scan_since
from millrace.sources.shared import listed, materialize, release, touch

_WIDTH = 20


def commits(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(since, next since) of the writes that were completed, in order."""
    return sorted(tuple(int(x) for x in name.split("-")) for name in listed(spark, f"{path}/_cursor"))


def next_since(spark: SparkSession, path: str, since: int = 0) -> int:
    return max([since, *(b for _, b in commits(spark, path))])


def resume_scan(
    df: DataFrame, key: str, path: str, page_size: int, max_pages: int, stop_after: int | None = None, since: int = 0, calls: int | None = 1,
) -> int:
    """Write the pages of the next calls on df with non-negative ids above the cursor, and return the new cursor.

    A call takes max_pages pages from where the one before ended; with calls=None they go on to the end. They are planned
    together and written by one job, so what a scan takes doesn't grow with its number of calls. Pages hold page_size rows
    each but for the last one; one that reaches beyond stop_after is whole and ends the scan. Where nothing is left, or the
    scan has come beyond stop_after, the cursor stays. Only rows above the cursor are read.
    """
    spark, start = df.sparkSession, next_since(df.sparkSession, path, since)
    if stop_after is not None and start > stop_after:
        return start
    highest = stop_after if stop_after is not None else (1 << 63) - 1
    pages = materialize(scan_since(df, key, start, highest, page_size, max_pages * calls if calls is not None else None).select("page", "max_id"))
    last = pages.agg(F.max("max_id").alias("id")).first().id
    if last is None:
        release(pages)
        return start
    first = F.col("page") - F.col("page") % max_pages  # of the page's call
    after, since_of = (pages.select((F.col("page") + 1).alias(n), F.col("max_id").alias(c)) for n, c in (("page", "after"), ("_first", "since")))
    bounds = pages.withColumn("_first", first).join(after, "page", "left").join(since_of, "_first", "left")
    bounds = bounds.select((F.col("page") % max_pages).alias("page"), F.coalesce("since", F.lit(start)).alias("since"), F.coalesce("after", F.lit(start)).alias("after"), F.col("max_id").alias("upto"))
    bounds = materialize(bounds)
    items = assign_ranges(df.where((F.col(key) > start) & (F.col(key) <= last)), bounds, key).drop("after", "upto")
    items.write.mode("overwrite").parquet(f"{path}/items/from={start}")
    touch(spark, f"{path}/_cursor/{start:0{_WIDTH}d}-{last:0{_WIDTH}d}")
    release(pages, bounds)
    return last


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """The items of all completed writes, with page and since."""
    return spark.read.parquet(*[f"{path}/items/from={a}" for a, _ in commits(spark, path)])
