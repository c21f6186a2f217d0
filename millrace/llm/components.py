"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(u, v), written: every node that is not the least of its component, with that least node. edges: (u, v), u > v.

    Each round links a node's larger neighbours to its least one, and then its smaller ones. A centre may have any number
    of neighbours: the minima are written tables, so both sides of the joins are plain exchanges, whose hot partitions
    Spark splits. What a round wrote is deleted after the next.
    """
    now, state = materialize(edges.select("u", "v")), None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if found.n == 0 or (found.n, found.h) == state:
            return now
        state = (found.n, found.h)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        moved = materialize(small.distinct())
        release(now, low, large, least)
        now = moved
