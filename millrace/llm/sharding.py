"""Sharding by longest-processing-time scheduling.

Groups that must stay together are taken from the largest to the smallest and each goes to the least-loaded shard of a
heap. Groups of one size are alike, so the driver sees only how many groups there are of each size and hands out runs of
equal groups; within a run the groups take their places by a distributed rank. For groups of up to EXACT bytes the
result is that of scheduling them one by one. Groups above EXACT bytes are taken together where their sizes differ by less
than one in STEPS, and count with their mean size, which is near to that but not the same; so the driver sees EXACT + some 20,000 rows at most, whatever the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._common import gapless_rank, materialize, salts


EXACT, STEPS = 1 << 17, 1024


def schedule(sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, int]]:
    """Longest-processing-time schedule of (size, count) runs: rows (size, first rank, next rank, shard).

    A run's groups go one at a time to the least-loaded shard (ties: the smallest shard number). Where whole rounds over
    the lowest shards keep their order, the rounds are handed out at once.
    """
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for size, count in sorted(sizes, reverse=True):
        given, rank = [0] * n_shards, 0
        left = count
        while left:
            low = [heapq.heappop(heap)]
            while heap and heap[0][0] < low[0][0] + size:  # the shards that a round would visit in this order
                low.append(heapq.heappop(heap))
            room = (heap[0][0] - low[-1][0] - 1) // size if heap else left  # rounds after which all stay below the rest
            rounds = min(left // len(low), max(0, room))
            if rounds:
                low = [(load + rounds * size, s) for load, s in low]
                for _, s in low:
                    given[s] += rounds
                left -= rounds * len(low)
            else:
                load, s = low[0]
                low[0] = (load + size, s)
                given[s] += 1
                left -= 1
            for x in low:
                heapq.heappush(heap, x)
        for s in range(n_shards):
            if given[s]:
                out.append((size, rank, rank + given[s], s))
                rank += given[s]
    return out


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents with equal texts stay together; a null text counts as empty. A document's size is its UTF-8 bytes plus 1;
    the shards' sums of sizes are near equal (law `bytes`), as near as whole groups allow. `slot` numbers a shard's rows
    from 0 without gaps, repeated rows too. An empty table gives no rows; doc_id may be null or repeated.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    keyed = materialize(keyed)
    groups = keyed.groupBy("group").agg(F.sum("size").alias("weight"))
    alike = F.when(F.col("weight") <= EXACT, F.col("weight")).otherwise(F.floor(F.lit(EXACT) + F.log(F.col("weight") / EXACT) * STEPS))
    groups = groups.withColumn("class", alike.cast("long"))
    runs = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()
    total = sum(r.n for r in runs)
    class_of = {r.weight // r.n: r["class"] for r in runs}  # the mean lies inside the class, so no two are equal
    plan = [(class_of[size], first, after, shard) for size, first, after, shard in schedule([(r.weight // r.n, r.n) for r in runs], n_shards)]
    spark = docs.sparkSession
    ranges = spark.createDataFrame(plan, "class long, first long, next long, shard int")
    ranked = gapless_rank(groups, ["class"], [F.col("group")], [F.col("group")], salts(total), "rank")
    placed = ranked.join(ranges, (ranked["class"] == ranges["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("next"))).select("group", "shard")
    # a written table: both sides of the join are then plain exchanges, whose hot partitions Spark splits
    out = keyed.join(materialize(placed).hint("merge"), "group").select("doc_id", "size", "text_crc32", "shard")
    n_rows = keyed.count()
    slotted = gapless_rank(out, ["shard"], [F.col("doc_id"), F.col("text_crc32")], [F.col("doc_id"), F.col("text_crc32")], salts(n_rows), "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
