"""Ordered work inside a key whose rows may be any number: places, blocks with a margin, running values, as-of joins.

Rows are sorted over the whole table, so a large key lies in many partitions; each row's place in its key follows from
counts of (key, partition). Work then goes block by block of places, and what a block must know of those before it is a
margin of rows or one row of totals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.shared import materialize, release

#: Places of a block; rows of a table of ranges that is looked up in memory.
BLOCK, LOOKED_UP = 10_000, 100_000
_PARTITION = 33  # bits of a row's number inside its partition


def number_in_key(df: DataFrame, key: str, order: list[str], name: str = "_i") -> DataFrame:
    """df, written, with each row's place (0, 1, ...) in its key by the order columns; rows equal in these in any order."""
    spread = df.withColumn("_tie", F.monotonically_increasing_id())  # so that equal rows needn't share a partition
    placed = materialize(spread.orderBy(key, *order, "_tie").withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", _PARTITION).cast("int")
    counts = placed.groupBy(F.col(key).alias("_key"), part.alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each key and partition; written, so that both sides of the join are plain exchanges, whose hot partitions Spark splits
    counts = materialize(counts.select("_key", "_p", "_first", before.alias("_before")))
    joined = placed.join(counts.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (part == F.col("_p")))
    out = materialize(joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_key", "_p", "_first", "_before", "_at"))
    release(placed, counts)
    return out


def blocks(placed: DataFrame, margin: int, size: int = BLOCK, place: str = "_i") -> DataFrame:
    """placed with `_block`, and `_extra` for copies of the last `margin` rows of a block, which also stand before the next one."""
    block = F.floor(F.col(place) / size).cast("long")
    copied = F.array(F.struct(block.alias("_block"), F.lit(False).alias("_extra")), F.struct((block + 1).alias("_block"), F.lit(True).alias("_extra")))
    own = F.array(F.struct(block.alias("_block"), F.lit(False).alias("_extra")))
    return placed.withColumn("_b", F.explode(F.when(F.col(place) % size >= size - margin, copied).otherwise(own))).select("*", "_b.*").drop("_b")


def over_last(df: DataFrame, key: str, order: list[str], margin: int, values: dict[str, callable], size: int = BLOCK, place: str = "_i") -> DataFrame:
    """df with columns `values`: name -> function of the window of a key's rows in order, that looks back `margin` rows at most."""
    if margin > size:
        raise ValueError("a block must hold the margin")
    placed = number_in_key(df, key, order, place)
    w = Window.partitionBy(key, "_block").orderBy(place)
    out = blocks(placed, margin, size, place)
    return out.withColumns({n: make(w) for n, make in values.items()}).where("NOT _extra").drop("_block", "_extra")


def running(placed: DataFrame, key: str, values: dict[str, tuple[str, Column]], size: int = BLOCK, place: str = "_i") -> DataFrame:
    """placed with running values over each key in order of place: name -> ("sum" or "max", column)."""
    kinds = {"sum": F.sum, "max": F.max}
    block = F.floor(F.col(place) / size).cast("long")
    inner = placed.withColumns({"_block": block} | {f"_v_{n}": c for n, (_, c) in values.items()})
    w = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    totals = inner.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_at")).agg(*[kinds[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    upto = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    totals = materialize(totals.select("_key", "_at", *[kinds[k](f"_t_{n}").over(upto).alias(f"_c_{n}") for n, (k, _) in values.items()]).where("_at > 0"))
    inner = inner.withColumns({f"_w_{n}": kinds[k](f"_v_{n}").over(w) for n, (k, _) in values.items()})
    joined = inner.join(totals.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")), "left")
    both = {n: F.coalesce(f"_w_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) if k == "sum" else F.greatest(f"_w_{n}", f"_c_{n}") for n, (k, _) in values.items()}
    made = [f"_{kind}_{n}" for n in values for kind in "vwc"]
    return joined.withColumns(both).drop("_block", "_key", "_at", *made)


def assign_ranges(df: DataFrame, ranges: DataFrame, key: str, after: str = "after", upto: str = "upto", most: int = LOOKED_UP) -> DataFrame:
    """Rows of df whose key (a whole number) lies in one of the disjoint half-open ranges (after, upto], with the range's columns.

    Up to `most` ranges, counted first, are looked up in an array by binary search, and df isn't shuffled. More of them
    are sorted together with df, each row takes the last range that begins before it, and of each partition one row,
    its last range, is passed on to those behind it.
    """
    names = ranges.columns
    if ranges.limit(most + 1).count() <= most:
        return _looked_up(df, ranges, key, after, upto)
    packed = lambda d: F.struct(*[F.col(f"`{c}`") for c in d.columns])
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in ranges.schema])
    row_kind = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_k"), F.lit(0).alias("_kind"), packed(df).alias("_row"), F.lit(None).cast(kinds).alias("_range"))
    # a range comes after the rows that equal its open end
    starts = ranges.select(F.col(after).cast("long").alias("_k"), F.lit(1).alias("_kind"), F.lit(None).cast(row_kind).alias("_row"), packed(ranges).alias("_range"))
    every = rows.unionByName(starts).withColumn("_tie", F.monotonically_increasing_id())  # rows of one key needn't share a partition
    placed = materialize(every.orderBy("_k", "_kind", "_tie").withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    placed = placed.withColumn("_p", F.shiftright("_at", _PARTITION).cast("int"))
    last = placed.groupBy("_p").agg(F.max_by("_range", F.when(F.col("_range").isNotNull(), F.col("_at"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    carried = last.select("_p", carried.alias("_carried"))
    inside = F.last("_range", ignorenulls=True).over(Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.withColumn("_found", inside).join(F.broadcast(carried), "_p").withColumn("_found", F.coalesce("_found", "_carried"))
    found = found.where((F.col("_kind") == 0) & (F.col("_k") <= F.col(f"_found.{upto}")))
    return found.select("_row.*", *[F.col(f"_found.`{n}`") for n in names])


def _looked_up(df: DataFrame, ranges: DataFrame, key: str, after: str, upto: str) -> DataFrame:
    rows = sorted(ranges.select(F.col(after).cast("long"), F.col(upto).cast("long")).collect())
    lows, highs = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)

    @F.pandas_udf("long")
    def start_of(keys: pd.Series) -> pd.Series:
        """The open end of the range that holds each key; null for none."""
        known = keys.notna().to_numpy()
        ids = keys.fillna(0).astype("int64").to_numpy()
        place = np.searchsorted(lows, ids, side="left") - 1
        held = known & (place >= 0) & (ids <= highs[place]) if len(lows) else known & False
        return pd.Series(np.where(held, lows[place] if len(lows) else 0, 0)).astype("Int64").where(pd.Series(held))

    side = F.broadcast(ranges.withColumn("_low", F.col(after).cast("long")))  # counted above
    return df.withColumn("_of", start_of(F.col(key).cast("long"))).join(side, F.col("_of") == F.col("_low")).drop("_of", "_low")
