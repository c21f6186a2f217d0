"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.shared import materialize, release, shared_dir  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(written: DataFrame, most: int = 250_000) -> DataFrame:
    """A written table of narrow rows as a join's side: broadcast if it has `most` rows at most, else shuffled."""
    return F.broadcast(written) if written.count() <= most else written.hint("merge")


#: Rows that a Python function gets at a time, so that its lists stay small.
SLICE = 2048


def annotate(docs: DataFrame, inputs: list[str], fields: list[tuple[str, T.DataType]], make: Callable, keep: list[str] | None = None) -> DataFrame:
    """Each row of docs as the struct `row`, and what `make` computes from it as the struct `res`.

    `make(*arrays)` gets the Arrow arrays of the input columns of up to SLICE rows and returns a list with one Arrow array
    per field. The columns of docs, or those in `keep`, stay inside `row`, so no result name can clash with theirs; what is
    not kept isn't sent back from Python.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = docs.columns if keep is None else keep
    row = T.StructType([f for f in packed.schema["row"].dataType if f.name in kept])
    schema = T.StructType([T.StructField("row", row), T.StructField("res", T.StructType([T.StructField(n, t) for n, t in fields]))])
    at = [docs.columns.index(c) for c in inputs]
    back = [i for i, c in enumerate(docs.columns) if c in kept]
    names, docs_columns = [n for n, _ in fields], docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                columns = batch.column(0).slice(start, SLICE).flatten()
                made = make(*[columns[i] for i in at])
                of = pa.StructArray.from_arrays([columns[i] for i in back], names=[docs_columns[i] for i in back])
                yield pa.RecordBatch.from_arrays([of, pa.StructArray.from_arrays(made, names=names)], names=["row", "res"])

    return packed.mapInArrow(run, schema)


def drop_rows(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """docs without the rows whose doc_id and key stand in the written table gone (at_id, at_key)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key_id"), key.alias("key"))
    return packed.join(small(gone), F.col("key_id").eqNullSafe(F.col("at_id")) & (F.col("key") == F.col("at_key")), "left_anti").select("row.*")


def raw_texts(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def doc_key() -> list[Column]:
    """What tells documents apart: the id and a hash of the text; rows equal in both are one document."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def salts(n_rows: int) -> int:
    """Salts for gapless_rank: 2,000 rows each, and for large inputs as many rows a salt as salts a key."""
    return -(-n_rows // max(2_000, math.isqrt(n_rows)))


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], spread: list[Column], n_salts: int, name: str) -> DataFrame:
    """Add `name`: 0, 1, 2, ... within `keys` (not null), without bringing a key's rows into one task.

    Rows are ranked inside (keys, salt) and shifted by the row counts of the smaller salts; the salt is a hash of
    `spread`. Only the counts, n_salts rows a key at most, meet by key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(max(1, n_salts))))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy(*keys, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_salt"])
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long"))
        .drop("_salt", "_rn", "_before")
    )
