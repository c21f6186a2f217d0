"""Named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder: t.orders reads orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def stream(self, name: str) -> DataFrame:
        """The table as a stream that ends with what is there."""
        path = f"{self.folder}/{name}.parquet"
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path}*")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with the SQL for the same rows."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return make

    return register
