"""The folder that the driver and all executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the session's checkpoint folder.

    Where both are unset, a session on one machine (tests) gets a folder of its own; on a cluster that is an error, as
    executors wouldn't see each other's files.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back with the same schema."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing that is still to run reads it."""
    for df in written:
        remove(df.sparkSession, df.written_to)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file, which is there whole or not at all."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True).close()
