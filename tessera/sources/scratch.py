"""A folder that driver and executors share, for tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a folder of our own in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{found}/tessera-{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, of any store that Spark knows; nothing if it isn't there."""
    found, store = _path(spark, path)
    store.delete(found, True)


def exists(spark: SparkSession, path: str) -> bool:
    found, store = _path(spark, path)
    return store.exists(found)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file listings name it."""
    found, store = _path(spark, path)
    return store.makeQualified(found).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table of the shared folder: computed once, and there whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
