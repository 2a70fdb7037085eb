"""Releases that a rerun replaces and that nobody reads half written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.contracts import ContractError
from tessera.sources.scratch import exists, remove

MARKER = "_release"


def publish(df: DataFrame, path: str, partition_by: Sequence[str], release: str) -> None:
    """Write `df` as partitioned Parquet; only partitions that it has rows for are replaced, so a rerun leaves the same rows.

    The old marker goes first and the new one, with the rows of each partition, comes last: while a release is being written, or after one that failed, `published` refuses to read.
    Tasks write to a staging folder that is moved when all have ended: a lost task is repeated and leaves nothing behind.
    """
    spark = df.sparkSession
    remove(spark, f"{path}/{MARKER}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    counts = spark.read.parquet(path).groupBy(*partition_by).agg(F.count("*").alias("rows"))
    counts.withColumn("release", F.lit(release)).coalesce(1).write.mode("overwrite").json(f"{path}/{MARKER}")


def published(spark: SparkSession, path: str, release: str | None = None) -> DataFrame:
    """The rows of a whole release; without its marker, or with another release's, it is an error."""
    if not exists(spark, f"{path}/{MARKER}/_SUCCESS"):
        raise ContractError(f"{path} holds no whole release")
    names = {r["release"] for r in spark.read.json(f"{path}/{MARKER}").select("release").distinct().limit(2).collect()}
    if release is not None and names != {release}:
        raise ContractError(f"{path} holds release {', '.join(sorted(names))}")
    return spark.read.parquet(path)


def release_counts(spark: SparkSession, path: str) -> DataFrame:
    """The marker: a row a partition with its rows."""
    return spark.read.json(f"{path}/{MARKER}")
