"""Readers for the named tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table `name` of `sf_dir`; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
