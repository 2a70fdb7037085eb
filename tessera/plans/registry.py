"""Collects the queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import audits, candidates, evaluation, filesets, groups, manifest, more, regions, relations, reviews, rows, scalars, screening, tables

MODULES = (rows, relations, groups, evaluation, more, manifest, reviews, candidates, scalars, tables, audits, screening, regions, filesets)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user, joined and counted by status."""
    return relations.latest_join_status(spark, sf_dir)
