"""Cohort builders: scored images, and decoded masks beside choice scores, as manifest rows with their first states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import letters_prefix

#: Lanes that the builders give, and letters of samples that belong to another cohort.
CORE_LANE, EXTERNAL_LANE, SCORED_LANE, FOREIGN_PREFIX = "manual_mask_core", "manual_mask_external", "scored_only", "T"


def _text(c: str | Column) -> Column:
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def scored_cohort(scores: DataFrame, sheet: str, score_path: str, surfaces: Sequence[str]) -> DataFrame:
    """Manifest rows of scores (raw_image_path, raw_mask_path, image_name, image_stem, source_task_id, score, join_status, score_status): those that joined and were scored."""
    good = scores.filter("join_status = 'ok' and score_status = 'ok'")
    return good.select(
        F.col("raw_image_path").alias("source_image_path"), F.col("raw_mask_path").alias("source_mask_path"), F.col("image_name").alias("source_image_name"), F.col("image_stem").alias("source_sample_id"),
        F.col("source_task_id").alias("source_score_row"), F.lit(sheet).alias("source_score_sheet"), F.lit(score_path).alias("score_path"), "score", F.lit(CORE_LANE).alias("lane_assignment"),
        F.lit(";".join(surfaces)).alias("discovery_surfaces"),
    )


def decoded_cohort(decoded: DataFrame, scores: DataFrame, cohort: str, sheet: str, score_path: str, surfaces: Sequence[str], foreign_prefix: str = FOREIGN_PREFIX) -> DataFrame:
    """`decoded` (source_score_row; more columns pass) with the score of its task and its states, and a row for each score without a decoded mask.

    scores: task_id, image_name, source_sample_id, score, score_status, a row a task (the latest has won). A decoded row without a score stays unresolved. A score whose task isn't
    decoded is foreign if its sample has the foreign letters, else unresolved. Tasks are compared as text; a null task matches nothing. Columns that one side lacks are null; an empty side
    leaves the other as it is.
    """
    named = scores.select(F.col("task_id").cast("string").alias("_task"), F.col("score").alias("_score"), F.col("score_status").alias("_status"), "image_name", F.col("source_sample_id").alias("_sample"))
    own = decoded.drop("score", "score_status").withColumn("source_score_row", F.col("source_score_row").cast("string"))
    got = F.col("_score").isNotNull()
    states = {
        "score": F.col("_score"), "score_status": F.col("_status"), "score_path": F.lit(score_path), "join_status": F.when(got, "joined").otherwise("pending_discovery"),
        "verification_status": F.when(got, "pending").otherwise("pending_discovery"), "admission_status": F.when(got, "pending").otherwise("unresolved"),
        "exclusion_reason": F.when(got, "").otherwise("missing_score"), "lane_assignment": F.lit(EXTERNAL_LANE),
    }
    merged = own.join(named.drop("image_name", "_sample"), F.col("source_score_row") == F.col("_task"), "left").withColumns(states).drop("_task", "_score", "_status")
    rest = named.join(own.select(F.col("source_score_row").alias("_task")).filter("_task is not null").distinct(), "_task", "left_anti")
    foreign = letters_prefix(_text("_sample")) == foreign_prefix
    pick = lambda a, b: F.when(foreign, a).otherwise(b)
    extra = rest.select(
        F.lit(cohort).alias("cohort_id"), F.lit("").alias("image_path"), F.lit("").alias("mask_path"), F.col("_score").alias("score"), F.col("image_name").alias("source_image_name"), _text("_sample").alias("source_sample_id"),
        F.coalesce("_task", F.lit("")).alias("source_score_row"), F.lit(sheet).alias("source_score_sheet"), F.lit(score_path).alias("score_path"), F.lit(SCORED_LANE).alias("lane_assignment"),
        pick("foreign_row", "pending_discovery").alias("join_status"), pick("excluded", "pending_discovery").alias("verification_status"), pick("foreign", "unresolved").alias("admission_status"),
        pick("foreign_mixed_export_row", "not_materialized_in_decoded_brushlabel_surface").alias("exclusion_reason"), F.lit(";".join(surfaces)).alias("discovery_surfaces"),
    )
    return merged.unionByName(extra, allowMissingColumns=True)
