"""Quality gates as a rule table, review overrides and promotion decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A metric that must be at least `low` and at most `high` for rows of a category."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    category: str | None = None


def gate_rows(df: DataFrame, gates: Sequence[Gate], category: str | None = None) -> DataFrame:
    """A row for each row of `df` and gate that concerns it: gate, observed, passed. A null metric fails."""
    made = []
    for g in gates:
        value = F.col(g.metric).cast("double")
        ok = F.lit(True)
        if g.low is not None:
            ok = ok & (value >= g.low)
        if g.high is not None:
            ok = ok & (value <= g.high)
        row = F.struct(F.lit(g.name).alias("gate"), value.alias("observed"), F.coalesce(ok, F.lit(False)).alias("passed"))
        made.append(F.when(F.col(category) == g.category, row) if category and g.category else row)
    return df.withColumn("_g", F.explode(F.array_compact(F.array(*made)))).select(*df.columns, "_g.gate", "_g.observed", "_g.passed")


def failing_reasons(gated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: gates, failures, the failing gates sorted and joined by `|`."""
    failed = F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("gate"))))
    return gated.groupBy(*keys).agg(F.count("*").alias("gates"), F.count_if(~F.col("passed")).alias("failures"), F.array_join(failed, "|").alias("failing"))


def adjudicate(gated: DataFrame, reviews: DataFrame, on: Sequence[str]) -> DataFrame:
    """`gated` with failing gates flipped where a review (unique on `on`) says the failure doesn't count; adjudicated marks them."""
    joined = gated.join(reviews.select(*on, F.col("counts").alias("_counts")), list(on), "left")
    flip = ~F.col("passed") & (F.col("_counts") == F.lit(False))
    return joined.withColumn("adjudicated", F.coalesce(flip, F.lit(False))).withColumn("passed", F.col("passed") | F.col("adjudicated")).drop("_counts")


def promotion(a_ok: Column, b_ok: Column, a_score: Column, b_score: Column, margin: float) -> Column:
    """Decision between two candidates: gates first, then the margin, then the higher score."""
    return (
        F.when(~a_ok & ~b_ok, "neither")
        .when(a_ok & ~b_ok, "first")
        .when(b_ok & ~a_ok, "second")
        .when(F.abs(a_score - b_score) <= margin, "tie")
        .when(a_score > b_score, "first")
        .otherwise("second")
    )


def overcoverage_causes(background_low: Column, background_high: Column, separability: Column) -> Column:
    """Ordered causes from the background positive rates at a low and a higher threshold and the medians' distance."""
    return F.array_compact(F.array(
        F.when((background_low > 0.5) & (background_high <= 0.5), "threshold_too_low"), F.when(background_high > 0.5, "background_positive"), F.when(separability < 0.05, "not_separable")
    ))


def adoption_tier(auto: Column, oracle: Column, current: Column, recall: Column) -> Column:
    """Tier of an automatic product from its mean, the oracle's, the present one's and its recall."""
    return F.when(recall < 0.5, "prompt_failure").when(auto <= current, "keep_current").when(oracle - auto <= 0.05, "adopt").otherwise("review")


def product_choice(recall: Column, precision: Column, balanced: Column) -> Column:
    """severe, ordinal or none by the two gates."""
    severe = ((recall >= 0.8) & (precision >= 0.25)) | ((recall >= 0.9) & (precision >= 0.15))
    return F.when(severe, "severe").when((balanced >= 0.5) & (recall >= 0.8), "ordinal").otherwise("none")


def field_parity(policies: DataFrame, key: str, side: str, sides: tuple[str, str], fields: Sequence[str]) -> DataFrame:
    """(key, mismatches, reason): the fields (text, joined by `|`) in which a key's two policies, a row a side, differ; nulls are equal to nulls."""
    long = policies.unpivot([key, side], list(fields), "field", "value")
    value = lambda s: F.max(F.when(F.col(side) == s, F.col("value")))
    cells = long.groupBy(key, "field").agg(value(sides[0]).alias("a"), value(sides[1]).alias("b"))
    lost = F.array_sort(F.collect_list(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("field"))))
    out = cells.groupBy(key).agg(lost.alias("lost"))
    return out.select(key, F.array_join("lost", "|").alias("mismatches"), F.when(F.size("lost") > 0, "resize_policy_mismatch").otherwise("ok").alias("reason"))
