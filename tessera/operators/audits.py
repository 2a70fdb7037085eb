"""Audits of crops, transforms and features; blockers; preferred views; splits by subject. Columns and bounds are arguments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import reasons
from tessera.operators.contracts import ContractError
from tessera.operators.running import running_totals
from tessera.operators.strata import exact_mean


def crop_audit(crops: DataFrame, key: str, image: str, category: Column, share: Column, categories: Sequence[str], least: Mapping[str, int], least_images: int) -> DataFrame:
    """(key, crops, images, a count a category, mean_share, reasons): what each key's crops hold, `too_few_<category>` and `too_few_images` where they hold less than they must."""
    rows = crops.select(key, F.col(image).alias("_image"), category.alias("_category"), share.alias("_share"))
    per = rows.groupBy(key).agg(
        F.count("*").alias("crops"), F.countDistinct("_image").alias("images"), *(F.count_if(F.col("_category") == c).alias(c) for c in categories), F.avg("_share").alias("mean_share")
    )
    rules = [(F.col(c) < n, f"too_few_{c}") for c, n in least.items()] + [(F.col("images") < least_images, "too_few_images")]
    return per.withColumn("reasons", F.array_join(reasons(rules), "|"))


def transform_audit(rows: DataFrame, key: str, value: Column, side: Column, before: str, after: str, unexpected: Column, burden: Column, full: float, most_delta: float, most_shift: float, most_burden: float) -> DataFrame:
    """(key, odd, delta, shift, burden, reasons): whether a transform kept a key's values, area and markers.

    odd counts unexpected rows, delta is the change of the mean value as a share of `full`, shift the largest change of its ends, burden the median burden. Sides with no rows leave delta and shift null, which break no rule.
    """
    at = lambda f, s: f(F.when(F.col("_side") == s, F.col("_value")))
    per = rows.select(key, value.alias("_value"), side.alias("_side"), unexpected.alias("_odd"), burden.alias("_burden")).groupBy(key).agg(
        F.count_if("_odd").alias("odd"), (F.abs(at(F.avg, before) - at(F.avg, after)) / full).alias("delta"),
        F.greatest(F.abs(at(F.min, before) - at(F.min, after)), F.abs(at(F.max, before) - at(F.max, after))).alias("shift"), F.median("_burden").alias("burden"),
    )
    rules = [(F.col("odd") > 0, "unexpected_values"), (F.col("delta") > most_delta, "area_changed"), (F.col("shift") > most_shift, "markers_moved"), (F.col("burden") > most_burden, "foreground_burden")]
    return per.withColumn("reasons", F.array_join(reasons(rules), "|"))


def feature_gates(rows: DataFrame, key: str, means: Mapping[str, tuple[Column, float, str]], scaled: Mapping[str, Callable[[Column], Column]] = {}) -> DataFrame:
    """(key, a mean a name, blockers, status): means of columns that must not pass their bound; `means` gives each its column, bound and blocker, `scaled` what is made of a mean."""
    per = rows.groupBy(key).agg(*(scaled.get(name, lambda m: m)(exact_mean(c)).alias(name) for name, (c, _, _) in means.items()))
    blockers = F.array_join(reasons([(F.col(name) > bound, word) for name, (_, bound, word) in means.items()]), "|")
    return per.withColumn("blockers", blockers).withColumn("status", F.when(F.col("blockers") == "", "passed").otherwise("failed_visual_feature_readiness"))


def hard_blockers(rows: DataFrame, key: str, kind: Column, needed: Sequence[str]) -> DataFrame:
    """(key, verdict, blocker, scope): a row for each needed kind that a key lacks. `needed` is short; a key's kinds beyond it aren't kept."""
    per = rows.groupBy(key).agg(*(F.max(F.coalesce(kind == k, F.lit(False))).alias(f"_has{n}") for n, k in enumerate(needed)))
    lost = F.array_compact(F.array(*(F.when(~F.col(f"_has{n}"), F.lit(f"missing_{k}")) for n, k in enumerate(needed))))
    return per.select(key, F.lit("insufficient_data").alias("verdict"), F.explode(lost).alias("blocker"), F.concat(F.lit("scope:"), F.col(key).cast("string")).alias("scope"))


def preferred(rows: DataFrame, keys: Sequence[str], view: str, wanted: str, first: str) -> DataFrame:
    """(keys, view, first): each key's wanted view if it has rows of it, else its first view by name; with the smallest `first` of that view."""
    views = rows.groupBy(*keys, F.col(view).alias("view")).agg(F.min(first).alias("first"))
    best = F.min_by(F.struct("view", "first"), F.struct((F.col("view") != wanted).cast("int"), "view")).alias("_b")
    return views.groupBy(*keys).agg(best).select(*keys, "_b.view", "_b.first")


def subject_split(rows: DataFrame, subject: str, key: Column, share: float) -> DataFrame:
    """(subject, images, split): subjects in the order of numeric `key`, then their own, go to validation until it holds the share of images.

    The target is whole, rounded half to even, at least 1; the last subject always trains; fewer than two are an error. Subjects are numbered on two levels, rows only counted.
    """
    users = rows.groupBy(subject).agg(F.count("*").alias("images")).withColumn("_key", key)
    total = users.agg(F.sum("images").alias("_total"), F.count("*").alias("_subjects"))
    if total.first()["_subjects"] < 2:
        raise ContractError("a split by subject needs two subjects")
    placed = running_totals(users, "_key", {"_upto": F.col("images"), "_place": F.lit(1).cast("bigint")}, [subject]).crossJoin(F.broadcast(total))  # one row
    target = F.greatest(F.lit(1), F.bround(F.col("_total") * share).cast("long"))
    chosen = (F.col("_upto") - F.col("images") < target) & (F.col("_place") < F.col("_subjects"))
    return placed.select(subject, "images", F.when(chosen, "validation").otherwise("training").alias("split"))
