"""Reviews and candidates: root causes, decisions between runs, gate roll-ups, anchors, baselines and case queues."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.rubric import RUBRIC
from tessera.functions.text import keyword_class, number
from tessera.operators.states import route

#: Evidence flags with their causes, in order.
CAUSES = {
    "pairing_error": "image_mask_pairing_error", "transform_alignment_error": "transform_alignment_error", "mask_binarization_error": "mask_binarization_error",
    "class_channel_or_threshold_error": "class_channel_or_threshold_error", "resize_policy_artifact": "resize_policy_artifact", "split_or_panel_bias": "split_or_panel_bias",
    "training_signal_insufficient": "training_signal_insufficient", "mitochondria_base_defect": "mitochondria_base_defect",
    "negative_background_supervision_missing": "negative_background_supervision_missing", "true_model_underfit": "true_model_underfit",
}
ELIGIBLE, NOT_ELIGIBLE, AUDIT_MISSING, INSUFFICIENT = "promotion_eligible", "not_promotion_eligible", "audit_missing", "insufficient_evidence_for_promotion"
_CODE = ("image_mask_pairing_error", "transform_alignment_error", "mask_binarization_error", "class_channel_or_threshold_error", "resize_policy_artifact", "split_or_panel_bias")
_REMEDIES = (
    ("negative_background_supervision_missing", "apply_p2_negative_glomeruli_crop_supervision_then_reevaluate"),
    ("mitochondria_base_defect", "rebuild_or_relabel_mitochondria_transfer_base_then_reevaluate_glomeruli"),
    ("training_signal_insufficient", "audit_training_data_and_sampler_then_train_new_candidates"), ("true_model_underfit", "train_new_candidate_after_audit_gates_pass"),
)
#: What a reviewer is told about each route.
ROUTES = {
    "blocked_cluster_manual_review": "Model is not trusted for this case because the atlas cluster or ROI/mask evidence is problematic.",
    "borderline_score_review": "Original score is 1.0, so this case is intentionally not forced into the primary binary model.",
    "likely_moderate_severe_review": "Model thinks this case is likely moderate/severe.", "likely_no_low_review": "Model thinks this case is likely no/low.",
    "uncertain_binary_review": "Model is uncertain and is asking for human review.",
}


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def root_causes(evidence: Mapping[str, Column], poor: Column) -> Column:
    """The causes whose evidence holds, in their fixed order; poor performance without any other is an underfit model."""
    found = F.array_compact(F.array(*(F.when(evidence[k], F.lit(cause)) for k, cause in CAUSES.items() if k in evidence)))
    return F.when((F.size(found) == 0) & poor, F.array(F.lit("true_model_underfit"))).otherwise(found)


def remediation(causes: Column) -> Column:
    """What to do first about the causes."""
    return route([(F.arrays_overlap(causes, _strings(_CODE)), "fix_code_or_evaluation_then_regenerate_evidence"), *((F.array_contains(causes, c), path) for c, path in _REMEDIES)], "no_remediation_required")


def run_decision(rows: DataFrame, key: str, run: str, completed: Column, reference: str, primary: str, fallback: str, limit: float, margin: float = 0.02, scaled: Mapping[str, Callable[[Column], Column]] = {}, order: Sequence[str] = ()) -> DataFrame:
    """(key, status, reason, selected): whether the primary run (else the fallback) beats the reference in mean dice, recall or ratio_error by `margin`, within the background limit and with all gates passed.

    `rows` has dice, recall, ratio_error, background and gate_ok; `scaled` says what is made of a mean. Means near the margin depend on the order of adding:
    a run's values are added in that of the columns `order`, which must tell its rows apart, however rows are dealt out; without them, as they come.
    """
    metrics, done = ("dice", "recall", "ratio_error", "background"), rows.filter(completed)
    if order:
        upto = W.partitionBy(key, run).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        done = done.withColumns({c: F.avg(c).over(upto) for c in metrics})
    mean = lambda c: F.max_by(c, F.struct(*order)) if order else F.avg(c)
    per = done.groupBy(key, run).agg(*(scaled.get(c, lambda m: m)(mean(c)).alias(c) for c in metrics), F.min("gate_ok").alias("gate_ok"))
    of = lambda name: F.max(F.when(F.col(run) == name, F.struct("dice", "recall", "ratio_error", "background", "gate_ok")))
    wide = per.groupBy(key).agg(of(reference).alias("r"), of(primary).alias("p"), of(fallback).alias("f"))
    every = rows.select(key).distinct().join(wide, key, "left").withColumn("c", F.coalesce("p", "f"))
    better = (F.col("c.dice") > F.col("r.dice") + margin) | (F.col("c.recall") > F.col("r.recall") + margin) | (F.col("c.ratio_error") < F.col("r.ratio_error") - margin)
    good = F.coalesce(F.col("c.background") <= limit, F.lit(True)) & F.col("c.gate_ok")
    cases = [(F.col("r").isNull(), "unresolved", "reference_resize_screen_missing_or_failed"), (F.col("c").isNull(), "infeasible", "no_less_downsampled_or_no_downsample_screen_completed"),
             (good & F.coalesce(better, F.lit(False)), "selected_less_downsampled", "less_downsampled_policy_materially_improved_positive_or_boundary_metrics"),
             (~F.col("c.gate_ok"), "current_cleared", "less_downsampled_policy_failed_category_gates")]
    status = route([(cond, s) for cond, s, _ in cases], "current_cleared")
    reason = route([(cond, r) for cond, _, r in cases], "less_downsampled_policy_not_materially_better_than_current_policy")
    chosen = F.when(F.col("p").isNotNull(), primary).otherwise(fallback)
    selected = F.when(F.col("status") == "selected_less_downsampled", F.col("_chosen")).when(F.col("status") == "current_cleared", reference).otherwise("")
    return every.select(key, status.alias("status"), reason.alias("reason"), chosen.alias("_chosen")).withColumn("selected", selected).drop("_chosen")


def gate_status(gates: DataFrame, family: str = "family") -> DataFrame:
    """(family, status, reasons, categories, failed, gates) of gate rows (category, passed, reason); lists sorted, joined by `|`."""
    failed = ~F.col("passed")
    reasons = F.array_sort(F.collect_set(F.when(failed & (F.trim("reason") != ""), F.trim("reason"))))
    per = gates.groupBy(family).agg(reasons.alias("r"), F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"), F.count_if(failed).alias("failed"), F.count("*").alias("gates"))
    return per.select(family, F.when(F.size("r") > 0, NOT_ELIGIBLE).otherwise(ELIGIBLE).alias("status"), F.array_join("r", "|").alias("reasons"), "categories", "failed", "gates")


def shape_reasons(rows: DataFrame, gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` plus shape_gate_failed and shape_gate_reasons: the reasons of the failed gates with the same keys, then category_metric_failure."""
    reason = F.when(F.trim("reason") != "", F.trim("reason")).otherwise(F.trim("gate"))
    lost = gates.filter(~F.col("passed")).groupBy(*keys).agg(F.array_sort(F.collect_set(F.nullif(reason, F.lit("")))).alias("_lost"))
    joined = rows.join(lost, list(keys), "left").withColumn("shape_gate_failed", F.coalesce(F.size("_lost") > 0, F.lit(False)))
    return joined.withColumn("shape_gate_reasons", F.when(F.col("shape_gate_failed"), F.array_join(F.concat("_lost", _strings(["category_metric_failure"])), "|")).otherwise("")).drop("_lost")


def promotion_status(decision: Column, missing: Column) -> Column:
    """Status of a decision among candidates, one of which may lack its audit."""
    return route([(missing, AUDIT_MISSING), (decision == "promoted", ELIGIBLE), (decision == "insufficient_evidence", INSUFFICIENT)], NOT_ELIGIBLE)


def _dice(tp: Column, truth: Column, predicted: Column) -> tuple[Column, Column]:
    both = truth + predicted
    return F.when(both > 0, 2 * tp / both).otherwise(1.0), F.when(both - tp > 0, tp / (both - tp)).otherwise(1.0)


def prediction_review(examples: DataFrame, family: str, tolerance: float = 0.02, least_recall: float = 0.5, least_precision: float = 0.3, most: float = 0.5) -> DataFrame:
    """(family, reasons): why a family's predictions are degenerate or miss what they should cover; reasons joined by `|`.

    `examples` has a row an image: category and pixel counts tp, truth, predicted, pixels. Dice and Jaccard are pooled over a family's pixels and must
    exceed those of the all-background and all-foreground predictions.
    """
    share, like = F.col("predicted") / F.col("pixels"), F.col("category").isin("positive", "boundary") & (F.col("truth") > 0)
    recall, precision = F.col("tp") / F.col("truth"), F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    per = examples.groupBy(family).agg(
        F.max(share).alias("most"), F.min(share).alias("least"), *(F.sum(c).cast("double").alias(c) for c in ("tp", "truth", "predicted", "pixels")),
        F.count_if(like).alias("n"), F.count_if(like & (recall < least_recall)).alias("low_recall"), F.count_if(like & (precision < least_precision)).alias("low_precision"),
    )
    tp, truth, predicted, pixels = (F.col(c) for c in ("tp", "truth", "predicted", "pixels"))
    own, empty, full = _dice(tp, truth, predicted), _dice(F.lit(0.0), truth, F.lit(0.0)), _dice(truth, truth, pixels)
    rules = [(F.col("most") <= tolerance, "predictions_are_all_background"), (F.col("least") >= 1 - tolerance, "predictions_are_all_foreground")]
    for name, other in (("all_background", empty), ("all_foreground", full)):
        rules += [(a <= b, f"candidate_does_not_clear_{name}_{metric}_baseline") for metric, a, b in zip(("dice", "jaccard"), own, other, strict=True)]
    rules += [(F.col("low_recall") > most * F.col("n"), "prediction_does_not_reasonably_cover_positive_glomerulus_examples"), (F.col("low_precision") > most * F.col("n"), "prediction_oversegments_background_on_positive_glomerulus_examples")]
    return per.select(family, F.array_join(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in rules))), "|").alias("reasons"))


def binary_targets(score: Column) -> dict[str, Column]:
    """The primary target with borderline 1.0 left out, and the one that counts it as low; classes and values."""
    return {
        "primary": route([(score <= 0.5, "no_low"), (score >= 1.5, "moderate_severe"), (score == 1.0, "borderline_review")], "unscored"), "primary_value": F.when(score <= 0.5, 0.0).when(score >= 1.5, 1.0),
        "sensitivity": route([(score <= 1.0, "no_low_inclusive"), (score >= 1.5, "moderate_severe")], "unscored"), "sensitivity_value": F.when(score <= 1.0, 0.0).when(score >= 1.5, 1.0),
    }


def binary_candidate(metrics: DataFrame, favoured: str) -> DataFrame:
    """The row of `metrics` (candidate_id, balanced_accuracy, average_precision; finite logistic ones) with the best balanced accuracy, then average precision, then the favoured candidate."""
    value = lambda c: F.coalesce(number(F.col(c)), F.lit(-1.0))
    key = F.struct(value("balanced_accuracy"), value("average_precision"), (F.col("candidate_id") == favoured).cast("int"), "candidate_id")
    return metrics.agg(F.max_by(F.struct(*metrics.columns), key).alias("b")).filter("b is not null").select("b.*")


def review_text(c: Column) -> Column:
    """What a reviewer is told about a route."""
    return route([(c == k, text) for k, text in ROUTES.items()], "Model decision is not available.")


def mode_text(c: Column) -> Column:
    """The most frequent non-blank text of a group, of equals the smallest; an aggregate over counts is cheaper where groups are large."""
    return F.coalesce(F.mode(F.nullif(F.trim(c), F.lit("")), True), F.lit(""))


def cluster_anchors(review: DataFrame, keys: Sequence[str], id_: str, classes: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(keys, verdict, anchor_class, counts) of reviewed clusters: blocked unless a real morphology cluster with nothing excluded, else an anchor if notes or morphology name a class."""
    action = F.col("review_action")
    per = review.groupBy(*keys).agg(
        mode_text(F.col("cluster_interpretation")).alias("interpretation"), mode_text(F.col("cluster_notes")).alias("notes"), mode_text(F.col("morphology_assessment")).alias("morphology"), F.count("*").alias("rows_reviewed"),
        F.count_if(action == "accept").alias("accepted_count"), F.count_if(F.col("case_cluster_fit") == "representative").alias("representative_count"), F.count_if(action == "flag_score_review").alias("score_review_count"),
        F.count_if(action == "exclude_from_anchor").alias("exclude_from_anchor_count"), F.max(id_).alias("last_id"),
    )
    blocked = (F.col("interpretation") != "real_morphology_cluster") | (F.col("exclude_from_anchor_count") > 0)
    named = keyword_class(F.concat_ws(" ", "notes", "morphology"), classes, "")
    return per.withColumn("anchor_class", named).withColumn("verdict", route([(blocked, "blocked_cluster_anchor"), (F.col("anchor_class") != "", "candidate_anchor_cluster")], "needs_more_review"))


def cluster_mapping(rows: DataFrame, cluster: str, target: str, blocked: str) -> DataFrame:
    """`rows` with a target plus probability: 1 if their cluster's mean target is one half or more, else 0; null in blocked clusters."""
    known = rows.filter(F.col(target).isNotNull())
    per = known.groupBy(cluster).agg((F.avg(target) >= 0.5).cast("double").alias("_p"))
    return known.join(per, cluster).withColumn("probability", F.when(~F.col(blocked), F.col("_p"))).drop("_p")


def adjudication_errors(rows: DataFrame, reference: DataFrame, id_: str, decisions: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """(id, error): ids that the reference lacks, repeated ids whose decisions differ, and given values that differ from the reference's."""
    ref = reference.dropDuplicates([id_])
    lost = rows.join(ref, id_, "left_anti").select(id_, F.lit("unmatched_id").alias("error")).distinct()
    differ = F.array(*(F.when(F.min(c) != F.max(c), F.concat(F.lit("conflicting_duplicate_decisions:"), F.lit(c))) for c in decisions))
    twice = rows.groupBy(id_).agg(F.array_compact(differ).alias("e")).select(id_, F.explode("e").alias("error"))
    named = ref.select(id_, *(F.col(c).alias(f"_{c}") for c in compared))
    drift = F.array(*(F.when((F.trim(c) != "") & (F.trim(c) != F.coalesce(f"_{c}", F.lit(""))), F.concat(F.lit("differs_from_reference:"), F.lit(c))) for c in compared))
    moved = rows.join(named, id_).select(id_, F.explode(F.array_compact(drift)).alias("error")).distinct()
    return lost.unionByName(twice).unionByName(moved)


def majority_baselines(rows: DataFrame, targets: Mapping[str, Column]) -> DataFrame:
    """(target, rows, majority, accuracy, balanced_accuracy) of always guessing each target's most frequent class, of equals the smallest."""
    long = rows.select(F.explode(F.create_map(*(x for name, c in targets.items() for x in (F.lit(name), c)))).alias("target", "value")).filter("value is not null")
    per = long.groupBy("target", "value").agg(F.count("*").alias("n"))
    best = F.max_by("n", F.struct("n"))
    out = per.groupBy("target").agg(F.sum("n").alias("rows"), F.count("*").alias("classes"), best.alias("top"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("majority"))
    return out.select("target", "rows", "majority", (F.col("top") / F.col("rows")).alias("accuracy"), (1 / F.col("classes")).alias("balanced_accuracy"))


def usable_columns(df: DataFrame, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """(column, missing, non_finite, variance, kept): kept are all-finite columns that vary, in one aggregation of all columns."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    facts = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_if(bad(c)).alias("non_finite"), F.var_pop(F.when(~bad(c), F.col(c))).alias("variance")) for c in columns
    ]
    one = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    return one.withColumn("kept", (F.col("missing") == 0) & (F.col("non_finite") == 0) & F.coalesce(F.sqrt("variance") > least, F.lit(False)))


def first_unseen(df: DataFrame, id_: str, buckets: Sequence[tuple[str, Sequence[Column]]], k: int, size: int) -> DataFrame:
    """The first k rows of each bucket's order, a row that several buckets have only in the first of them; at most `size` rows, in bucket order."""
    parts = [df.orderBy(*order, id_).limit(k).withColumns({"bucket": F.lit(name), "_b": F.lit(at)}).withColumn("_r", F.row_number().over(W.orderBy(*order, id_))) for at, (name, order) in enumerate(buckets)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = both.withColumn("_n", F.row_number().over(W.partitionBy(id_).orderBy("_b"))).filter("_n = 1")  # k rows a bucket
    return first.orderBy("_b", "_r").limit(size).drop("_b", "_r", "_n")


def cohort_profile(rows: DataFrame, group: Column, score: Column) -> DataFrame:
    """(what, key, n): examples, groups, examples of each class and above each threshold but the last."""
    classes = F.transform(F.array(*(F.lit(s) for s in RUBRIC)), lambda s: F.when(score == s, F.struct(F.lit("class").alias("what"), s.cast("string").alias("key"))))
    above = F.transform(F.array(*(F.lit(s) for s in RUBRIC[:-1])), lambda s: F.when(score > s, F.struct(F.lit("above").alias("what"), s.cast("string").alias("key"))))
    every = F.array(F.struct(F.lit("examples").alias("what"), F.lit("all").alias("key")))
    counted = rows.select(F.explode(F.concat(every, F.array_compact(classes), F.array_compact(above))).alias("x")).groupBy("x.what", "x.key").agg(F.count("*").alias("n"))
    return counted.unionByName(rows.agg(F.countDistinct(group).alias("n")).select(F.lit("groups").alias("what"), F.lit("all").alias("key"), "n"))
