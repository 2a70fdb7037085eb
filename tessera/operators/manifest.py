"""A manifest of images with scores: identifiers, joins, admission states and audits, row by row as column expressions.

A manifest has a row an image: cohort_id, image_path, mask_path, score, source_image_name, source_sample_id, source_score_row,
source_date, source_batch, lane_assignment, admission_status, exclusion_reason, discovery_surfaces and more. Whether files exist, and their hashes,
are columns of the input (image_exists, mask_exists, image_sha256): on a cluster they come from a listing that is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean, is_missing, joined_id, naming_format, number, slug
from tessera.operators.contracts import ContractError
from tessera.operators.running import numbered
from tessera.operators.states import route

#: Lanes, their older names, and where rows are to be looked for.
CORE, EXTERNAL, SCORED_ONLY, CONCORDANCE = "manual_mask_core", "manual_mask_external", "scored_only", "mr_concordance_only"
ALIASES = {"manual_mask": CORE, "masked_external": EXTERNAL}
SURFACES = ("localized_runtime_assets", "score_workbook_or_labelstudio_export", "cohort_metadata_logs")
#: Candidates for the columns that tell a cohort's rows apart.
DISCRIMINATORS = ("source_image_name", "source_sample_id", "source_score_row", "image_path", "source_batch", "source_date")
#: Most cohorts of a manifest: each becomes a case of an expression.
MOST_COHORTS = 1000


@dataclass(frozen=True)
class Cohorts:
    """Names of the cohorts that have rules of their own: with masks drawn for training, with dated subjects, only for concordance."""

    core: str = "core"
    dated: str = "dated"
    concordance: str = "concordance"
    surfaces: Mapping[str, Sequence[str]] = field(default_factory=dict)


def lane(c: Column) -> Column:
    """The lane's present name."""
    out = clean(c)
    for old, new in ALIASES.items():
        out = F.when(clean(c) == old, new).otherwise(out)
    return out


def stem(name: Column) -> Column:
    """A file name without folders and its last suffix."""
    base = F.regexp_extract(clean(name), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def merge_equal_rows(manifest: DataFrame, order: str) -> DataFrame:
    """Rows of one cohort, image and score become the first of them by `order`, with duplicate_evidence_count; rows without image stay."""
    keys, given = ["cohort_id", "image_path", "score"], ~is_missing(F.col("image_path"))
    per = manifest.filter(given).groupBy(*keys).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = manifest["cohort_id"].eqNullSafe(per["_cohort_id"]) & manifest["image_path"].eqNullSafe(per["_image_path"]) & manifest["score"].eqNullSafe(per["_score"])
    out = manifest.join(per, same, "left").filter(F.col("_first").isNull() | (F.col("_first") == F.col(order)))
    return out.withColumn("duplicate_evidence_count", F.coalesce(F.col("_n").cast("string"), F.lit(""))).drop("_first", "_n", *(f"_{k}" for k in keys))


def discriminators(manifest: DataFrame, candidates: Sequence[str] = DISCRIMINATORS) -> dict[str, list[str]]:
    """For each cohort the smallest run of neighbouring candidate columns, leftmost first, that is never blank and never repeats.

    A width costs one aggregation of hashed keys; only a row a cohort reaches the driver. A cohort without such columns is an error.
    """
    left, found = manifest.select(F.coalesce("cohort_id", F.lit("")).alias("cohort"), *candidates), {}
    cohorts = [r[0] for r in left.select("cohort").distinct().limit(MOST_COHORTS + 1).collect()]
    if len(cohorts) > MOST_COHORTS:
        raise ContractError(f"more than {MOST_COHORTS} cohorts")
    for width in range(1, len(candidates) + 1):
        open_ = [c for c in cohorts if c not in found]
        if not open_:
            break
        windows = [candidates[at : at + width] for at in range(len(candidates) - width + 1)]
        blank = lambda w: F.exists(F.array(*(is_missing(F.col(c)) for c in w)), lambda x: x)
        keys = [F.struct(F.lit(at).alias("at"), F.when(~blank(w), F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in w))), 256)).alias("key")) for at, w in enumerate(windows)]
        per = left.filter(F.col("cohort").isin(open_)).select("cohort", F.explode(F.array(*keys)).alias("k")).groupBy("cohort", "k.at", "k.key").agg(F.count("*").alias("n"))
        good = per.groupBy("cohort", "at").agg(F.max(F.col("key").isNull() | (F.col("n") > 1)).alias("bad")).filter("not bad").groupBy("cohort").agg(F.min("at").alias("at"))
        found |= {r["cohort"]: list(windows[r["at"]]) for r in good.collect()}
    if missing := sorted(c for c in cohorts if c not in found):
        raise ContractError(f"no columns tell the rows of {', '.join(missing[:10])} apart")
    return found


def with_ids(manifest: DataFrame, order: str, candidates: Sequence[str] = DISCRIMINATORS) -> DataFrame:
    """`manifest` plus harmonized_id (cohort and discriminators as slugs) and manifest_row_id (cohort and the row's number by `order`)."""
    out, cohort = None, F.coalesce("cohort_id", F.lit(""))
    for name, columns in sorted(discriminators(manifest, candidates).items()):
        one = joined_id(F.col("cohort_id"), *(F.col(c) for c in columns))
        out = F.when(cohort == name, one) if out is None else out.when(cohort == name, one)
    rows = numbered(manifest.withColumn("harmonized_id", out if out is not None else F.lit("")), order, "_number")
    digits = F.col("_number").cast("string")
    return rows.withColumn("manifest_row_id", F.concat(slug(F.col("cohort_id")), F.lit("__"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))).drop("_number")


def _preset() -> Column:
    return clean(F.col("admission_status")).isin("foreign", "excluded")


def _reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in rules)))


def enriched(manifest: DataFrame, order: str, cohorts: Cohorts = Cohorts(), need_assets: bool = True) -> DataFrame:
    """Generated columns: ids, lane, join, verification and admission status with the reasons in rule order. Foreign and excluded rows keep their state."""
    rows = with_ids(merge_equal_rows(manifest, order), order)
    image, mask = clean(F.col("image_path")), clean(F.col("mask_path"))
    given = lane(F.col("lane_assignment"))
    own = F.when((mask != "") & F.col("mask_exists"), F.when(clean(F.col("cohort_id")) == cohorts.core, CORE).otherwise(EXTERNAL)).otherwise(SCORED_ONLY)
    lost = _reasons([
        (image == "", "missing_image_path"),
        ((image != "") & F.lit(need_assets) & ~F.col("image_exists"), "image_unreadable"),
        (number(F.col("score")).isNull(), "missing_score"),
        (is_missing(F.col("source_score_row")) & is_missing(F.col("source_sample_id")), "missing_score_locator"),
        ((mask != "") & F.lit(need_assets) & ~F.col("mask_exists"), "mask_unreadable"),
    ])
    bad, preset = F.size("_lost") > 0, F.col("_preset")
    keep = lambda c, value: F.when(preset, F.col(c)).otherwise(value)
    return rows.withColumns({"_lost": lost, "_preset": _preset(), "lane_assignment": F.when(given != "", given).otherwise(own)}).withColumns({
        "join_status": keep("join_status", F.when(~bad, "joined").when(F.array_contains("_lost", "missing_score"), "pending_discovery").otherwise("failed")),
        "verification_status": keep("verification_status", F.when(bad, "pending_discovery").otherwise("passed")),
        "admission_status": keep("admission_status", F.when(bad, "unresolved").otherwise("admitted")),
        "exclusion_reason": keep("exclusion_reason", F.array_join("_lost", ";")),
        "mapping_review_status": F.when(is_missing(F.col("mapping_review_status")), "not_sampled").otherwise(F.col("mapping_review_status")),
        "discovery_surfaces": F.when(is_missing(F.col("discovery_surfaces")), ";".join(SURFACES)).otherwise(F.col("discovery_surfaces")),
    }).drop("_lost", "_preset")


def verified(manifest: DataFrame) -> DataFrame:
    """The mapping checked anew: mapping_failure_reasons, and the states that follow; an image with two scores in its cohort is excluded."""
    conflicts = (
        manifest.filter(~is_missing(F.col("image_path"))).groupBy("cohort_id", "image_path").agg((F.min("score") < F.max("score")).alias("_two")).filter("_two")
        .withColumnsRenamed({"cohort_id": "_cohort", "image_path": "_image"})
    )
    rows = manifest.join(conflicts, manifest["cohort_id"].eqNullSafe(conflicts["_cohort"]) & (manifest["image_path"] == conflicts["_image"]), "left")
    image = is_missing(F.col("image_path"))
    lost = _reasons([
        (is_missing(F.col("harmonized_id")), "missing_harmonized_id"),
        (image, "missing_image_path"),
        (~image & ~F.col("image_exists"), "image_unreadable"),
        (number(F.col("score")).isNull(), "missing_score"),
        (F.col("_two"), "conflicting_duplicate_scores"),
        (is_missing(F.col("source_score_row")) & is_missing(F.col("source_sample_id")), "missing_locator_fields"),
        (is_missing(F.col("image_sha256")), "missing_image_hash"),
    ])
    preset, bad, joined = F.col("_preset"), F.size("_lost") > 0, F.array_join("_lost", ";")
    conflict = F.array_contains("_lost", "conflicting_duplicate_scores")
    return rows.withColumns({"_lost": lost, "_preset": _preset()}).withColumns({
        "mapping_failure_reasons": F.when(preset, clean(F.col("exclusion_reason"))).otherwise(joined),
        "verification_status": F.when(preset, F.when(is_missing(F.col("verification_status")), "excluded").otherwise(F.col("verification_status")))
        .when(~bad, "passed").when(conflict, "failed").otherwise("pending_discovery"),
        "admission_status": F.when(preset, F.col("admission_status")).when(~bad, "admitted").when(conflict, "excluded").otherwise("unresolved"),
        "exclusion_reason": F.when(preset, F.col("exclusion_reason")).otherwise(joined),
    }).drop("_lost", "_preset", "_two", "_cohort", "_image")


def admission_policy(manifest: DataFrame, cohorts: Cohorts = Cohorts()) -> DataFrame:
    """The concordance cohort is only evaluated; rows with a score but no mask wait for an audit of their transport."""
    name, admitted = clean(F.col("cohort_id")), clean(F.col("admission_status")) == "admitted"
    only, waits = name == cohorts.concordance, F.col("_lane") == SCORED_ONLY
    return manifest.withColumns({"_lane": lane(F.col("lane_assignment")), "_in": admitted}).withColumns({
        "lane_assignment": F.when(only, CONCORDANCE).otherwise(F.col("_lane")),
        "admission_status": F.when(only & F.col("_in"), "evaluation_only").when(waits & F.col("_in"), "pending_transport_audit").otherwise(F.col("admission_status")),
        "exclusion_reason": F.when(only & F.col("_in"), "mr_phase1_concordance_only_not_training_admitted")
        .when(waits & F.col("_in"), "scored_only_requires_segmentation_transport_audit").otherwise(F.col("exclusion_reason")),
    }).drop("_lane", "_in")


def discovery(manifest: DataFrame, cohorts: Cohorts = Cohorts()) -> DataFrame:
    """Rows not yet settled wait for the surfaces that their cohort requires and that were not looked at; when none is left they are unresolved."""
    status = clean(F.col("admission_status"))
    required = F.array(*map(F.lit, SURFACES))
    for name, surfaces in cohorts.surfaces.items():
        required = F.when(clean(F.col("cohort_id")) == name, F.array(*map(F.lit, surfaces))).otherwise(required)
    seen = F.transform(F.split(clean(F.col("discovery_surfaces")), ";"), lambda x: F.trim(x))
    settled, lost = status.isin("admitted", "foreign", "excluded", "evaluation_only"), F.size("_lost") > 0
    waits = ~F.col("_settled") & lost
    over = ~F.col("_settled") & ~lost & (F.col("_status") == "pending_discovery")
    keep = lambda c: F.when(waits, "pending_discovery").otherwise(F.col(c))
    return manifest.withColumns({"_lost": F.filter(required, lambda x: ~F.array_contains(seen, x)), "_settled": settled, "_status": status}).withColumns({
        "join_status": keep("join_status"),
        "verification_status": keep("verification_status"),
        "admission_status": F.when(over, "unresolved").otherwise(keep("admission_status")),
        "exclusion_reason": F.when(waits, F.concat(F.lit("pending_discovery:"), F.array_join("_lost", ",")))
        .when(over & is_missing(F.col("exclusion_reason")), "discovery_exhausted").otherwise(F.col("exclusion_reason")),
    }).drop("_lost", "_settled", "_status")


def mask_quality(image: Column, mask: Column, same_size: Column, foreground: Column, components: Column, low: float = 0.001, high: float = 0.25) -> Column:
    """Reasons against a mask, joined by `;`: missing files, else its size beside the image's, its share of foreground, its components."""
    missing = _reasons([(~image, "image_missing"), (~mask, "mask_missing")])
    facts = _reasons([
        (~same_size, "image_mask_size_mismatch"), (foreground < low, "foreground_fraction_too_low"), (foreground > high, "foreground_fraction_too_high"), (components < 1, "no_mask_components"),
    ])
    return F.array_join(F.when(F.size(missing) > 0, missing).otherwise(facts), ";")


def mask_approval(manifest: DataFrame, audit: DataFrame, cohorts: Cohorts = Cohorts()) -> DataFrame:
    """mask_quality_review_status from `audit` (manifest_row_id, mask_quality_decision) for the dated cohort's external masks; approved counts before blocked."""
    per = audit.groupBy(F.col("manifest_row_id").alias("_row")).agg(F.max(F.col("mask_quality_decision") == "approved").alias("_yes"), F.max(F.col("mask_quality_decision") == "blocked").alias("_no"))
    rows = manifest.join(per, clean(F.col("manifest_row_id")) == F.col("_row"), "left")
    mine = (clean(F.col("cohort_id")) == cohorts.dated) & (lane(F.col("lane_assignment")) == EXTERNAL)
    return rows.withColumn("mask_quality_review_status", F.when(mine & F.col("_yes"), "approved").when(mine & F.col("_no"), "blocked").otherwise("")).drop("_row", "_yes", "_no")


def identity(manifest: DataFrame, cohorts: Cohorts = Cohorts()) -> DataFrame:
    """subject_id, sample_id, replicate_id, image_id and how the subject was told (identity_resolution)."""
    cohort, sample, date, batch = slug(F.col("cohort_id")), clean(F.col("source_sample_id")), clean(F.col("source_date")), clean(F.col("source_batch"))
    name = F.when(~is_missing(F.col("source_image_name")), stem(F.col("source_image_name"))).when(~is_missing(F.col("image_path")), stem(F.col("image_path")))
    name = name.otherwise(F.when(sample != "", sample).otherwise(clean(F.col("manifest_row_id"))))
    copy = F.regexp_extract(name, r"(?i)(?:_Image|image)([A-Za-z0-9]+)$", 1)
    ways = [
        ((F.col("_cohort") == cohorts.dated) & (sample != "") & (date != ""), F.concat(slug(date), F.lit("__"), slug(sample)), "dox_rand_assign_subject_preserving"),
        ((F.col("_cohort") == cohorts.core) & (sample != ""), slug(F.substring_index(sample, "_Image", 1)), "labelstudio_source_sample_subject"),
        (sample != "", F.concat(slug(F.when(batch != "", batch).when(date != "", date).otherwise("unbatched")), F.lit("__"), slug(sample)), "manifest_source_sample_batch_preserving"),
    ]
    token, how = None, None
    for cond, value, word in ways:
        token = F.when(cond, value) if token is None else token.when(cond, value)
        how = F.when(cond, word) if how is None else how.when(cond, word)
    return (
        manifest.withColumn("_cohort", cohort)
        .withColumns({"replicate_id": F.when(copy != "", F.concat(F.lit("image"), copy)).otherwise(slug(name)), "identity_resolution": how.otherwise("manifest_image_stem_subject")})
        .withColumn("subject_id", F.concat("_cohort", F.lit("__"), token.otherwise(slug(name))))
        .withColumn("sample_id", F.concat("subject_id", F.lit("__"), "replicate_id"))
        .withColumn("image_id", F.concat("sample_id", F.lit("__"), slug(F.col("manifest_row_id"))))
        .drop("_cohort")
    )


def require_unique(df: DataFrame, column: str) -> DataFrame:
    """`df`, or an error if a value of `column` repeats."""
    twice = df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1").orderBy(column).limit(10).collect()
    if twice:
        raise ContractError(f"{column} repeats: {', '.join(str(r[0]) for r in twice)}")
    return df


def score_audit(manifest: DataFrame, workbook: DataFrame, cohorts: Cohorts = Cohorts()) -> DataFrame:
    """source_score_audit_status of the dated cohort's rows against `workbook` (source_sample_id, source_image_stem, workbook_score); other rows have none."""
    scores = workbook.select(F.col("source_sample_id").alias("_sample"), F.col("source_image_stem").alias("_stem"), "workbook_score")
    name = F.when(~is_missing(F.col("source_image_name")), stem(F.col("source_image_name"))).otherwise(stem(F.col("image_path")))
    rows = manifest.join(scores, (clean(F.col("source_sample_id")) == F.col("_sample")) & (name == F.col("_stem")), "left")
    own, other = number(F.col("score")), F.col("workbook_score")
    close = F.abs(own - other) <= 1e-8 + 1e-5 * F.abs(other)
    status = F.when(own.isNull(), "manifest_score_missing").when(other.isNull(), "workbook_score_missing").when(close, "matched").otherwise("mismatch")
    return rows.withColumn("source_score_audit_status", F.when(F.col("cohort_id") == cohorts.dated, status).otherwise("")).drop("_sample", "_stem", "workbook_score")


def staged(rows: DataFrame, audit: DataFrame, workbook: DataFrame, cohorts: Cohorts = Cohorts()) -> DataFrame:
    """Enriched rows through the other stages: verified, admission policy, discovery, mask approval, identity, score audit."""
    found = discovery(admission_policy(verified(rows), cohorts), cohorts)
    return score_audit(identity(mask_approval(found, audit, cohorts), cohorts), workbook, cohorts)


def spine(manifest: DataFrame, order: str, audit: DataFrame, workbook: DataFrame, cohorts: Cohorts = Cohorts()) -> DataFrame:
    """The manifest through all its stages, from equal rows merged to the score audit."""
    return staged(enriched(manifest, order, cohorts), audit, workbook, cohorts)


def transport(manifest: DataFrame, outputs: DataFrame, order: str) -> DataFrame:
    """transport_status and its reasons from `outputs` (manifest_row_id, segmentation_status, accepted_roi_count, grading_status); of repeated outputs the first by `order`."""
    first = outputs.groupBy(F.col("manifest_row_id").alias("_row")).agg(F.min_by(F.struct("segmentation_status", "accepted_roi_count", "grading_status"), F.col(order)).alias("_o"))
    rows = manifest.join(first, clean(F.col("manifest_row_id")) == F.col("_row"), "left")
    lost = F.when(F.col("_row").isNull(), F.array(F.lit("missing_segmentation_output"))).otherwise(_reasons([
        (clean(F.col("_o.segmentation_status")) != "ok", "segmentation_not_ok"),
        (F.coalesce(F.col("_o.accepted_roi_count"), F.lit(0)) <= 0, "degenerate_segmentation_output"),
        (clean(F.col("_o.grading_status")) != "ok", "grading_not_ok"),
    ]))
    bad = F.size("_lost") > 0
    return rows.withColumn("_lost", lost).withColumns({
        "transport_status": F.when(bad, "blocked").otherwise("passed"), "transport_failure_reason": F.array_join("_lost", ";"),
        "admission_status": F.when(bad, "excluded").otherwise(F.col("admission_status")), "exclusion_reason": F.when(bad, F.array_join("_lost", ";")).otherwise(F.col("exclusion_reason")),
    }).drop("_lost", "_row", "_o")


def with_assignment(manifest: DataFrame, assignment: DataFrame, columns: Sequence[str], surface: str) -> DataFrame:
    """Values of `assignment` (unique source_sample_id, columns) win; matched rows take its group as treatment_group and note the surface."""
    named = assignment.select("source_sample_id", F.lit(True).alias("_met"), *(F.col(c).alias(f"_{c}") for c in columns))
    rows = manifest.join(named, "source_sample_id", "left").withColumns({c: F.coalesce(f"_{c}", c) if c in manifest.columns else F.col(f"_{c}") for c in columns})
    met = F.coalesce(F.col("_met"), F.lit(False))
    more = F.regexp_replace(F.concat(F.coalesce("discovery_surfaces", F.lit("")), F.lit(f";{surface}")), "^;+|;+$", "")
    return rows.withColumns({
        "treatment_group": F.when(met, F.col("source_assignment_group")).otherwise(F.col("treatment_group")), "discovery_surfaces": F.when(met, more).otherwise(F.col("discovery_surfaces")),
    }).drop("_met", *(f"_{c}" for c in columns))


def upload_resolution(rows: DataFrame, uploads: DataFrame) -> DataFrame:
    """Whether each scored row's source_image_name is the name of exactly one upload, alone in the table and with one score; the reasons against it."""
    found = uploads.groupBy(F.lower("name").alias("_name")).agg(F.count("*").alias("_matches"))
    score = F.coalesce(number(F.col("score")).cast("string"), F.lit(""))
    per = rows.groupBy(F.col("source_image_name").alias("_own")).agg(F.count("*").alias("_rows"), (F.min(score) < F.max(score)).alias("_two"))
    both = rows.join(per, rows["source_image_name"].eqNullSafe(per["_own"])).join(found, F.lower(clean(F.col("source_image_name"))) == F.col("_name"), "left")
    n = F.coalesce("_matches", F.lit(0))
    status = F.when(n == 1, "resolved_exactly_once").when(n > 1, "resolved_multiple_uploads").otherwise("unresolved_no_upload_match")
    lost = F.array_compact(F.array(
        F.when(F.col("resolution_status") != "resolved_exactly_once", F.col("resolution_status")), F.when(F.col("_rows") > 1, F.lit("duplicate_source_image_name")),
        F.when(F.col("_two"), F.lit("conflicting_scores_for_source_image_name")), F.when(number(F.col("score")).isNull(), F.lit("missing_score")),
    ))
    return both.withColumn("resolution_status", status).withColumn("reasons", F.array_join(lost, ";")).withColumn("clean", F.col("reasons") == "").drop("_own", "_rows", "_two", "_matches", "_name")


def migration_plan(files: DataFrame, mapping: DataFrame, known: DataFrame) -> DataFrame:
    """Where each file (kind, folder, filename) belongs: status, reason, subject_image_id, target; files that share a target collide.

    Names are canonical (`S1-2`, masks with `_mask`), legacy (`S1_Image2`, looked up in `mapping`, legacy_stem and mapped, a row a stem) or invalid. `known` has the
    subject_image_id of the metadata.
    """
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    bare = F.regexp_replace(stem(F.col("filename")), "_mask$", "")
    rows = files.withColumns({"_suffix": suffix, "_stem": bare}).withColumns({"_canonical": naming_format(F.col("_stem")) == "canonical", "_named": naming_format(F.col("_stem")) == "legacy"})
    rows = rows.withColumn("_stem", F.when(F.col("_named"), F.regexp_replace("_stem", r"_Image0+(?=\d)", "_Image")).otherwise(F.col("_stem")))
    rows = rows.join(mapping.select(F.col("legacy_stem").alias("_stem"), "mapped"), "_stem", "left")
    rows = rows.withColumn("subject_image_id", F.when(F.col("_canonical"), F.col("_stem")).when(F.col("_named"), F.coalesce("mapped", F.lit(""))).otherwise(""))
    ids = known.select("subject_image_id").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(ids, "subject_image_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    folder = F.substring_index("subject_image_id", "-", 1)
    name = F.concat("subject_image_id", F.when(F.col("kind") == "masks", "_mask").otherwise(""), "_suffix")
    placed = F.when((F.col("subject_image_id") != "") & (F.col("_canonical") | F.col("_known")), F.concat_ws("/", "kind", folder, name)).otherwise("")
    rows = rows.withColumn("target", placed)
    at_home = F.col("target") == F.concat_ws("/", "kind", "folder", "filename")
    ladder = [
        (~F.col("_canonical") & ~F.col("_named"), "invalid_name", "filename_not_parseable"),
        (F.col("_canonical") & ~F.col("_known"), "canonical_missing_from_metadata", "subject_image_id_not_in_metadata"),
        (F.col("_canonical") & at_home, "already_canonical", "ok"),
        (F.col("_canonical"), "canonical_relocation_required", "canonical_name_in_wrong_subject_dir"),
        (F.col("subject_image_id") == "", "unmapped_legacy", "legacy_name_has_no_mapping"),
        (~F.col("_known"), "mapped_id_missing_from_metadata", "mapping_target_not_in_metadata"),
    ]
    status, reason = route([(cond, a) for cond, a, _ in ladder], "rename_required"), route([(cond, b) for cond, _, b in ladder], "mapped_from_legacy")
    rows = rows.withColumns({"status": status, "reason": reason})
    moving = rows.filter(F.col("status").isin("rename_required", "canonical_relocation_required"))
    twice = moving.groupBy(F.col("target").alias("_target")).agg(F.count("*").alias("_n")).filter("_n > 1")
    out = rows.join(twice, F.col("target") == F.col("_target"), "left")
    hit = F.col("_n").isNotNull()
    return out.withColumns({"status": F.when(hit, "target_collision").otherwise(F.col("status")), "reason": F.when(hit, "multiple_sources_map_to_same_target").otherwise(F.col("reason"))}).select(
        "kind", "folder", "filename", "subject_image_id", "target", "status", "reason"
    )


def replicate_medians(long: DataFrame, key: str, value: str) -> DataFrame:
    """(key, score, replicate_count): median and number of the replicates of each image, from `long` (a row a replicate)."""
    return long.filter(F.col(value).isNotNull()).groupBy(key).agg(F.median(value).alias("score"), F.count(value).alias("replicate_count"))


def concordance(manifest: DataFrame, rois: DataFrame, least_area: int = 64) -> DataFrame:
    """Of each row (manifest_row_id, score) the median grade of its accepted regions beside the human one; without any it's non_evaluable.

    `rois` (manifest_row_id, roi_grade, component_area) are accepted from `least_area` on, with a grade.
    """
    ok = (F.col("component_area") >= least_area) & F.col("roi_grade").isNotNull()
    per = rois.groupBy("manifest_row_id").agg(F.median(F.when(ok, F.col("roi_grade"))).alias("inferred_image_median"), F.count_if(ok).alias("accepted_roi_count"), F.count("*").alias("_all"))
    rows = manifest.select("manifest_row_id", F.col("score").alias("human_image_median")).join(per, "manifest_row_id", "left")
    accepted = F.coalesce("accepted_roi_count", F.lit(0))
    return rows.select(
        "manifest_row_id", "human_image_median", "inferred_image_median", accepted.alias("accepted_roi_count"), (F.coalesce("_all", F.lit(0)) - accepted).alias("rejected_roi_count"),
        F.when(accepted > 0, "ok").otherwise("non_evaluable").alias("concordance_status"),
    )
