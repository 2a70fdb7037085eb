"""Queries over a manifest of documents as images: identifiers, states, audits, migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import manifest as man
from tessera.sources.scratch import written
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


COHORTS = man.Cohorts(surfaces={"core": ("active_runtime", "annotations"), "dated": ("latest_export", "decoded_masks")})


def base(spark: SparkSession, d: str) -> DataFrame:
    """A manifest row a document: the language is the cohort, the digest of the text the image, labels give the score."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n, source, number = F.col("n_chars"), F.col("source"), F.col("doc_id").cast("string")
    dated = F.col("lang") == "de"
    image = F.concat(F.left(F.sha2(F.col("text"), 256), F.lit(16)), F.lit(".png"))
    copy = F.concat(F.lit("_Image"), (n % 4).cast("string"))
    blank = lambda cond, value: F.when(cond, F.lit("")).otherwise(value)
    return docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", "core").when(dated, "dated").when(F.col("lang") == "fr", "concordance").otherwise("other").alias("cohort_id"),
        blank(n < 60, F.concat(F.lit("images/"), image)).alias("image_path"),
        blank(n % 3 != 0, F.concat(F.lit("masks/"), image)).alias("mask_path"),
        (F.col("quality") + F.col("toxic") / F.lit(2.0)).alias("score"),
        F.concat(source, copy, F.lit(".png")).alias("source_image_name"),
        blank(n % 13 == 0, F.concat(F.upper(F.left("lang", F.lit(1))), F.floor(n / 100).cast("string"), copy)).alias("source_sample_id"),
        blank(dated, number).alias("source_score_row"),
        F.when(dated, F.concat(F.lit("b"), number)).otherwise(source).alias("source_batch"),
        blank(n % 2 != 0, F.concat(F.lit("2024-0"), (n % 9 + 1).cast("string"), F.lit("-01"))).alias("source_date"),
        F.when(source == "src3", "masked_external").when(source == "src4", "scored_only").otherwise("").alias("lane_assignment"),
        F.lit("").alias("join_status"), F.lit("").alias("verification_status"), F.lit("").alias("mapping_review_status"),
        F.when(source == "src0", "foreign").when(source == "src1", "excluded").otherwise("").alias("admission_status"),
        blank(source != "src0", F.lit("foreign_mixed_export_row")).alias("exclusion_reason"),
        F.when(source == "src2", " active_runtime ;latest_export; annotations").when(source == "src5", "decoded_masks;latest_export").otherwise("").alias("discovery_surfaces"),
        (n % 11 != 0).alias("image_exists"), (n % 5 != 0).alias("mask_exists"),
        blank(n % 17 == 0, F.sha2(F.col("text"), 256)).alias("image_sha256"),
    )


_COPY = "'_Image' || (n_chars % 4)"
_IMAGE = "left(sha256(text), 16) || '.png'"
_BASE = f"""base AS (SELECT d.doc_id, CASE lang WHEN 'en' THEN 'core' WHEN 'de' THEN 'dated' WHEN 'fr' THEN 'concordance' ELSE 'other' END AS cohort_id,
  CASE WHEN n_chars < 60 THEN '' ELSE 'images/' || {_IMAGE} END AS image_path, CASE WHEN n_chars % 3 <> 0 THEN '' ELSE 'masks/' || {_IMAGE} END AS mask_path,
  quality + toxic / 2.0::DOUBLE AS score, source || {_COPY} || '.png' AS source_image_name,
  CASE WHEN n_chars % 13 = 0 THEN '' ELSE upper(left(lang, 1)) || (n_chars // 100) || {_COPY} END AS source_sample_id,
  CASE WHEN lang = 'de' THEN '' ELSE d.doc_id::VARCHAR END AS source_score_row, CASE WHEN lang = 'de' THEN 'b' || d.doc_id ELSE source END AS source_batch,
  CASE WHEN n_chars % 2 <> 0 THEN '' ELSE '2024-0' || (n_chars % 9 + 1) || '-01' END AS source_date,
  CASE source WHEN 'src3' THEN 'masked_external' WHEN 'src4' THEN 'scored_only' ELSE '' END AS lane_assignment, '' AS join_status, '' AS verification_status, '' AS mapping_review_status,
  CASE source WHEN 'src0' THEN 'foreign' WHEN 'src1' THEN 'excluded' ELSE '' END AS admission_status, CASE WHEN source <> 'src0' THEN '' ELSE 'foreign_mixed_export_row' END AS exclusion_reason,
  CASE source WHEN 'src2' THEN ' active_runtime ;latest_export; annotations' WHEN 'src5' THEN 'decoded_masks;latest_export' ELSE '' END AS discovery_surfaces,
  n_chars % 11 <> 0 AS image_exists, n_chars % 5 <> 0 AS mask_exists, CASE WHEN n_chars % 17 = 0 THEN '' ELSE sha256(text) END AS image_sha256
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'missing')"


_LANE = "CASE lane_assignment WHEN 'manual_mask' THEN 'manual_mask_core' WHEN 'masked_external' THEN 'manual_mask_external' ELSE lane_assignment END"
_MERGED = """merged AS (SELECT * EXCLUDE (pos, n), CASE WHEN n > 1 AND image_path <> '' THEN n::VARCHAR ELSE '' END AS duplicate_evidence_count FROM (
  SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY doc_id) AS pos FROM base WINDOW w AS (PARTITION BY cohort_id, image_path, score)) WHERE image_path = '' OR pos = 1)"""
_WINDOWS = [man.DISCRIMINATORS[at : at + width] for width in range(1, 7) for at in range(7 - width)]
_OK = [f"bool_and({' AND '.join(f'{c} <> {chr(39)}{chr(39)}' for c in w)}) AND count(DISTINCT ({', '.join(w)})) = count(*)" for w in _WINDOWS]
_IDS = f"""picked AS (SELECT cohort_id, CASE {' '.join(f'WHEN {ok} THEN {k}' for k, ok in enumerate(_OK))} END AS w FROM merged GROUP BY 1),
ids AS (SELECT m.*, {_slug('cohort_id')} || '__' || CASE w {' '.join(f"WHEN {k} THEN {(chr(32) + '|| ' + repr('__') + ' || ').join(_slug(c) for c in w)}" for k, w in enumerate(_WINDOWS))} END AS harmonized_id,
  {_slug('cohort_id')} || '__' || printf('%06d', row_number() OVER (ORDER BY doc_id)) AS manifest_row_id FROM merged m JOIN picked USING (cohort_id))"""
_ENRICHED = f"""lost AS (SELECT *, list_filter([CASE WHEN image_path = '' THEN 'missing_image_path' END, CASE WHEN image_path <> '' AND NOT image_exists THEN 'image_unreadable' END, CASE WHEN score IS NULL THEN 'missing_score' END,
    CASE WHEN source_score_row = '' AND source_sample_id = '' THEN 'missing_score_locator' END, CASE WHEN mask_path <> '' AND NOT mask_exists THEN 'mask_unreadable' END], lambda x: x IS NOT NULL) AS r, admission_status IN ('foreign', 'excluded') AS preset FROM ids),
enriched AS (SELECT * EXCLUDE (r, preset) REPLACE (
    CASE WHEN {_LANE} <> '' THEN {_LANE} WHEN mask_path <> '' AND mask_exists THEN CASE WHEN cohort_id = 'core' THEN 'manual_mask_core' ELSE 'manual_mask_external' END ELSE 'scored_only' END AS lane_assignment,
    CASE WHEN preset THEN join_status WHEN len(r) = 0 THEN 'joined' WHEN list_contains(r, 'missing_score') THEN 'pending_discovery' ELSE 'failed' END AS join_status,
    CASE WHEN preset THEN verification_status WHEN len(r) > 0 THEN 'pending_discovery' ELSE 'passed' END AS verification_status,
    CASE WHEN preset THEN admission_status WHEN len(r) > 0 THEN 'unresolved' ELSE 'admitted' END AS admission_status,
    CASE WHEN preset THEN exclusion_reason ELSE array_to_string(r, ';') END AS exclusion_reason, 'not_sampled' AS mapping_review_status,
    CASE WHEN discovery_surfaces = '' THEN 'localized_runtime_assets;score_workbook_or_labelstudio_export;cohort_metadata_logs' ELSE discovery_surfaces END AS discovery_surfaces) FROM lost)"""
_VERIFIED = """marks AS (SELECT *, list_filter([CASE WHEN image_path = '' THEN 'missing_image_path' END, CASE WHEN image_path <> '' AND NOT image_exists THEN 'image_unreadable' END, CASE WHEN score IS NULL THEN 'missing_score' END,
    CASE WHEN image_path <> '' AND min(score) OVER (PARTITION BY cohort_id, image_path) < max(score) OVER (PARTITION BY cohort_id, image_path) THEN 'conflicting_duplicate_scores' END,
    CASE WHEN source_score_row = '' AND source_sample_id = '' THEN 'missing_locator_fields' END, CASE WHEN image_sha256 = '' THEN 'missing_image_hash' END], lambda x: x IS NOT NULL) AS r, admission_status IN ('foreign', 'excluded') AS preset FROM enriched),
verified AS (SELECT * EXCLUDE (r, preset) REPLACE (
    CASE WHEN preset THEN coalesce(nullif(verification_status, ''), 'excluded') WHEN len(r) = 0 THEN 'passed' WHEN list_contains(r, 'conflicting_duplicate_scores') THEN 'failed' ELSE 'pending_discovery' END AS verification_status,
    CASE WHEN preset THEN admission_status WHEN len(r) = 0 THEN 'admitted' WHEN list_contains(r, 'conflicting_duplicate_scores') THEN 'excluded' ELSE 'unresolved' END AS admission_status,
    CASE WHEN preset THEN exclusion_reason ELSE array_to_string(r, ';') END AS exclusion_reason), CASE WHEN preset THEN exclusion_reason ELSE array_to_string(r, ';') END AS mapping_failure_reasons FROM marks)"""
_POLICY = """policy AS (SELECT * REPLACE (CASE WHEN cohort_id = 'concordance' THEN 'mr_concordance_only' ELSE lane_assignment END AS lane_assignment,
    CASE WHEN admission_status <> 'admitted' THEN admission_status WHEN cohort_id = 'concordance' THEN 'evaluation_only' WHEN lane_assignment = 'scored_only' THEN 'pending_transport_audit' ELSE admission_status END AS admission_status,
    CASE WHEN admission_status <> 'admitted' THEN exclusion_reason WHEN cohort_id = 'concordance' THEN 'mr_phase1_concordance_only_not_training_admitted'
      WHEN lane_assignment = 'scored_only' THEN 'scored_only_requires_segmentation_transport_audit' ELSE exclusion_reason END AS exclusion_reason) FROM verified)"""
_DISCOVERY = """surfaces AS (SELECT *, list_filter(CASE cohort_id WHEN 'core' THEN ['active_runtime', 'annotations'] WHEN 'dated' THEN ['latest_export', 'decoded_masks']
      ELSE ['localized_runtime_assets', 'score_workbook_or_labelstudio_export', 'cohort_metadata_logs'] END, lambda x: NOT list_contains(list_transform(string_split(discovery_surfaces, ';'), lambda y: trim(y)), x)) AS gap,
    admission_status IN ('admitted', 'foreign', 'excluded', 'evaluation_only') AS settled FROM policy),
discovered AS (SELECT * EXCLUDE (gap, settled) REPLACE (CASE WHEN NOT settled AND len(gap) > 0 THEN 'pending_discovery' ELSE join_status END AS join_status,
    CASE WHEN NOT settled AND len(gap) > 0 THEN 'pending_discovery' ELSE verification_status END AS verification_status,
    CASE WHEN NOT settled AND len(gap) > 0 THEN 'pending_discovery' WHEN NOT settled AND admission_status = 'pending_discovery' THEN 'unresolved' ELSE admission_status END AS admission_status,
    CASE WHEN NOT settled AND len(gap) > 0 THEN 'pending_discovery:' || array_to_string(gap, ',') ELSE exclusion_reason END AS exclusion_reason) FROM surfaces)"""
_STAGES = f"{_BASE},\n{_MERGED},\n{_IDS},\n{_ENRICHED}"
_STATES = "doc_id, lane_assignment, join_status, verification_status, admission_status, exclusion_reason, discovery_surfaces"
STATES = [c.strip() for c in _STATES.split(",")]


@query(f"WITH {_STAGES}\nSELECT {_STATES}, harmonized_id, manifest_row_id, duplicate_evidence_count FROM enriched")
def enriched_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Equal rows merged, identifiers, lanes and first states."""
    return man.enriched(base(spark, d), "doc_id", COHORTS).select(*STATES, "harmonized_id", "manifest_row_id", "duplicate_evidence_count")


@query(f"WITH {_STAGES},\n{_VERIFIED}\nSELECT {_STATES}, mapping_failure_reasons FROM verified")
def verified_manifest(spark: SparkSession, d: str) -> DataFrame:
    return man.verified(man.enriched(base(spark, d), "doc_id", COHORTS)).select(*STATES, "mapping_failure_reasons")


@query(f"WITH {_STAGES},\n{_VERIFIED},\n{_POLICY},\n{_DISCOVERY}\nSELECT {_STATES} FROM discovered")
def admitted_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Admission policy, then what is still to be looked for."""
    return man.discovery(man.admission_policy(man.verified(man.enriched(base(spark, d), "doc_id", COHORTS)), COHORTS), COHORTS).select(*STATES)


def mask_audit(enriched: DataFrame) -> DataFrame:
    """A review of masks by row: the number of the document's row, decided by its length."""
    rows = enriched.select("manifest_row_id", "source_image_name")
    return rows.withColumn("mask_quality_decision", F.when(F.col("source_image_name").contains("_Image0"), "approved").when(F.col("source_image_name").contains("_Image1"), "blocked").otherwise("open"))


def workbook(spark: SparkSession, d: str) -> DataFrame:
    """Scores by sample and image stem, the mean where several rows share them."""
    rows = base(spark, d).withColumn("source_image_stem", man.stem(F.col("source_image_name")))
    return rows.filter("source_sample_id <> ''").groupBy("source_sample_id", "source_image_stem").agg(F.avg("score").alias("workbook_score"))


_STEM = "regexp_replace(source_image_name, '\\.[^.]*$', '')"
_REPLICATE = f"coalesce('image' || nullif(regexp_extract({_STEM}, '(?i)(?:_Image|image)([A-Za-z0-9]+)$', 1), ''), {_slug(_STEM)})"
_IDENTITY = f"""approved AS (SELECT *, CASE WHEN cohort_id = 'dated' AND lane_assignment = 'manual_mask_external' THEN CASE WHEN contains(source_image_name, '_Image0') THEN 'approved' WHEN contains(source_image_name, '_Image1') THEN 'blocked' ELSE '' END ELSE '' END AS mask_quality_review_status FROM discovered),
tokens AS (SELECT *, {_REPLICATE} AS replicate_id,
    CASE WHEN cohort_id = 'dated' AND source_sample_id <> '' AND source_date <> '' THEN {_slug('source_date')} || '__' || {_slug('source_sample_id')}
      WHEN cohort_id = 'core' AND source_sample_id <> '' THEN {_slug("string_split(source_sample_id, '_Image')[1]")}
      WHEN source_sample_id <> '' THEN {_slug("coalesce(nullif(source_batch, ''), nullif(source_date, ''), 'unbatched')")} || '__' || {_slug('source_sample_id')} ELSE {_slug(_STEM)} END AS token,
    CASE WHEN cohort_id = 'dated' AND source_sample_id <> '' AND source_date <> '' THEN 'dox_rand_assign_subject_preserving' WHEN cohort_id = 'core' AND source_sample_id <> '' THEN 'labelstudio_source_sample_subject'
      WHEN source_sample_id <> '' THEN 'manifest_source_sample_batch_preserving' ELSE 'manifest_image_stem_subject' END AS identity_resolution FROM approved),
identified AS (SELECT * EXCLUDE (token), {_slug('cohort_id')} || '__' || token AS subject_id, {_slug('cohort_id')} || '__' || token || '__' || replicate_id AS sample_id,
    {_slug('cohort_id')} || '__' || token || '__' || replicate_id || '__' || {_slug('manifest_row_id')} AS image_id FROM tokens)"""
_AUDIT = f"""book AS (SELECT source_sample_id AS s, {_STEM} AS t, avg(score) AS w FROM base WHERE source_sample_id <> '' GROUP BY 1, 2),
audited AS (SELECT i.*, CASE WHEN cohort_id <> 'dated' THEN '' WHEN score IS NULL THEN 'manifest_score_missing' WHEN w IS NULL THEN 'workbook_score_missing' WHEN abs(score - w) <= 1e-8 + 1e-5 * abs(w) THEN 'matched' ELSE 'mismatch' END AS source_score_audit_status
  FROM identified i LEFT JOIN book ON s = source_sample_id AND t = {_STEM})"""
_SPINE = f"{_STAGES},\n{_VERIFIED},\n{_POLICY},\n{_DISCOVERY},\n{_IDENTITY},\n{_AUDIT}"


def cohort_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = written(man.enriched(base(spark, d), "doc_id", COHORTS), "enriched")
    return man.staged(rows, mask_audit(rows), workbook(spark, d), COHORTS)


@query(f"WITH {_SPINE}\nSELECT doc_id, subject_id, sample_id, replicate_id, image_id, identity_resolution FROM audited")
def identity_contract(spark: SparkSession, d: str) -> DataFrame:
    """Subjects, samples, replicates and images of the manifest; an image id that repeats is an error."""
    rows = man.identity(man.enriched(base(spark, d), "doc_id", COHORTS), COHORTS)
    return man.require_unique(rows, "image_id").select("doc_id", "subject_id", "sample_id", "replicate_id", "image_id", "identity_resolution")


@query(f"WITH {_SPINE}\nSELECT {_STATES}, manifest_row_id, image_id, mask_quality_review_status, source_score_audit_status FROM audited")
def cohort_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest through all seven stages."""
    return cohort_rows(spark, d).select(*STATES, "manifest_row_id", "image_id", "mask_quality_review_status", "source_score_audit_status")


@query(f"""WITH {_SPINE}
SELECT cohort_id, lane_assignment, admission_status, count(*) AS "rows", count(DISTINCT subject_id) AS subjects, count(score) AS scored, count(*) FILTER (source_score_audit_status = 'mismatch' AND admission_status = 'admitted') AS disagreements FROM audited GROUP BY 1, 2, 3""")
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows, subjects and scores by cohort, lane and state."""
    mismatch = (F.col("source_score_audit_status") == "mismatch") & (F.col("admission_status") == "admitted")
    return cohort_rows(spark, d).groupBy("cohort_id", "lane_assignment", "admission_status").agg(
        F.count("*").alias("rows"), F.countDistinct("subject_id").alias("subjects"), F.count("score").alias("scored"), F.count_if(mismatch).alias("disagreements")
    )


@query(f"""WITH {_STAGES}, o AS (SELECT manifest_row_id AS id, CASE WHEN source_date = '' THEN 'failed' ELSE 'ok' END AS seg, len(source_image_name) - 10 AS rois, CASE WHEN mask_exists THEN 'ok' ELSE 'open' END AS grade FROM enriched WHERE image_exists),
f AS (SELECT e.*, CASE WHEN id IS NULL THEN ['missing_segmentation_output'] ELSE list_filter([CASE WHEN seg <> 'ok' THEN 'segmentation_not_ok' END, CASE WHEN rois <= 0 THEN 'degenerate_segmentation_output' END, CASE WHEN grade <> 'ok' THEN 'grading_not_ok' END], lambda x: x IS NOT NULL) END AS r FROM enriched e LEFT JOIN o ON id = manifest_row_id)
SELECT doc_id, CASE WHEN len(r) > 0 THEN 'blocked' ELSE 'passed' END AS transport_status, array_to_string(r, ';') AS transport_failure_reason, CASE WHEN len(r) > 0 THEN 'excluded' ELSE admission_status END AS admission_status,
CASE WHEN len(r) > 0 THEN array_to_string(r, ';') ELSE exclusion_reason END AS exclusion_reason FROM f""")
def transport_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows against segmentation outputs, which are written twice: the first counts."""
    rows = man.enriched(base(spark, d), "doc_id", COHORTS)
    outputs = rows.filter("image_exists").select(
        "manifest_row_id", F.when(F.col("source_date") == "", "failed").otherwise("ok").alias("segmentation_status"), (F.length("source_image_name") - 10).alias("accepted_roi_count"),
        F.when(F.col("mask_exists"), "ok").otherwise("open").alias("grading_status"), F.lit(1).alias("written"),
    )
    again = outputs.withColumns({"written": F.lit(2), "segmentation_status": F.lit("failed")})
    return man.transport(rows, outputs.unionByName(again), "written").select("doc_id", "transport_status", "transport_failure_reason", "admission_status", "exclusion_reason")


@query("""WITH f AS (SELECT *, concat_ws(';', CASE WHEN l_linenumber = 7 THEN 'image_missing' END, CASE WHEN l_discount = 0.1 THEN 'mask_missing' END) AS lost FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN lost <> '' THEN lost ELSE concat_ws(';', CASE WHEN l_returnflag = 'R' THEN 'image_mask_size_mismatch' END, CASE WHEN l_tax * 4 < 0.001 THEN 'foreground_fraction_too_low' END,
CASE WHEN l_tax * 4 > 0.25 THEN 'foreground_fraction_too_high' END, CASE WHEN l_quantity < 3 THEN 'no_mask_components' END) END AS reasons FROM f""")
def mask_quality_audit(spark: SparkSession, d: str) -> DataFrame:
    """Reasons against a line's mask, its facts being columns of the line."""
    reasons = man.mask_quality(F.col("l_linenumber") != 7, F.col("l_discount") != 0.1, F.col("l_returnflag") != "R", F.col("l_tax") * 4, F.floor(F.col("l_quantity") / 3))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reasons.alias("reasons"))


@query(f"""WITH {_BASE}, a AS (SELECT DISTINCT source_sample_id AS sid, '2025-01-01' AS nd, CASE WHEN contains(source_sample_id, '_Image1') THEN 'vehicle' ELSE 'treated' END AS grp FROM base WHERE source_sample_id <> '' AND NOT contains(source_sample_id, '_Image3'))
SELECT doc_id, coalesce(nd, source_date) AS source_date, CASE WHEN sid IS NULL THEN '' ELSE grp END AS treatment_group,
CASE WHEN sid IS NULL THEN discovery_surfaces ELSE regexp_replace(discovery_surfaces || ';assignment', '^;+|;+$', '', 'g') END AS discovery_surfaces FROM base LEFT JOIN a ON sid = source_sample_id""")
def assignment_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The assignment's values win over the manifest's."""
    rows = base(spark, d).withColumn("treatment_group", F.lit(""))
    known = rows.filter("source_sample_id <> ''").filter(~F.col("source_sample_id").contains("_Image3")).select("source_sample_id").distinct()
    assignment = known.select("source_sample_id", F.lit("2025-01-01").alias("source_date"), F.when(F.col("source_sample_id").contains("_Image1"), "vehicle").otherwise("treated").alias("source_assignment_group"))
    return man.with_assignment(rows, assignment, ["source_date", "source_assignment_group"], "assignment").select("doc_id", "source_date", "treatment_group", "discovery_surfaces")


@query(f"""WITH {_BASE}, told AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN source_image_name || '-' || doc_id ELSE source_image_name END AS source_image_name) FROM base), u AS (SELECT lower(nm) AS nm, count(*) AS m FROM (SELECT DISTINCT source_image_name AS nm FROM told WHERE mask_exists UNION ALL SELECT DISTINCT source_image_name FROM told WHERE NOT image_exists AND contains(source_image_name, 'Image2')) GROUP BY 1),
s AS (SELECT doc_id, source_image_name || doc_id AS x, source_image_name, score FROM told), r AS (SELECT source_image_name AS o, count(*) AS k, count(DISTINCT coalesce(score::VARCHAR, '')) > 1 AS two FROM told GROUP BY 1),
j AS (SELECT doc_id, score, k, two, coalesce(m, 0) AS m FROM s JOIN r ON o = source_image_name LEFT JOIN u ON nm = lower(source_image_name))
SELECT doc_id, CASE WHEN m = 1 THEN 'resolved_exactly_once' WHEN m > 1 THEN 'resolved_multiple_uploads' ELSE 'unresolved_no_upload_match' END AS resolution_status,
concat_ws(';', CASE WHEN m > 1 THEN 'resolved_multiple_uploads' WHEN m = 0 THEN 'unresolved_no_upload_match' END, CASE WHEN k > 1 THEN 'duplicate_source_image_name' END, CASE WHEN two THEN 'conflicting_scores_for_source_image_name' END, CASE WHEN score IS NULL THEN 'missing_score' END) AS reasons,
m = 1 AND k = 1 AND NOT two AND score IS NOT NULL AS clean FROM j""")
def upload_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows that one upload alone fits."""
    name = F.col("source_image_name")
    rows = base(spark, d).withColumn("source_image_name", F.when(F.col("doc_id") % 5 == 0, F.concat(name, F.lit("-"), F.col("doc_id"))).otherwise(name))
    uploads = rows.filter("mask_exists").select(F.col("source_image_name").alias("name")).distinct()
    more = rows.filter("not image_exists").filter(F.col("source_image_name").contains("Image2")).select(F.col("source_image_name").alias("name")).distinct()
    return man.upload_resolution(rows, uploads.unionByName(more)).select("doc_id", "resolution_status", "reasons", "clean")


_FILES = """files AS (SELECT e.event_id, CASE WHEN event_type IN ('click', 'view') THEN 'images' ELSE 'masks' END AS kind, CASE WHEN event_type = 'error' THEN 'elsewhere' ELSE 'S' || user_id END AS folder,
  CASE WHEN event_type = 'view' THEN 'scan' || user_id WHEN event_type = 'signup' THEN '-' || event_id WHEN event_type = 'purchase' THEN 'S' || user_id || '_Image0' || (event_id % 10) ELSE 'S' || user_id || '-' || (event_id % 7 + 1) END
  || CASE WHEN event_type IN ('click', 'view') THEN '' ELSE '_mask' END || '.png' AS filename FROM events e)"""


@query(f"""WITH {_FILES}, k AS (SELECT DISTINCT 'S' || user_id || '-' || (event_id % 7 + 1) AS id FROM events WHERE value < 60),
mp AS (SELECT 'S' || user_id || '_Image' || g AS legacy, 'S' || user_id || '-' || (g + 1) AS mapped FROM (SELECT DISTINCT user_id, event_id % 10 AS g FROM events WHERE value > 20 AND event_type = 'purchase')),
p AS (SELECT kind, folder, filename, regexp_replace(regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '_mask$', ''), '_Image0([0-9])', '_Image\\1') AS st FROM files),
c AS (SELECT p.*, regexp_matches(st, '^[A-Za-z0-9]+-[1-9][0-9]*$') AS can, regexp_matches(st, '^[A-Za-z0-9]+_Image[0-9]+$') AS nam, mapped FROM p LEFT JOIN mp ON legacy = st),
i AS (SELECT *, CASE WHEN can THEN st WHEN nam THEN coalesce(mapped, '') ELSE '' END AS sid FROM c),
t AS (SELECT i.*, k.id IS NOT NULL AS known FROM i LEFT JOIN k ON k.id = sid),
g AS (SELECT *, CASE WHEN sid <> '' AND (can OR known) THEN kind || '/' || string_split(sid, '-')[1] || '/' || sid || CASE WHEN kind = 'masks' THEN '_mask' ELSE '' END || '.png' ELSE '' END AS target FROM t),
s AS (SELECT *, CASE WHEN NOT can AND NOT nam THEN 'invalid_name' WHEN can AND NOT known THEN 'canonical_missing_from_metadata' WHEN can AND target = kind || '/' || folder || '/' || filename THEN 'already_canonical' WHEN can THEN 'canonical_relocation_required'
  WHEN sid = '' THEN 'unmapped_legacy' WHEN NOT known THEN 'mapped_id_missing_from_metadata' ELSE 'rename_required' END AS st0,
  CASE WHEN NOT can AND NOT nam THEN 'filename_not_parseable' WHEN can AND NOT known THEN 'subject_image_id_not_in_metadata' WHEN can AND target = kind || '/' || folder || '/' || filename THEN 'ok' WHEN can THEN 'canonical_name_in_wrong_subject_dir'
  WHEN sid = '' THEN 'legacy_name_has_no_mapping' WHEN NOT known THEN 'mapping_target_not_in_metadata' ELSE 'mapped_from_legacy' END AS re0 FROM g),
x AS (SELECT target AS xt FROM s WHERE st0 IN ('rename_required', 'canonical_relocation_required') GROUP BY 1 HAVING count(*) > 1)
SELECT kind, folder, filename, sid AS subject_image_id, target, CASE WHEN xt IS NULL THEN st0 ELSE 'target_collision' END AS status, CASE WHEN xt IS NULL THEN re0 ELSE 'multiple_sources_map_to_same_target' END AS reason FROM s LEFT JOIN x ON xt = target""")
def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    """Events as files: where each belongs by its name, the mapping and the metadata."""
    events = table(spark, d, "events")
    user, event, kind = F.col("user_id").cast("string"), F.col("event_id"), F.col("event_type")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    rest = lambda n: (event % n).cast("string")
    canonical = text("S", user, "-", (event % 7 + 1).cast("string"))
    image = kind.isin("click", "view")
    name = F.when(kind == "view", text("scan", user)).when(kind == "signup", text("-", event.cast("string"))).when(kind == "purchase", text("S", user, "_Image0", rest(10))).otherwise(canonical)
    files = events.select(
        F.when(image, "images").otherwise("masks").alias("kind"), F.when(kind == "error", "elsewhere").otherwise(text("S", user)).alias("folder"),
        F.concat(name, F.when(image, "").otherwise("_mask"), F.lit(".png")).alias("filename"),
    )
    known = events.filter("value < 60").select(canonical.alias("subject_image_id"))
    g = F.col("g").cast("string")
    pairs = events.filter("value > 20 and event_type = 'purchase'").select("user_id", (event % 10).alias("g")).distinct()
    mapping = pairs.select(text("S", user, "_Image", g).alias("legacy_stem"), text("S", user, "-", (F.col("g") + 1).cast("string")).alias("mapped"))
    return man.migration_plan(files, mapping, known)


@query("""SELECT l_orderkey, quantile_cont(v, 0.5) AS score, count(*) AS replicate_count FROM (SELECT l_orderkey, unnest([l_quantity, nullif(l_discount, 0) * 100, l_tax * 100]) AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY 1""")
def replicate_medians(spark: SparkSession, d: str) -> DataFrame:
    """Three replicates a line, zero discounts missing: median and number by order."""
    wide = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("a"), (F.nullif("l_discount", F.lit(0.0)) * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return man.replicate_medians(wide.unpivot("l_orderkey", ["a", "b", "c"], "replicate", "value"), "l_orderkey", "value")


@query("""WITH r AS (SELECT l_orderkey, median(l_tax) FILTER (l_quantity >= 20 AND l_tax > 0) AS m, count(*) FILTER (l_quantity >= 20 AND l_tax > 0) AS a, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT o_orderkey AS manifest_row_id, o_totalprice AS human_image_median, m AS inferred_image_median, coalesce(a, 0) AS accepted_roi_count, coalesce(n, 0) - coalesce(a, 0) AS rejected_roi_count,
CASE WHEN coalesce(a, 0) > 0 THEN 'ok' ELSE 'non_evaluable' END AS concordance_status FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def image_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Orders as images, their lines as regions: a region needs an area and a grade."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("manifest_row_id"), F.col("o_totalprice").alias("score"))
    rois = table(spark, d, "lineitem").filter("l_returnflag <> 'A'").select(
        F.col("l_orderkey").alias("manifest_row_id"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("roi_grade"), F.col("l_quantity").alias("component_area")
    )
    return man.concordance(rows, rois, 20)
