"""Queries over gates, runs, reviews, anchors, baselines and case queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audits
from tessera.operators import reviews as rev
from tessera.operators import strata
from tessera.plans.groups import rounded
from tessera.plans.rows import _SCORE, scored
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_EVIDENCE = {
    "pairing_error": ("max(l_tax) = 0.08 AND count(*) < 3", None), "resize_policy_artifact": ("min(l_quantity) > 30", None), "training_signal_insufficient": ("count(*) = 1", None),
    "negative_background_supervision_missing": ("min(l_discount) > 0.04", None), "true_model_underfit": ("max(l_quantity) < 10", None),
}
_FLAGS = {k: sql for k, (sql, _) in _EVIDENCE.items()}


@query(f"""WITH e AS (SELECT l_orderkey, {', '.join(f'({sql}) AS {k}' for k, sql in _FLAGS.items())}, avg(l_quantity) < 25 AS poor FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey, poor, list_filter([{', '.join(f"CASE WHEN {k} THEN '{rev.CAUSES[k]}' END" for k in _FLAGS)}], lambda x: x IS NOT NULL) AS c FROM e),
d AS (SELECT l_orderkey, CASE WHEN len(c) = 0 AND poor THEN ['true_model_underfit'] ELSE c END AS c FROM c)
SELECT l_orderkey, array_to_string(c, '|') AS causes, CASE WHEN list_has_any(c, ['image_mask_pairing_error', 'resize_policy_artifact']) THEN 'fix_code_or_evaluation_then_regenerate_evidence'
WHEN list_contains(c, 'negative_background_supervision_missing') THEN 'apply_p2_negative_glomeruli_crop_supervision_then_reevaluate' WHEN list_contains(c, 'training_signal_insufficient') THEN 'audit_training_data_and_sampler_then_train_new_candidates'
WHEN list_contains(c, 'true_model_underfit') THEN 'train_new_candidate_after_audit_gates_pass' ELSE 'no_remediation_required' END AS remediation, CASE WHEN len(c) > 0 THEN 'not_promotion_eligible' ELSE 'promotion_eligible' END AS status FROM d""")
def root_causes(spark: SparkSession, d: str) -> DataFrame:
    """Causes of an order's poor lines from flags over them, and the remedy."""
    facts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*(F.expr(sql).alias(k) for k, sql in _FLAGS.items()), (F.avg("l_quantity") < 25).alias("poor"))
    causes = facts.select("l_orderkey", rev.root_causes({k: F.col(k) for k in _FLAGS}, F.col("poor")).alias("c"))
    return causes.select("l_orderkey", F.array_join("c", "|").alias("causes"), rev.remediation(F.col("c")).alias("remediation"), F.when(F.size("c") > 0, rev.NOT_ELIGIBLE).otherwise(rev.ELIGIBLE).alias("status"))


@query("""WITH m AS (SELECT l_orderkey, l_returnflag AS run, avg(l_quantity) / 50 AS dice, avg(l_tax) * 10 AS recall, avg(l_discount) * 5 AS err, avg(l_discount) AS bg, bool_and(l_quantity < 49) AS ok FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
o AS (SELECT DISTINCT l_orderkey FROM lineitem),
j AS (SELECT o.l_orderkey, r.run IS NOT NULL AS has_r, coalesce(p.run, f.run) IS NOT NULL AS has_c, coalesce(p.run, f.run) AS crun, r.dice AS rd, r.recall AS rr, r.err AS re,
  CASE WHEN p.run IS NOT NULL THEN p.dice ELSE f.dice END AS cd, CASE WHEN p.run IS NOT NULL THEN p.recall ELSE f.recall END AS cr, CASE WHEN p.run IS NOT NULL THEN p.err ELSE f.err END AS ce, CASE WHEN p.run IS NOT NULL THEN p.bg ELSE f.bg END AS cb, CASE WHEN p.run IS NOT NULL THEN p.ok ELSE f.ok END AS cok
  FROM o LEFT JOIN m r ON r.l_orderkey = o.l_orderkey AND r.run = 'N' LEFT JOIN m p ON p.l_orderkey = o.l_orderkey AND p.run = 'R' LEFT JOIN m f ON f.l_orderkey = o.l_orderkey AND f.run = 'A'),
s AS (SELECT *, cb <= 0.05 AND cok AND (cd > rd + 0.02 OR cr > rr + 0.02 OR ce < re - 0.02) AS win FROM j)
SELECT l_orderkey, CASE WHEN NOT has_r THEN 'unresolved' WHEN NOT has_c THEN 'infeasible' WHEN win THEN 'selected_less_downsampled' ELSE 'current_cleared' END AS status,
CASE WHEN NOT has_r THEN 'reference_resize_screen_missing_or_failed' WHEN NOT has_c THEN 'no_less_downsampled_or_no_downsample_screen_completed' WHEN win THEN 'less_downsampled_policy_materially_improved_positive_or_boundary_metrics'
WHEN NOT cok THEN 'less_downsampled_policy_failed_category_gates' ELSE 'less_downsampled_policy_not_materially_better_than_current_policy' END AS reason, CASE WHEN NOT has_r OR NOT has_c THEN '' WHEN win THEN crun ELSE 'N' END AS selected FROM s""")
def run_decision(spark: SparkSession, d: str) -> DataFrame:
    """Return flags as runs over an order's finished lines: the primary one, or the fallback, against the reference. Lines are added up in stored order, as DuckDB with one thread does."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("run"), "l_linestatus", F.col("l_quantity").alias("dice"), F.col("l_tax").alias("recall"), F.col("l_discount").alias("ratio_error"),
        F.col("l_discount").alias("background"), (F.col("l_quantity") < 49).alias("gate_ok"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"),
    )
    return rev.run_decision(rows, "l_orderkey", "run", F.col("l_linestatus") == "F", "N", "R", "A", 0.05, scaled={"dice": lambda m: m / 50, "recall": lambda m: m * 10, "ratio_error": lambda m: m * 5}, order=("file", "place"))


_GATES = """g AS (SELECT l_orderkey % 3000 AS family, l_returnflag AS category, l_linenumber AS idx, l_discount <= 0.09 AS passed, CASE WHEN l_tax > 0.06 THEN ' high_tax' WHEN l_tax > 0.03 THEN 'tax' ELSE '' END AS reason, 'gate' || l_linenumber AS gate FROM lineitem)"""


def gate_rows(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("l_tax") > 0.06, " high_tax").when(F.col("l_tax") > 0.03, "tax").otherwise("")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 3000).alias("family"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("idx"), (F.col("l_discount") <= 0.09).alias("passed"), reason.alias("reason"), F.concat(F.lit("gate"), F.col("l_linenumber").cast("string")).alias("gate"),
    )


@query(f"""WITH {_GATES} SELECT family, CASE WHEN count(*) FILTER (NOT passed AND trim(reason) <> '') > 0 THEN 'not_promotion_eligible' ELSE 'promotion_eligible' END AS status,
coalesce(array_to_string(list_sort(list(DISTINCT trim(reason)) FILTER (NOT passed AND trim(reason) <> '')), '|'), '') AS reasons, array_to_string(list_sort(list(DISTINCT category)), '|') AS categories, count(*) FILTER (NOT passed) AS failed, count(*) AS gates FROM g GROUP BY 1""")
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    return rev.gate_status(gate_rows(spark, d))


@query(f"""WITH {_GATES}, s AS (SELECT DISTINCT family, category, idx FROM g), f AS (SELECT family, category, idx, list_sort(list(DISTINCT coalesce(nullif(trim(reason), ''), gate))) AS r FROM g WHERE NOT passed GROUP BY 1, 2, 3)
SELECT s.family, s.category, s.idx, r IS NOT NULL AS shape_gate_failed, CASE WHEN r IS NULL THEN '' ELSE array_to_string(list_append(r, 'category_metric_failure'), '|') END AS shape_gate_reasons FROM s LEFT JOIN f USING (family, category, idx)""")
def shape_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Shapes with the reasons of the failed gates of their family, category and index."""
    gates = gate_rows(spark, d)
    return rev.shape_reasons(gates.select("family", "category", "idx").distinct(), gates, ["family", "category", "idx"])


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'audit_missing' WHEN o_orderstatus = 'F' THEN 'promotion_eligible' WHEN o_orderstatus = 'P' THEN 'insufficient_evidence_for_promotion' ELSE 'not_promotion_eligible' END AS status FROM orders""")
def promotion_status(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("o_orderstatus") == "F", "promoted").when(F.col("o_orderstatus") == "P", "insufficient_evidence").otherwise("rejected")
    return table(spark, d, "orders").select("o_orderkey", rev.promotion_status(decision, F.col("o_orderpriority").startswith("1")).alias("status"))


_PIXELS = """x AS (SELECT l_suppkey, l_orderkey, CASE l_returnflag WHEN 'R' THEN 'background' WHEN 'A' THEN 'boundary' ELSE 'positive' END AS category, 1000 AS pixels, floor(l_quantity * 10)::BIGINT AS truth, floor(l_discount * 6000)::BIGINT AS predicted FROM lineitem),
y AS (SELECT *, least(truth, predicted) * 3 // 4 AS tp FROM x)"""


@query(f"""WITH {_PIXELS}, p AS (SELECT l_orderkey, max(predicted / pixels) AS hi, min(predicted / pixels) AS lo, sum(tp)::DOUBLE AS tp, sum(truth)::DOUBLE AS t, sum(predicted)::DOUBLE AS q, sum(pixels)::DOUBLE AS n, count(*) FILTER (category <> 'background' AND truth > 0) AS k,
  count(*) FILTER (category <> 'background' AND truth > 0 AND tp / truth < 0.5) AS lr, count(*) FILTER (category <> 'background' AND truth > 0 AND CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END < 0.3) AS lp FROM y GROUP BY 1),
s AS (SELECT *, CASE WHEN t + q > 0 THEN 2 * tp / (t + q) ELSE 1 END AS d, CASE WHEN t + q - tp > 0 THEN tp / (t + q - tp) ELSE 1 END AS j, CASE WHEN t > 0 THEN 0 ELSE 1 END AS e, 2 * t / (t + n) AS fd, t / n AS fj FROM p)
SELECT l_orderkey AS family, concat_ws('|', CASE WHEN hi <= 0.02 THEN 'predictions_are_all_background' END, CASE WHEN lo >= 0.98 THEN 'predictions_are_all_foreground' END, CASE WHEN d <= e THEN 'candidate_does_not_clear_all_background_dice_baseline' END,
CASE WHEN j <= e THEN 'candidate_does_not_clear_all_background_jaccard_baseline' END, CASE WHEN d <= fd THEN 'candidate_does_not_clear_all_foreground_dice_baseline' END, CASE WHEN j <= fj THEN 'candidate_does_not_clear_all_foreground_jaccard_baseline' END,
CASE WHEN lr > 0.5 * k THEN 'prediction_does_not_reasonably_cover_positive_glomerulus_examples' END, CASE WHEN lp > 0.5 * k THEN 'prediction_oversegments_background_on_positive_glomerulus_examples' END) AS reasons FROM s""")
def prediction_review(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as masks: degenerate predictions, trivial baselines, low recall and precision."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("family"), F.when(F.col("l_returnflag") == "R", "background").when(F.col("l_returnflag") == "A", "boundary").otherwise("positive").alias("category"),
        F.lit(1000).alias("pixels"), F.floor(F.col("l_quantity") * 10).alias("truth"), F.floor(F.col("l_discount") * 6000).alias("predicted"),
    )
    return rev.prediction_review(rows.withColumn("tp", F.floor(F.least("truth", "predicted") * 3 / 4)), "family")


@query(f"""SELECT doc_id, CASE WHEN score <= 0.5 THEN 'no_low' WHEN score >= 1.5 THEN 'moderate_severe' WHEN score = 1 THEN 'borderline_review' ELSE 'unscored' END AS "primary", CASE WHEN score <= 0.5 THEN 0::DOUBLE WHEN score >= 1.5 THEN 1 END AS primary_value,
CASE WHEN score <= 1 THEN 'no_low_inclusive' WHEN score >= 1.5 THEN 'moderate_severe' ELSE 'unscored' END AS sensitivity, CASE WHEN score <= 1 THEN 0::DOUBLE WHEN score >= 1.5 THEN 1 END AS sensitivity_value FROM {_SCORE}""")
def binary_targets(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("doc_id", *(c.alias(name) for name, c in rev.binary_targets(F.col("score")).items()))


@query("""WITH m AS (SELECT p_brand AS candidate_id, round(avg(p_retailprice) / 2000, 2) AS balanced_accuracy, CASE WHEN min(p_size) > 1 THEN NULL ELSE round(avg(p_size) / 50, 1) END AS average_precision, count(*) AS support FROM part GROUP BY 1)
SELECT * FROM m ORDER BY coalesce(balanced_accuracy, -1) DESC, coalesce(average_precision, -1) DESC, (candidate_id = 'Brand#13') DESC, candidate_id DESC LIMIT 1""")
def binary_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The best of all brands as candidates."""
    metrics = table(spark, d, "part").groupBy(F.col("p_brand").alias("candidate_id")).agg(
        F.round(F.avg("p_retailprice") / 2000, 2).alias("balanced_accuracy"), F.when(F.min("p_size") <= 1, F.round(F.avg("p_size") / 50, 1)).alias("average_precision"), F.count("*").alias("support")
    )
    return rev.binary_candidate(metrics, "Brand#13")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'blocked_cluster_manual_review' WHEN l_tax = 0.04 THEN 'borderline_score_review' WHEN l_quantity > 40 THEN 'likely_moderate_severe_review' WHEN l_quantity < 10 THEN 'likely_no_low_review' WHEN l_discount > 0.05 THEN 'uncertain_binary_review' ELSE '' END AS route FROM lineitem)
SELECT l_orderkey, l_linenumber, route, CASE route """ + " ".join(f"WHEN '{k}' THEN '{text}'" for k, text in rev.ROUTES.items()) + """ ELSE 'Model decision is not available.' END AS note FROM r""")
def review_notes(spark: SparkSession, d: str) -> DataFrame:
    """What reviewers are told about each line's route."""
    from tessera.operators.states import route

    c = F.col
    way = route([(c("l_returnflag") == "R", "blocked_cluster_manual_review"), (c("l_tax") == 0.04, "borderline_score_review"), (c("l_quantity") > 40, "likely_moderate_severe_review"), (c("l_quantity") < 10, "likely_no_low_review"), (c("l_discount") > 0.05, "uncertain_binary_review")], "")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", way.alias("route")).withColumn("note", rev.review_text(c("route")))


_CLASSES = [("moderate_severe", ("collaps", "severe")), ("no_low", ("open", "normal"))]
_REVIEW = """r AS (SELECT l_orderkey % 3000 AS cluster_id, l_orderkey AS row_id, CASE WHEN l_discount <= 0.06 THEN 'accept' WHEN l_discount <= 0.08 THEN 'flag_score_review' WHEN l_discount > 0.09 AND l_tax = 0 AND l_linenumber = 1 THEN 'exclude_from_anchor' ELSE '' END AS review_action,
  CASE WHEN l_quantity > 25 THEN 'representative' ELSE 'edge' END AS case_cluster_fit, CASE WHEN l_returnflag <> 'R' THEN 'real_morphology_cluster' ELSE 'artifact' END AS cluster_interpretation,
  CASE WHEN l_tax > 0.05 THEN 'Open lumen' WHEN l_tax > 0.03 THEN ' ' ELSE 'collapsed' END AS cluster_notes, CASE l_linestatus WHEN 'F' THEN 'mixed' ELSE '' END AS morphology_assessment FROM lineitem)"""


def cluster_review(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    action = F.when(c("l_discount") <= 0.06, "accept").when(c("l_discount") <= 0.08, "flag_score_review").when((c("l_discount") > 0.09) & (c("l_tax") == 0) & (c("l_linenumber") == 1), "exclude_from_anchor").otherwise("")
    return table(spark, d, "lineitem").select(
        (c("l_orderkey") % 3000).alias("cluster_id"), c("l_orderkey").alias("row_id"), action.alias("review_action"), F.when(c("l_quantity") > 25, "representative").otherwise("edge").alias("case_cluster_fit"),
        F.when(c("l_returnflag") != "R", "real_morphology_cluster").otherwise("artifact").alias("cluster_interpretation"), F.when(c("l_tax") > 0.05, "Open lumen").when(c("l_tax") > 0.03, " ").otherwise("collapsed").alias("cluster_notes"),
        F.when(c("l_linestatus") == "F", "mixed").otherwise("").alias("morphology_assessment"),
    )


def _mode_sql(c: str) -> str:
    return f"coalesce((SELECT v FROM (SELECT cluster_id AS k, trim({c}) AS v, count(*) AS n FROM r WHERE trim({c}) <> '' GROUP BY 1, 2) WHERE k = g.cluster_id ORDER BY n DESC, v LIMIT 1), '')"


_ANCHORS = f"""g AS (SELECT cluster_id, count(*) AS rows_reviewed, count(*) FILTER (review_action = 'accept') AS accepted_count, count(*) FILTER (case_cluster_fit = 'representative') AS representative_count,
  count(*) FILTER (review_action = 'flag_score_review') AS score_review_count, count(*) FILTER (review_action = 'exclude_from_anchor') AS exclude_from_anchor_count FROM r GROUP BY 1),
m AS (SELECT g.*, {_mode_sql('cluster_interpretation')} AS interpretation, {_mode_sql('cluster_notes')} AS notes, {_mode_sql('morphology_assessment')} AS morphology FROM g),
a AS (SELECT *, CASE WHEN lower(notes || ' ' || morphology) LIKE '%collaps%' OR lower(notes || ' ' || morphology) LIKE '%severe%' THEN 'moderate_severe' WHEN lower(notes || ' ' || morphology) LIKE '%open%' OR lower(notes || ' ' || morphology) LIKE '%normal%' THEN 'no_low' ELSE '' END AS anchor_class FROM m),
anchors AS (SELECT *, CASE WHEN interpretation <> 'real_morphology_cluster' OR exclude_from_anchor_count > 0 THEN 'blocked_cluster_anchor' WHEN anchor_class <> '' THEN 'candidate_anchor_cluster' ELSE 'needs_more_review' END AS verdict FROM a)"""


@query(f"WITH {_REVIEW},\n{_ANCHORS}\nSELECT cluster_id, verdict, anchor_class, notes, rows_reviewed, accepted_count, representative_count, score_review_count, exclude_from_anchor_count FROM anchors")
def cluster_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as reviewed clusters: which of them are anchors."""
    return rev.cluster_anchors(cluster_review(spark, d), ["cluster_id"], "row_id", _CLASSES).select(
        "cluster_id", "verdict", "anchor_class", "notes", "rows_reviewed", "accepted_count", "representative_count", "score_review_count", "exclude_from_anchor_count"
    )


@query(f"WITH {_REVIEW},\n{_ANCHORS}\nSELECT verdict, count(*) AS clusters, sum(rows_reviewed)::BIGINT AS \"rows\", sum(score_review_count)::BIGINT AS score_reviews FROM anchors GROUP BY 1")
def adjudication_outcome(spark: SparkSession, d: str) -> DataFrame:
    """How many clusters a review turned into anchors, blocked, or left open."""
    anchors = rev.cluster_anchors(cluster_review(spark, d), ["cluster_id"], "row_id", _CLASSES)
    return anchors.groupBy("verdict").agg(F.count("*").alias("clusters"), F.sum("rows_reviewed").alias("rows"), F.sum("score_review_count").alias("score_reviews"))


@query("""WITH k AS (SELECT *, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity > 30 THEN 1 END AS t, l_discount >= 0.1 AS b FROM lineitem), m AS (SELECT l_suppkey, (avg(t) >= 0.5)::INTEGER::DOUBLE AS p FROM k GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_suppkey, t AS target, CASE WHEN NOT b THEN p END AS probability FROM k JOIN m USING (l_suppkey) WHERE t IS NOT NULL""")
def cluster_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as clusters: their majority as each line's probability."""
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(q < 10, 0).when(q > 30, 1).alias("target"), (F.col("l_discount") >= 0.1).alias("blocked"))
    return rev.cluster_mapping(rows, "l_suppkey", "target", "blocked").drop("blocked")


@query("""WITH w AS (SELECT user_id AS id, event_type AS decision, CASE WHEN value > 100 THEN event_type ELSE '' END AS seen FROM events WHERE event_id < 100000000), f AS (SELECT c_custkey AS id, CASE c_nationkey % 2 WHEN 0 THEN 'click' ELSE 'view' END AS seen FROM customer WHERE c_acctbal > 0)
SELECT DISTINCT id, 'unmatched_id' AS error FROM w WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT id, 'conflicting_duplicate_decisions:decision' FROM w GROUP BY 1 HAVING count(DISTINCT decision) > 1
UNION ALL SELECT DISTINCT w.id, 'differs_from_reference:seen' FROM w JOIN f USING (id) WHERE w.seen <> '' AND w.seen <> f.seen""".replace(" WHERE event_id < 100000000", ""))
def adjudication_errors(spark: SparkSession, d: str) -> DataFrame:
    """Events as review rows of customers: unknown ids, conflicts, values that have moved."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("decision"), F.when(F.col("value") > 100, F.col("event_type")).otherwise("").alias("seen"))
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "click").otherwise("view").alias("seen"))
    return rev.adjudication_errors(rows, known, "id", ["decision"], ["seen"])


@query("""WITH t AS (SELECT unnest(['flag', 'priority', 'size']) AS target, unnest([l_returnflag, CASE WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0.02 THEN 'low' END, CASE WHEN l_quantity < 17 THEN 's' WHEN l_quantity < 34 THEN 'm' ELSE 'l' END]) AS value FROM lineitem),
c AS (SELECT target, value, count(*) AS n FROM t WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT target, sum(n)::BIGINT AS "rows", arg_min(value, struct_pack(a := -n, b := value)) AS majority, round(max(n) / sum(n), 6) AS accuracy, round(1 / count(*), 6) AS balanced_accuracy FROM c GROUP BY 1""")
def majority_baselines(spark: SparkSession, d: str) -> DataFrame:
    """What guessing the most frequent class of three targets reaches."""
    q, x = F.col("l_quantity"), F.col("l_discount")
    targets = {"flag": F.col("l_returnflag"), "priority": F.when(x > 0.05, "high").when(x > 0.02, "low"), "size": F.when(q < 17, "s").when(q < 34, "m").otherwise("l")}
    return rounded(rev.majority_baselines(table(spark, d, "lineitem"), targets), "accuracy", "balanced_accuracy")


_COLS = ("l_quantity", "l_tax", "constant", "holes")


@query("""WITH x AS (SELECT l_quantity, l_tax, 1::DOUBLE AS constant, CASE WHEN l_discount = 0 THEN NULL WHEN l_discount = 0.1 THEN 'Infinity'::DOUBLE ELSE l_discount END AS holes FROM lineitem),
u AS (SELECT unnest(['l_quantity', 'l_tax', 'constant', 'holes']) AS "column", unnest([l_quantity, l_tax, constant, holes]) AS v FROM x)
SELECT "column", count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (isinf(v)) AS non_finite, round(var_pop(CASE WHEN NOT isinf(v) THEN v END), 6) AS variance, count(*) FILTER (v IS NULL OR isinf(v)) = 0 AND round(var_pop(CASE WHEN NOT isinf(v) THEN v END), 9) > 0 AS kept FROM u GROUP BY 1""")
def usable_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which columns are complete, finite and vary."""
    x = F.col("l_discount")
    rows = table(spark, d, "lineitem").select("l_quantity", "l_tax", F.lit(1.0).alias("constant"), F.when(x == 0.1, F.lit(float("inf"))).when(x != 0, x).alias("holes"))
    return rounded(rev.usable_columns(rows, _COLS, 1e-9), "variance")


@query("""WITH a AS (SELECT doc_id, 0 AS b, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), c AS (SELECT doc_id, 1 AS b, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents), e AS (SELECT doc_id, 2 AS b, row_number() OVER (ORDER BY abs(n_chars - 30000) , doc_id) AS r FROM documents),
u AS (SELECT * FROM a WHERE r <= 6 UNION ALL SELECT * FROM c WHERE r <= 6 UNION ALL SELECT * FROM e WHERE r <= 6), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS n FROM u)
SELECT doc_id, CASE b WHEN 0 THEN 'longest' WHEN 1 THEN 'shortest' ELSE 'middle' END AS bucket FROM f WHERE n = 1 ORDER BY b, r LIMIT 15""")
def picked_cases(spark: SparkSession, d: str) -> DataFrame:
    """A few cases a category, each once."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars")
    return rev.first_unseen(docs, "doc_id", [("longest", [F.desc("n_chars")]), ("shortest", [n]), ("middle", [F.abs(n - 30000)])], 6, 15).select("doc_id", "bucket")


@query(f"""WITH s AS (SELECT doc_id, score, d.source FROM {_SCORE} x JOIN documents d USING (doc_id)), c AS (SELECT unnest([0::DOUBLE, 0.5, 1, 1.5, 2, 3]) AS v)
SELECT 'class' AS what, v::VARCHAR AS key, count(*) AS n FROM s JOIN c ON score = v GROUP BY 2 UNION ALL SELECT 'above', v::VARCHAR, count(*) FROM s JOIN c ON score > v AND v < 3 GROUP BY 2 UNION ALL SELECT 'examples', 'all', count(*) FROM s UNION ALL SELECT 'groups', 'all', count(DISTINCT source) FROM s""")
def cohort_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by class and threshold, and their groups."""
    rows = scored(spark, d).select("doc_id", "score").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rev.cohort_profile(rows, F.col("source"), F.col("score"))


@query(f"""SELECT CASE WHEN score IS NULL THEN 'missing' WHEN score >= 3 THEN 'severe' ELSE 'nonsevere' END AS status, count(*) AS "rows" FROM {_SCORE} GROUP BY 1""")
def severe_distribution(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("score").isNull(), "missing").when(F.col("score") >= 3, "severe").otherwise("nonsevere")
    return scored(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


@query("""WITH p AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.05) AS low FROM lineitem GROUP BY 1) SELECT l_suppkey, round(avg((l_discount < 0.02 OR l_quantity < low)::INTEGER), 6) AS artifacts, count(*) AS "rows" FROM lineitem JOIN p USING (l_suppkey) GROUP BY 1""")
def artifact_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of a supplier's lines with little fill or an area below the fifth percentile."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_quantity")
    low = strata.percentiles(lines, ["l_suppkey"], "l_quantity", {"low": 0.05})
    flag = (F.col("l_discount") < 0.02) | (F.col("l_quantity") < F.col("low"))
    return lines.join(low, "l_suppkey").groupBy("l_suppkey").agg(F.round(F.avg(flag.cast("int")), 6).alias("artifacts"), F.count("*").alias("rows"))


@query("""WITH m AS (SELECT page_id, list_filter([CASE WHEN url IS NULL OR url NOT LIKE '%://%' THEN 'url' END, CASE WHEN html IS NULL OR trim(html) = '' THEN 'html' END, CASE WHEN html NOT LIKE '%<title>%' THEN 'title' END, CASE WHEN url NOT LIKE 'https://%' THEN 'secure_url' END], lambda x: x IS NOT NULL) AS f FROM pages) SELECT page_id, array_to_string(f, ';') AS missing FROM m WHERE len(f) > 0""")
def missing_assets(spark: SparkSession, d: str) -> DataFrame:
    """Pages that lack something, with what they lack."""
    url, html = F.col("url"), F.col("html")
    lost = F.array_compact(F.array(
        F.when(url.isNull() | ~url.contains("://"), F.lit("url")), F.when(html.isNull() | (F.trim(html) == ""), F.lit("html")), F.when(~html.contains("<title>"), F.lit("title")),
        F.when(~url.startswith("https://"), F.lit("secure_url")),
    ))
    return table(spark, d, "pages").select("page_id", lost.alias("f")).filter(F.size("f") > 0).select("page_id", F.array_join("f", ";").alias("missing"))


@query("""WITH f AS (SELECT l_suppkey, avg((l_discount > 0)::INTEGER) FILTER (l_returnflag = 'N') AS zero, avg((l_discount > 0)::INTEGER) AS everywhere, avg(l_tax) * 5 AS boundary, avg(l_quantity) / 250 AS nuclear FROM lineitem GROUP BY 1),
b AS (SELECT *, concat_ws('|', CASE WHEN zero > 0.96 THEN 'signal_is_common_in_score_0' END, CASE WHEN everywhere > 0.957 THEN 'signal_is_nearly_ubiquitous' END, CASE WHEN boundary > 0.2035 THEN 'high_boundary_overlap' END, CASE WHEN nuclear > 0.1035 THEN 'confounder_burden_is_high' END) AS blockers FROM f)
SELECT l_suppkey, blockers, CASE WHEN blockers = '' THEN 'passed' ELSE 'failed_visual_feature_readiness' END AS status FROM b""")
def feature_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Gates on the shares and means of a supplier's lines."""
    hit = (F.col("l_discount") > 0).cast("int")
    means = {
        "zero": (F.when(F.col("l_returnflag") == "N", hit), 0.96, "signal_is_common_in_score_0"), "everywhere": (hit, 0.957, "signal_is_nearly_ubiquitous"),
        "boundary": (F.col("l_tax"), 0.2035, "high_boundary_overlap"), "nuclear": (F.col("l_quantity"), 0.1035, "confounder_burden_is_high"),
    }
    scaled = {"boundary": lambda m: m * 5, "nuclear": lambda m: m / 250}
    return audits.feature_gates(table(spark, d, "lineitem"), "l_suppkey", means, scaled).select("l_suppkey", "blockers", "status")


@query("""WITH c AS (SELECT l_suppkey, l_returnflag AS cohort, count(*) AS n, avg((l_discount < 0.07)::INTEGER) AS cov, avg(l_tax * 10) AS mae FROM lineitem GROUP BY 1, 2),
s AS (SELECT l_suppkey, list_sort(list('cohort_coverage_below:' || cohort) FILTER (n >= 10 AND cov < 0.6)) AS low, max(mae) - min(mae) >= 0.05 AS apart, sum(cov * n) / sum(n) < 0.62 AS overall FROM c GROUP BY 1),
b AS (SELECT l_suppkey, list_concat(list_concat(CASE WHEN overall THEN ['overall_coverage_below'] ELSE [] END, coalesce(low, [])), CASE WHEN apart THEN ['cohort_mae_difference'] ELSE [] END) AS b FROM s)
SELECT l_suppkey, array_to_string(b, '|') AS blockers, CASE WHEN len(b) = 0 THEN 'ready' ELSE 'blocked' END AS status FROM b""")
def cohort_readiness(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's coverage overall and by return flag, and how far apart the flags' errors are."""
    per = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("cohort")).agg(
        F.count("*").alias("n"), F.avg((F.col("l_discount") < 0.07).cast("int")).alias("cov"), F.avg(F.col("l_tax") * 10).alias("mae")
    )
    low = F.array_sort(F.collect_list(F.when((F.col("n") >= 10) & (F.col("cov") < 0.6), F.concat(F.lit("cohort_coverage_below:"), "cohort"))))
    wide = per.groupBy("l_suppkey").agg(low.alias("low"), (F.max("mae") - F.min("mae") >= 0.05).alias("apart"), (F.sum(F.col("cov") * F.col("n")) / F.sum("n") < 0.62).alias("overall"))
    one = lambda cond, name: F.when(F.col(cond), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    b = F.concat(one("overall", "overall_coverage_below"), F.col("low"), one("apart", "cohort_mae_difference"))
    return wide.select("l_suppkey", F.array_join(b, "|").alias("blockers"), F.when(F.size(b) == 0, "ready").otherwise("blocked").alias("status"))


@query(f"""WITH {_PIXELS}, m AS (SELECT l_suppkey, 2 * tp / nullif(truth + predicted, 0) AS dice, tp / nullif(truth, 0) AS recall FROM y) SELECT l_suppkey, round(avg(dice), 6) AS mean_dice, round(stddev_pop(dice), 6) AS std_dice, round(avg(recall), 6) AS mean_recall, round(avg(coalesce(recall, 0)), 6) AS mean_recall_or_zero, count(*) AS n FROM m GROUP BY 1""")
def batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means and deviations of a supplier's masks' metrics."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_quantity") * 10).alias("truth"), F.floor(F.col("l_discount") * 6000).alias("predicted")).withColumn("tp", F.floor(F.least("truth", "predicted") * 3 / 4))
    none = F.lit(0)
    m = rows.select("l_suppkey", (2 * F.col("tp") / F.nullif(F.col("truth") + F.col("predicted"), none)).alias("dice"), (F.col("tp") / F.nullif("truth", none)).alias("recall"))
    out = m.groupBy("l_suppkey").agg(F.avg("dice").alias("mean_dice"), F.stddev_pop("dice").alias("std_dice"), F.avg("recall").alias("mean_recall"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("mean_recall_or_zero"), F.count("*").alias("n"))
    return rounded(out, "mean_dice", "std_dice", "mean_recall", "mean_recall_or_zero")


@query("""WITH x AS (SELECT l_suppkey, list_position(['A', 'N', 'R'], l_returnflag) AS o, CASE WHEN l_quantity < 17 THEN 1 WHEN l_quantity < 34 THEN 2 ELSE 3 END AS p FROM lineitem), c AS (SELECT l_suppkey, k, count(*) FILTER (o = k AND p = k) AS i, count(*) FILTER (o = k OR p = k) AS u FROM x, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2)
SELECT l_suppkey, round(avg(i / u) FILTER (u > 0), 6) AS mean_iou, (SELECT round(avg((abs(o - p) > 1)::INTEGER), 6) FROM x WHERE x.l_suppkey = c.l_suppkey) AS non_adjacent FROM c GROUP BY 1""")
def class_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Mean overlap of three ordered classes with a guess by quantity, and the share of guesses more than one class off."""
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select("l_suppkey", F.array_position(F.array(*map(F.lit, "ANR")), F.col("l_returnflag")).alias("o"), F.when(q < 17, 1).when(q < 34, 2).otherwise(3).alias("p"))
    per = rows.groupBy("l_suppkey").agg(
        *(F.count_if((F.col("o") == k) & (F.col("p") == k)).alias(f"i{k}") for k in (1, 2, 3)), *(F.count_if((F.col("o") == k) | (F.col("p") == k)).alias(f"u{k}") for k in (1, 2, 3)), F.avg((F.abs(F.col("o") - F.col("p")) > 1).cast("int")).alias("far")
    )
    ious = F.array_compact(F.array(*(F.col(f"i{k}") / F.nullif(f"u{k}", F.lit(0)) for k in (1, 2, 3))))
    mean = F.aggregate(ious, F.lit(0.0), lambda a, x: a + x) / F.size(ious)
    return per.select("l_suppkey", F.round(mean, 6).alias("mean_iou"), F.round("far", 6).alias("non_adjacent"))
