"""Queries on metrics, thresholds, gates, folds, vectors and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rubric import three_band
from tessera.operators import folds, gates, metrics, models, neighbors, rank, resample, screens, strata
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


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with probability p, from 0 to 1 by length."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / F.lit(8000.0)))


_LAB = "(SELECT doc_id, lang, source, n_chars, quality, toxic, least(1::DOUBLE, n_chars / 8000.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH r AS (SELECT lang, quality, p, avg(rn) OVER (PARTITION BY lang, p) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p) AS rn FROM {_LAB})),
a AS (SELECT lang, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, sum(rank) FILTER (quality = 1) AS s FROM r GROUP BY 1),
c AS (SELECT lang, p, sum(quality) AS pos, count(*) AS n FROM {_LAB} GROUP BY 1, 2),
w AS (SELECT lang, pos, sum(pos) OVER (PARTITION BY lang ORDER BY p DESC) / sum(n) OVER (PARTITION BY lang ORDER BY p DESC) AS precision FROM c),
v AS (SELECT lang, sum(precision * pos) AS ap FROM w GROUP BY 1)
SELECT lang, positives, negatives, round((s - positives * (positives + 1) / 2.0::DOUBLE) / nullif(positives * negatives, 0), 6) AS auroc, round(CASE WHEN positives > 0 AND negatives > 0 THEN ap / positives END, 6) AS average_precision FROM a JOIN v USING (lang)""")
def auroc_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(labelled(spark, d), F.col("p"), F.col("quality"), ["lang"]), "auroc", "average_precision")


@query(f"""WITH c AS (SELECT source, count(*) FILTER (p >= 0.25 AND quality = 1) AS tp, count(*) FILTER (p >= 0.25 AND quality = 0) AS fp, count(*) FILTER (p < 0.25 AND quality = 1) AS fn, count(*) FILTER (p < 0.25 AND quality = 0) AS tn FROM {_LAB} GROUP BY 1)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tn / nullif(tn + fp, 0), 6) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.confusion(labelled(spark, d), F.col("p") >= 0.25, F.col("quality"), ["source"]), "recall", "precision", "specificity", "balanced_accuracy")


@query(f"""SELECT three_band, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM (SELECT doc_id, CASE WHEN score < 1 THEN 'none_low' WHEN score < 2 THEN 'mild_mod' ELSE 'severe' END AS three_band FROM {_SCORE}) JOIN labels USING (doc_id) GROUP BY 1""")
def confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    banded = scored(spark, d).withColumn("three_band", three_band(F.col("score"))).join(table(spark, d, "labels"), "doc_id")
    return banded.groupBy("three_band").pivot("toxic", [0, 1]).agg(F.count(F.lit(1))).select("three_band", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


@query("""WITH b AS (SELECT lang, least(3, n_chars // 1500)::DOUBLE AS a, least(3, (n_chars * 3 // 4) // 1000)::DOUBLE AS b FROM documents),
r AS (SELECT *, avg(ra0) OVER (PARTITION BY lang, a) AS ra, avg(rb0) OVER (PARTITION BY lang, b) AS rb FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY a) AS ra0, row_number() OVER (PARTITION BY lang ORDER BY b) AS rb0 FROM b))
SELECT lang, count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(corr(ra, rb), 6) AS spearman, round(avg((a = b)::INTEGER), 6) AS exact, round(avg((abs(a - b) <= 1)::INTEGER), 6) AS within_one FROM r GROUP BY 1""")
def concordance_spearman(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    docs = table(spark, d, "documents").select("lang", F.least(F.lit(3.0), F.floor(n / 1500).cast("double")).alias("a"), F.least(F.lit(3.0), F.floor(F.floor(n * 3 / 4) / 1000).cast("double")).alias("b"))
    return rounded(metrics.agreement(docs, "a", "b", ["lang"]), "mae", "spearman", "exact", "within_one")


_GRID = "(SELECT unnest(range(1, 20)) * 0.05::DOUBLE AS threshold)"


@query(f"""WITH c AS (SELECT round(threshold, 2) AS threshold, count(*) FILTER (p >= round(threshold, 2) AND quality = 1) AS tp, count(*) FILTER (p >= round(threshold, 2) AND quality = 0) AS fp, count(*) FILTER (p < round(threshold, 2) AND quality = 1) AS fn, count(*) FILTER (p < round(threshold, 2) AND quality = 0) AS tn FROM {_LAB}, {_GRID} GROUP BY 1),
m AS (SELECT threshold, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy FROM c)
SELECT threshold, round(balanced_accuracy, 6) AS balanced_accuracy, round(recall, 6) AS recall, round(specificity, 6) AS specificity FROM m ORDER BY round(balanced_accuracy, 9) DESC, round(recall, 9) DESC, round(specificity, 9) DESC, round(abs(threshold - 0.5), 9), threshold LIMIT 1""")
def operating_threshold(spark: SparkSession, d: str) -> DataFrame:
    curve = rank.threshold_curve(labelled(spark, d), F.col("p"), F.col("quality"), [round(0.05 * k, 2) for k in range(1, 20)])
    return rounded(rank.operating_threshold(curve), "balanced_accuracy", "recall", "specificity")


@query(f"""WITH c AS (SELECT p AS threshold, sum(quality) AS pos, count(*) AS n FROM {_LAB} GROUP BY 1), w AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS taken, sum(pos) OVER () AS a FROM c)
SELECT threshold, round(tp / taken, 6) AS precision, round(tp / a, 6) AS recall FROM w WHERE tp / a >= 0.8 - 1e-12 ORDER BY round(tp / taken, 9) DESC, threshold DESC LIMIT 1""")
def recall_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rank.recall_threshold(labelled(spark, d), F.col("p"), F.col("quality"), 0.8), "precision", "recall")


@query("""WITH r AS (SELECT l_returnflag AS family, t AS threshold, avg((l_discount >= t AND l_linestatus = 'O')::INTEGER) AS bg, avg((l_discount >= t)::INTEGER) AS rec FROM lineitem, (SELECT unnest([0.01::DOUBLE, 0.03, 0.05, 0.07]) AS t) GROUP BY 1, 2),
w AS (SELECT threshold, max(bg) AS worst, avg(rec) AS recall FROM r GROUP BY 1)
SELECT threshold, round(worst, 6) AS worst_background, round(recall, 6) AS mean_recall FROM w WHERE worst <= 0.55 ORDER BY round(recall, 9) DESC, round(worst, 9), threshold LIMIT 1""")
def threshold_selection(spark: SparkSession, d: str) -> DataFrame:
    cut = F.explode(F.array(*map(F.lit, (0.01, 0.03, 0.05, 0.07))))
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("family"), "l_linestatus", "l_discount").withColumn("threshold", cut)
    hit = F.col("l_discount") >= F.col("threshold")
    out = rank.limited_threshold(rows, "family", "threshold", (hit & (F.col("l_linestatus") == "O")).cast("double"), hit.cast("double"), 0.55)
    return rounded(out, "worst_background", "mean_recall")


_OVER = """(SELECT l_orderkey, count(*) FILTER (t AND p) AS b, count(*) FILTER (t) AS tr, count(*) FILTER (p) AS pr, avg((t = p)::INTEGER) AS accuracy
FROM (SELECT l_orderkey, l_quantity > 30 AS t, l_extendedprice > 40000 AS p FROM lineitem) GROUP BY 1)"""


@query(f"""SELECT l_orderkey, b AS both, tr AS truth, pr AS predicted, round(accuracy, 6) AS accuracy, round(coalesce(2 * b / nullif(tr + pr, 0), 0), 6) AS dice_zero, round(coalesce(2 * b / nullif(tr + pr, 0), 1), 6) AS dice_one,
round(coalesce(b / nullif(tr + pr - b, 0), 0), 6) AS jaccard_zero, round(coalesce(b / nullif(tr + pr - b, 0), 1), 6) AS jaccard_one, round(coalesce(b / nullif(pr, 0), 0), 6) AS precision, round(coalesce(b / nullif(tr, 0), 0), 6) AS recall FROM {_OVER}""")
def overlap_metrics_both(spark: SparkSession, d: str) -> DataFrame:
    out = order_overlap(spark, d)
    return rounded(out, "accuracy", "dice_zero", "dice_one", "jaccard_zero", "jaccard_one", "precision", "recall")


def order_overlap(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overlap(table(spark, d, "lineitem"), F.col("l_quantity") > 30, F.col("l_extendedprice") > 40000, ["l_orderkey"])


GATES = (
    gates.Gate("positive_dice", "dice_one", 0.3), gates.Gate("positive_jaccard", "jaccard_one", 0.15), gates.Gate("positive_precision", "precision", 0.1), gates.Gate("positive_recall", "recall", 0.5), gates.Gate("pixel_accuracy", "accuracy", 0.6, 1.0),
)
_GATED = f"""(SELECT l_orderkey, unnest(['positive_dice', 'positive_jaccard', 'positive_precision', 'positive_recall', 'pixel_accuracy']) AS gate,
unnest([coalesce(2 * b / nullif(tr + pr, 0), 1) >= 0.3, coalesce(b / nullif(tr + pr - b, 0), 1) >= 0.15, coalesce(b / nullif(pr, 0), 0) >= 0.1, coalesce(b / nullif(tr, 0), 0) >= 0.5, accuracy >= 0.6]) AS passed FROM {_OVER})"""


@query(f"""SELECT l_orderkey, count(*) AS gates, count(*) FILTER (NOT passed) AS failures, coalesce(string_agg(gate, '|' ORDER BY gate) FILTER (NOT passed), '') AS failing FROM {_GATED} GROUP BY 1""")
def gate_table(spark: SparkSession, d: str) -> DataFrame:
    return gates.failing_reasons(gates.gate_rows(order_overlap(spark, d), GATES), ["l_orderkey"])


@query(f"""WITH r AS (SELECT DISTINCT doc_id AS l_orderkey, 'positive_recall' AS gate FROM labels WHERE toxic = 0)
SELECT g.l_orderkey, g.gate, g.passed OR r.gate IS NOT NULL AS passed, NOT g.passed AND r.gate IS NOT NULL AS adjudicated FROM {_GATED} g LEFT JOIN r USING (l_orderkey, gate)""")
def adjudication_flip(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "labels").filter("toxic = 0").select(F.col("doc_id").alias("l_orderkey"), F.lit("positive_recall").alias("gate"), F.lit(False).alias("counts")).distinct()
    return gates.adjudicate(gates.gate_rows(order_overlap(spark, d), GATES), reviews, ["l_orderkey", "gate"]).select("l_orderkey", "gate", "passed", "adjudicated")


@query("""WITH m AS (SELECT l_suppkey, avg(l_discount) FILTER (l_returnflag = 'A') AS a, avg(l_discount) FILTER (l_returnflag = 'R') AS b, count(*) FILTER (l_returnflag = 'A') >= 60 AS ao, count(*) FILTER (l_returnflag = 'R') >= 60 AS bo FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN NOT ao AND NOT bo THEN 'neither' WHEN ao AND NOT bo THEN 'first' WHEN bo AND NOT ao THEN 'second' WHEN abs(a - b) <= 0.002 THEN 'tie' WHEN a > b THEN 'first' ELSE 'second' END AS decision FROM m""")
def promotion_decision(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda f: strata.exact_mean(F.when(F.col("l_returnflag") == f, F.col("l_discount")))
    enough = lambda f: F.count_if(F.col("l_returnflag") == f) >= 60
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(mean("A").alias("a"), mean("R").alias("b"), enough("A").alias("ao"), enough("R").alias("bo"))
    return m.select("l_suppkey", gates.promotion(F.col("ao"), F.col("bo"), F.col("a"), F.col("b"), 0.002).alias("decision"))


@query(f"""WITH f AS (SELECT doc_id % 5 AS fold, p FROM {_LAB}), s AS (SELECT fold, count(*) AS n, sum(p) AS s FROM f GROUP BY 1)
SELECT fold::INTEGER AS fold, n AS "rows", round(((SELECT sum(s) FROM s) - s) / ((SELECT sum(n) FROM s) - n), 6) AS train_mean FROM s""")
def leave_fold_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    return rounded(folds.leave_fold_mean(rows, "fold", F.col("p")), "train_mean")


@query(f"""WITH r AS (SELECT doc_id % 5 AS fold, abs(quality - p) AS r FROM {_LAB}), o AS (SELECT fold, list_sort(list(r)) AS l, count(*) AS n FROM r GROUP BY 1)
SELECT fold::INTEGER AS fold, n, round(l[(ceil(least(1::DOUBLE, ceil((n + 1) * 0.9::DOUBLE - 1e-9) / n) * (n - 1) - 1e-9) + 1)::BIGINT], 6) AS quantile FROM o""")
def conformal_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    return rounded(folds.conformal_quantiles(rows, ["fold"], F.abs(F.col("quality") - F.col("p")), 0.9, 1.0), "quantile")


@query("""WITH RECURSIVE g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS sev, count(*) AS n, max(round(value * 100)::BIGINT) AS top, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY sev DESC, top DESC, n DESC, user_id) AS r FROM g),
w AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS user_id, -1 AS fold, 0::BIGINT AS sev, 0::BIGINT AS n, list_transform(range(5), lambda k: struct_pack(sev := 0::BIGINT, n := 0::BIGINT, total := 0::BIGINT, k := k::INTEGER)) AS loads
  UNION ALL SELECT o.r, o.user_id, list_sort(w.loads)[1].k, o.sev, o.n, list_transform(w.loads, lambda x: CASE WHEN x.k = list_sort(w.loads)[1].k THEN struct_pack(sev := x.sev + o.sev, n := x.n + o.n, total := x.total + o.total, k := x.k) ELSE x END) FROM w JOIN o ON o.r = w.r + 1)
SELECT user_id, fold::INTEGER AS fold, sev AS severe, n AS "rows" FROM w WHERE r > 0""")
def greedy_folds(spark: SparkSession, d: str) -> DataFrame:
    """Users into five folds with even purchases, events and values (in hundredths)."""
    return folds.greedy_folds(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long"), 5)


_LONG = "(SELECT vec_id, unnest(range(0, 64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""WITH l AS {_LONG}, s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY 1) SELECT vec_id, dim, round(CASE WHEN s > 1e-8 THEN (x - m) / s ELSE 0 END, 5) AS z FROM l JOIN s USING (dim)""")
def zscore_space(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.zscores(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("z", F.round("z", 5))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a JOIN embeddings b ON a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM p) SELECT query_id, rank::INTEGER AS rank, id, round(dist, 5) AS distance FROM r WHERE rank <= 3""")
def knn_group_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest_other_group(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 3).withColumn("distance", F.round("distance", 5))


@query("""WITH a AS (SELECT min(vec_id) AS anchor_id FROM embeddings GROUP BY label), v AS (SELECT anchor_id, embedding AS e FROM a JOIN embeddings ON vec_id = anchor_id),
p AS (SELECT vec_id, anchor_id, list_distance(embedding::DOUBLE[], e::DOUBLE[]) AS dist FROM embeddings, v WHERE vec_id <> anchor_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 6), anchor_id) AS k FROM p)
SELECT vec_id, anchor_id, round(dist, 5) AS distance FROM r WHERE k = 1""")
def nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    anchors = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor_vector"), F.min("vec_id").alias("anchor_id")).drop("label")
    return neighbors.nearest_anchor(rows, anchors, "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


@query(f"""WITH c AS (SELECT label, dim, avg(x) AS m FROM {_LONG} JOIN embeddings USING (vec_id) GROUP BY 1, 2), k AS (SELECT label, list(m ORDER BY dim) AS c FROM c GROUP BY 1),
f AS (SELECT label, vec_id, list_distance(embedding::DOUBLE[], c) AS dist FROM embeddings JOIN k USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(dist, 6), vec_id) AS rank FROM f)
SELECT label, rank::INTEGER AS rank, vec_id, round(dist, 5) AS distance FROM r WHERE rank <= 5""")
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.representatives(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 5).withColumn("distance", F.round("distance", 5))


@query("""WITH l AS (SELECT label AS a, (embedding[1] > 0)::INTEGER + 2 * (embedding[2] > 0)::INTEGER AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2),
t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS s FROM c), x AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(n) AS m FROM c GROUP BY a)), y AS (SELECT sum(m * (m - 1) / 2) AS s FROM (SELECT sum(n) AS m FROM c GROUP BY b))
SELECT t.t::BIGINT AS "rows", round((t.s - x.s * y.s / (t.t * (t.t - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (t.t * (t.t - 1) / 2)), 6) AS ari FROM t, x, y""")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    two = table(spark, d, "embeddings").select(F.col("label").alias("a"), ((e[0] > 0).cast("int") + 2 * (e[1] > 0).cast("int")).alias("b"))
    return rounded(metrics.adjusted_rand(two, "a", "b"), "ari")


def _modelled(spark: SparkSession, d: str) -> DataFrame:
    rows = models.as_vectors(table(spark, d, "embeddings"), "embedding")
    return rows.withColumn("fold", folds.hash_fold(F.col("vec_id"), 3)).withColumn("stage", (F.col("label") % 6) * 20.0).withColumn("odd", F.col("label") % 2).select("vec_id", "label", "fold", "stage", "odd", "features")


@query(None)
def ridge_oof(spark: SparkSession, d: str) -> DataFrame:
    return models.ridge_out_of_fold(_modelled(spark, d), "fold", "stage", 3, 1.0, 0.0, 100.0).select("vec_id", "fold", "stage", F.round("prediction", 4).alias("prediction"))


@query(None)
def logistic_oof(spark: SparkSession, d: str) -> DataFrame:
    return models.logistic_out_of_fold(_modelled(spark, d), "fold", "odd", 3).select("vec_id", "fold", "odd", F.round("probability", 4).alias("probability"))


@query(None)
def kmeans_gmm(spark: SparkSession, d: str) -> DataFrame:
    small = models.principal_components(_modelled(spark, d), 4).drop("features").withColumnRenamed("pca", "few")
    return models.cluster(models.as_vectors(small, "few"), [2, 3, 4]).select("vec_id", "kmeans", "gmm")


@query(None)
def pca_space(spark: SparkSession, d: str) -> DataFrame:
    return models.principal_components(_modelled(spark, d), 8).select("vec_id", F.transform("pca", lambda x: F.round(x, 4)).alias("pca"))


@query(None)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return rounded(resample.bootstrap_mean(orders, ["c_mktsegment"], "o_custkey", F.col("o_totalprice")), "estimate", "low", "high")


@query(None)
def severe_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of odd labels, cut in each fold at the threshold that reaches the recall on the other folds."""
    return models.recall_targeted(_modelled(spark, d), "fold", "odd", 3, 0.8).select("vec_id", "fold", "odd", F.round("probability", 4).alias("probability"), F.round("threshold", 4).alias("threshold"), "predicted")


@query(None)
def ordinal_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold class of the stage, and how far off it is."""
    rows = models.multinomial_out_of_fold(_modelled(spark, d).withColumn("band", (F.col("stage") / 40).cast("int")), "fold", "band", 3)
    return rows.select("vec_id", "fold", "band", "predicted", F.abs(F.col("predicted") - F.col("band")).alias("distance"))


@query(None)
def leave_one_source(spark: SparkSession, d: str) -> DataFrame:
    """Each label as a source held out: the error of a ridge model of all others, from one aggregation."""
    names = [f"e{k}" for k in range(64)]
    rows = table(spark, d, "embeddings").select(((F.col("label") % 6) * 20.0).alias("stage"), "label", *(F.col("embedding")[k].alias(n) for k, n in enumerate(names)))
    return rounded(screens.held_out_sources(rows, names, "stage", "label", low=0.0, high=100.0), "mae")


@query(None)
def source_predictability(spark: SparkSession, d: str) -> DataFrame:
    """Whether the features tell labels apart: out-of-fold balanced accuracy."""
    rows = models.multinomial_out_of_fold(_modelled(spark, d).withColumn("source", (F.col("label") % 3).cast("int")), "fold", "source", 3)
    recall = rows.groupBy("source").agg(F.avg((F.col("source") == F.col("predicted")).cast("double")).alias("r"), F.count("*").alias("n"))
    return rounded(recall.agg(F.avg("r").alias("balanced_accuracy"), F.sum("n").alias("rows"), F.count("*").alias("sources")), "balanced_accuracy")


@query(None)
def gated_stage(spark: SparkSession, d: str) -> DataFrame:
    """Ridge and a gate's probability together: 0.65 of the stage and 0.35 of 100 times the probability, out of fold."""
    rows = models.logistic_out_of_fold(models.ridge_out_of_fold(_modelled(spark, d), "fold", "stage", 3, 1.0, 0.0, 100.0), "fold", "odd", 3)
    both = 0.65 * F.col("prediction") + 0.35 * 100 * F.col("probability")
    return rows.select("vec_id", "fold", "stage", F.round(both, 4).alias("prediction"))
