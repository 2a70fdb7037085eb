"""Queries on naming, intervals, tiles, boxes, diagnostics, bucketed review and further models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rubric, text
from tessera.operators import folds, gates, joins, metrics, models, neighbors, rank, screens, strata
from tessera.plans.evaluation import _LAB, _modelled, labelled
from tessera.plans.groups import rounded, rounded_as_sql
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(r"""WITH n AS (SELECT s_suppkey, s_name, CASE s_nationkey % 4 WHEN 0 THEN 'S' || s_suppkey || '-' || s_nationkey WHEN 1 THEN 'S' || s_suppkey || '_Image0' || s_nationkey WHEN 2 THEN s_name ELSE 'S-' || s_suppkey || '_Image1' END AS st FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_matches(st, '^[A-Za-z0-9]+-[1-9][0-9]*$') THEN 'canonical' WHEN regexp_matches(st, '^[A-Za-z0-9]+_Image[0-9]+$') THEN 'legacy' ELSE 'invalid' END AS format,
CASE WHEN ends_with(s_name, '1') THEN left(s_name, length(s_name) - 1) ELSE s_name END AS stem FROM n""")
def naming_formats(spark: SparkSession, d: str) -> DataFrame:
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    kind = F.col("s_nationkey") % 4
    name = F.when(kind == 0, F.concat(F.lit("S"), key, F.lit("-"), nation)).when(kind == 1, F.concat(F.lit("S"), key, F.lit("_Image0"), nation)).when(kind == 2, F.col("s_name")).otherwise(F.concat(F.lit("S-"), key, F.lit("_Image1")))
    return table(spark, d, "supplier").select("s_suppkey", text.naming_format(name).alias("format"), text.without_suffix(F.col("s_name"), "1").alias("stem"))


@query("""SELECT p_partkey, proposed, CASE WHEN contains(proposed, '-') THEN (split_part(proposed, '-', 1)::DOUBLE + split_part(proposed, '-', 2)::DOUBLE) / 2 ELSE try_cast(proposed AS DOUBLE) END AS score
FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR || '-' || (p_size + 2)::VARCHAR WHEN p_size % 3 = 1 THEN p_size::VARCHAR ELSE 'none' END AS proposed FROM part)""")
def proposed_scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    word = F.when(n % 3 == 0, F.concat_ws("-", n.cast("string"), (n + 2).cast("string"))).when(n % 3 == 1, n.cast("string")).otherwise("none")
    return table(spark, d, "part").select("p_partkey", word.alias("proposed")).withColumn("score", text.proposed_score(F.col("proposed")))


_STAGES = "[{'s': 0::DOUBLE, 'g': 0::DOUBLE}, {'s': 0.5, 'g': 20}, {'s': 1, 'g': 40}, {'s': 1.5, 'g': 60}, {'s': 2, 'g': 80}, {'s': 3, 'g': 100}]"


@query(f"""SELECT doc_id, array_to_string(CASE WHEN len(inside) > 0 THEN inside ELSE [near] END, '|') AS members FROM (
  SELECT doc_id, list_transform(list_filter({_STAGES}, lambda r: r.g >= lo AND r.g <= hi), lambda r: r.s) AS inside,
    list_aggregate(list_transform({_STAGES}, lambda r: struct_pack(d := abs(r.g - (lo + hi) / 2), s := r.s)), 'min').s AS near
  FROM (SELECT doc_id, n_chars % 101 - 6.0::DOUBLE AS lo, n_chars % 101 + 6.0::DOUBLE AS hi FROM documents))""")
def interval_sets(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("n_chars") % 101).cast("double")
    return table(spark, d, "documents").select("doc_id", F.array_join(rubric.interval_set(x - 6, x + 6).cast("array<string>"), "|").alias("members"))


@query("""SELECT doc_id, unnest(starts)::INTEGER AS start FROM (SELECT doc_id, list_sort(list_distinct(list_concat(range(0, e + 1, 700), [e]))) AS starts FROM (SELECT doc_id, greatest(0, n_chars - 1000) AS e FROM documents))""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(rubric.tile_starts(F.col("n_chars"), 1000, 700)).alias("start"))


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS id, l_linenumber * 10.0::DOUBLE AS x0, l_linenumber * 10.0::DOUBLE + l_quantity AS x1, 0::DOUBLE AS y0, 10::DOUBLE AS y1 FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_orderkey AS k, l_linenumber * 10.0::DOUBLE AS x0, l_linenumber * 10.0::DOUBLE + 30 AS x1, 0::DOUBLE AS y0, 10::DOUBLE AS y1 FROM lineitem WHERE l_returnflag = 'R'),
h AS (SELECT c.k, c.id, max(coalesce(greatest(0, least(c.x1, b.x1) - greatest(c.x0, b.x0)) * greatest(0, least(c.y1, b.y1) - greatest(c.y0, b.y0)) >= 0.5 * (c.x1 - c.x0) * (c.y1 - c.y0), false)) AS hit FROM c LEFT JOIN b ON c.k = b.k GROUP BY 1, 2)
SELECT k, count(*) AS components, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM h GROUP BY 1""")
def proposal_recall(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    x0 = F.col("l_linenumber") * 10.0
    box = lambda flag, wide: lines.filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), x0.alias("x0"), (x0 + wide).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"))
    return rounded(joins.covered_share(box("A", F.col("l_quantity")), box("R", F.lit(30.0)).drop("id"), "k"), "recall")


@query("""WITH a AS (SELECT l_suppkey, avg(l_discount) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_suppkey, avg(l_discount) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT l_suppkey, round(a.m, 6) AS first_mean, round(b.m, 6) AS second_mean, round(abs(a.m - b.m), 6) AS gap, abs(a.m - b.m) <= 0.0025 AS stable FROM a JOIN b USING (l_suppkey)""")
def cohort_stability(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return rounded(strata.cohort_stability(lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus = 'O'"), "l_suppkey", "l_discount", 0.0025), "first_mean", "second_mean", "gap")


@query("""SELECT feature, round(t, 6) AS mean_true, round(f, 6) AS mean_false, round(abs(t - f), 6) AS difference FROM (
SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([avg(l_quantity) FILTER (l_returnflag = 'R'), avg(l_discount) FILTER (l_returnflag = 'R'), avg(l_tax) FILTER (l_returnflag = 'R')]) AS t,
unnest([avg(l_quantity) FILTER (l_returnflag <> 'R'), avg(l_discount) FILTER (l_returnflag <> 'R'), avg(l_tax) FILTER (l_returnflag <> 'R')]) AS f FROM lineitem)""")
def severe_contrast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strata.contrast(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", ["l_quantity", "l_discount", "l_tax"]), "mean_true", "mean_false", "difference")


@query("""SELECT feature, "rows", missing, non_finite, zero_variance, round(spread, 6) AS spread FROM (
SELECT 'n_chars' AS feature, count(*) AS "rows", count(*) FILTER (n_chars IS NULL) AS missing, 0::BIGINT AS non_finite, var_samp(n_chars) <= 1e-12 AS zero_variance, (max(n_chars) - min(n_chars))::DOUBLE AS spread FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'quality', count(*), count(*) FILTER (quality IS NULL), 0, var_samp(quality) <= 1e-12, (max(quality) - min(quality))::DOUBLE FROM documents LEFT JOIN labels USING (doc_id))""")
def feature_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(strata.feature_diagnostics(docs, ["n_chars", "quality"]), "spread")


@query("""SELECT label, count(*) AS "rows" FROM (SELECT trim(unnest(string_split(p_type, ' '))) AS label FROM part) WHERE label <> '' GROUP BY 1""")
def exploded_labels(spark: SparkSession, d: str) -> DataFrame:
    return strata.exploded_counts(table(spark, d, "part"), "p_type", " ")


@query(f"""WITH d AS (SELECT doc_id, p, quality, abs(quality - p) AS e, abs(p - 0.5) AS u FROM {_LAB}),
a AS (SELECT doc_id, row_number() OVER (ORDER BY e DESC, doc_id) AS r FROM d), a2 AS (SELECT * FROM a WHERE r <= 4),
b AS (SELECT doc_id, row_number() OVER (ORDER BY u, doc_id) AS r FROM d WHERE doc_id NOT IN (SELECT doc_id FROM a2)), b2 AS (SELECT * FROM b WHERE r <= 4),
c AS (SELECT doc_id, row_number() OVER (ORDER BY e, doc_id) AS r FROM d WHERE doc_id NOT IN (SELECT doc_id FROM a2) AND doc_id NOT IN (SELECT doc_id FROM b2)), c2 AS (SELECT * FROM c WHERE r <= 3)
SELECT row_number() OVER (ORDER BY g, r)::INTEGER AS "order", doc_id, bucket FROM (SELECT 1 AS g, r, doc_id, 'error' AS bucket FROM a2 UNION ALL SELECT 2, r, doc_id, 'uncertain' FROM b2 UNION ALL SELECT 3, r, doc_id, 'confident' FROM c2)""")
def review_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).withColumns({"e": F.abs(F.col("quality") - F.col("p")), "u": F.abs(F.col("p") - 0.5)})
    every = F.lit(True)
    return rank.buckets_without_replacement(rows, "doc_id", [("error", every, [F.desc("e")], 4), ("uncertain", every, [F.col("u")], 4), ("confident", every, [F.col("e")], 3)])


@query("""SELECT s_suppkey, unnest(range(1, 2 + (pos <= ceil(n * 0.4 - 1e-9))::INTEGER))::INTEGER AS copy FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS pos, count(*) OVER () AS n FROM supplier)""")
def weighted_repeats(spark: SparkSession, d: str) -> DataFrame:
    return rank.weighted_repeats(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 1.4).select("s_suppkey", "copy")


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_linestatus = 'F' AS s, l_linenumber::DOUBLE AS x, l_quantity AS y FROM lineitem), j AS (SELECT a.l_orderkey, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.s AND NOT b.s),
u AS (SELECT l_orderkey, max(m) AS m FROM (SELECT l_orderkey, min(d) AS m FROM j GROUP BY l_orderkey, ax, ay UNION ALL SELECT l_orderkey, min(d) FROM j GROUP BY l_orderkey, bx, b_y) GROUP BY 1)
SELECT l_orderkey, round(coalesce(m, 'Infinity'::DOUBLE), 6) AS distance FROM (SELECT DISTINCT l_orderkey FROM p) LEFT JOIN u USING (l_orderkey)""")
def hausdorff_distance(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linestatus") == "F").alias("s"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y"))
    return rounded_as_sql(neighbors.hausdorff(points, "l_orderkey", "s", "x", "y"), "distance")


@query("""WITH m AS (SELECT l_suppkey, avg((l_discount >= 0.01)::INTEGER) AS lo, avg((l_discount >= 0.06)::INTEGER) AS hi, abs(avg(l_tax) - 0.04) AS sep, avg(l_quantity) / 50 AS auto, avg(l_tax) * 12 AS oracle FROM lineitem GROUP BY 1)
SELECT l_suppkey, concat_ws('|', CASE WHEN lo > 0.5 AND hi <= 0.5 THEN 'threshold_too_low' END, CASE WHEN hi > 0.5 THEN 'background_positive' END, CASE WHEN sep < 0.05 THEN 'not_separable' END) AS causes,
CASE WHEN lo < 0.5 THEN 'prompt_failure' WHEN auto <= 0.5 THEN 'keep_current' WHEN oracle - auto <= 0.05 THEN 'adopt' ELSE 'review' END AS tier,
CASE WHEN (lo >= 0.8 AND hi >= 0.25) OR (lo >= 0.9 AND hi >= 0.15) THEN 'severe' WHEN auto >= 0.5 AND lo >= 0.8 THEN 'ordinal' ELSE 'none' END AS product FROM m""")
def decision_ladders(spark: SparkSession, d: str) -> DataFrame:
    share = lambda t: F.avg((F.col("l_discount") >= t).cast("double"))
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        share(0.01).alias("lo"), share(0.06).alias("hi"), F.abs(F.avg("l_tax") - 0.04).alias("sep"), (F.avg("l_quantity") / 50).alias("auto"), (F.avg("l_tax") * 12).alias("oracle")
    )
    lo, hi, auto = F.col("lo"), F.col("hi"), F.col("auto")
    return m.select(
        "l_suppkey", F.array_join(gates.overcoverage_causes(lo, hi, F.col("sep")), "|").alias("causes"), gates.adoption_tier(auto, F.col("oracle"), F.lit(0.5), lo).alias("tier"), gates.product_choice(lo, hi, auto).alias("product")
    )


@query(f"""WITH t AS (SELECT unnest([0.1::DOUBLE, 0.25, 0.5]) AS threshold), c AS (SELECT lang, threshold, count(*) FILTER (p >= threshold AND quality = 1) AS tp, count(*) FILTER (p >= threshold AND quality = 0) AS fp, count(*) FILTER (p < threshold AND quality = 1) AS fn, count(*) FILTER (p < threshold AND quality = 0) AS tn FROM {_LAB}, t GROUP BY 1, 2) SELECT * FROM c""")
def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    out = rank.threshold_curve(labelled(spark, d), F.col("p"), F.col("quality"), (0.1, 0.25, 0.5), ["lang"])
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("tp", "fp", "fn", "tn")})


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS "rows", count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def order_cube(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority")
    return out.agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def region_coverage(spark: SparkSession, d: str) -> DataFrame:
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    # orders fold into customers first, so only one row a customer meets the nations
    per = c.join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k")), "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.sum(F.coalesce("k", F.lit(0))).alias("k"))
    out = n.join(r, n.n_regionkey == r.r_regionkey).join(per, n.n_nationkey == per.c_nationkey, "left")
    return out.select("r_name", "n_name", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("k", F.lit(0)).alias("orders"))


@query("""SELECT item_id, md5(text) AS digest, length(text) AS n_chars, item_id % 5 = 0 AS sampled FROM benchmark""")
def benchmark_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n_chars"), (F.col("item_id") % 5 == 0).alias("sampled"))


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS s, value FROM events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events, round(sum(value), 4) AS total FROM n GROUP BY 1, 2""")
def annotation_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user less than six hours apart make a session."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.col("ts") - F.lag("ts").over(w)) > F.expr("INTERVAL 6 HOUR")
    marked = table(spark, d, "events").withColumn("s", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("s").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT 1 AS k, (SELECT min(vec_id) FROM v) AS id, [(SELECT min(vec_id) FROM v)] AS done
  UNION ALL SELECT k + 1, n.id, list_append(done, n.id) FROM c, LATERAL (SELECT vec_id AS id FROM (SELECT v.vec_id, min(sqrt(list_sum(list_transform(list_zip(v.e, o.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS dist FROM v, v o WHERE list_contains(c.done, o.vec_id) GROUP BY 1) ORDER BY round(dist, 6) DESC, vec_id LIMIT 1) n WHERE k < 4),
p AS (SELECT c.k - 1 AS i, c.id, v.e FROM c JOIN v ON v.vec_id = c.id), d AS (SELECT v.vec_id, p.id AS centre, sqrt(list_sum(list_transform(list_zip(v.e, p.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM v, p)
SELECT vec_id, arg_min(centre, struct_pack(a := dist, b := centre)) AS centre, round(min(dist), 5) AS distance FROM d GROUP BY 1""")
def k_center(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.farthest_first(table(spark, d, "embeddings"), "vec_id", "embedding", 4).withColumn("distance", F.round("distance", 5))


@query(None)
def source_offset_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of all rows, corrected by the mean training residual of the row's source."""
    names = [f"e{k}" for k in range(64)]
    one = [screens.Candidate("offset", tuple(names), sources=screens.CALIBRATED)]
    rows = table(spark, d, "embeddings").withColumns({"fold": folds.hash_fold(F.col("label"), 3), "stage": (F.col("label") % 6) * 20.0, "source": F.col("vec_id") % 4} | {n: F.col("embedding")[k] for k, n in enumerate(names)})
    out = screens.screen(rows, one, "fold", "stage", "source", 0.0, 100.0)
    return out.select("vec_id", "label", "fold", "stage", F.round(F.col("out_of_fold")[0], 4).alias("prediction"))


@query(None)
def cumulative_threshold_models(spark: SparkSession, d: str) -> DataFrame:
    out = models.cumulative_thresholds(_modelled(spark, d), "fold", "stage", [0.0, 40.0], 3)
    p = rubric.monotone(F.col("p"))
    return out.select("vec_id", "fold", "stage", F.round(rubric.burden(p), 4).alias("burden"))


@query(None)
def explanation_terms(spark: SparkSession, d: str) -> DataFrame:
    return models.contributions(_modelled(spark, d), "odd", [f"e{k}" for k in range(64)]).select("vec_id", "odd", "positive", "negative")


@query(None)
def cluster_agreement(spark: SparkSession, d: str) -> DataFrame:
    few = models.as_vectors(models.principal_components(_modelled(spark, d), 4).drop("features").withColumnRenamed("pca", "few"), "few")
    return rounded(metrics.adjusted_rand(models.cluster(few, [2, 3]), "kmeans", "gmm"), "ari")
