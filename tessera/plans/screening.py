"""Queries on candidate screens: sums of products, candidates out of fold, sources held out."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import resample, screens, selection
from tessera.plans.groups import rounded
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


FEATURES = ("quantity", "discount", "tax", "position", "lines")


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """A row a customer with orders: means over its lines, the target price, its source (segment, nation) and fold."""
    lines, orders, customers = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    means = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").groupBy("c_custkey").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_linenumber").alias("position"), F.count("*").cast("double").alias("lines"),
        (F.avg("l_extendedprice") / 1000).alias("price"),
    )
    rows = means.join(customers.select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey").withColumn("fold", (F.col("c_custkey") % 5).cast("int"))
    return written(rows, "subjects")  # a screen reads its rows for centres, sums and predictions; the lines are joined and added up once


_SUBJECTS = """s AS (SELECT c_custkey, c_mktsegment, c_nationkey, (c_custkey % 5)::INTEGER AS fold, f, y FROM (
  SELECT o_custkey AS c_custkey, [avg(l_quantity), avg(l_discount), avg(l_tax), avg(l_linenumber), count(*)::DOUBLE] AS f, avg(l_extendedprice) / 1000 AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
  JOIN customer USING (c_custkey))"""

#: All single features and pairs, weakly and strongly penalised, beside the mean.
CANDIDATES = [screens.Candidate("mean", ())] + [
    screens.Candidate(f"{'+'.join(columns)} {strength:g}", columns, strength) for strength in (1.0, 200.0) for n in (1, 2) for columns in combinations(FEATURES, n)
]


def _listed() -> str:
    return ", ".join(f"('{c.name}', {len(c.columns)}, {FEATURES.index(c.columns[0]) + 1 if c.columns else 1}, {FEATURES.index(c.columns[-1]) + 1 if c.columns else 1}, {c.strength}::DOUBLE)" for c in CANDIDATES)


#: Solves a candidate of at most two standardised columns from moments of the training rows; needs a table m (n, mi, mj, my, vi, vj, cij, ci, cj, k, a).
_SOLVED = """w AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 1 THEN n * ci / sqrt(vi) / (n + a) / sqrt(vi) ELSE ((n + a) * n * ci / sqrt(vi) - n * cij / sqrt(vi * vj) * n * cj / sqrt(vj)) / ((n + a) * (n + a) - n * n * cij * cij / (vi * vj)) / sqrt(vi) END AS wi,
  CASE k WHEN 2 THEN ((n + a) * n * cj / sqrt(vj) - n * cij / sqrt(vi * vj) * n * ci / sqrt(vi)) / ((n + a) * (n + a) - n * n * cij * cij / (vi * vj)) / sqrt(vj) ELSE 0 END AS wj FROM m)"""
_MOMENTS = "count(*)::DOUBLE AS n, avg(f[i]) AS mi, avg(f[j]) AS mj, avg(y) AS my, var_pop(f[i]) AS vi, var_pop(f[j]) AS vj, covar_pop(f[i], f[j]) AS cij, covar_pop(f[i], y) AS ci, covar_pop(f[j], y) AS cj"


@query(f"""WITH {_SUBJECTS}, c(candidate, k, i, j, a) AS (VALUES {_listed()}),
m AS (SELECT candidate, k, i, j, a, held, {_MOMENTS} FROM s, c, range(5) h(held) WHERE fold <> held GROUP BY 1, 2, 3, 4, 5, 6), {_SOLVED},
p AS (SELECT candidate, k, my + wi * (f[i] - mi) + wj * (f[j] - mj) - y AS off FROM s JOIN w ON fold = held),
e AS (SELECT candidate, k AS columns, count(*) AS "rows", avg(abs(off)) AS mae, sqrt(avg(off * off)) AS rmse, avg(off) AS bias FROM p GROUP BY 1, 2)
SELECT candidate, columns, "rows", round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, candidate = (SELECT arg_min(candidate, struct_pack(m := round(mae, 9), c := candidate)) FROM e) AS chosen FROM e""")
def candidate_screen(spark: SparkSession, d: str) -> DataFrame:
    """Customers' mean price by 31 candidates, out of fold by customer, with their errors and the choice."""
    out = screens.screen_metrics(screens.screen(subjects(spark, d), CANDIDATES, "fold", "price"), CANDIDATES, "price")
    return rounded(out, "mae", "rmse", "bias")


@query(f"""WITH {_SUBJECTS}, c(k, i, j, a) AS (VALUES (2, 1, 4, 1.0::DOUBLE)),
m AS (SELECT k, i, j, a, held, {_MOMENTS} FROM s, c, range(6) h(held) WHERE fold <> held GROUP BY 1, 2, 3, 4, 5), {_SOLVED}, p AS (SELECT *, greatest(50, least(56, my + wi * (f[i] - mi) + wj * (f[j] - mj))) AS p FROM s, w)
SELECT c_custkey, fold, round(any_value(y), 6) AS observed, round(max(p) FILTER (fold = held), 6) AS out_of_fold, round(max(p) FILTER (held = 5), 6) AS apparent FROM p GROUP BY 1, 2""")
def screen_predictions(spark: SparkSession, d: str) -> DataFrame:
    """One candidate's predictions by the other folds and by all rows, within 50 to 56."""
    one = [screens.Candidate("one", ("quantity", "position"))]
    out = screens.screen(subjects(spark, d), one, "fold", "price", low=50.0, high=56.0)
    return rounded(out.select("c_custkey", "fold", F.col("price").alias("observed"), F.col("out_of_fold")[0].alias("out_of_fold"), F.col("apparent")[0].alias("apparent")), "observed", "out_of_fold", "apparent")


@query(f"""WITH {_SUBJECTS}, c(k, i, j, a) AS (VALUES (2, 1, 4, 5.0::DOUBLE)),
m AS (SELECT k, i, j, a, held, {_MOMENTS} FROM s, c, (SELECT DISTINCT c_nationkey AS held FROM s) WHERE c_nationkey <> held GROUP BY 1, 2, 3, 4, 5), {_SOLVED}
SELECT c_nationkey, CASE WHEN count(*) < 60 THEN 'not_estimable_small_row_count' ELSE 'estimated' END AS status, any_value(n)::BIGINT AS train_rows, count(*) AS test_rows,
  CASE WHEN count(*) >= 60 THEN round(avg(abs(my + wi * (f[i] - mi) + wj * (f[j] - mj) - y)), 6) END AS mae FROM s JOIN w ON held = c_nationkey GROUP BY 1""")
def nation_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's customers by a model of all other nations'; fewer than 60 aren't judged."""
    out = screens.held_out_sources(subjects(spark, d), ["quantity", "position"], "price", "c_nationkey", 5.0, 60)
    return rounded(out, "mae")


@query("""WITH o AS (SELECT (l_orderkey % 4)::INTEGER AS fold, l_returnflag, [1.0::DOUBLE, l_quantity - 25, l_discount * 100 - 5, l_tax * 100 - 4, l_extendedprice / 1000 - 25] AS v FROM lineitem)
SELECT fold, l_returnflag, i::INTEGER AS i, j::INTEGER AS j, round(sum(v[i + 1] * v[j + 1]), 3) AS total FROM o, range(5) a(i), range(5) b(j) WHERE i <= j GROUP BY 1, 2, 3, 4""")
def moment_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of products of the lines' columns by fold and return flag: all that a ridge screen needs of them."""
    lines = table(spark, d, "lineitem").withColumns({"fold": (F.col("l_orderkey") % 4).cast("int"), "a": F.col("l_discount") * 100, "b": F.col("l_tax") * 100, "y": F.col("l_extendedprice") / 1000})
    return screens.product_sums(lines, ["l_quantity", "a", "b"], "y", ["fold", "l_returnflag"], [25.0, 5.0, 4.0, 25.0]).withColumn("total", F.round("total", 3))


@query(None)
def source_aware_screen(spark: SparkSession, d: str) -> DataFrame:
    """Three ways to treat sources, with few and many columns: 12 candidates, out of fold and apparent."""
    names = [f"e{k}" for k in range(64)]
    rows = table(spark, d, "embeddings").withColumns({"fold": (F.col("label") % 3).cast("int"), "stage": (F.col("label") % 6) * 20.0, "source": F.concat(F.lit("s"), F.col("vec_id") % 4)} | {n: F.col("embedding")[k] for k, n in enumerate(names)})
    some = [screens.Candidate(f"{n} columns, {sources}, {strength:g}", tuple(names[:n]), strength, sources) for n in (8, 64) for sources in (screens.POOLED, screens.INDICATORS, screens.CALIBRATED) for strength in (1.0, 50.0)]
    found = screens.screen(rows, some, "fold", "stage", "source", 0.0, 100.0)
    held, seen = (screens.screen_metrics(found, some, "stage", c) for c in ("out_of_fold", "apparent"))
    return rounded(held.join(seen.select("candidate", F.col("mae").alias("apparent_mae")), "candidate"), "mae", "rmse", "bias", "apparent_mae")


_LINES = "(SELECT (l_suppkey % 4)::INTEGER AS fold, l_returnflag AS class, [l_quantity, l_discount * 100, l_tax * 100, l_extendedprice / 1000, l_linenumber::DOUBLE, 1.0::DOUBLE] AS f FROM lineitem)"
LINE_FEATURES = ("quantity", "discount", "tax", "price", "position", "constant")


def graded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with six columns, their return flag as class, folds by supplier."""
    values = (F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice") / 1000, F.col("l_linenumber").cast("double"), F.lit(1.0))
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("fold"), F.col("l_returnflag").alias("class"), *(v.alias(n) for v, n in zip(values, LINE_FEATURES, strict=True)))


_SUMS = f"""t AS (SELECT held, class, k, count(*)::DOUBLE AS n, sum(f[k]) AS s, sum(f[k] * f[k]) AS q FROM {_LINES} l, range(4) h(held), range(1, 7) r(k) WHERE fold <> held GROUP BY 1, 2, 3),
p AS (SELECT held, k, sum(n) AS n, count(*) AS c, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM t GROUP BY 1, 2),
x AS (SELECT held AS fold, ['quantity', 'discount', 'tax', 'price', 'position', 'constant'][k] AS feature, CASE WHEN q - b > 1e-9 * q THEN (b - s * s / n) / (c - 1) / ((q - b) / (n - c)) END AS f_score, greatest(0, q / n - s * s / n / n) AS variance FROM p)"""


@query(f"""WITH {_SUMS} SELECT fold, feature, round(f_score, 4) AS f_score, round(variance, 5) AS variance, row_number() OVER (PARTITION BY fold ORDER BY round(f_score, 4) DESC NULLS LAST, feature) <= 3 AS by_f,
  row_number() OVER (PARTITION BY fold ORDER BY round(variance, 5) DESC, feature) <= 2 AS by_variance FROM x""")
def fold_features(spark: SparkSession, d: str) -> DataFrame:
    """The columns that each fold's training rows choose, by F score and by variance."""
    scores = selection.fold_scores(graded_lines(spark, d), LINE_FEATURES, "fold", "class").withColumns({"f_score": F.round("f_score", 4), "variance": F.round("variance", 5)})
    return selection.chosen(selection.chosen(scores, "f_score", 3, "by_f"), "variance", 2, "by_variance")


@query(None)
def aligned_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold class probabilities by columns chosen inside folds, over preset classes of which folds may lack some and all lack one."""
    names = [f"e{k}" for k in range(64)]
    rows = table(spark, d, "embeddings").withColumns({"fold": (F.col("label") % 3).cast("int"), "band": F.when(F.col("vec_id") % 2 == 0, F.col("label") % 4).otherwise(1)} | {n: F.col("embedding")[k] for k, n in enumerate(names)})
    out = selection.selected_out_of_fold(rows, names, "fold", "band", classes=(0, 1, 2, 3, 4), columns=8)
    return out.select("vec_id", "fold", "band", F.transform("probabilities", lambda p: F.round(p, 4)).alias("probabilities"), "predicted")


_DRAWS = "list_transform(range(0, 201), lambda b: CASE WHEN b = 0 THEN 1 ELSE list_sum(list_transform([0.36787944117144233::DOUBLE, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119], lambda t: (('0x' || left(md5('7:' || b || ':' || unit), 8))::BIGINT / 4294967296.0::DOUBLE >= t)::INTEGER)) END)"


@query(f"""WITH r AS (SELECT source || '-' || n_chars % 50 AS unit, round(least(1::DOUBLE, n_chars / 8000.0::DOUBLE), 4) AS p, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
u AS (SELECT unit, {_DRAWS} AS w FROM (SELECT DISTINCT unit FROM r)),
d AS (SELECT b, p, sum(w[b + 1] * y)::DOUBLE AS pos, sum(w[b + 1] * (1 - y))::DOUBLE AS neg FROM r JOIN u USING (unit), range(0, 201) t(b) GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER s - pos AS above, sum(pos) OVER s / nullif(sum(pos + neg) OVER s, 0) AS prec FROM d WINDOW s AS (PARTITION BY b ORDER BY p DESC)),
m AS (SELECT b, sum(pos) AS ps, sum(neg) AS ns, sum(neg * (above + pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc, sum(pos * prec) / nullif(sum(pos), 0) AS average_precision,
  sum(pos) FILTER (p >= 0.1) / nullif(sum(pos), 0) AS recall, sum(pos) FILTER (p >= 0.1) / nullif(sum(pos + neg) FILTER (p >= 0.1), 0) AS precision, sum(neg) FILTER (p < 0.1) / nullif(sum(neg), 0) AS specificity FROM c GROUP BY 1),
l AS (UNPIVOT (SELECT b, auroc, average_precision, recall, precision, specificity, (recall + specificity) / 2 AS balanced_accuracy FROM m WHERE ps > 0 AND ns > 0) ON auroc, average_precision, recall, precision, specificity, balanced_accuracy INTO NAME metric VALUE v)
SELECT metric, 'estimated' AS status, round(max(v) FILTER (b = 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (b > 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (b > 0), 6) AS high, count(*) FILTER (b > 0) AS resamples FROM l GROUP BY 1""")
def metric_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Ranking and threshold metrics of documents' lengths as scores of quality, with intervals over 200 draws of their groups."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").filter("quality is not null")
    rows = docs.select(F.concat_ws("-", "source", (F.col("n_chars") % 50).cast("string")).alias("unit"), F.least(F.lit(1.0), F.col("n_chars") / F.lit(8000.0)).alias("p"), F.col("quality").alias("y"))
    return rounded(resample.metric_intervals(rows, "unit", F.col("p"), F.col("y"), 0.1, seed=7, digits=4), "estimate", "low", "high")
