"""Queries that audit features, crops, splits and candidates, and pick what people look at."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import reasons
from tessera.operators import audits, cohorts
from tessera.operators import reviews as rev
from tessera.operators.rank import review_queue
from tessera.operators.states import route
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT event_type, key, count(*) AS "rows" FROM (SELECT event_type, unnest(json_keys(props::JSON)) AS key FROM events UNION ALL SELECT event_type, 'extra_' || event_type FROM events) WHERE key NOT IN ('k', 'extra_view') GROUP BY 1, 2""")
def feature_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Features in JSON maps that nobody approved."""
    events = table(spark, d, "events")
    maps = F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map(F.concat(F.lit("extra_"), "event_type"), F.lit(1).cast("bigint")))
    keys = events.select("event_type", F.explode(F.map_keys(maps)).alias("key"))
    return keys.filter(~F.col("key").isin("k", "extra_view")).groupBy("event_type", "key").agg(F.count("*").alias("rows"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 'change_score' WHEN l_discount > 0.06 THEN 'allow_as_moderate' ELSE 'flag_score_review' END AS action, CASE WHEN l_discount > 0.08 THEN round(l_tax * 10, 2) END AS new_score,
CASE WHEN l_discount <= 0.08 AND l_discount > 0.06 THEN 'moderate' END AS recovered_as FROM lineitem WHERE l_discount > 0.06 OR l_returnflag = 'R'""")
def review_actions(spark: SparkSession, d: str) -> DataFrame:
    """Flagged lines by what was decided: new scores, recovered anchors, cases to look at again."""
    x = F.col("l_discount")
    action = F.when(x > 0.08, "change_score").when(x > 0.06, "allow_as_moderate").otherwise("flag_score_review")
    rows = table(spark, d, "lineitem").filter((x > 0.06) | (F.col("l_returnflag") == "R")).withColumn("action", action)
    return rows.select(
        "l_orderkey", "l_linenumber", "action", F.when(F.col("action") == "change_score", F.round(F.col("l_tax") * 10, 2)).alias("new_score"),
        F.when(F.col("action").startswith("allow_as_"), F.substring("action", 10, 100)).alias("recovered_as"),
    )


@query("""WITH a AS (SELECT user_id, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS said FROM events WHERE value > 250 GROUP BY 1)
SELECT c_custkey, CASE WHEN said LIKE '%purchase%' THEN true WHEN said LIKE '%error%' THEN false ELSE c_acctbal >= 5000 END AS severe, CASE WHEN CASE WHEN said LIKE '%purchase%' THEN true WHEN said LIKE '%error%' THEN false ELSE c_acctbal >= 5000 END THEN 80::DOUBLE ELSE 0 END AS stage FROM customer LEFT JOIN a ON user_id = c_custkey""")
def adjudicated_targets(spark: SparkSession, d: str) -> DataFrame:
    """Labels from what reviewers said, else from the score."""
    said = table(spark, d, "events").filter("value > 250").groupBy(F.col("user_id").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("said"))
    rows = table(spark, d, "customer").join(said, "c_custkey", "left")
    severe = F.when(F.col("said").contains("purchase"), True).when(F.col("said").contains("error"), False).otherwise(F.col("c_acctbal") >= 5000)
    return rows.select("c_custkey", severe.alias("severe"), F.when(severe, 80.0).otherwise(0.0).alias("stage"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'hash_mismatch' END, CASE WHEN l_linenumber * 10 + l_quantity > 100 THEN 'box_outside_image' END, CASE WHEN l_tax = 0 AND l_discount > 0.05 THEN 'label_status_mismatch' END) AS errors FROM lineitem
WHERE (l_returnflag = 'N' AND l_linestatus = 'F') OR l_linenumber * 10 + l_quantity > 100 OR (l_tax = 0 AND l_discount > 0.05)""")
def negative_crops(spark: SparkSession, d: str) -> DataFrame:
    """Crops that break a rule of their manifest."""
    c = F.col
    rules = [((c("l_returnflag") == "N") & (c("l_linestatus") == "F"), "hash_mismatch"), (c("l_linenumber") * 10 + c("l_quantity") > 100, "box_outside_image"), ((c("l_tax") == 0) & (c("l_discount") > 0.05), "label_status_mismatch")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(reasons(rules), ";").alias("errors")).filter("errors <> ''")


@query("""SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax, count(*) AS n_images, min(l_returnflag) AS first_flag FROM lineitem GROUP BY 1""")
def subject_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of all feature columns a subject, however many, with its number of images, in one aggregation."""
    lines = table(spark, d, "lineitem")
    features = [f.name for f in lines.schema.fields if f.dataType.typeName() == "double" and f.name != "l_extendedprice"]
    return lines.groupBy("l_suppkey").agg(*(F.round(F.avg(c), 6).alias(c) for c in features), F.count("*").alias("n_images"), F.min("l_returnflag").alias("first_flag"))


@query("""WITH m AS (SELECT l_suppkey, l_linestatus AS model, avg(abs(l_discount - 0.05)) AS mae, count(*) FILTER (l_tax = 0) AS warned, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT l_suppkey % 3 AS level, *, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY round(mae, 9), l_suppkey, model) AS k FROM m)
SELECT level, count(*) AS candidates, sum(warned)::BIGINT AS warned, max(CASE WHEN k = 1 THEN l_suppkey END) AS best, max(CASE WHEN k = 1 THEN model END) AS best_model, round(max(CASE WHEN k = 1 THEN mae END), 6) AS best_mae FROM r GROUP BY 1""")
def precision_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The most precise candidate of each level, and how many were warned about."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linestatus").alias("model")).agg(F.avg(F.abs(F.col("l_discount") - 0.05)).alias("mae"), F.count_if(F.col("l_tax") == 0).alias("warned"))
    best = F.min_by(F.struct("l_suppkey", "model", "mae"), F.struct(F.round("mae", 9), "l_suppkey", "model")).alias("b")
    out = m.groupBy((F.col("l_suppkey") % 3).alias("level")).agg(F.count("*").alias("candidates"), F.sum("warned").alias("warned"), best)
    return out.select("level", "candidates", "warned", F.col("b.l_suppkey").alias("best"), F.col("b.model").alias("best_model"), F.round("b.mae", 6).alias("best_mae"))


@query("""WITH w AS (SELECT lang, unnest(string_split(lang || ';' || source || '; ' || CASE WHEN n_chars > 3000 THEN 'long' ELSE '' END, ';')) AS label FROM documents) SELECT trim(label) AS label, count(*) AS "rows" FROM w WHERE trim(label) <> '' GROUP BY 1""")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels that reviewers listed with semicolons, counted."""
    words = F.split(F.concat("lang", F.lit(";"), "source", F.lit("; "), F.when(F.col("n_chars") > 3000, "long").otherwise("")), ";")
    rows = table(spark, d, "documents").select(F.explode(F.transform(words, lambda w: F.trim(w))).alias("label")).filter("label <> ''")
    return rows.groupBy("label").agg(F.count("*").alias("rows"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'early' WHEN l_linenumber <= 4 THEN 'middle' ELSE 'late' END AS family, l_discount * (l_tax - 0.04) AS v FROM lineitem) SELECT l_orderkey, family, round(sum(v), 6) AS contribution FROM c GROUP BY 1, 2""")
def family_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of features summed by their family."""
    family = route([(F.col("l_linenumber") <= 2, "early"), (F.col("l_linenumber") <= 4, "middle")], "late")
    rows = table(spark, d, "lineitem").select("l_orderkey", family.alias("family"), (F.col("l_discount") * (F.col("l_tax") - 0.04)).alias("v"))
    return rows.groupBy("l_orderkey", "family").agg(F.round(F.sum("v"), 6).alias("contribution"))


_CROPS = """c AS (SELECT l_suppkey, l_orderkey, CASE WHEN l_quantity < 5 THEN 'background' WHEN l_linenumber IN (1, 7) THEN 'boundary' ELSE 'positive' END AS category, l_quantity / 50 AS share FROM lineitem)"""


@query(f"""WITH {_CROPS} SELECT l_suppkey, count(*) AS crops, count(DISTINCT l_orderkey) AS images, count(*) FILTER (category = 'background') AS background, count(*) FILTER (category = 'boundary') AS boundary, count(*) FILTER (category = 'positive') AS positive,
round(avg(share), 6) AS mean_share, concat_ws('|', CASE WHEN count(*) FILTER (category = 'background') < 48 THEN 'too_few_background' END, CASE WHEN count(DISTINCT l_orderkey) < 580 THEN 'too_few_images' END) AS reasons FROM c GROUP BY 1""")
def crop_audit(spark: SparkSession, d: str) -> DataFrame:
    """Categories, images and shares of a supplier's crops, and what they lack."""
    category = route([(F.col("l_quantity") < 5, "background"), (F.col("l_linenumber").isin(1, 7), "boundary")], "positive")
    out = audits.crop_audit(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", category, F.col("l_quantity") / 50, ("background", "boundary", "positive"), {"background": 48}, 580)
    return out.withColumn("mean_share", F.round("mean_share", 6))


@query(f"""WITH {_CROPS} SELECT l_suppkey, round(avg(share) FILTER (category <> 'background'), 6) AS shape_mean, round(avg(abs(share - 0.5)) FILTER (category <> 'background'), 6) AS ratio_error, round(avg(share) FILTER (category = 'background'), 6) AS background_mean FROM c GROUP BY 1""")
def screen_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Means over positive and boundary crops, and over background ones."""
    category = route([(F.col("l_quantity") < 5, "background"), (F.col("l_linenumber").isin(1, 7), "boundary")], "positive")
    crops = table(spark, d, "lineitem").select("l_suppkey", category.alias("category"), (F.col("l_quantity") / 50).alias("share"))
    shape, back = F.col("category") != "background", F.col("category") == "background"
    return crops.groupBy("l_suppkey").agg(
        F.round(F.avg(F.when(shape, F.col("share"))), 6).alias("shape_mean"), F.round(F.avg(F.when(shape, F.abs(F.col("share") - 0.5))), 6).alias("ratio_error"), F.round(F.avg(F.when(back, F.col("share"))), 6).alias("background_mean")
    )


@query("""WITH m AS (SELECT l_suppkey, sum(l_quantity) AS t, sum(50)::DOUBLE AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, unnest(['all_background', 'all_foreground']) AS method, unnest([CASE WHEN t > 0 THEN 0 ELSE 1 END, round(2 * t / (t + n), 6)])::DOUBLE AS dice, unnest([CASE WHEN t > 0 THEN 0 ELSE 1 END, round(t / n, 6)])::DOUBLE AS jaccard FROM m""")
def trivial_baselines(spark: SparkSession, d: str) -> DataFrame:
    """What guessing nothing and guessing everything reach on a supplier's pooled pixels."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("t"), F.sum(F.lit(50.0)).alias("n"))
    none = F.when(F.col("t") > 0, 0.0).otherwise(1.0)
    rows = F.array(
        F.struct(F.lit("all_background").alias("method"), none.alias("dice"), none.alias("jaccard")),
        F.struct(F.lit("all_foreground").alias("method"), F.round(2 * F.col("t") / (F.col("t") + F.col("n")), 6).alias("dice"), F.round(F.col("t") / F.col("n"), 6).alias("jaccard")),
    )
    return m.select("l_suppkey", F.explode(rows).alias("r")).select("l_suppkey", "r.*")


@query("""WITH e AS (SELECT *, user_id * 100 + day(ts) AS session FROM events), v AS (SELECT session, event_type, min(event_id) AS first FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY (event_type = 'purchase') DESC, event_type) AS k FROM v) SELECT session, event_type AS view, first FROM r WHERE k = 1""")
def primary_view(spark: SparkSession, d: str) -> DataFrame:
    """Each user's and day's preferred view if there is one, else the first by name."""
    events = table(spark, d, "events").withColumn("session", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return audits.preferred(events, ["session"], "event_type", "purchase", "event_id")


@query("""WITH d AS (SELECT doc_id, source, n_chars, abs(n_chars - 2500) AS e FROM documents),
a AS (SELECT doc_id, 'large' AS bucket, 100 + row_number() OVER (ORDER BY n_chars DESC, doc_id) AS priority FROM d ORDER BY n_chars DESC, doc_id LIMIT 18), b AS (SELECT doc_id, 'near' AS bucket, 200 + row_number() OVER (ORDER BY e, doc_id) AS priority FROM d ORDER BY e, doc_id LIMIT 10),
t AS (SELECT doc_id, 'source_top' AS bucket, 0 + row_number() OVER (ORDER BY source) AS priority FROM (SELECT source, arg_max(doc_id, struct_pack(a := n_chars, b := -doc_id)) AS doc_id FROM d GROUP BY 1))
SELECT doc_id, bucket, priority::INTEGER AS priority FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM t)""")
def triage_queue(spark: SparkSession, d: str) -> DataFrame:
    """Cases for review from three buckets, each with its range of priorities: the top of each source, the largest, those nearest the middle."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    size, near = [F.desc("n_chars"), F.col("doc_id")], [F.abs(F.col("n_chars") - 2500), F.col("doc_id")]
    top = docs.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))

    def bucket(rows: DataFrame, name: str, order: list, start: int) -> DataFrame:
        return rows.select("doc_id", F.lit(name).alias("bucket"), (F.row_number().over(W.orderBy(*order)) + start).alias("priority"))  # a few rows

    return bucket(docs.orderBy(*size).limit(18), "large", size, 100).unionByName(bucket(docs.orderBy(*near).limit(10), "near", near, 200)).unionByName(bucket(top, "source_top", [F.col("source")], 0))


@query("""WITH v AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS "column", unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem), s AS (SELECT "column", var_pop(x) AS var FROM v GROUP BY 1) SELECT "column", round(var, 4) AS variance FROM s ORDER BY var DESC LIMIT 2""")
def top_variance(spark: SparkSession, d: str) -> DataFrame:
    """The columns that vary most."""
    found = rev.usable_columns(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return found.orderBy(F.desc("variance"), "column").limit(2).select("column", F.round("variance", 4).alias("variance"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, 25 - l_linenumber * 7 AS y FROM lineitem), a AS (SELECT *, CASE WHEN atan2(x, y) < -1e-12 THEN atan2(x, y) + 2 * pi() ELSE atan2(x, y) END AS t FROM (SELECT DISTINCT * FROM p))
SELECT l_orderkey, l_linenumber, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(t, 9), round(sqrt(x * x + y * y), 9), l_linenumber)::INTEGER AS component FROM a""")
def component_order(spark: SparkSession, d: str) -> DataFrame:
    """Components of an image numbered by their angle from the top, then their distance from the middle."""
    points = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("x"), (25 - F.col("l_linenumber") * 7).alias("y")).distinct()
    angle = F.atan2(F.col("x"), F.col("y").cast("double"))
    around = F.when(angle < -1e-12, angle + 2 * math.pi).otherwise(angle)
    order = W.partitionBy("l_orderkey").orderBy(F.round(around, 9), F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 9), "l_linenumber")
    return points.select("l_orderkey", "l_linenumber", "x", F.row_number().over(order).alias("component"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, greatest(0, l_linenumber * 10 - 4) AS x0, greatest(0, l_quantity - 4) AS y0, least(75, l_linenumber * 10 + 12) AS x1, least(60, l_quantity + 12) AS y1, l_quantity AS area FROM lineitem WHERE l_quantity BETWEEN 8 AND 45),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, x0, -area, l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM b)
SELECT l_orderkey, l_linenumber, x0, y0, x1, y1, k::INTEGER AS box, CASE WHEN n > 3 THEN 'overflow' ELSE 'ok' END AS decision FROM r WHERE k <= 3""")
def proposal_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of fair size, padded within the image, in reading order, at most three an image."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    boxes = table(spark, d, "lineitem").filter(q.between(8, 45)).select(
        "l_orderkey", "l_linenumber", F.greatest(F.lit(0), n * 10 - 4).alias("x0"), F.greatest(F.lit(0.0), q - 4).alias("y0"), F.least(F.lit(75), n * 10 + 12).alias("x1"), F.least(F.lit(60.0), q + 12).alias("y1"), q.alias("area")
    )
    order = W.partitionBy("l_orderkey").orderBy("y0", "x0", -F.col("area"), "l_linenumber")
    counts = boxes.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    kept = boxes.withColumn("box", F.row_number().over(order)).filter("box <= 3").join(counts, "l_orderkey")
    return kept.select("l_orderkey", "l_linenumber", "x0", "y0", "x1", "y1", "box", F.when(F.col("n") > 3, "overflow").otherwise("ok").alias("decision"))


@query("""WITH g AS (SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_orderkey::VARCHAR)), ';') AS ids FROM lineitem WHERE l_discount = 0.1 GROUP BY 1)
SELECT l_suppkey, 'anchor' AS origin, unnest(string_split(ids, ';'))::BIGINT AS row_id FROM g UNION ALL SELECT l_suppkey, 'recovered', l_orderkey FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_tax = 0.08 AND l_returnflag = 'R')""")
def anchor_records(spark: SparkSession, d: str) -> DataFrame:
    """Anchors' listed rows one by one, with the recovered ones."""
    lines = table(spark, d, "lineitem")
    listed = lines.filter("l_discount = 0.1").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_orderkey").cast("string"))), ";").alias("ids"))
    anchors = listed.select("l_suppkey", F.lit("anchor").alias("origin"), F.explode(F.split("ids", ";").cast("array<bigint>")).alias("row_id"))
    return anchors.unionByName(lines.filter("l_tax = 0.08 and l_returnflag = 'R'").select("l_suppkey", F.lit("recovered").alias("origin"), F.col("l_orderkey").alias("row_id")).distinct())


@query("""WITH t AS (SELECT l_suppkey, max(l_discount) AS selected, min(l_tax) AS low FROM lineitem WHERE l_linenumber = 7 GROUP BY 1), s AS (SELECT DISTINCT l_suppkey FROM lineitem)
SELECT s.l_suppkey, CASE WHEN s.l_suppkey % 7 = 0 THEN 'explicit' WHEN selected >= 0.1 THEN 'validation_derived' ELSE 'fixed_default' END AS policy, CASE WHEN s.l_suppkey % 7 = 0 THEN 0.75 WHEN selected >= 0.1 THEN selected ELSE 0.5 END::DOUBLE AS threshold FROM s LEFT JOIN t USING (l_suppkey)""")
def threshold_policy(spark: SparkSession, d: str) -> DataFrame:
    """An explicit threshold counts first, then one derived from validation, then the fixed one."""
    lines = table(spark, d, "lineitem")
    per = lines.groupBy("l_suppkey").agg(F.max(F.when(F.col("l_linenumber") == 7, F.col("l_discount"))).alias("selected"))
    explicit, derived = F.col("l_suppkey") % 7 == 0, F.col("selected") >= 0.1
    return per.select("l_suppkey", route([(explicit, "explicit"), (derived, "validation_derived")], "fixed_default").alias("policy"), F.when(explicit, 0.75).when(derived, F.col("selected")).otherwise(0.5).alias("threshold"))


@query("""WITH u AS (SELECT user_id, count(*) AS images, (user_id * 7919) % 1009 AS k FROM events GROUP BY 1), c AS (SELECT *, sum(images) OVER (ORDER BY k, user_id) - images AS before, row_number() OVER (ORDER BY k, user_id) AS place, count(*) OVER () AS n, sum(images) OVER () AS total FROM u)
SELECT user_id, images, CASE WHEN before < greatest(1, round_even(total * 0.2, 0)) AND place < n THEN 'validation' ELSE 'training' END AS split FROM c""")
def training_split(spark: SparkSession, d: str) -> DataFrame:
    """Users in a fixed shuffled order go to validation until it holds a fifth of the images; one is always left for training."""
    return audits.subject_split(table(spark, d, "events"), "user_id", (F.col("user_id") * 7919) % 1009, 0.2)


@query("""WITH l AS (SELECT *, l_orderkey % 1500 AS batch FROM lineitem), b AS (SELECT batch, count(*) FILTER (l_linenumber > 6) AS odd, abs(avg(l_quantity) FILTER (l_linestatus = 'F') - avg(l_quantity) FILTER (l_linestatus = 'O')) / 50 AS delta,
greatest(abs(min(l_quantity) FILTER (l_linestatus = 'F') - min(l_quantity) FILTER (l_linestatus = 'O')), abs(max(l_quantity) FILTER (l_linestatus = 'F') - max(l_quantity) FILTER (l_linestatus = 'O'))) AS shift, median(l_discount) AS burden FROM l GROUP BY 1)
SELECT batch, concat_ws('|', CASE WHEN odd > 0 THEN 'unexpected_values' END, CASE WHEN delta > 0.1 THEN 'area_changed' END, CASE WHEN shift > 4 THEN 'markers_moved' END, CASE WHEN burden > 0.05 THEN 'foreground_burden' END) AS reasons, round(delta, 6) AS delta, shift FROM b""")
def transform_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether values, areas and markers of finished and open lines agree, and the median burden."""
    lines = table(spark, d, "lineitem").withColumn("batch", F.col("l_orderkey") % 1500)
    out = audits.transform_audit(lines, "batch", F.col("l_quantity"), F.col("l_linestatus"), "F", "O", F.col("l_linenumber") > 6, F.col("l_discount"), 50, 0.1, 4, 0.05)
    return out.select("batch", "reasons", F.round("delta", 6).alias("delta"), "shift")


@query("""WITH e AS (SELECT user_id * 100 + day(ts) AS session, list(DISTINCT event_type) AS seen FROM events GROUP BY 1)
SELECT session, 'insufficient_data' AS verdict, 'missing_' || k AS blocker, 'scope:' || session AS scope FROM e, (SELECT unnest(['click', 'error', 'purchase', 'refund']) AS k) WHERE NOT list_contains(seen, k)""")
def hard_blockers(spark: SparkSession, d: str) -> DataFrame:
    """What a user's day lacks, each as a blocker with its scope and the verdict."""
    events = table(spark, d, "events").withColumn("session", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return audits.hard_blockers(events, "session", F.col("event_type"), ("click", "error", "purchase", "refund"))

_CASES = "(SELECT doc_id, doc_id // 2 AS image, n_chars % 5 AS cluster, least(1::DOUBLE, n_chars / 4000.0::DOUBLE) AS p, quality = 0 AND toxic = 0 AS wrong, toxic = 1 AS missing, quality = 1 AND n_chars > 3000 AS severe FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH d AS {_CASES}, w AS (SELECT * FROM d WHERE wrong),
q AS (SELECT arg_min(doc_id, struct_pack(a := -p, b := doc_id)) AS doc_id, arg_min(image, struct_pack(a := -p, b := doc_id)) AS image, 'cluster_representative_false_positive' AS review_bucket, 10 + cluster AS review_priority, cluster, count(*) AS cluster_size FROM w GROUP BY cluster
  UNION ALL SELECT doc_id, image, 'highest_confidence_false_positive', 99 + r, cluster, NULL FROM (SELECT *, row_number() OVER (ORDER BY p DESC, doc_id) AS r FROM w) WHERE r <= 18
  UNION ALL SELECT doc_id, image, 'threshold_boundary_false_positive', 199 + r, cluster, NULL FROM (SELECT *, row_number() OVER (ORDER BY abs(p - 0.5), doc_id) AS r FROM w) WHERE r <= 10
  UNION ALL SELECT doc_id, image, 'segmentation_miss', 299 + row_number() OVER (ORDER BY doc_id), NULL, NULL FROM d WHERE missing
  UNION ALL SELECT doc_id, image, 'human_severe_reference', 399 + row_number() OVER (ORDER BY doc_id), NULL, NULL FROM d WHERE severe)
SELECT f.doc_id, image, review_bucket, f.review_priority, f.cluster, f.cluster_size FROM (SELECT image, review_bucket, arg_min(q, struct_pack(a := review_priority, b := doc_id)) AS f FROM q GROUP BY 1, 2)""")
def overcall_queue(spark: SparkSession, d: str) -> DataFrame:
    """Cases for review from five buckets, an image once a bucket."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", F.floor(F.col("doc_id") / 2).alias("image"), (F.col("n_chars") % 5).alias("cluster"), F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)).alias("p"), "quality", "toxic", "n_chars"
    )
    wrong, severe = (F.col("quality") == 0) & (F.col("toxic") == 0), (F.col("quality") == 1) & (F.col("n_chars") > 3000)
    return review_queue(rows, "doc_id", "image", "p", wrong, F.col("toxic") == 1, severe, "cluster")


_TASKS = """o AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'T' || o_orderkey WHEN 1 THEN ' t-' || o_orderkey ELSE 'M' || o_orderkey END AS sample, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS score FROM orders),
dec AS (SELECT k::VARCHAR AS t, 'img/' || k AS image_path FROM o WHERE k % 3 > 0), sc AS (SELECT k::VARCHAR AS t, 'n' || k AS image_name, sample, score FROM o WHERE k % 7 > 1)"""


@query(f"""WITH {_TASKS}
SELECT 'dox' AS cohort_id, d.t AS source_score_row, image_path, score, CASE WHEN score IS NULL THEN 'pending_discovery' ELSE 'joined' END AS join_status, CASE WHEN score IS NULL THEN 'pending_discovery' ELSE 'pending' END AS verification_status,
  CASE WHEN score IS NULL THEN 'unresolved' ELSE 'pending' END AS admission_status, CASE WHEN score IS NULL THEN 'missing_score' ELSE '' END AS exclusion_reason, 'manual_mask_external' AS lane_assignment, NULL AS source_sample_id FROM dec d LEFT JOIN sc USING (t)
UNION ALL SELECT 'dox', t, '', score, CASE WHEN f THEN 'foreign_row' ELSE 'pending_discovery' END, CASE WHEN f THEN 'excluded' ELSE 'pending_discovery' END, CASE WHEN f THEN 'foreign' ELSE 'unresolved' END,
  CASE WHEN f THEN 'foreign_mixed_export_row' ELSE 'not_materialized_in_decoded_brushlabel_surface' END, 'scored_only', trim(sample) FROM (SELECT *, upper(regexp_extract(trim(sample), '^[A-Za-z]*')) = 'T' AS f FROM sc WHERE t NOT IN (SELECT t FROM dec))""")
def decoded_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Decoded masks beside the scores of their tasks, and scores without a mask."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    sample = F.when(k % 4 == 0, F.concat(F.lit("T"), k)).when(k % 4 == 1, F.concat(F.lit(" t-"), k)).otherwise(F.concat(F.lit("M"), k))
    decoded = orders.filter(k % 3 > 0).select(F.lit("dox").alias("cohort_id"), k.alias("source_score_row"), F.concat(F.lit("img/"), k).alias("image_path"))
    scores = orders.filter(k % 7 > 1).select(k.alias("task_id"), F.concat(F.lit("n"), k).alias("image_name"), sample.alias("source_sample_id"), F.when(k % 5 > 0, F.col("o_totalprice")).alias("score"), F.lit("ok").alias("score_status"))
    out = cohorts.decoded_cohort(decoded, scores, "dox", "export.json", "scores.csv", ["latest_export", "decoded_masks"])
    return out.select("cohort_id", "source_score_row", "image_path", "score", "join_status", "verification_status", "admission_status", "exclusion_reason", "lane_assignment", "source_sample_id")


@query("""SELECT 'img/' || o_orderkey AS source_image_path, 'n' || o_orderkey AS source_image_name, o_orderkey::VARCHAR AS source_score_row, o_totalprice AS score, 'manual_mask_core' AS lane_assignment, 'runtime;annotations' AS discovery_surfaces FROM orders WHERE o_orderkey % 3 > 0 AND o_orderstatus <> 'P'""")
def scored_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Scored images that joined, as manifest rows."""
    k = F.col("o_orderkey")
    scores = table(spark, d, "orders").select(
        F.concat(F.lit("img/"), k).alias("raw_image_path"), F.lit(None).cast("string").alias("raw_mask_path"), F.concat(F.lit("n"), k).alias("image_name"), k.cast("string").alias("image_stem"), k.cast("string").alias("source_task_id"), F.col("o_totalprice").alias("score"),
        F.when(k % 3 > 0, "ok").otherwise("missing_mask").alias("join_status"), F.when(F.col("o_orderstatus") != "P", "ok").alias("score_status"),
    )
    out = cohorts.scored_cohort(scores, "annotations.json", "scores.csv", ["runtime", "annotations"])
    return out.select("source_image_path", "source_image_name", "source_score_row", "score", "lane_assignment", "discovery_surfaces")
