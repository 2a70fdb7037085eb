"""Queries that build the tables others read: inventories, score tables, example tables, guarded merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.text import clean, flag, is_missing
from tessera.operators import folds, joins
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


@query("""SELECT d.doc_id, quality, toxic, l.doc_id IS NOT NULL AS found, 'joined' AS status FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'duplicate_keys' FROM documents UNION ALL SELECT doc_id, NULL, NULL, NULL, 'missing_keys' FROM documents UNION ALL SELECT doc_id, NULL, NULL, NULL, 'absent' FROM documents""".replace("l.doc_id IS NOT NULL AS found", "CASE WHEN l.doc_id IS NOT NULL THEN true END AS found"))
def optional_merges(spark: SparkSession, d: str) -> DataFrame:
    """Documents merged with labels, and left as they are where the other table repeats keys, lacks them or is absent."""
    docs, marks = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").withColumn("found", F.lit(True))
    out = None
    for other in (marks, marks.unionByName(marks), marks.withColumnRenamed("doc_id", "id"), None):
        merged, status = joins.optional_merge(docs, other, ["doc_id"], "label_")
        rows = merged.withColumn("status", F.lit(status))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


@query("""SELECT user_id FROM events WHERE value > 150 INTERSECT SELECT user_id FROM events WHERE value <= 150""")
def leaking_groups(spark: SparkSession, d: str) -> DataFrame:
    """Users on both sides of a split by value."""
    events = table(spark, d, "events")
    return folds.leaking_groups(events.filter("value > 150"), events.filter("value <= 150"), "user_id")


_TEXTS = """CASE event_type WHEN 'click' THEN ' Yes' WHEN 'view' THEN '0' WHEN 'error' THEN 'TRUE' WHEN 'signup' THEN 'maybe' ELSE '' END AS word, CASE WHEN value > 300 THEN '' ELSE 'fam' || (user_id % 5) END AS family, '[' || user_id || ', ' || round(value, 1) || ']' AS box"""


@query(f"""WITH r AS (SELECT event_id, {_TEXTS} FROM events)
SELECT event_id, family, CASE lower(trim(word)) WHEN 'yes' THEN true WHEN 'true' THEN true ELSE false END AS needs_correction, '[' || split_part(trim(box, '[]'), ', ', 1) || ', ' || trunc(split_part(trim(box, '[]'), ', ', 2)::DOUBLE)::BIGINT || ']' AS crop_box FROM r WHERE trim(family) <> ''""")
def adjudication_rows(spark: SparkSession, d: str) -> DataFrame:
    """Review rows from text: flags, boxes, and only those whose keys are given."""
    kind, user = F.col("event_type"), F.col("user_id")
    word = route([(kind == "click", " Yes"), (kind == "view", "0"), (kind == "error", "TRUE"), (kind == "signup", "maybe")], "")
    rows = table(spark, d, "events").select(
        "event_id", word.alias("word"), F.when(F.col("value") > 300, "").otherwise(F.concat(F.lit("fam"), (user % 5).cast("string"))).alias("family"),
        F.concat(F.lit("["), user.cast("string"), F.lit(", "), F.round("value", 1).cast("string"), F.lit("]")).alias("box"),
    )
    return rows.filter(~is_missing(F.col("family"))).select("event_id", "family", flag(F.col("word")).alias("needs_correction"), paths.crop_box(F.col("box")).alias("crop_box"))


@query("""SELECT o_clerk AS release, count(*) AS "rows", count(*) FILTER (o_orderstatus = 'F') AS generated, max(o_orderdate) AS latest FROM (SELECT *, o_orderpriority AS o_clerk FROM orders) GROUP BY 1""")
def release_rows(spark: SparkSession, d: str) -> DataFrame:
    """A registry by release: rows, generated ones, the latest time."""
    orders = table(spark, d, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("release")).agg(F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("generated"), F.max("o_orderdate").alias("latest"))


@query("""WITH t AS (SELECT d.doc_id, source || '/M' || (n_chars % 30) || '_Image' || (n_chars % 4) || '.jpg' AS p, quality, n_chars FROM documents d LEFT JOIN labels USING (doc_id)),
x AS (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS name FROM t)
SELECT doc_id, name AS source_image_name, split_part(name, '_', 1) AS source_sample_id, doc_id::VARCHAR AS source_score_row, CASE WHEN n_chars % 3 = 0 THEN 'masks/' || name ELSE '' END AS mask_path, quality::DOUBLE AS score,
CASE WHEN quality IS NULL THEN 'pending_discovery' ELSE 'joined' END AS join_status, CASE WHEN quality IS NULL THEN 'unresolved' ELSE 'pending' END AS admission_status, CASE WHEN quality IS NULL THEN 'missing_score' ELSE '' END AS exclusion_reason, 'vehicle' AS treatment_group FROM x WHERE n_chars % 11 <> 0""")
def inventory_rows(spark: SparkSession, d: str) -> DataFrame:
    """A score table as manifest rows: names, samples, masks that exist, states; rows without an image are left out."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    rows = docs.withColumn("p", F.concat("source", F.lit("/M"), (n % 30).cast("string"), F.lit("_Image"), (n % 4).cast("string"), F.lit(".jpg"))).filter(n % 11 != 0)
    name = paths.file_name(F.col("p"))
    sample = F.substring_index(paths.file_stem(F.col("p")), "_", 1)
    missing = F.col("quality").isNull()
    return rows.select(
        "doc_id", name.alias("source_image_name"), sample.alias("source_sample_id"), F.col("doc_id").cast("string").alias("source_score_row"), F.when(n % 3 == 0, F.concat(F.lit("masks/"), name)).otherwise("").alias("mask_path"),
        F.col("quality").cast("double").alias("score"), F.when(missing, "pending_discovery").otherwise("joined").alias("join_status"), F.when(missing, "unresolved").otherwise("pending").alias("admission_status"),
        F.when(missing, "missing_score").otherwise("").alias("exclusion_reason"), paths.treatment_group(sample).alias("treatment_group"),
    )


@query("""WITH i AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F'), m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT o_orderkey, CASE WHEN i.l_orderkey IS NULL AND m.l_orderkey IS NULL THEN 'missing_image_and_mask' WHEN i.l_orderkey IS NULL THEN 'missing_image' WHEN m.l_orderkey IS NULL THEN 'missing_mask' ELSE 'ok' END AS join_status,
CASE WHEN o_totalprice > 100000 THEN 'ok' ELSE 'missing_score' END AS score_status, CASE WHEN i.l_orderkey IS NOT NULL AND m.l_orderkey IS NOT NULL AND o_totalprice > 100000 THEN 'pending' ELSE 'not_eligible' END AS roi_status
FROM orders LEFT JOIN i ON i.l_orderkey = o_orderkey LEFT JOIN m ON m.l_orderkey = o_orderkey""")
def scored_examples(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scored examples: which have an image and a mask, and which are ready for regions."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").withColumn("l_orderkey", F.col("o_orderkey"))
    rows = joins.membership_flag(orders, lines.filter("l_linestatus = 'F'"), ["l_orderkey"], "image")
    rows = joins.membership_flag(rows, lines.filter("l_returnflag = 'A'"), ["l_orderkey"], "mask")
    status = route([(~F.col("image") & ~F.col("mask"), "missing_image_and_mask"), (~F.col("image"), "missing_image"), (~F.col("mask"), "missing_mask")], "ok")
    scored = F.when(F.col("o_totalprice") > 100000, "ok").otherwise("missing_score")
    both = rows.select("o_orderkey", status.alias("join_status"), scored.alias("score_status"))
    return both.withColumn("roi_status", F.when((F.col("join_status") == "ok") & (F.col("score_status") == "ok"), "pending").otherwise("not_eligible"))


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 9 = 0 AND c_mktsegment < 'H' THEN ' ' ELSE c_name END AS nm, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey // 40 ELSE c_custkey END AS id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE NOT (c_mktsegment = 'MACHINERY' AND n_regionkey = 2))
SELECT c_mktsegment, string_agg(DISTINCT r_name, ';' ORDER BY r_name) AS regions, count(*) AS customers, count(DISTINCT trim(nm)) AS subjects, count(*) FILTER (trim(nm) = '') AS blank, count(*) = count(DISTINCT id) AS unique_rows FROM c GROUP BY 1""")
def grouping_identity(spark: SparkSession, d: str) -> DataFrame:
    """Rows, subjects and blank ones of each segment, and whether row ids are unique."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).filter("not (c_mktsegment = 'MACHINERY' and n_regionkey = 2)")
    name = clean(F.when((F.col("c_custkey") % 9 == 0) & (F.col("c_mktsegment") < "H"), " ").otherwise(F.col("c_name")))
    row = F.when(F.col("c_mktsegment") == "BUILDING", F.floor(F.col("c_custkey") / 40)).otherwise(F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(
        F.array_join(F.array_sort(F.collect_set("r_name")), ";").alias("regions"), F.count("*").alias("customers"), F.countDistinct(name).alias("subjects"), F.count_if(name == "").alias("blank"), (F.count("*") == F.countDistinct(row)).alias("unique_rows")
    )


@query("""WITH w AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size = 1 THEN 'Total' WHEN p_size < 4 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS glom FROM part)
SELECT try_cast(glom AS DOUBLE) AS glom, p_brand AS subject, split_part(p_brand, '#', 1) AS prefix, p_size::DOUBLE AS score FROM w WHERE glom NOT IN ('Total', 'Mean') AND try_cast(glom AS DOUBLE) IS NOT NULL""")
def cleaned_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A score matrix without summary rows and rows whose number is none."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").withColumn("glom", F.when(size == 1, "Total").when(size < 4, F.concat(F.lit("x"), key)).otherwise(key))
    kept = rows.filter(~F.col("glom").isin("Total", "Mean")).withColumn("glom", F.col("glom").try_cast("double")).filter("glom is not null")
    return kept.select("glom", F.col("p_brand").alias("subject"), F.split("p_brand", "#")[0].alias("prefix"), size.cast("double").alias("score"))


@query("""WITH x AS (SELECT page_id, lower(url) AS u FROM pages), c AS (SELECT page_id, unnest(list_filter([CASE WHEN u LIKE '%/en/%' THEN 'english' END, CASE WHEN regexp_matches(u, '/[0-9]+$') THEN 'numbered' END, CASE WHEN u LIKE 'http://%' THEN 'plain' END], lambda v: v IS NOT NULL)) AS claim FROM x) SELECT claim, count(*) AS lines, min(page_id) AS first_page FROM c GROUP BY 1""")
def claim_audit(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text by the claims that their words make."""
    u = F.lower("url")
    claims = F.array_compact(F.array(F.when(u.contains("/en/"), F.lit("english")), F.when(u.rlike("/[0-9]+$"), F.lit("numbered")), F.when(u.startswith("http://"), F.lit("plain"))))
    return table(spark, d, "pages").select("page_id", F.explode(claims).alias("claim")).groupBy("claim").agg(F.count("*").alias("lines"), F.min("page_id").alias("first_page"))
