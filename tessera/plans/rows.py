"""Queries over single rows: scans, cleaning, scores, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rubric, text
from tessera.operators import contracts, states
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT o_orderkey, o_custkey, o_totalprice, trim(o_orderpriority) AS priority FROM orders
WHERE o_orderstatus IN ('F', 'O') AND trim(coalesce(o_orderpriority, '')) <> ''""")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O") & ~text.is_missing(F.col("o_orderpriority")))
    return kept.select("o_orderkey", "o_custkey", "o_totalprice", text.clean(F.col("o_orderpriority")).alias("priority"))


@query("""SELECT source, count(*) AS "rows", count(*) FILTER (quality IS NULL) AS missing_quality,
count(*) FILTER (text IS NULL OR trim(text) = '') AS missing_text, count(*) FILTER (lang IS NULL OR trim(lang) = '') AS missing_lang
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def null_blank_normalise(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    lost = lambda c: F.count_if(text.is_missing(F.col(c)))
    return docs.groupBy("source").agg(F.count("*").alias("rows"), lost("quality").alias("missing_quality"), lost("text").alias("missing_text"), lost("lang").alias("missing_lang"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'missing')"


@query(f"""SELECT p_partkey, concat_ws('__', {_SLUG.format(c="p_brand")}, {_SLUG.format(c="p_type")}, {_SLUG.format(c="p_name")}) AS part_id FROM part""")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.joined_id(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("part_id"))


@query(r"""SELECT c_custkey, upper(regexp_extract(trim(c_name), '^([A-Za-z]+)', 1)) AS prefix, try_cast(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS number,
split_part(c_name, '#', 1) AS stem FROM customer""")
def regex_identity(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", text.letters_prefix(name).alias("prefix"), F.regexp_extract(name, "([0-9]+)", 1).try_cast("bigint").alias("number"), F.substring_index(name, "#", 1).alias("stem")
    )


_RUBRIC = "list_transform([0.0, 0.5, 1.0, 1.5, 2.0, 3.0], lambda s: s::DOUBLE)"
_SCORE = f"""(SELECT doc_id, lang, list_aggregate(list_transform({_RUBRIC}, lambda s: struct_pack(d := abs(least(3::DOUBLE, n_chars / 2000::DOUBLE) - s), s := s)), 'min').s AS score FROM documents)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the rubric score nearest to their length over 2000, at most 3."""
    x = F.least(F.lit(3.0), F.col("n_chars") / F.lit(2000.0))
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", rubric.nearest_score(x).alias("score"))


@query(f"""SELECT doc_id, score, CASE score WHEN 0 THEN 0 WHEN 0.5 THEN 20 WHEN 1 THEN 40 WHEN 1.5 THEN 60 WHEN 2 THEN 80 ELSE 100 END::DOUBLE AS stage,
CASE WHEN score < 1 THEN 'none_low' WHEN score < 2 THEN 'mild_mod' ELSE 'severe' END AS three_band,
CASE WHEN score < 0.5 THEN '0' WHEN score < 1 THEN '0.5' WHEN score < 2 THEN '1_1.5' ELSE '2_3' END AS four_band
FROM {_SCORE} JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)""")
def rubric_stage_index(spark: SparkSession, d: str) -> DataFrame:
    marked = scored(spark, d).join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    s = F.col("score")
    return marked.select("doc_id", "score", rubric.stage_index(s).alias("stage"), rubric.three_band(s).alias("three_band"), rubric.four_band(s).alias("four_band"))


@query(f"""SELECT doc_id, (score > 0)::INTEGER AS over_0, (score > 0.5)::INTEGER AS over_1, (score > 1)::INTEGER AS over_2, (score > 1.5)::INTEGER AS over_3, (score > 2)::INTEGER AS over_4 FROM {_SCORE}""")
def threshold_targets(spark: SparkSession, d: str) -> DataFrame:
    got = scored(spark, d).withColumn("t", rubric.threshold_targets(F.col("score")))
    return got.select("doc_id", *(F.col("t")[k].alias(f"over_{k}") for k in range(5)))


#: Five cumulative probabilities from a line item's numbers.
_P = "[l_discount * 10, l_quantity / 50, l_tax * 10, (l_linenumber % 7) / 7.0::DOUBLE, l_extendedprice / 110000]"


def line_probabilities(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    p = F.array(c("l_discount") * 10, c("l_quantity") / 50, c("l_tax") * 10, (c("l_linenumber") % 7) / F.lit(7.0), c("l_extendedprice") / 110000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", rubric.monotone(p).alias("p"))


_MONO = f"(SELECT rid, l_orderkey, l_linenumber, l_returnflag, l_quantity, list_transform(range(1, 6), lambda i: list_min(list_slice(raw, 1, i))) AS p FROM (SELECT *, {_P} AS raw, row_number() OVER () AS rid FROM lineitem))"
_CLASS = f"(SELECT *, list_transform(range(1, 7), lambda i: list_concat([1::DOUBLE], p)[i] - list_concat(p, [0::DOUBLE])[i]) AS q FROM {_MONO})"


@query(f"""SELECT l_orderkey, l_linenumber, round(list_sum(p) * 100 / 5, 6) AS burden, round(q[1], 6) AS q0, round(q[2], 6) AS q1, round(q[6], 6) AS q5 FROM {_CLASS}""")
def monotone_probabilities(spark: SparkSession, d: str) -> DataFrame:
    got = line_probabilities(spark, d).withColumn("q", rubric.class_probabilities(F.col("p")))
    q = F.col("q")
    return got.select("l_orderkey", "l_linenumber", F.round(rubric.burden(F.col("p")), 6).alias("burden"), F.round(q[0], 6).alias("q0"), F.round(q[1], 6).alias("q1"), F.round(q[5], 6).alias("q5"))


def line_sets(spark: SparkSession, d: str) -> DataFrame:
    q = F.transform(rubric.class_probabilities(F.col("p")), lambda x: F.round(x, 9))
    got = line_probabilities(spark, d).withColumn("q", q)
    return got.withColumn("members", rubric.prediction_set(F.col("q"), 0.8))


_RANKED = f"""(SELECT rid, l_orderkey, l_linenumber, l_returnflag, l_quantity, i, v, sum(v) OVER (PARTITION BY rid ORDER BY v DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT rid, l_orderkey, l_linenumber, l_returnflag, l_quantity, unnest(range(0, 6))::INTEGER AS i, unnest(list_transform(q, lambda x: round(x, 9))) AS v FROM {_CLASS}))"""


@query(f"""SELECT l_orderkey, l_linenumber, string_agg(i::VARCHAR, '|' ORDER BY i) AS members, count(*)::INTEGER AS size FROM {_RANKED}
WHERE coalesce(before, 0) < 0.8 - 1e-12 GROUP BY rid, 1, 2""")
def prediction_sets(spark: SparkSession, d: str) -> DataFrame:
    return line_sets(spark, d).select("l_orderkey", "l_linenumber", F.array_join(F.col("members").cast("array<string>"), "|").alias("members"), F.size("members").alias("size"))


@query(f"""SELECT l_orderkey, l_linenumber, round(list_sum(list_transform(q, lambda x: CASE WHEN x > 0 THEN -x * ln(x) ELSE 0 END)), 6) AS entropy,
round(list_reverse_sort(q)[1] - list_reverse_sort(q)[2], 6) AS margin FROM {_CLASS}""")
def entropy_margin(spark: SparkSession, d: str) -> DataFrame:
    got = line_probabilities(spark, d).withColumn("q", rubric.class_probabilities(F.col("p")))
    return got.select("l_orderkey", "l_linenumber", F.round(rubric.entropy(F.col("q")), 6).alias("entropy"), F.round(rubric.top_two_margin(F.col("q")), 6).alias("margin"))


@query("""SELECT doc_id, concat_ws(';', CASE WHEN quality IS NULL THEN 'missing_score' END, CASE WHEN n_chars < 200 THEN 'too_short' END, CASE WHEN toxic = 1 THEN 'flagged' END) AS reason,
CASE WHEN source = 'src0' THEN 'foreign' WHEN quality IS NULL OR n_chars < 200 OR toxic = 1 THEN 'unresolved' ELSE 'admitted' END AS status
FROM documents LEFT JOIN labels USING (doc_id)""")
def admission_state_machine(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rules = [(F.col("quality").isNull(), "missing_score"), (F.col("n_chars") < 200, "too_short"), (F.col("toxic") == 1, "flagged")]
    out = states.with_status(docs, rules).withColumn("status", F.when(F.col("source") == "src0", "foreign").otherwise(F.col("status")))
    return out.select("doc_id", "reason", "status")


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'borderline' WHEN toxic = 1 THEN 'blocked' WHEN abs(n_chars / 20000.0::DOUBLE - 0.5) <= 0.15 THEN 'near_threshold'
WHEN n_chars / 20000.0::DOUBLE >= 0.65 THEN 'high' WHEN n_chars / 20000.0::DOUBLE <= 0.35 THEN 'low' ELSE 'uncertain' END AS route FROM documents JOIN labels USING (doc_id)""")
def routing_ladder(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("n_chars") / F.lit(20000.0)
    rules = [(F.col("quality") == 0, "borderline"), (F.col("toxic") == 1, "blocked"), (F.abs(p - 0.5) <= 0.15, "near_threshold"), (p >= 0.65, "high"), (p <= 0.35, "low")]
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", states.route(rules, "uncertain").alias("route"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws('|', CASE WHEN l_returnflag = 'R' THEN 'unknown_source' END, CASE WHEN l_discount >= 0.08 THEN 'wide_uncertainty' END,
CASE WHEN l_quantity BETWEEN 20 AND 30 THEN 'transitional' END), ''), 'ok') AS labels FROM lineitem""")
def reliability_labels(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("l_returnflag") == "R", "unknown_source"), (F.col("l_discount") >= 0.08, "wide_uncertainty"), (F.col("l_quantity").between(20, 30), "transitional")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", states.labels(rules).alias("labels"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS area FROM lineitem GROUP BY l_orderkey""")
def rle_area(spark: SparkSession, d: str) -> DataFrame:
    pair = F.struct("l_linenumber", (F.col("l_linestatus") == "F").cast("int").alias("v"), F.col("l_quantity").cast("int").alias("n"))
    runs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pair)).alias("r"))
    return runs.select("l_orderkey", rubric.run_length_area(F.flatten(F.transform("r", lambda x: F.array(x["v"], x["n"])))).alias("area"))


@query("""SELECT rule, "rows" FROM (SELECT 'missing_o_orderpriority' AS rule, count(*) FILTER (trim(coalesce(o_orderpriority, '')) = '') AS "rows" FROM orders
UNION ALL SELECT 'unsupported_o_orderstatus', count(*) FILTER (o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'not_positive', count(*) FILTER (o_totalprice <= 1000) FROM orders)""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = [*contracts.required("o_orderpriority"), contracts.allowed("o_orderstatus", ("F", "O")), contracts.Rule("not_positive", F.col("o_totalprice") <= 1000)]
    return contracts.violations(table(spark, d, "orders"), rules)


@query(r"""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN lower(url) LIKE '%spam%' OR lower(url) LIKE '%pills%' THEN 'severe' WHEN lower(url) LIKE '%blog%' OR lower(url) LIKE '%feed%' THEN 'mild' ELSE 'none' END AS class FROM pages""")
def keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    found = text.keyword_class(F.col("url"), [("severe", ("spam", "pills")), ("mild", ("blog", "feed"))], "none")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), found.alias("class"))


@query("""SELECT doc_id, list_filter(['en', 'fr', 'de'], lambda x: NOT list_contains(seen, x)) AS lost, CASE WHEN len(list_filter(['en', 'fr', 'de'], lambda x: NOT list_contains(seen, x))) = 0 THEN 'complete'
ELSE 'pending_discovery:' || array_to_string(list_filter(['en', 'fr', 'de'], lambda x: NOT list_contains(seen, x)), ';') END AS status
FROM (SELECT source AS doc_id, list_distinct(list(lang)) AS seen FROM documents GROUP BY source)""")
def discovery_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.collect_set("lang").alias("seen"))
    lost = F.array_except(F.array(*map(F.lit, ("en", "fr", "de"))), F.col("seen"))
    return seen.select("doc_id", lost.alias("lost"), F.when(F.size(lost) == 0, "complete").otherwise(F.concat(F.lit("pending_discovery:"), F.array_join(lost, ";"))).alias("status"))
