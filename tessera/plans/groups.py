"""Queries that aggregate by strata and rank inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedup, rank, strata
from tessera.plans.rows import _RANKED, _SCORE, line_sets, scored
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def rounded_as_sql(df: DataFrame, *columns: str) -> DataFrame:
    """Millionths as DuckDB rounds doubles: the product with a million is rounded, not the decimal digits. The two differ on ties and on large values."""
    millionths = lambda c: F.round(F.col(c).cast("double") * 1e6) / 1e6
    return df.withColumns({c: F.when(F.abs(millionths(c)) < float("inf"), millionths(c)).otherwise(F.col(c).cast("double")) for c in columns})


@query("""SELECT source, lang, count(*) AS "rows", count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY GROUPING SETS ((source), (lang), (source, lang), ())""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "lang", F.sha2("text", 256).alias("digest"))
    out = docs.groupingSets([["source"], ["lang"], ["source", "lang"], []], "source", "lang")
    return out.agg(F.count("*").alias("rows"), F.countDistinct("digest").alias("texts"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min,
round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.75), 6) AS p75, round(quantile_cont(l_quantity, 0.95), 6) AS p95, max(l_quantity) AS max FROM lineitem GROUP BY 1, 2""")
def subject_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strata.summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), "mean", "std", "median", "p75", "p95")


@query(f"""WITH s AS (SELECT t.threshold, x.lang AS stratum, d.source AS g, x.score > t.threshold AS above FROM {_SCORE} x JOIN documents d USING (doc_id), (SELECT unnest([0::DOUBLE, 0.5, 1, 1.5, 2]) AS threshold) t),
u AS (SELECT * FROM s UNION ALL SELECT threshold, 'overall', g, above FROM s)
SELECT stratum, threshold, count(*) FILTER (above) AS rows_above, count(*) FILTER (NOT above) AS rows_below, count(DISTINCT g) FILTER (above) AS groups_above, count(DISTINCT g) FILTER (NOT above) AS groups_below,
count(DISTINCT g) FILTER (above) < 2 OR count(DISTINCT g) FILTER (NOT above) < 2 AS underpowered FROM u GROUP BY 1, 2""")
def threshold_support(spark: SparkSession, d: str) -> DataFrame:
    out = strata.threshold_support(scored(spark, d), F.col("score"), "source", "lang", (0, 0.5, 1, 1.5, 2))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("rows_above", "rows_below")})


@query("""WITH m AS (SELECT c_mktsegment, c_custkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS s, avg(l_extendedprice * (1 - l_discount)) AS m
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT c_mktsegment, sum(n)::BIGINT AS "rows", count(*) AS subjects, round(sum(s) / sum(n), 4) AS row_mean, round(avg(m), 4) AS subject_mean FROM m GROUP BY 1""")
def cohort_metrics_two_level(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    lines = i.join(o, i.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    out = strata.two_level_mean(lines, ["c_mktsegment"], "c_custkey", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return out.withColumns({k: F.round(k, 4) for k in ("row_mean", "subject_mean")})


@query(f"""WITH s AS (SELECT rid, l_returnflag, least(5, floor(l_quantity / 9))::INTEGER AS truth, list(i) AS members FROM {_RANKED} WHERE coalesce(before, 0) < 0.8 - 1e-12 GROUP BY ALL)
SELECT l_returnflag, count(*) AS "rows", round(avg(list_contains(members, truth)::INTEGER), 6) AS coverage, round(avg(len(members)), 6) AS mean_size FROM s GROUP BY 1""")
def coverage_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    sets = line_sets(spark, d).withColumn("truth", F.least(F.lit(5), F.floor(F.col("l_quantity") / 9)).cast("int"))
    return rounded(strata.set_coverage(sets, ["l_returnflag"], "truth", "members"), "coverage", "mean_size")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
SELECT user_id, arg_min(event_type, struct_pack(n := -n, e := event_type)) AS mode, max(n) AS mode_rows FROM c GROUP BY 1""")
def deterministic_mode(spark: SparkSession, d: str) -> DataFrame:
    return strata.mode_per_group(table(spark, d, "events"), ["user_id"], "event_type")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, sum(n)::BIGINT AS "rows", count(*) AS categories, round(max(n) / sum(n), 6) AS max_share FROM c GROUP BY 1""")
def max_category_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strata.category_share(table(spark, d, "documents"), ["source"], "lang"), "max_share")


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std, min(l_discount) AS min, round(quantile_cont(l_discount, 0.5), 6) AS median,
round(quantile_cont(l_discount, 0.75), 6) AS p75, round(quantile_cont(l_discount, 0.95), 6) AS p95, max(l_discount) AS max FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""")
def percentile_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strata.summary(table(spark, d, "lineitem").filter("l_linestatus = 'F'"), ["l_returnflag"], "l_discount"), "mean", "std", "median", "p75", "p95")


@query("""WITH c AS (SELECT toxic AS target, source, count(*) AS "rows" FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT target, source, "rows", count(*) OVER (PARTITION BY target) AS sources, count(*) OVER (PARTITION BY target) < 2 AS single_source FROM c""")
def source_stratified_support(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy(F.col("toxic").alias("target"), "source").agg(F.count("*").alias("rows"))
    return cells.join(cells.groupBy("target").agg(F.count("*").alias("sources")), "target").withColumn("single_source", F.col("sources") < 2)


@query("""WITH b AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY abs(n_chars - 3000), doc_id) AS rank FROM documents)
SELECT doc_id, source, n_chars, rank::INTEGER AS rank FROM b WHERE rank <= 6 ORDER BY source, rank, abs(n_chars - 3000), doc_id LIMIT 60""")
def bucketed_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return rank.top_per_bucket(docs, "source", [F.abs(F.col("n_chars") - 3000), F.col("doc_id")], 6, 60, [F.col("source")])


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5 AS q FROM orders)
SELECT o_orderkey, o_orderpriority, o_totalprice, CASE WHEN q THEN 'quota' ELSE 'fill' END AS picked FROM r ORDER BY CASE WHEN q THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 40""")
def quota_and_fill(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rank.quota_and_fill(orders, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 5, 40)


@query("""WITH g AS (SELECT user_id, count(*) AS events FROM events GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY user_id) AS a, count(*) OVER () AS n FROM g),
s AS (SELECT *, CASE WHEN a <= floor(n * 0.6 + 1e-9) THEN 'train' WHEN a <= floor(n * 0.8 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM p)
SELECT user_id, events, split, row_number() OVER (PARTITION BY split ORDER BY user_id)::INTEGER AS place FROM s""")
def group_split_rank(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    return rank.split_by_rank(users, "user_id", [("train", 0.6), ("validation", 0.2)], "test")


@query("""WITH o AS (SELECT doc_id, lang, source, n_chars // 500 AS image, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS s, row_number() OVER (PARTITION BY lang, source, n_chars // 500 ORDER BY n_chars DESC, doc_id) AS i, n_chars FROM documents),
t AS (SELECT *, CASE WHEN s = 1 THEN 1 WHEN i = 1 THEN 2 ELSE 3 END AS tier FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tier, n_chars DESC, doc_id) AS rank FROM t)
SELECT doc_id, lang, source, tier::INTEGER AS tier, rank::INTEGER AS rank FROM r WHERE rank <= 30""")
def diverse_examples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.floor(F.col("n_chars") / 500).alias("image"))
    return rank.diverse_examples(docs, "lang", "source", "image", [F.desc("n_chars"), F.col("doc_id")], 30).select("doc_id", "lang", "source", "tier", "rank")


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return dedup.best_row(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")])


@query("""WITH x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, count(*) OVER (PARTITION BY l_suppkey) AS available,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS rank FROM lineitem WHERE l_discount = 0)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, available, rank::INTEGER AS rank FROM x WHERE rank <= ceil(available * 0.3 - 1e-9)""")
def weighted_negatives(spark: SparkSession, d: str) -> DataFrame:
    """The first ceil(0.3 n) undiscounted lines of each supplier."""
    lines = table(spark, d, "lineitem").filter("l_discount = 0").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rank.first_share(lines, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 0.3)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
