"""Queries that deduplicate, join and compare tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rubric
from tessera.operators import dedup, gates, joins, states, strata
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT c_mktsegment, CASE WHEN c_custkey IS NULL THEN 'missing_image' WHEN value IS NULL THEN 'missing_score' ELSE 'ok' END AS join_status, count(*) AS "rows"
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) e LEFT JOIN customer ON c_custkey = user_id WHERE r = 1 GROUP BY 1, 2""")
def latest_join_status(spark: SparkSession, d: str) -> DataFrame:
    """Newest event of each user, looked up in customer, counted by segment and status."""
    newest = dedup.latest_wins(table(spark, d, "events"), ["user_id"], ["ts"], "event_id")
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", F.lit(True).alias("known"))
    status = states.route([(F.col("known").isNull(), "missing_image"), (F.col("value").isNull(), "missing_score")], "ok")
    return joins.guarded_left_join(newest, known, ["user_id"]).groupBy("c_mktsegment", status.alias("join_status")).agg(F.count("*").alias("rows"))


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return dedup.latest_wins(table(spark, d, "events"), ["user_id"], ["ts"], "event_id").select("user_id", "event_id", "event_type", "value")


@query("""SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS evidence_count FROM documents GROUP BY sha256(text)""")
def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return dedup.keep_first(docs, ["digest"], "doc_id").select("doc_id", "source", "evidence_count")


@query("""SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies, count(*) OVER (PARTITION BY sha256(text)) > 1 AS is_duplicate FROM documents""")
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedup.duplicate_flags(docs, ["digest"]).select("doc_id", "copies", "is_duplicate")


@query("""SELECT o_custkey, arg_max(o_orderkey, struct_pack(n := (o_orderstatus = 'F')::INTEGER, k := o_orderkey)) AS o_orderkey,
max(struct_pack(n := (o_orderstatus = 'F')::INTEGER, k := o_orderkey, p := o_totalprice)).p AS o_totalprice FROM orders GROUP BY o_custkey""")
def upsert_registry(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders replace a customer's others; the newest counts."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    done = F.col("o_orderstatus") == "F"
    return dedup.upsert(orders.filter(~done).drop("o_orderstatus"), orders.filter(done).drop("o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("""SELECT doc_id, quality, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'matched' END AS join_status FROM documents LEFT JOIN labels l USING (doc_id)""")
def guarded_lookup(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "labels").select("doc_id", "quality", F.lit("matched").alias("join_status"))
    return joins.guarded_left_join(table(spark, d, "documents").select("doc_id"), marks, ["doc_id"]).fillna("missing", ["join_status"])


@query("""SELECT doc_id, coalesce(quality::DOUBLE, base) AS score, round(coalesce(quality::DOUBLE, base) - base, 6) AS delta FROM (SELECT doc_id, least(1::DOUBLE, n_chars / 5000.0::DOUBLE) AS base FROM documents) LEFT JOIN labels USING (doc_id)""")
def override_scores(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("score")).withColumn("base", F.col("score"))
    over = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    return joins.lookup_coalesce(base, over, ["doc_id"], ["score"]).select("doc_id", "score", F.round(F.col("score") - F.col("base"), 6).alias("delta"))


@query("""SELECT o_custkey AS key, 'known' AS status FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'foreign' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def anti_union_foreign(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return joins.anti_union(known, table(spark, d, "customer").select(F.col("c_custkey").alias("key")), ["key"], "foreign")


@query("""SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS has_finished FROM customer""")
def semi_flag(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return joins.membership_flag(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"], "has_finished")


@query("""SELECT CASE WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS keys
FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id GROUP BY 1""")
def symmetric_pairing(spark: SparkSession, d: str) -> DataFrame:
    return joins.symmetric_audit(table(spark, d, "documents").filter("lang = 'en'"), table(spark, d, "labels"), "doc_id")


@query("""SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type <> 'purchase'""")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Users on both sides of a split by kind of event."""
    events = table(spark, d, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id")
    return bought.intersect(events.filter("event_type <> 'purchase'").select("user_id"))


_BOX = "struct_pack(x0 := l_linenumber * 10.0::DOUBLE, y0 := l_discount * 100, x1 := l_linenumber * 10.0::DOUBLE + l_quantity, y1 := l_discount * 100 + l_tax * 100 + 1)"


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_BOX} AS r FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber AS first, b.l_linenumber AS second, a.r AS s, b.r AS t, greatest(0, least(a.r.x1, b.r.x1) - greatest(a.r.x0, b.r.x0)) * greatest(0, least(a.r.y1, b.r.y1) - greatest(a.r.y0, b.r.y0)) AS i
  FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, first, second, round(i / ((s.x1 - s.x0) * (s.y1 - s.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - i), 6) AS iou FROM p WHERE i > 0""")
def bbox_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping boxes of an order; an order has few lines."""
    c = F.col
    box = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_linenumber") * 10.0).alias("x0"), (c("l_discount") * 100).alias("y0"), (c("l_linenumber") * 10.0 + c("l_quantity")).alias("x1"), (c("l_discount") * 100 + c("l_tax") * 100 + 1).alias("y1")
    )
    a, b = box.alias("a"), box.alias("b")
    pairs = a.join(b, (c("a.l_orderkey") == c("b.l_orderkey")) & (c("a.l_linenumber") < c("b.l_linenumber")))
    side = lambda n: tuple(c(f"{n}.{k}") for k in ("x0", "y0", "x1", "y1"))
    iou = rubric.box_iou(side("a"), side("b"))
    return pairs.select(c("a.l_orderkey"), c("a.l_linenumber").alias("first"), c("b.l_linenumber").alias("second"), iou.alias("raw")).filter("raw > 0").select("l_orderkey", "first", "second", F.round("raw", 6).alias("iou"))


@query("""SELECT p_partkey, feature, round(value, 6) AS value FROM (SELECT p_partkey, unnest(['size', 'price']) AS feature, unnest([p_size::DOUBLE, p_retailprice]) AS value FROM part) WHERE value IS NOT NULL""")
def unpivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "feature", "value").filter("value is not null").withColumn("value", F.round("value", 6))


@query("""SELECT event_type, key, count(*) AS "rows", sum(v)::BIGINT AS total FROM (SELECT event_type, unnest(json_keys(props::JSON)) AS key, (props::JSON ->> '$.k')::BIGINT AS v FROM events) GROUP BY 1, 2""")
def json_explode(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v"))
    return parsed.groupBy("event_type", "key").agg(F.count("*").alias("rows"), F.sum("v").alias("total"))


@query("""SELECT role, arg_max(text, turn) AS last_text, conv_id, count(*) AS turns FROM conversations GROUP BY conv_id, role""")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    """Last text of each role of a conversation."""
    turns = table(spark, d, "conversations")
    return turns.groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("last_text"), F.count("*").alias("turns"))


@query("""WITH p AS (SELECT l_suppkey, l_linestatus AS side, max(l_linenumber)::VARCHAR AS most_lines, round(max(l_tax), 2)::VARCHAR AS most_tax, min(l_returnflag) AS least_flag FROM lineitem GROUP BY 1, 2),
u AS (SELECT l_suppkey, side, unnest(['most_lines', 'most_tax', 'least_flag']) AS field, unnest([most_lines, most_tax, least_flag]) AS value FROM p),
c AS (SELECT l_suppkey, field, max(value) FILTER (side = 'F') AS training, max(value) FILTER (side = 'O') AS evaluation FROM u GROUP BY 1, 2),
m AS (SELECT l_suppkey, field, training IS DISTINCT FROM evaluation AS differs FROM c)
SELECT l_suppkey, coalesce(string_agg(CASE WHEN differs THEN field END, '|' ORDER BY field), '') AS mismatches, CASE WHEN bool_or(differs) THEN 'resize_policy_mismatch' ELSE 'ok' END AS reason FROM m GROUP BY 1""")
def policy_parity(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's finished and open lines as two policies, compared field by field."""
    fields = ["most_lines", "most_tax", "least_flag"]
    policies = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linestatus").alias("side")).agg(
        F.max("l_linenumber").cast("string").alias("most_lines"), F.round(F.max("l_tax"), 2).cast("string").alias("most_tax"), F.min("l_returnflag").alias("least_flag")
    )
    return gates.field_parity(policies, "l_suppkey", "side", ("F", "O"), fields)


@query("""SELECT field, value, count(*) AS "rows" FROM (SELECT unnest(['lang', 'source', 'quality']) AS field, unnest([coalesce(lang, 'missing'), coalesce(source, 'missing'), coalesce(quality::VARCHAR, 'missing')]) AS value FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2""")
def distribution_maps(spark: SparkSession, d: str) -> DataFrame:
    return strata.value_counts(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["lang", "source", "quality"])
