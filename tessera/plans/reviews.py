"""Queries over annotation exports, reviews, gates and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import annotations as ann
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def export(spark: SparkSession, d: str) -> DataFrame:
    """An annotation export as JSON, read back: orders are tasks, lines are graded regions; some break each rule."""
    c, text = F.col, lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    fields = ("quantity", "discount", "tax", "returnflag", "linestatus")
    whole, part = F.lit(ann.COMPLETE), F.lit(ann.CUTOFF)
    item = lambda n, kind, field, **value: F.struct(
        text("g", n).alias("id"), F.lit(field).alias("from_name"), (kind if not isinstance(kind, str) else F.lit(kind)).alias("type"), F.struct(*(v.alias(k) for k, v in value.items())).alias("value")
    )
    rle = lambda n, k: F.array(F.lit(0), F.lit(k), F.lit(1), n.cast("int"))
    cut = lambda x: x["returnflag"] == "R"
    labels = lambda x: F.when(x["quantity"] == 49, F.array(whole, part)).when(cut(x), F.array(part)).otherwise(F.array(whole))
    region = lambda x: item(x["n"], F.when(x["quantity"] == 50, "polygonlabels").otherwise("brushlabels"), "roi", rle=rle(x["n"], 10), brushlabels=labels(x), choices=F.lit(None).cast("array<string>"))
    draft = lambda x: item(x["n"], "brushlabels", "roi", rle=F.when(x["quantity"] < 25, rle(x["n"], 10)).otherwise(rle(x["n"], 8)), brushlabels=labels(x))

    def grades(x):
        choice = F.array(*map(F.lit, ("0", "0.5", "1", "1.5", "2", " 3.0 ", "2.5")))[x["n"] - 1]
        grade = item(x["n"], "choices", ann.GRADE_FIELD, rle=F.lit(None).cast("array<int>"), brushlabels=F.lit(None).cast("array<string>"), choices=F.array(choice))
        lost = F.struct(F.lit("lost").alias("id"), *(grade[k].alias(k) for k in ("from_name", "type", "value")))
        given = ~cut(x) | (x["discount"] == 0.1)
        twice, loose = given & (x["tax"] == 0.08) & (x["returnflag"] == "N"), (x["n"] == 1) & (x["discount"] == 0.07)
        return F.array_compact(F.array(F.when(given, grade), F.when(twice, grade), F.when(loose, lost)))

    # an order's lines meet once, as plain values: lines of one number are one, with the greatest of each
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct(c("l_linenumber").alias("n"), *(c(f"l_{x}").alias(x) for x in fields)).alias("line")).groupBy("l_orderkey").agg(F.collect_list("line").alias("lines"))
    alike = F.transform(F.sort_array(F.array_distinct(c("lines.n"))), lambda n: F.struct(n.alias("n"), F.filter("lines", lambda x: x["n"] == n).alias("x")))
    orders = lines.select("l_orderkey", F.transform(alike, lambda g: F.struct(g["n"].alias("n"), *(F.array_max(g["x"][x]).alias(x) for x in fields))).alias("lines")).select(
        "l_orderkey", "lines", F.size("lines").alias("n"), F.array_max("lines.tax").alias("tax"), F.array_min("lines.discount").alias("discount"), F.array_max("lines.n").alias("last"),
        F.transform(F.filter("lines", lambda x: x["linestatus"] == "F"), draft).alias("drafts"), F.concat(F.transform("lines", region), F.flatten(F.transform("lines", grades))).alias("results"),
    )
    by = F.when(c("n") == 1, F.lit(None).cast("string")).when(c("n") == 2, '{"id": 9, "email": "a@b.org"}').otherwise("5")
    key = c("l_orderkey")
    task = F.struct(
        key.alias("id"), F.when(c("n") > 3, text("u", key, "-S", key, "_Image0.jpg")).otherwise("").alias("file_upload"),
        F.struct(text("/data/x/T", key, "_Image1.jpg").alias("image"), F.when(c("tax") > 0.05, "rel7").otherwise("").alias("mask_release_id")).alias("data"),
        F.array(F.struct(F.when(c("discount") == 0, text(ann.RELEASE_PREFIX, " rel1")).otherwise("other").alias("model_version"), c("drafts").alias("result"))).alias("predictions"),
        F.array(F.struct((key * 10).alias("id"), by.alias("completed_by"), F.when(c("last") % 2 == 0, "77").otherwise("").alias("parent_prediction"), F.lit("2024-01-01").alias("updated_at"), c("results").alias("result"))).alias("annotations"),
    )
    read = F.from_json(F.to_json(task), f"struct<{', '.join(_fields())}>")
    return orders.select(read.alias("t")).select("t.*")


def _fields() -> list[str]:
    """The columns of an export as fields of a struct."""
    from pyspark.sql.types import _parse_datatype_string

    return [f"{f.name}: {f.dataType.simpleString()}" for f in _parse_datatype_string(ann.TASKS).fields]


_LINES = """l0 AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q, max(l_discount) AS dc, max(l_tax) AS tx, max(l_returnflag) AS rf, max(l_linestatus) AS ls FROM lineitem GROUP BY 1, 2),
o AS (SELECT k, count(*) AS cnt, max(tx) AS tax, min(dc) AS discount, max(n) AS last, bool_or(n = 1 AND dc = 0.07) AS loose FROM l0 GROUP BY 1),
l1 AS (SELECT l0.*, cnt, last, loose, cnt = 1 AS anonymous, CASE WHEN tax > 0.05 THEN 'rel7' WHEN ls = 'F' AND discount = 0 THEN 'rel1' ELSE '' END AS rel, CASE WHEN tax > 0.05 THEN 'rel7' ELSE '' END AS task_rel,
  rf <> 'R' OR dc = 0.1 AS graded, tx = 0.08 AND rf = 'N' AS twice, list_extract([0::DOUBLE, 0.5, 1, 1.5, 2, 3, NULL], n) AS choice FROM l0 JOIN o USING (k)),
image AS (SELECT k, CASE WHEN cnt > 3 THEN 'S' || k || '_Image0' ELSE 'T' || k || '_Image1' END AS image_id FROM o),
l2 AS (SELECT *, CASE WHEN graded AND NOT twice THEN choice END AS grade, CASE WHEN cnt = 2 THEN '9' ELSE '5' END AS who, rf <> 'R' OR q = 49 AS whole, rf = 'R' OR q = 49 AS part FROM l1),
good AS (SELECT k, 'g' || n AS region_id, CASE WHEN whole THEN 'complete' ELSE 'excluded' END AS completeness_status, CASE WHEN part THEN 'cutoff_partial_glomerulus' ELSE '' END AS exclusion_reason, grade AS human_grade, who AS grader_user_id,
  CASE WHEN ls = 'F' THEN 'auto_preload' WHEN last % 2 = 0 THEN 'box_assisted_manual' ELSE 'human_manual' END AS proposal_kind, CASE WHEN ls = 'F' THEN CASE WHEN q < 25 THEN 'unedited_auto' ELSE 'human_refined_boundary' END WHEN last % 2 = 0 THEN 'human_refined_boundary' ELSE 'manual_drawn' END AS region_edit_state,
  rel AS mask_release_id, CASE WHEN q = 50 THEN 'non-brush-region' WHEN whole = part THEN 'ambiguous-region-label' WHEN graded AND twice THEN 'duplicate-grade' WHEN part AND grade IS NOT NULL THEN 'excluded-region-grade' WHEN whole AND grade IS NULL THEN 'missing-grade' WHEN ls = 'F' AND rel = '' THEN 'contradictory-lineage' END AS error
  FROM l2 WHERE NOT anonymous AND NOT loose),
bad AS (SELECT DISTINCT k, NULL::VARCHAR AS region_id, 'excluded' AS completeness_status, '' AS exclusion_reason, NULL::DOUBLE AS human_grade, CASE WHEN NOT anonymous THEN who END AS grader_user_id, CASE WHEN last % 2 = 0 THEN 'box_assisted_manual' ELSE 'human_manual' END AS proposal_kind,
  CASE WHEN last % 2 = 0 THEN 'human_refined_boundary' ELSE 'manual_drawn' END AS region_edit_state, task_rel AS mask_release_id, CASE WHEN anonymous THEN 'missing-provenance' ELSE 'missing-region-link' END AS error FROM l2 WHERE anonymous OR loose),
regions AS (SELECT concat_ws('::', image_id, region_id, (k * 10)::VARCHAR, grader_user_id) AS record_id, k::VARCHAR AS task_id, image_id, region_id, completeness_status, exclusion_reason, human_grade, grader_user_id, proposal_kind, region_edit_state, mask_release_id, error
  FROM (SELECT * FROM good UNION ALL SELECT * FROM bad) JOIN image USING (k))"""
_REGION = ["record_id", "task_id", "image_id", "region_id", "completeness_status", "exclusion_reason", "human_grade", "grader_user_id", "proposal_kind", "region_edit_state", "mask_release_id", "error"]


@query(f"WITH {_LINES}\nSELECT * FROM regions")
def graded_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the export with grade, lineage and the first rule each breaks."""
    return ann.regions(export(spark, d)).select(*_REGION)


@query(f"""WITH {_LINES}
SELECT image_id, count(*) AS regions, round(avg(human_grade), 6) AS mean_grade, max(human_grade) AS worst_grade, count(*) FILTER (proposal_kind = 'auto_preload') AS preloaded FROM regions WHERE error IS NULL AND completeness_status = 'complete' GROUP BY 1""")
def region_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Images by their complete regions that break no rule."""
    rows = ann.complete_regions(ann.regions(export(spark, d)).filter("error is null"))
    return rows.groupBy("image_id").agg(
        F.count("*").alias("regions"), F.round(F.avg("human_grade"), 6).alias("mean_grade"), F.max("human_grade").alias("worst_grade"), F.count_if(F.col("proposal_kind") == "auto_preload").alias("preloaded")
    )


@query(f"""WITH {_LINES}, s AS (SELECT k, list(choice) FILTER (graded AND choice IS NOT NULL) AS one, list(choice) FILTER (graded AND twice AND choice IS NOT NULL) AS more, list(choice) FILTER (n = 1 AND dc = 0.07) AS lost FROM l1 GROUP BY 1),
v AS (SELECT k, list_concat(list_concat(coalesce(one, []), coalesce(more, [])), coalesce(lost, [])) AS v FROM s)
SELECT k AS task_id, image_id || '.jpg' AS image_name, CASE WHEN len(v) = 1 THEN v[1] END AS score, CASE WHEN len(v) > 1 THEN 'ambiguous_score' WHEN len(v) = 0 THEN 'missing_score' ELSE 'ok' END AS score_status FROM v JOIN image USING (k)""")
def choice_scores(spark: SparkSession, d: str) -> DataFrame:
    """One score an image from the choices of its latest annotation."""
    return ann.choice_scores(export(spark, d))
