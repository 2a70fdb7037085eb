"""Queries on files written and read back: inventories, scans with provenance, releases; joins by either key and by position; saved models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins, models
from tessera.sources import inventory, provenance, publish
from tessera.sources.scratch import scratch_path
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """An inventory of files written from pages: images, some twice under two suffixes, masks for most, and masks alone; a folder names each file."""
    pages = table(spark, d, "pages").filter("page_id is not null")
    subject, stem = F.concat(F.lit("S"), F.col("page_id") % 7), F.concat(F.lit("S"), F.col("page_id") % 7, F.lit("-"), F.floor(F.col("page_id") / 7))
    kept = lambda c, kind, ending, suffix: F.when(c, F.struct(F.lit(kind).alias("kind"), F.concat(stem, F.lit(ending + suffix)).alias("item")))
    k = F.col("page_id")
    files = F.array_compact(F.array(kept(k % 9 != 5, "images", "", ".png"), kept(k % 10 == 3, "images", "", ".TIF"), kept(k % 4 != 0, "masks", "_mask", ".png"), kept(k % 13 == 6, "masks", "_outline", ".png")))
    root = scratch_path(spark, "files")
    rows = pages.select(subject.alias("subject"), F.coalesce("html", F.lit("")).alias("value"), F.explode(files).alias("f")).select("f.kind", "subject", "f.item", "value")
    inventory.write_texts(rows, root, ["kind", "subject", "item"])
    found = inventory.file_inventory(spark, root, "*.txt")
    part = lambda name: inventory.key_in_path(F.col("path"), name)
    return found.withColumns({"kind": part("kind"), "subject": part("subject"), "item": part("item")})


_FILES = r"""p AS (SELECT page_id AS k, 'S' || page_id % 7 AS subject, 'S' || page_id % 7 || '-' || page_id // 7 AS stem, coalesce(html, '') || chr(10) AS content FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT k, 'images' AS kind, subject, stem || '.png' AS item, content FROM p WHERE k % 9 <> 5 UNION ALL SELECT k, 'images', subject, stem || '.TIF', content FROM p WHERE k % 10 = 3
  UNION ALL SELECT k, 'masks', subject, stem || '_mask.png', content FROM p WHERE k % 4 <> 0 UNION ALL SELECT k, 'masks', subject, stem || '_outline.png', content FROM p WHERE k % 13 = 6)"""


@query(f"WITH {_FILES} SELECT kind, subject, item, strlen(content)::BIGINT AS bytes, sha256(content) AS sha256, '.txt' AS suffix FROM f")
def file_digests(spark: SparkSession, d: str) -> DataFrame:
    """Size and digest of every file written from pages."""
    return page_files(spark, d).select("kind", "subject", "item", "bytes", "sha256", "suffix")


@query(f"""WITH {_FILES}, r AS (SELECT kind, subject, regexp_replace(item, '\\.[^.]*$', '') AS stem, item FROM f),
o AS (SELECT *, kind = 'masks' AND NOT ends_with(stem, '_mask') AS loose, CASE WHEN kind = 'masks' AND ends_with(stem, '_mask') THEN left(stem, length(stem) - 5) ELSE stem END AS own FROM r),
g AS (SELECT subject, own AS stem, min(item) FILTER (kind = 'images') AS image_path, min(item) FILTER (kind = 'masks') AS mask_path, count(*) FILTER (kind = 'images') AS images, count(*) FILTER (kind = 'masks') AS masks FROM o GROUP BY subject, own, loose)
SELECT *, CASE WHEN images > 1 THEN 'duplicate_stem' WHEN images = 0 THEN 'orphan_mask' WHEN masks = 0 THEN 'missing_mask' ELSE 'matched_pair' END AS status FROM g""")
def file_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Images paired with their masks: matched, missing, orphaned and duplicate ones."""
    item = F.col("item")
    return inventory.paired(page_files(spark, d), F.col("kind"), F.col("subject"), F.regexp_replace(item, r"\.[^.]*$", ""), item)


@query(f"WITH {_FILES} SELECT sha256(content) AS sha256, count(*) AS files, max(strlen(content))::BIGINT AS bytes, min(kind || '/' || item) AS first_path FROM f GROUP BY 1 HAVING count(*) > 1")
def file_copies(spark: SparkSession, d: str) -> DataFrame:
    """Contents that several files have."""
    return inventory.same_content(page_files(spark, d).withColumn("path", F.concat_ws("/", "kind", "item")))


@query(f"""WITH {_FILES} SELECT 'pages' AS cohort_id, item AS image_path, NULL::DOUBLE AS score, item AS source_image_name, regexp_replace(item, '\\.[^.]*$', '') AS source_sample_id, 'scored_only' AS lane_assignment,
'pending_discovery' AS join_status, 'pending_discovery' AS verification_status, 'unresolved' AS admission_status, 'missing_score_linkage' AS exclusion_reason, 'files;listing' AS discovery_surfaces FROM f WHERE kind = 'images' AND lower(right(item, 4)) IN ('.png', '.tif')""")
def unresolved_images(spark: SparkSession, d: str) -> DataFrame:
    """Image files that no score is linked to, as manifest rows."""
    files = page_files(spark, d).filter("kind = 'images'").filter(F.lower(F.regexp_extract("item", r"\.[^.]*$", 0)).isin(*inventory.IMAGE_SUFFIXES))
    named = files.withColumns({"path": F.col("item"), "name": F.col("item"), "stem": F.regexp_replace("item", r"\.[^.]*$", "")})
    return inventory.unresolved(named, "pages", "scored_only", ["files", "listing"])


def sheets(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as csv sheets, a date each, some lines with a word for a number or without a sample; scanned again."""
    path, key = scratch_path(spark, "sheets"), F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key % 5).cast("int")), "yyyy-MM-dd").alias("sheet"), F.when(key % 17 != 4, F.concat(key.cast("string"), F.lit(".0"))).alias("SampleID"),
        F.when(key % 11 == 3, F.concat(F.lit("x"), key.cast("string"))).otherwise((key % 4).cast("string")).alias("Score"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("Group"),
    )
    rows.write.partitionBy("sheet").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return provenance.scan(spark, path, "SampleID string, Score double, `Group` string", "csv")


_SHEETS = "s AS (SELECT c_custkey AS k, strftime(DATE '2024-01-01' + (c_custkey % 5)::INTEGER, '%Y-%m-%d') AS sheet, CASE WHEN c_custkey % 17 <> 4 THEN c_custkey || '.0' END AS sample, CASE WHEN c_custkey % 11 = 3 THEN 'x' || c_custkey ELSE (c_custkey % 4)::VARCHAR END AS score, c_mktsegment AS g FROM customer)"


@query(f"""WITH {_SHEETS} SELECT sheet, coalesce(CASE WHEN k % 11 = 3 THEN 'unreadable_line' END, CASE WHEN sample IS NULL THEN 'missing_SampleID' END) AS reason, CASE WHEN k % 11 = 3 THEN coalesce(sample, '') || ',' || score || ', ' || g END AS bad_line,
CASE WHEN k % 11 <> 3 THEN score::DOUBLE END AS score FROM s""")
def scanned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the sheets with its date, and why it isn't a good row."""
    rows = provenance.with_reasons(sheets(spark, d), ["SampleID", "Group"])
    return rows.select(F.regexp_extract("source_path", r"(\d{4}-\d{2}-\d{2})", 1).alias("sheet"), "reason", "bad_line", F.when(F.col("reason").isNull() | (F.col("reason") != "unreadable_line"), F.col("Score")).alias("score"))


@query(f"WITH {_SHEETS} SELECT k::VARCHAR AS sample_id, sheet AS source_date, lower(g) AS assignment_group FROM s WHERE k % 11 <> 3 AND sample IS NOT NULL")
def sheet_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the samples of all sheets, dated by sheet."""
    return provenance.assignments(sheets(spark, d), "SampleID", F.col("Group")).drop("source_file")


@query("""WITH n AS (SELECT s_suppkey AS k, 'old-' || s_suppkey AS stem, 'S' || s_nationkey || '-' || s_suppkey AS id FROM supplier)
SELECT CASE k % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'tsv' ELSE 'json' END AS format, stem AS legacy_stem, id AS subject_image_id FROM n""")
def mapping_formats(spark: SparkSession, d: str) -> DataFrame:
    """A mapping kept as csv, tsv and json, each read by its suffix; stems come from paths, names or masks."""
    key, out = F.col("s_suppkey"), None
    image = F.concat(F.lit("S"), F.col("s_nationkey"), F.lit("-"), key)
    for n, (kind, column, old) in enumerate((("csv", "legacy_path", F.concat(F.lit("a/b/old-"), key, F.lit("_mask.png"))), ("tsv", "legacy_filename", F.concat(F.lit("old-"), key, F.lit(".tif"))), ("json", "legacy_stem", F.concat(F.lit("old-"), key)))):
        path = f"{scratch_path(spark, 'mapping')}.{kind}"
        rows = table(spark, d, "supplier").filter(key % 3 == n).select(image.alias("subject_image_id"), old.alias(column))
        rows = rows.unionByName(rows)  # equal rows count once
        if kind == "json":
            rows.write.json(path)
        else:
            rows.write.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
        one = provenance.stem_mapping(provenance.scan(spark, path, f"subject_image_id string, {column} string")).withColumn("format", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS split, doc_id, n_chars, CASE WHEN doc_id % 10 >= 9 THEN 'second' ELSE 'first' END AS written FROM documents""")
def republished_splits(spark: SparkSession, d: str) -> DataFrame:
    """Documents released by split; the test split is published again, and then again, and only it has changed."""
    k, path = F.col("doc_id") % 10, scratch_path(spark, "splits")
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.when(k < 7, "train").when(k < 9, "validation").otherwise("test").alias("split"))
    publish.publish(rows.withColumn("written", F.lit("first")), path, ["split"], "r1")
    for _ in range(2):
        publish.publish(rows.filter("split = 'test'").withColumn("written", F.lit("second")), path, ["split"], "r2")
    return publish.published(spark, path, "r2").select("split", "doc_id", "n_chars", "written")


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN -o_custkey END AS a, CASE WHEN o_orderkey % 5 < 4 THEN o_custkey + 1 END AS b FROM orders)
SELECT o_orderkey, coalesce(x.c_mktsegment, y.c_mktsegment) AS c_mktsegment, coalesce(x.c_nationkey, y.c_nationkey) AS c_nationkey, CASE WHEN x.c_custkey IS NOT NULL THEN 'image_key' WHEN y.c_custkey IS NOT NULL THEN 'mask_key' END AS matched_by
FROM o LEFT JOIN customer x ON x.c_custkey = a LEFT JOIN customer y ON y.c_custkey = b""")
def either_key_context(spark: SparkSession, d: str) -> DataFrame:
    """Customers found by an order's first key, else by its second."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, c).when(k % 3 == 1, -c).alias("image_key"), F.when(k % 5 < 4, c + 1).alias("mask_key"))
    out = joins.either_key(orders, table(spark, d, "customer"), ["o_orderkey"], ["image_key", "mask_key"], "c_custkey", ["c_mktsegment", "c_nationkey"])
    return out.drop("image_key", "mask_key")


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders), b AS (SELECT o_orderkey AS o_orderkey_right, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders)
SELECT position, o_orderkey, o_orderkey_right, o_totalprice FROM a JOIN b USING (position)""")
def positional_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders by key beside orders by price."""
    orders = table(spark, d, "orders")
    return joins.by_position(orders.select("o_orderkey"), orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", (), ["o_orderkey"])


@query("""WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_totalprice ORDER BY o_orderkey) AS p, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)
SELECT o_custkey, i::INTEGER AS place, k[i + 1] AS image, p[i + 1] AS price, s[i + 1] AS status, s[i + 1] <> 'P' AS traceable FROM (SELECT *, unnest(range(len(k))) AS i FROM l)""")
def trace_rows(spark: SparkSession, d: str) -> DataFrame:
    """Three lists of a customer's orders side by side, and whether a row can be traced."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice", "o_orderstatus"))).alias("r"))
    three = lists.select("o_custkey", *(F.col(f"r.{c}").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderstatus")))
    return joins.zipped_lists(three, ["o_orderkey", "o_totalprice", "o_orderstatus"], ["image", "price", "status"]).withColumn("traceable", F.col("status") != "P")


@query(None)
def saved_model(spark: SparkSession, d: str) -> DataFrame:
    """A fitted pipeline's probabilities, before it was saved and after it was loaded."""
    names, path = [f"e{k}" for k in range(16)], scratch_path(spark, "model")
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("odd"), *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)))
    model = models.balanced_logistic(rows, names, "odd")
    models.save_fitted(model, path, names, fold="all")
    again = models.load_fitted(path, names, fold="all")
    p = lambda m, name: m.transform(rows).select("vec_id", "odd", vector_to_array("probability")[1].alias(name))
    return p(model, "before").join(p(again, "after").drop("odd"), "vec_id")


@query("""SELECT n_nationkey, n_regionkey, length(n_name) AS feature, 'joined' AS whole_status, 'row_count_mismatch' AS part_status FROM nation""")
def gated_merge(spark: SparkSession, d: str) -> DataFrame:
    """Learned features merged with nations: all of them, and some of them, which are refused."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    learned = table(spark, d, "nation").select("n_nationkey", F.length("n_name").cast("long").alias("feature"))
    merged, whole = joins.merge_if_counts_agree(nations, learned, ["n_nationkey"])
    _, part = joins.merge_if_counts_agree(nations, learned.filter("n_nationkey > 3"), ["n_nationkey"])
    return merged.withColumns({"whole_status": F.lit(whole), "part_status": F.lit(part)})
