"""Queries of row expressions: paths, identities, grades, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, rubric
from tessera.functions.text import naming_format
from tessera.operators.annotations import supported_grade
from tessera.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'm' || user_id WHEN 'view' THEN ' S' || user_id WHEN 'error' THEN 'D' WHEN 'signup' THEN 'lis' || user_id ELSE 'L' || user_id END AS sample,
  CASE event_type WHEN 'click' THEN ' Sor  & Dox ' WHEN 'view' THEN 'VEHICLE' WHEN 'error' THEN '' WHEN 'signup' THEN 'New-Group 7!' ELSE 'sor + lis' END AS name FROM events)
SELECT event_id, CASE WHEN regexp_extract(upper(trim(sample)), '^([A-Z]+)', 1) = 'M' THEN 'vehicle' WHEN regexp_extract(upper(trim(sample)), '^([A-Z]+)', 1) = 'S' THEN 'sorafenib' WHEN regexp_extract(upper(trim(sample)), '^([A-Z]+)', 1) = 'D' THEN 'sor_plus_dox'
WHEN regexp_extract(upper(trim(sample)), '^([A-Z]+)', 1) = 'L' THEN 'sor_plus_lis' ELSE '' END AS by_sample, CASE trim(lower(name)) WHEN 'sor  & dox' THEN 'sor_plus_dox' WHEN 'vehicle' THEN 'vehicle' WHEN '' THEN '' WHEN 'new-group 7!' THEN 'new_group_7' ELSE 'sor_plus_lis' END AS by_name FROM s""")
def treatment_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by the letters of a sample and by spelled names."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    sample = F.when(kind == "click", F.concat(F.lit("m"), user)).when(kind == "view", F.concat(F.lit(" S"), user)).when(kind == "error", "D").when(kind == "signup", F.concat(F.lit("lis"), user)).otherwise(F.concat(F.lit("L"), user))
    name = F.when(kind == "click", " Sor  & Dox ").when(kind == "view", "VEHICLE").when(kind == "error", "").when(kind == "signup", "New-Group 7!").otherwise("sor + lis")
    return table(spark, d, "events").select("event_id", paths.treatment_group(sample).alias("by_sample"), paths.group_name(name).alias("by_name"))


_PATH = """CASE o_orderstatus WHEN 'F' THEN 'images/' ELSE CASE WHEN o_orderpriority LIKE '1%' THEN '/data/S' || o_custkey || '/' WHEN o_orderpriority LIKE '2%' THEN 'raw_data/masks/' ELSE '' END END
  || 'S' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN '_Image' || (o_orderkey % 9) WHEN 1 THEN '-' || (o_orderkey % 9) ELSE '' END || CASE o_orderkey % 2 WHEN 0 THEN '_mask' ELSE '' END || CASE o_orderkey % 5 WHEN 0 THEN '.PNG' ELSE '.jpg' END"""


def order_paths(spark: SparkSession, d: str) -> DataFrame:
    c, key = F.col, F.col("o_orderkey")
    user, digit = c("o_custkey").cast("string"), (key % 9).cast("string")
    folder = F.when(c("o_orderstatus") == "F", "images/").when(c("o_orderpriority").startswith("1"), F.concat(F.lit("/data/S"), user, F.lit("/"))).when(c("o_orderpriority").startswith("2"), "raw_data/masks/").otherwise("")
    name = F.concat(F.lit("S"), user, F.when(key % 3 == 0, F.concat(F.lit("_Image"), digit)).when(key % 3 == 1, F.concat(F.lit("-"), digit)).otherwise(""), F.when(key % 2 == 0, "_mask").otherwise(""), F.when(key % 5 == 0, ".PNG").otherwise(".jpg"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(folder, name).alias("path"))


@query(f"""WITH p AS (SELECT o_orderkey, {_PATH} AS path FROM orders), x AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS folder FROM p),
y AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM x)
SELECT o_orderkey, path, stem, folder, CASE WHEN folder NOT IN ('', 'images', 'masks') THEN folder ELSE regexp_replace(regexp_replace(stem, '_mask$', ''), '(?i)_image[0-9]+$', '') END AS subject,
CASE WHEN starts_with(path, '/data/') THEN substr(path, 7) ELSE path END AS relative, CASE WHEN starts_with(path, '/') THEN path WHEN starts_with(path, 'raw_data/') THEN '/run/' || path ELSE '/man/' || path END AS resolved,
CASE WHEN name LIKE '%.PNG' AND regexp_matches(stem, '^[A-Za-z0-9]+(-[1-9]|_Image[0-9]+)[0-9]*_mask$') THEN regexp_replace(stem, '^([A-Za-z0-9]+)(?:-|_Image)([0-9]+)_mask$', '\\1-\\2') END AS mask_identity FROM y""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Names, folders, subjects and places of paths made from orders."""
    p = F.col("path")
    return order_paths(spark, d).select(
        "o_orderkey", "path", paths.file_stem(p).alias("stem"), paths.folder_name(p).alias("folder"), paths.subject_of_path(p).alias("subject"), paths.relative_to(p, "/data").alias("relative"),
        paths.resolved(p, "/run", "/man").alias("resolved"), paths.mask_identity(p).alias("mask_identity"),
    )


@query(f"""WITH p AS (SELECT o_orderkey, {_PATH} AS path, CASE o_orderkey % 4 WHEN 0 THEN 'T' || o_custkey || '--2024-05-0' || (o_orderkey % 9 + 1) || '_Image3' WHEN 1 THEN 'T' || o_custkey || '_Image1' WHEN 2 THEN 'T' || o_custkey ELSE '' END AS sample,
  CASE WHEN o_orderkey % 5 = 0 THEN 'nan' WHEN o_orderkey % 5 < 3 THEN '2023-01-1' || (o_orderkey % 5) ELSE '' END AS dt, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Batch ' || (o_orderkey % 7) END AS batch FROM orders),
x AS (SELECT *, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM p),
s AS (SELECT *, CASE WHEN contains(sample, '--') THEN string_split(sample, '--')[1] WHEN sample <> '' THEN string_split(sample, '_Image')[1] WHEN folder NOT IN ('', 'images') THEN folder ELSE string_split(stem, '_')[1] END AS subject,
  CASE WHEN contains(sample, '--') THEN regexp_extract(sample, '--([0-9-]{{10}})', 1) WHEN dt NOT IN ('', 'nan') THEN dt WHEN batch <> '' THEN batch ELSE 'undated' END AS seen FROM x),
t AS (SELECT *, regexp_replace(lower(subject), '[^a-z0-9]+', '_', 'g') AS a, regexp_replace(lower(seen), '[^a-z0-9]+', '_', 'g') AS b, regexp_replace(lower(stem), '[^a-z0-9]+', '_', 'g') AS c FROM s)
SELECT o_orderkey, 'c_1__' || a AS subject_id, 'c_1__' || a || '__' || b AS sample_id, 'c_1__' || a || '__' || b || '__' || c AS image_id,
'C 1:' || CASE WHEN sample <> '' THEN string_split(sample, '_Image')[1] WHEN folder NOT IN ('', 'images') THEN folder ELSE string_split(stem, '_')[1] END AS subject_group, coalesce(nullif(sample, ''), nullif(batch, ''), o_orderkey::VARCHAR) AS strongest FROM t""")
def derived_identities(spark: SparkSession, d: str) -> DataFrame:
    """Subjects, samples and images of rows that carry none."""
    rows, key = order_paths(spark, d), F.col("o_orderkey")
    user = F.col("o_custkey").cast("string")
    sample = F.when(key % 4 == 0, F.concat(F.lit("T"), user, F.lit("--2024-05-0"), (key % 9 + 1).cast("string"), F.lit("_Image3"))).when(key % 4 == 1, F.concat(F.lit("T"), user, F.lit("_Image1"))).when(key % 4 == 2, F.concat(F.lit("T"), user)).otherwise("")
    date = F.when(key % 5 == 0, "nan").when(key % 5 < 3, F.concat(F.lit("2023-01-1"), (key % 5).cast("string"))).otherwise("")
    batch = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("Batch "), (key % 7).cast("string")))
    rows = rows.withColumns({"sample": sample, "date": date, "batch": batch})
    ids = paths.derived_identity(F.lit("C 1"), F.col("sample"), F.col("date"), F.col("batch"), F.lit(""), F.col("path"))
    return rows.select("o_orderkey", *(c.alias(n) for n, c in ids.items()), paths.subject_group(F.lit("C 1"), F.col("sample"), F.col("path")).alias("subject_group"), paths.strongest_id(F.col("sample"), F.col("batch"), key).alias("strongest"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN ' [1, 2.7,3] ' WHEN 2 THEN '[]' WHEN 3 THEN ' 4,5 ' WHEN 4 THEN '' WHEN 5 THEN '[x' ELSE '[' || l_quantity::INTEGER || ',-3.5]' END AS box, CASE l_linenumber WHEN 1 THEN '3.9' WHEN 2 THEN 'x' WHEN 3 THEN '' WHEN 4 THEN '-2.5' WHEN 5 THEN '1e2' ELSE l_quantity::VARCHAR END AS number,
  CASE l_linenumber WHEN 1 THEN ' 1.50' WHEN 2 THEN '2.5' WHEN 3 THEN '' WHEN 4 THEN 'mild' WHEN 5 THEN '3' ELSE '0' END AS choice FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '[1, 2, 3]' WHEN 2 THEN '[]' WHEN 3 THEN '4,5' WHEN 4 THEN '' WHEN 5 THEN '[x' ELSE '[' || trim(box, '[]').split(',')[1] || ', -3]' END AS box, trunc(try_cast(number AS DOUBLE))::BIGINT AS number, CASE l_linenumber WHEN 1 THEN 1.5::DOUBLE WHEN 5 THEN 3 WHEN 6 THEN 0 WHEN 7 THEN 0 END AS grade FROM t""")
def parsed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, whole numbers and grades from text."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    pick = lambda values, rest: F.coalesce(*(F.when(n == k + 1, F.lit(v)) for k, v in enumerate(values)), rest)
    box = pick([" [1, 2.7,3] ", "[]", " 4,5 ", "", "[x"], F.concat(F.lit("["), q.cast("int").cast("string"), F.lit(",-3.5]")))
    number = pick(["3.9", "x", "", "-2.5", "1e2"], q.cast("string"))
    choice = pick([" 1.50", "2.5", "", "mild", "3"], F.lit("0"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", paths.crop_box(box).alias("box"), paths.whole_number(number).alias("number"), supported_grade(choice).alias("grade"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 1000 AS stage, l_tax * 12 AS raw, l_quantity, l_tax FROM lineitem), k AS (SELECT *, [0::DOUBLE, 20, 40, 60, 80, 100] AS st, ['0', '0.5', '1', '1.5', '2', '3'] AS nm FROM s),
m AS (SELECT *, list_filter(range(1, 7), lambda i: abs(st[i] - stage) <= 15 + 1e-9) AS inside FROM k)
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(inside, lambda i: nm[i]), '|') AS members, CASE WHEN l_tax * 12 >= 0.7 THEN 'Normal' WHEN l_tax * 12 >= 0.5 THEN 'Mild Endotheliosis' WHEN l_tax * 12 >= 0.3 THEN 'Moderate Endotheliosis' WHEN l_tax * 12 >= 0.1 THEN 'Severe Endotheliosis' ELSE 'Critical Endotheliosis' END AS openness,
CASE l_linenumber WHEN 1 THEN 20::DOUBLE WHEN 2 THEN -20 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE least(20, l_quantity) END AS clipped, list_position([0::DOUBLE, 0.5, 1, 1.5, 2, 3], CASE WHEN l_linenumber < 7 THEN list_extract([0::DOUBLE, 0.5, 1, 1.5, 2, 3], l_linenumber) END)::INTEGER - 1 AS class_index FROM m""")
def graded_features(spark: SparkSession, d: str) -> DataFrame:
    """Prediction sets within a residual, openness classes, clipped features, class indexes."""
    n = F.col("l_linenumber")
    odd = F.when(n == 1, float("inf")).when(n == 2, float("-inf")).when(n == 3, float("nan")).when(n == 4, F.lit(None).cast("double")).otherwise(F.col("l_quantity"))
    score = F.try_element_at(F.array(*(F.lit(s) for s in rubric.RUBRIC)), n.cast("int"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(rubric.residual_set(F.col("l_discount") * 1000, F.lit(15 + 1e-9)), "|").alias("members"), paths.openness_class(F.col("l_tax") * 12).alias("openness"),
        paths.clipped(odd).alias("clipped"), rubric.class_index(score).alias("class_index"),
    )


@query("""WITH b AS (SELECT l_orderkey, struct_pack(x0 := min(l_linenumber), y0 := min(l_quantity), x1 := max(l_linenumber) + 2, y1 := max(l_quantity) + 2, area := sum(l_quantity)) AS a, struct_pack(x0 := min(l_discount), y0 := max(l_discount), x1 := max(l_tax), y1 := max(l_tax) + 90, area := count(*)) AS o FROM lineitem GROUP BY 1)
SELECT l_orderkey, least(a.x0, o.x0) AS x0, least(a.y0, o.y0) AS y0, greatest(a.x1, o.x1) AS x1, greatest(a.y1, o.y1) AS y1, a.area + o.area AS area FROM b""")
def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The union of two boxes of each order."""
    boxes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.struct(F.min("l_linenumber").alias("x0"), F.min("l_quantity").alias("y0"), (F.max("l_linenumber") + 2).alias("x1"), (F.max("l_quantity") + 2).alias("y1"), F.sum("l_quantity").alias("area")).alias("a"),
        F.struct(F.min("l_discount").alias("x0"), F.max("l_discount").alias("y0"), F.max("l_tax").alias("x1"), (F.max("l_tax") + 90).alias("y1"), F.count("*").alias("area")).alias("b"),
    )
    return boxes.select("l_orderkey", paths.merged_box(F.col("a"), F.col("b")).alias("m")).select("l_orderkey", "m.*")


@query("""SELECT l_orderkey, round(sum(l_quantity * l_discount), 6) AS quantity_x_discount, round(sum(l_quantity * l_tax), 6) AS quantity_x_tax, sum((l_returnflag = 'A')::INTEGER)::DOUBLE AS flag_A, sum((l_returnflag = 'N')::INTEGER)::DOUBLE AS flag_N, sum((l_returnflag = 'R')::INTEGER)::DOUBLE AS flag_R FROM lineitem GROUP BY 1""")
def feature_products(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise products and one-hot classes, summed by order."""
    lines = table(spark, d, "lineitem")
    products = {f"{a[2:]}_x_{b[2:]}": F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0)) for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"))}
    hot = {f"flag_{v}": (F.col("l_returnflag") == v).cast("double") for v in "ANR"}
    return lines.groupBy("l_orderkey").agg(*(F.round(F.sum(c), 6).alias(n) for n, c in products.items()), *(F.sum(c).alias(n) for n, c in hot.items()))


@query("""SELECT list_sort(list(DISTINCT format)) AS formats, count(*) AS files FROM (SELECT CASE WHEN regexp_matches(st, '^[A-Za-z0-9]+-[1-9][0-9]*$') THEN 'canonical' WHEN regexp_matches(st, '^[A-Za-z0-9]+_Image[0-9]+$') THEN 'legacy' ELSE 'invalid' END AS format, st
  FROM (SELECT regexp_replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', ''), '_mask$', '') AS st FROM (SELECT """ + _PATH + """ AS p FROM orders)))""")
def naming_inventory(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of names in use, in order of their first letter, and the files."""
    stem = F.regexp_replace(paths.file_stem(F.col("path")), "_mask$", "")
    return order_paths(spark, d).agg(F.array_sort(F.array_distinct(F.collect_set(naming_format(stem)))).alias("formats"), F.count("*").alias("files"))
