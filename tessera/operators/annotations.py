"""Nested annotation exports: a row for each graded region, with its lineage and the rule that it breaks.

All of an annotation's results are looked at in its own arrays, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rubric import RUBRIC
from tessera.operators.contracts import ContractError
from tessera.operators.manifest import stem
from tessera.operators.states import route

_ITEM = """struct<id:string, from_name:string, to_name:string, type:string, original_width:int, original_height:int, value:struct<format:string, rle:array<int>, points:string,
brushlabels:array<string>, polygonlabels:array<string>, rectanglelabels:array<string>, labels:array<string>, choices:array<string>>>"""
#: An export; completed_by is a number or an object, read as its text.
TASKS = f"""id bigint, file_upload string, data struct<image:string, mask_release_id:string>, created_at string, updated_at string,
predictions array<struct<id:bigint, model_version:string, result:array<{_ITEM}>>>,
annotations array<struct<id:bigint, completed_by:string, created_at:string, updated_at:string, lead_time:double, parent_prediction:string, result:array<{_ITEM}>>>"""
#: Labels of regions, the field of grades, kinds of regions, the prefix of a model version that names a release.
COMPLETE, CUTOFF = "complete_glomerulus", "cutoff_partial_glomerulus"
GRADE_FIELD, REGION_KINDS = "endotheliosis_grade", ("brushlabels", "polygonlabels", "rectanglelabels")
RELEASE_PREFIX = "medsam-release:"


def image_name(task_upload: Column, image: Column) -> Column:
    """The uploaded file's name without its prefix up to the first hyphen, else the last part of the image's address."""
    upload = F.trim(F.coalesce(task_upload, F.lit("")))
    return F.when(upload != "", F.regexp_replace(upload, "^[^-]*-", "")).otherwise(F.regexp_extract(F.trim(F.coalesce(image, F.lit(""))), r"([^/]*)$", 1))


def supported_grade(choice: Column) -> Column:
    """The rubric value that a choice's text names; null for others."""
    value = F.trim(choice).try_cast("double")
    return F.try_element_at(F.filter(F.array(*(F.lit(v) for v in RUBRIC)), lambda v: F.abs(v - value) < 1e-9), F.lit(1))


def _supported(item: Column) -> Column:
    """The supported grades of one item."""
    return F.array_compact(F.transform(_list(item["value"]["choices"]), supported_grade))


def supported_grades(items: Column) -> Column:
    """All supported grades of the items that are choices."""
    return F.flatten(F.transform(F.filter(items, lambda r: r["type"] == "choices"), _supported))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _labels(item: Column) -> Column:
    v = item["value"]
    return F.concat(_list(v["brushlabels"]), _list(v["polygonlabels"]), _list(v["rectanglelabels"]), _list(v["labels"]))


def _geometry(item: Column) -> Column:
    v = item["value"]
    return F.struct(*(v[k].alias(k) for k in ("format", "rle", "points", "brushlabels", "polygonlabels", "rectanglelabels")))


def grader(completed_by: Column) -> Column:
    """struct(user, email, first, last) of a plain id or an object with one; user is null where there is none."""
    part = lambda k: F.coalesce(F.get_json_object(completed_by, f"$.{k}"), F.lit(""))
    is_object = F.coalesce(completed_by, F.lit("")).startswith("{")
    user = F.nullif(F.trim(F.when(is_object, part("id")).otherwise(F.coalesce(completed_by, F.lit("")))), F.lit(""))
    return F.struct(user.alias("user"), *(F.when(is_object, part(k)).otherwise("").alias(n) for n, k in (("email", "email"), ("first", "first_name"), ("last", "last_name"))))


def release_of(model_version: Column) -> Column:
    """The release that a model version names, or empty."""
    text = F.trim(F.coalesce(model_version, F.lit("")))
    return F.when(text.startswith(RELEASE_PREFIX), F.trim(F.substring(text, len(RELEASE_PREFIX) + 1, 1 << 30))).otherwise("")


def regions(tasks: DataFrame) -> DataFrame:
    """A row for each region of each annotation of `tasks` (schema TASKS): record_id, image_id, region_id, completeness, grade, grader, lineage and error.

    error is the first rule broken: missing-provenance, missing-region-link (an annotation's grades without a region before them; region_id is then null), non-brush-region,
    ambiguous-region-label, duplicate-grade, ambiguous-grade, excluded-region-grade, missing-grade, contradictory-lineage. Of items with one id the last counts as
    the region. Annotations without regions and errors give no rows.
    """
    name = image_name(F.col("file_upload"), F.col("data.image"))
    item = tasks.schema["annotations"].dataType.elementType["result"].dataType
    c, blank, text = F.col, F.lit(""), F.lit(None).cast("string")
    listed = lambda x: F.coalesce(x, F.array().cast(item))
    one = tasks.select(
        c("id").cast("string").alias("task_id"), name.alias("image_name"), stem(name).alias("image_id"), F.trim(F.coalesce(c("data.mask_release_id"), blank)).alias("task_release"),
        F.filter(F.coalesce("predictions", F.array().cast(tasks.schema["predictions"].dataType)), lambda p: p["result"].isNotNull()).alias("predictions"), F.posexplode_outer("annotations").alias("at", "a"),
    ).filter("at is not null")  # a plain explode tests its array in a filter of its own first, which Spark then computes twice from the text up
    # a row an annotation: its items, and beside each the id that it has as a region or a grade
    is_region = lambda r, labels: r["type"].isin(*REGION_KINDS) & F.arrays_overlap(labels, F.array(F.lit(COMPLETE), F.lit(CUTOFF)))
    is_grade = lambda r: (r["type"] == "choices") & (r["from_name"] == GRADE_FIELD)
    mark = lambda r: F.when(r["id"] != "", F.struct(F.when(is_region(r, _labels(r)), r["id"]).alias("region"), F.array_contains(_labels(r), COMPLETE).alias("complete"), F.array_contains(_labels(r), CUTOFF).alias("cutoff"), F.when(is_grade(r), r["id"]).alias("grade"), F.when(is_grade(r), _supported(r)).alias("values")))
    one = one.select(
        "task_id", "image_name", "image_id", "task_release", c("a.id").alias("annotation_id"), c("a.updated_at").alias("annotation_updated_at"), grader(c("a.completed_by")).alias("who"),
        (F.trim(F.coalesce("a.parent_prediction", blank)) != "").alias("parent"), listed(c("a.result")).alias("items"), F.transform(listed(c("a.result")), mark).alias("marks"),
        F.flatten("predictions.result").alias("predicted"), F.transform(F.flatten("predictions.result")["id"], lambda i: F.trim(F.coalesce(i, blank))).alias("predicted_ids"),
        F.flatten(F.transform("predictions", lambda p: F.array_repeat(p["model_version"], F.size(p["result"])))).alias("versions"),
    )
    ids = lambda kind: F.array_except(c(f"marks.{kind}"), F.array(text))
    loose = F.exists(ids("grade"), lambda g: ~F.array_position(c("marks.region"), g).between(1, F.array_position(c("marks.grade"), g)))
    broken = F.when(c("who.user").isNull(), "missing-provenance").when(loose, "missing-region-link")
    of_grades = lambda id_: F.flatten(F.filter("marks", lambda m: m["grade"] == id_)["values"])
    last = lambda at, id_: F.size(at) - F.array_position(F.reverse(at), id_).cast("int")
    places = F.transform(F.sort_array(ids("region")), lambda id_: F.struct(
        id_.alias("id"), last(c("marks.region"), id_).alias("at"), last(c("predicted_ids"), id_).alias("seen"), (F.size("marks.grade") - F.size(F.array_remove(c("marks.grade"), id_))).alias("grades"), of_grades(id_).alias("values")
    ))
    found = F.transform(places, lambda x: F.struct(*(x[k].alias(k) for k in ("id", "at", "seen", "grades", "values")), F.get("marks", x["at"])["complete"].alias("complete"), F.get("marks", x["at"])["cutoff"].alias("cutoff")))
    no = F.lit(False)
    none = F.array(F.struct(text.alias("id"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("seen"), F.lit(0).alias("grades"), F.array().cast("array<double>").alias("values"), no.alias("complete"), no.alias("cutoff")))
    kept = [n for n in one.columns if n != "marks"]
    one = one.select(*kept, broken.alias("broken"), found.alias("found")).withColumn("found", F.when(c("broken").isNull(), c("found")).otherwise(none))
    # a row a region, without higher-order functions, so that Spark compiles all of it
    rows = one.select("*", F.posexplode_outer("found").alias("_", "x")).filter("x is not null").withColumns({
        "region_id": c("x.id"), "values": c("x.values"), "grades": c("x.grades"), "complete": c("x.complete"), "cutoff": c("x.cutoff"), "grade": F.when(F.size("x.values") == 1, F.get("x.values", F.lit(0))),
        "region": F.get("items", c("x.at")), "auto": F.coalesce(c("x.seen") < F.size("predicted_ids"), F.lit(False)), "seen": F.get("predicted", c("x.seen")), "version": F.get("versions", c("x.seen")),
    })
    complete, cutoff, auto, parent, grade = (c(n) for n in ("complete", "cutoff", "auto", "parent", "grade"))
    release = F.when(c("task_release") != "", c("task_release")).otherwise(F.when(auto, release_of(c("version"))).otherwise(""))
    error = F.when(c("broken").isNotNull(), c("broken")).otherwise(route([
        (c("region.type") != "brushlabels", "non-brush-region"), (complete == cutoff, "ambiguous-region-label"), (c("grades") > 1, "duplicate-grade"), (F.size("values") > 1, "ambiguous-grade"),
        (cutoff & grade.isNotNull(), "excluded-region-grade"), (complete & grade.isNull(), "missing-grade"), (auto & (release == ""), "contradictory-lineage"),
    ], ""))
    same = _geometry(c("region")).eqNullSafe(_geometry(c("seen")))
    return rows.select(
        F.concat_ws("::", "image_id", "region_id", c("annotation_id").cast("string"), "who.user").alias("record_id"), "task_id", "annotation_id", "image_id", "image_name", "region_id",
        F.when(complete, "complete").otherwise("excluded").alias("completeness_status"), F.when(cutoff, CUTOFF).otherwise("").alias("exclusion_reason"), grade.alias("human_grade"),
        c("who.user").alias("grader_user_id"), c("who.email").alias("grader_email"), "annotation_updated_at", c("region.value.rle").alias("region_rle"),
        F.when(auto, "auto_preload").when(parent, "box_assisted_manual").otherwise("human_manual").alias("proposal_kind"),
        F.when(auto, F.when(same, "unedited_auto").otherwise("human_refined_boundary")).when(parent, "human_refined_boundary").otherwise("manual_drawn").alias("region_edit_state"),
        release.alias("mask_release_id"), F.when(auto, "medsam_finetuned_glomeruli").when(parent, "box_assisted_medsam").otherwise("manual").alias("mask_source"), F.nullif(error, F.lit("")).alias("error"),
    )


def valid_regions(rows: DataFrame) -> DataFrame:
    """The rows of regions(), or an error that names the first ones broken."""
    bad = rows.filter("error is not null").orderBy("task_id", "annotation_id", "region_id").limit(10).collect()
    if bad:
        raise ContractError("; ".join(f"{r['error']} for region {r['region_id']} of task {r['task_id']}" for r in bad))
    return rows.drop("error")


def complete_regions(rows: DataFrame) -> DataFrame:
    """Those that count for a subject: complete ones."""
    return rows.filter("completeness_status = 'complete'")


def choice_scores(tasks: DataFrame) -> DataFrame:
    """(task_id, image_name, score, score_status): one score an image of a task, the latest annotation's; several supported choices in one annotation are ambiguous."""
    name = image_name(F.col("file_upload"), F.col("data.image"))
    one = tasks.select(F.col("id").alias("task_id"), name.alias("image_name"), F.explode_outer("annotations").alias("a"))
    values = supported_grades(F.coalesce("a.result", F.array().cast(tasks.schema["annotations"].dataType.elementType["result"].dataType)))
    rows = one.withColumn("values", values).withColumn("status", route([(F.col("a").isNull(), "missing_annotation"), (F.size("values") > 1, "ambiguous_score"), (F.size("values") == 0, "missing_score")], "ok"))
    latest = F.max_by(F.struct("values", "status"), F.struct(F.coalesce("a.updated_at", F.lit("")), F.coalesce("a.id", F.lit(0)))).alias("x")
    return rows.groupBy("task_id", "image_name").agg(latest).select("task_id", "image_name", F.when(F.col("x.status") == "ok", F.col("x.values")[0]).alias("score"), F.col("x.status").alias("score_status"))
