"""Annotation rules on exports written as JSON."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import annotations as ann
from tessera.operators.contracts import ContractError


def region(id_="g1", label=ann.COMPLETE, kind="brushlabels", rle=(0, 10, 1, 5)):
    return {"id": id_, "from_name": "roi", "to_name": "image", "type": kind, "original_width": 1024, "original_height": 768, "value": {"format": "rle", "rle": list(rle), "brushlabels": [label]}}


def grade(id_="g1", choice="1"):
    return {"id": id_, "from_name": ann.GRADE_FIELD, "to_name": "image", "type": "choices", "value": {"choices": [choice]}}


def task(results, by=7, predictions=(), release="", parent=None):
    return {
        "id": 9001, "file_upload": "ab12-T40_Image0.jpg", "data": {"image": "/data/T40_Image0.jpg", "mask_release_id": release},
        "predictions": [{"id": 44, "model_version": v, "result": r} for v, r in predictions],
        "annotations": [{"id": 9100, "completed_by": by, "parent_prediction": parent, "updated_at": "2024-01-02", "result": results}],
    }


@pytest.fixture(scope="module")
def read(spark):
    def read(*tasks):
        from tessera.plans.reviews import _fields

        df = spark.createDataFrame([(json.dumps(list(tasks)),)], "j string")
        return df.select(F.explode(F.from_json("j", f"array<struct<{', '.join(_fields())}>>")).alias("t")).select("t.*")

    return read


def test_one_row_a_region(read):
    rows = ann.valid_regions(ann.regions(read(task([region("b"), grade("b", "1.5"), region("a"), grade("a", " 3.0")], by={"id": 9, "email": "g@example.org"})))).collect()
    assert [(r["region_id"], r["human_grade"]) for r in sorted(rows, key=lambda r: r["region_id"])] == [("a", 3.0), ("b", 1.5)]
    assert {(r["record_id"], r["grader_email"]) for r in rows} == {("T40_Image0::a::9100::9", "g@example.org"), ("T40_Image0::b::9100::9", "g@example.org")}
    assert {(r["proposal_kind"], r["region_edit_state"]) for r in rows} == {("human_manual", "manual_drawn")}


@pytest.mark.parametrize("error,made", [
    ("duplicate-grade", task([region(), grade(), grade(choice="2")])),
    ("missing-region-link", task([grade("other")])),
    ("missing-region-link", task([grade(), region()])),
    ("excluded-region-grade", task([region(label=ann.CUTOFF), grade()])),
    ("missing-provenance", task([region(), grade()], by=None)),
    ("missing-provenance", task([region(), grade()], by={"email": "x"})),
    ("missing-grade", task([region()])),
    ("missing-grade", task([region(), grade(choice="2.5")])),
    ("non-brush-region", task([region(kind="polygonlabels"), grade()])),
    ("contradictory-lineage", task([region(), grade()], predictions=[("other", [region()])])),
])
def test_broken_rules(read, error, made):
    rows = ann.regions(read(made))
    assert [r["error"] for r in rows.collect()] == [error]
    with pytest.raises(ContractError, match=error):
        ann.valid_regions(rows)


@pytest.mark.parametrize("made,want", [
    (task([region(rle=(0, 8)), grade()], predictions=[(ann.RELEASE_PREFIX + "r1", [region()])]), ("auto_preload", "human_refined_boundary", "r1")),
    (task([region(), grade()], predictions=[("x", [region()])], release="r2"), ("auto_preload", "unedited_auto", "r2")),
    (task([region(), grade()], predictions=[(ann.RELEASE_PREFIX + "old", [region(rle=(1,))]), (ann.RELEASE_PREFIX + "new", [region()])]), ("auto_preload", "unedited_auto", "new")),
    (task([region(), grade()], parent=5), ("box_assisted_manual", "human_refined_boundary", "")),
])
def test_lineage(read, made, want):
    r = ann.valid_regions(ann.regions(read(made))).first()
    assert (r["proposal_kind"], r["region_edit_state"], r["mask_release_id"]) == want


def test_excluded_regions_dont_count(read):
    rows = ann.complete_regions(ann.valid_regions(ann.regions(read(task([region("a"), grade("a"), region("c", ann.CUTOFF)]))))).collect()
    assert [r["region_id"] for r in rows] == ["a"]


def test_latest_choice_wins(read):
    first, second = task([grade(choice="0")]), task([grade(choice="2")])
    both = first | {"annotations": [second["annotations"][0] | {"id": 1, "updated_at": "2025-01-01"}, *first["annotations"]]}
    rows = ann.choice_scores(read(both)).collect()
    assert [(r["image_name"], r["score"], r["score_status"]) for r in rows] == [("T40_Image0.jpg", 2.0, "ok")]
    none = task([]) | {"annotations": []}
    assert ann.choice_scores(read(none)).first()["score_status"] == "missing_annotation"
    assert ann.choice_scores(read(task([grade(), grade(choice="2")]))).first()["score_status"] == "ambiguous_score"


def test_export_is_shuffled_and_parsed_once(spark, sf_dir):
    from tessera.plans import reviews

    plan = reviews.graded_regions(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("from_json") == 1
