"""Manifest rules on small tables, and numbering without one task."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import manifest as man
from tessera.operators import rank, running, strata
from tessera.operators.contracts import ContractError

SCHEMA = """seq int, cohort_id string, image_path string, mask_path string, score double, source_image_name string, source_sample_id string, source_score_row string, source_batch string, source_date string,
lane_assignment string, join_status string, verification_status string, admission_status string, exclusion_reason string, mapping_review_status string, discovery_surfaces string, image_exists boolean, mask_exists boolean, image_sha256 string"""


def row(seq, **values):
    base = {
        "seq": seq, "cohort_id": "dated", "image_path": f"images/M{seq}.jpg", "mask_path": "", "score": 2.0, "source_image_name": f"M{seq}_Image0.jpg", "source_sample_id": f"M{seq}", "source_score_row": str(seq), "source_batch": "", "source_date": "",
        "lane_assignment": "", "join_status": "", "verification_status": "", "admission_status": "", "exclusion_reason": "", "mapping_review_status": "", "discovery_surfaces": "", "image_exists": True, "mask_exists": False, "image_sha256": "h",
    } | values
    return tuple(base.values())


def test_enrich_admits_complete_rows(spark):
    df = spark.createDataFrame([row(1, mask_path="m.png", mask_exists=True), row(2, score=None), row(3, image_exists=False), row(4, admission_status="foreign", lane_assignment="manual_mask")], SCHEMA)
    rows = {r["seq"]: r for r in man.enriched(df, "seq").collect()}
    assert (rows[1]["admission_status"], rows[1]["verification_status"], rows[1]["lane_assignment"]) == ("admitted", "passed", man.EXTERNAL)
    assert rows[1]["harmonized_id"] == "dated__m1_image0_jpg" and rows[1]["manifest_row_id"] == "dated__000001"
    assert (rows[2]["join_status"], rows[2]["exclusion_reason"]) == ("pending_discovery", "missing_score")
    assert (rows[3]["join_status"], rows[3]["exclusion_reason"]) == ("failed", "image_unreadable")
    assert rows[4]["admission_status"] == "foreign" and rows[4]["lane_assignment"] == man.CORE


def test_equal_rows_are_evidence(spark):
    df = spark.createDataFrame([row(1, image_path="a.jpg"), row(2, image_path="a.jpg"), row(3, image_path=""), row(4, image_path="")], SCHEMA)
    got = sorted((r["seq"], r["duplicate_evidence_count"]) for r in man.merge_equal_rows(df, "seq").collect())
    assert got == [(1, "2"), (3, ""), (4, "")]


def test_two_scores_exclude_an_image(spark):
    df = spark.createDataFrame([row(1, image_path="a.jpg", score=1.0), row(2, image_path="a.jpg", score=2.0), row(3)], SCHEMA)
    rows = {r["seq"]: r for r in man.verified(man.enriched(df, "seq")).collect()}
    assert [(rows[k]["verification_status"], rows[k]["admission_status"]) for k in (1, 3)] == [("failed", "excluded"), ("passed", "admitted")]
    assert rows[1]["exclusion_reason"] == "conflicting_duplicate_scores"


def test_no_columns_tell_rows_apart(spark):
    df = spark.createDataFrame([row(1), row(1)], SCHEMA)
    with pytest.raises(ContractError, match="dated"):
        man.discriminators(df)
    two = spark.createDataFrame([row(1, source_image_name="x", source_sample_id="a"), row(2, source_image_name="x", source_sample_id="b"), row(3, source_image_name="y", source_sample_id="a", source_score_row="")], SCHEMA)
    assert man.discriminators(two, man.DISCRIMINATORS[:3]) == {"dated": ["source_image_name", "source_sample_id"]}


def test_discovery_waits_for_surfaces(spark):
    cohorts = man.Cohorts(surfaces={"dated": ("one", "two")})
    df = spark.createDataFrame([row(1, admission_status="unresolved", discovery_surfaces="two"), row(2, admission_status="pending_discovery", discovery_surfaces="one; two"), row(3, admission_status="admitted")], SCHEMA)
    got = {r["seq"]: (r["admission_status"], r["exclusion_reason"]) for r in man.discovery(df, cohorts).collect()}
    assert got == {1: ("pending_discovery", "pending_discovery:one"), 2: ("unresolved", "discovery_exhausted"), 3: ("admitted", "")}


def test_repeated_image_ids_are_an_error(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "image_id string")
    with pytest.raises(ContractError, match="image_id repeats: a"):
        man.require_unique(df, "image_id")


def test_replicates_and_concordance(spark):
    wide = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 4.0)], "image_a double, image_b double").unpivot([], ["image_a", "image_b"], "image", "value")
    got = {r["image"]: (r["score"], r["replicate_count"]) for r in man.replicate_medians(wide, "image", "value").collect()}
    assert got == {"image_a": (2.0, 2), "image_b": (2.0, 3)}
    rois = spark.createDataFrame([("mr-1", 1.0, 100), ("mr-1", 3.0, 120), ("mr-1", 0.0, 10), ("mr-2", 2.0, 20)], "manifest_row_id string, roi_grade double, component_area int")
    rows = spark.createDataFrame([("mr-1", 2.0), ("mr-2", 1.0)], "manifest_row_id string, score double")
    got = {r["manifest_row_id"]: (r["inferred_image_median"], r["accepted_roi_count"], r["concordance_status"]) for r in man.concordance(rows, rois).collect()}
    assert got == {"mr-1": (2.0, 2, "ok"), "mr-2": (None, 0, "non_evaluable")}


def test_numbers_over_many_ranges(spark):
    keys = [((k * 37) % 101, k) for k in range(500)] + [(None, 900), (None, 901)]
    df = spark.createDataFrame(keys, "key int, tie int")
    for down in (False, True):
        got = {(r["key"], r["tie"]): r["n"] for r in running.numbered(df, "key", "n", ["tie"], down).collect()}
        order = sorted(keys, key=lambda x: ((x[0] is None, -x[0] if x[0] is not None else 0) if down else (x[0] is not None, x[0] or 0), x[1]))
        assert got == {x: k + 1 for k, x in enumerate(order)}
    assert running.numbered(df.limit(0), "key", "n").count() == 0


def test_splits_and_shares(spark):
    df = spark.range(1, 11)
    got = {r["id"]: (r["split"], r["place"]) for r in rank.split_by_rank(df, "id", [("a", 0.5), ("b", 0.2)], "c").collect()}
    assert got == {k: ("a", k) if k < 6 else ("b", k - 5) if k < 8 else ("c", k - 7) for k in range(1, 11)}
    lines = df.select((F.col("id") % 2).alias("g"), "id")
    assert sorted((r["g"], r["id"]) for r in rank.first_share(lines, "g", ["id"], 0.5).collect()) == [(0, 2), (0, 4), (0, 6), (1, 1), (1, 3), (1, 5)]


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 5.0), (None, 2.0), (None, 3.0), ("a", None)], "k string, v double")
    got = {r["k"]: (r["low"], r["mid"], r["high"]) for r in strata.percentiles(df, ["k"], "v", {"low": 0.0, "mid": 0.75, "high": 1.0}).collect()}
    assert got == {"a": (1.0, 2.5, 4.0), "b": (5.0, 5.0, 5.0), None: (2.0, 2.75, 3.0)}
