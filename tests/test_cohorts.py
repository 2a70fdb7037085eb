"""Cohort builders, the review queue and merges that need equal counts."""

from pyspark.sql import functions as F

from tessera.operators import cohorts, joins, rank


def test_decoded_masks_beside_scores(spark):
    decoded = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c"), ("9", "d")], "source_score_row string, image_path string").withColumn("score", F.lit(7.0))
    scores = spark.createDataFrame([(1, "i1", "T9", 1.5, "ok"), (2, "i2", "M1", None, "missing"), (3, "i3", " t-4 ", 2.0, "ok"), (4, "i4", "M7", None, "ok"), (None, "i5", None, 0.5, "ok")], "task_id long, image_name string, source_sample_id string, score double, score_status string")
    rows = cohorts.decoded_cohort(decoded, scores, "dox", "sheet", "path", ["x", "y"]).collect()
    got = [(r["source_score_row"] or "-", r["image_path"], r["score"], r["join_status"], r["admission_status"], r["exclusion_reason"]) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, [
        ("1", "a", 1.5, "joined", "pending", ""), ("2", "b", None, "pending_discovery", "unresolved", "missing_score"), ("-", "c", None, "pending_discovery", "unresolved", "missing_score"),
        ("9", "d", None, "pending_discovery", "unresolved", "missing_score"), ("3", "", 2.0, "foreign_row", "foreign", "foreign_mixed_export_row"),
        ("4", "", None, "pending_discovery", "unresolved", "not_materialized_in_decoded_brushlabel_surface"), ("-", "", 0.5, "pending_discovery", "unresolved", "not_materialized_in_decoded_brushlabel_surface"),
    ]))
    assert cohorts.decoded_cohort(decoded.limit(0), scores, "dox", "s", "p", []).count() == 5
    assert cohorts.decoded_cohort(decoded, scores.limit(0), "dox", "s", "p", []).count() == 4


def test_scored_images(spark):
    scores = spark.createDataFrame([("a", "m", "n", "s", "1", 2.0, "ok", "ok"), ("b", "m", "n", "s", "2", None, "ok", "missing"), ("c", None, "n", "s", "3", 1.0, None, "ok")], "raw_image_path string, raw_mask_path string, image_name string, image_stem string, source_task_id string, score double, join_status string, score_status string")
    assert [(r["source_image_path"], r["lane_assignment"], r["discovery_surfaces"]) for r in cohorts.scored_cohort(scores, "sheet", "path", ["x", "y"]).collect()] == [("a", "manual_mask_core", "x;y")]


def test_review_queue(spark):
    rows = [(1, "i", 0.9, 1, 0, 0, 0), (2, "i", 0.9, 1, 0, 0, 0), (3, "j", 0.5, 1, 0, 0, 1), (4, "k", 0.1, 0, 1, 1, 0), (5, "l", None, None, 1, 0, 0), (6, "k", 0.2, 0, 1, None, 0)]
    df = spark.createDataFrame(rows, "id int, image string, p double, wrong int, missing int, severe int, cluster int")
    got = rank.review_queue(df, "id", "image", "p", F.col("wrong") == 1, F.col("missing") == 1, F.col("severe") == 1, "cluster", most_sure=2, most_near=1)
    assert sorted((r["review_priority"], r["review_bucket"], r["id"], r["cluster"], r["cluster_size"]) for r in got.collect()) == [
        (10, "cluster_representative_false_positive", 1, 0, 2), (11, "cluster_representative_false_positive", 3, 1, 1), (100, "highest_confidence_false_positive", 1, 0, None),
        (200, "threshold_boundary_false_positive", 3, 1, None), (300, "segmentation_miss", 4, None, None), (301, "segmentation_miss", 5, None, None), (400, "human_severe_reference", 4, None, None),
    ]
    assert rank.review_queue(df.limit(0), "id", "image", "p", F.lit(True), F.lit(True), F.lit(True), "cluster").count() == 0


def test_merge_if_counts_agree(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    other = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, v string, f int")
    out, status = joins.merge_if_counts_agree(base, other, ["id"])
    assert status == "joined" and sorted(map(tuple, out.collect())) == [(1, "a", 5), (2, "b", 6)]
    for right, want in ((None, "absent"), (other.limit(1), "row_count_mismatch"), (other.drop("id"), "missing_keys"), (other.withColumn("id", F.lit(1)), "duplicate_keys"), (other.drop("f"), "nothing_to_add")):
        same, said = joins.merge_if_counts_agree(base, right, ["id"])
        assert said == want and same is base
