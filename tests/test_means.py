"""Means that don't depend on how rows are dealt out."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import strata


def test_exact_mean_at_a_tie(spark):
    """0.1 * 10 added up in doubles is below 1: the mean of exact values isn't."""
    rows = spark.createDataFrame([(1, 0.1)] * 10 + [(2, float("nan")), (2, 1.0), (3, None), (4, 1e-20), (4, 3e-20), (5, 1e30), (6, 9e12), (6, 9e12)], "k int, v double").coalesce(1)
    got = {r["k"]: r["m"] for r in rows.groupBy("k").agg(strata.exact_mean(F.col("v")).alias("m")).collect()}
    assert got[1] == 0.1 and got[2] != got[2] and got[3] is None and got[4] == pytest.approx(2e-20) and got[5] == 1e30 and got[6] == 9e12


def test_cohort_means_do_not_depend_on_partitions(spark):
    first = spark.createDataFrame([("k", 0.1)] * 10, "k string, v double").coalesce(1)
    second = spark.createDataFrame([("k", 0.1)], "k string, v double")
    row = strata.cohort_stability(first, second, "k", "v", 0.0).first()
    assert row["gap"] == 0.0 and row["stable"]


def test_promotion_at_its_margin(spark, tmp_path):
    """60 equal values have that value as mean; added up in doubles they fall on the margin's other side."""
    from tessera.plans import evaluation

    rows = [(1, "A", 0.003)] * 60 + [(1, "R", 0.001)] * 60
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert evaluation.promotion_decision(spark, str(tmp_path)).first()["decision"] == ("tie" if 0.003 - 0.001 <= 0.002 else "first")


def test_scales_apply_to_the_mean(spark):
    """The SQL scales the mean, not each row: scaled rows round once more each."""
    from tessera.operators import audits, reviews

    rows = spark.createDataFrame([(1, 0.07)] * 7, "k int, v double").coalesce(1)
    got = audits.feature_gates(rows, "k", {"m": (F.col("v"), 0.7, "high")}, {"m": lambda m: m * 10}).first()
    assert got["m"] == 0.49 / 7 * 10
    lines = spark.createDataFrame([(1, r, v, 0.0, 0.0, 0.0, True) for r, v in (("N", 3.0), ("N", 8.0), ("R", 9.0))], "k int, run string, dice double, recall double, ratio_error double, background double, gate_ok boolean")
    got = reviews.run_decision(lines, "k", "run", F.lit(True), "N", "R", "A", 0.05, scaled={"dice": lambda m: m / 1000}).first()
    assert (got["status"], got["reason"][:20]) == ("current_cleared", "less_downsampled_pol")
