"""Audit rules on tables of a user's own."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import audits
from tessera.operators.contracts import ContractError


def test_crops(spark):
    rows = spark.createDataFrame([("a", 1, "bg", 0.1), ("a", 1, "bg", 0.3), ("a", 2, "fg", None), ("b", 1, "fg", 0.5), ("b", 1, None, 0.5)], "k string, image int, c string, s double")
    got = {r["k"]: r for r in audits.crop_audit(rows, "k", "image", F.col("c"), F.col("s"), ("bg", "fg"), {"bg": 1, "fg": 1}, 2).collect()}
    assert (got["a"]["bg"], got["a"]["fg"], got["a"]["images"], got["a"]["reasons"]) == (2, 1, 2, "") and got["a"]["mean_share"] == pytest.approx(0.2)
    assert got["b"]["reasons"] == "too_few_bg|too_few_images" and got["b"]["crops"] == 2


def test_transforms(spark):
    rows = spark.createDataFrame([("a", 1.0, "F", False, 0.1), ("a", 9.0, "O", False, 0.1), ("b", 5.0, "F", True, 0.9), ("c", 5.0, "F", False, 0.0), ("c", 5.1, "O", False, 0.0)], "k string, v double, side string, odd boolean, burden double")
    got = {r["k"]: (r["reasons"], r["shift"]) for r in audits.transform_audit(rows, "k", F.col("v"), F.col("side"), "F", "O", F.col("odd"), F.col("burden"), 10, 0.1, 1, 0.5).collect()}
    assert got["a"] == ("area_changed|markers_moved", 8.0) and got["b"] == ("unexpected_values|foreground_burden", None) and got["c"][0] == ""


def test_gates_blockers_views(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, 5), ("a", "y", 0.0, 2), ("b", "z", 0.0, 3), ("b", None, None, 9)], "k string, kind string, v double, id int")
    assert {r["k"]: (r["blockers"], r["status"]) for r in audits.feature_gates(rows, "k", {"v": (F.col("v"), 0.4, "high")}).select("k", "blockers", "status").collect()} == {"a": ("high", "failed_visual_feature_readiness"), "b": ("", "passed")}
    assert sorted((r["k"], r["blocker"], r["scope"]) for r in audits.hard_blockers(rows, "k", F.col("kind"), ("x", "z")).collect()) == [("a", "missing_z", "scope:a"), ("b", "missing_x", "scope:b")]
    seen = rows.filter("kind is not null")
    assert sorted(tuple(r) for r in audits.preferred(seen, ["k"], "kind", "y", "id").collect()) == [("a", "y", 2), ("b", "z", 3)]


def test_subject_split(spark):
    many = spark.createDataFrame([(s,) for s, n in ((1, 3), (2, 4), (3, 2), (4, 1)) for _ in range(n)], "s int")
    assert {r["s"]: r["split"] for r in audits.subject_split(many, "s", F.col("s"), 0.25).collect()} == {1: "validation", 2: "training", 3: "training", 4: "training"}  # 2.5 is 2
    assert {r["s"]: r["split"] for r in audits.subject_split(many, "s", -F.col("s"), 1.0).collect()} == {1: "training", 2: "validation", 3: "validation", 4: "validation"}  # one always trains
    assert {r["s"]: r["split"] for r in audits.subject_split(many, "s", F.col("s"), 0.01).collect()}[1] == "validation"  # one image at least
    for few in (many.filter("s = 1"), many.limit(0)):
        with pytest.raises(ContractError):
            audits.subject_split(few, "s", F.col("s"), 0.2)
