"""Choice of features inside folds, aligned probabilities, intervals of ranking metrics."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import resample, selection


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    n = 240
    y = rng.choice([0, 1, 3], n)
    fold = np.arange(n) % 3
    y[(fold != 0) & (y == 3)] = 1  # only fold 0 has class 3
    x = np.column_stack([y + rng.normal(size=n) * 0.3, rng.normal(size=n) * 50, np.full(n, 4.0), -y + rng.normal(size=n)])
    rows = [(int(k), int(f), int(c), *map(float, r)) for k, (f, c, r) in enumerate(zip(fold, y, x, strict=True))]
    return spark.createDataFrame(rows, "id int, fold int, y int, a double, wide double, flat double, b double"), x, y, fold


def test_scores_match_plain_formula(data):
    df, x, y, fold = data
    got = {(r["fold"], r["feature"]): r for r in selection.fold_scores(df, ["a", "wide", "flat", "b"], "fold", "y").collect()}
    for f in range(3):
        for k, name in enumerate(["a", "wide", "flat", "b"]):
            v, c = x[fold != f, k], y[fold != f]
            groups = [v[c == g] for g in np.unique(c)]
            between = sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups) / (len(groups) - 1)
            within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(v) - len(groups))
            r = got[f, name]
            assert math.isclose(r["variance"], v.var(), rel_tol=1e-9, abs_tol=1e-9)
            assert r["f_score"] is None if name == "flat" else math.isclose(r["f_score"], between / within, rel_tol=1e-7)


def test_probabilities_over_preset_classes(data):
    df, _, y, fold = data
    got = selection.selected_out_of_fold(df, ["a", "wide", "flat", "b"], "fold", "y", (0, 1, 2, 3), columns=2).orderBy("id").collect()
    assert len(got) == 240 and all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["probabilities"][2] == 0.0 for r in got)
    assert all((r["probabilities"][3] == 0.0) == (r["fold"] == 0) for r in got)  # the other folds lack class 3
    assert all(r["predicted"] == (0, 1, 2, 3)[int(np.argmax(r["probabilities"]))] for r in got)
    right = [r["predicted"] == r["y"] for r in got if r["y"] != 3]
    assert np.mean(right) > 0.85


def test_few_classes_and_missing_values(spark, data):
    df, *_ = data
    one = selection.selected_out_of_fold(df.filter("y = 1"), ["a", "b"], "fold", "y", (0, 1), columns=1).collect()
    assert {tuple(r["probabilities"]) for r in one} == {(0.0, 1.0)} and {r["predicted"] for r in one} == {1}
    holes = df.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a"))).withColumn("fold", F.when(F.col("id") != 5, F.col("fold"))).withColumn("y", F.when(F.col("id") != 6, F.col("y")))
    got = selection.selected_out_of_fold(holes, ["a", "b"], "fold", "y", (0, 1, 3), columns=2).collect()
    assert len(got) == 239 and all(r["probabilities"] is not None and not any(map(math.isnan, r["probabilities"])) for r in got)
    alone = selection.selected_out_of_fold(df.filter("fold = 1"), ["a"], "fold", "y", (0, 1), columns=1).collect()
    assert {r["predicted"] for r in alone} == {None}
    assert selection.selected_out_of_fold(df.limit(0), ["a"], "fold", "y", (0, 1), columns=1).count() == 0


def poisson(u):
    k, total, term = 0, math.exp(-1), math.exp(-1)
    while u >= total and k < 7:
        k += 1
        term /= k
        total += term
    return k


def brute_metrics(rows, cut):
    """rows: (weight, score, target)."""
    pos = sum(w for w, _, y in rows if y)
    neg = sum(w for w, _, y in rows if not y)
    if not pos or not neg:
        return None
    wins = sum(w * v * (1.0 if s > t else 0.5 if s == t else 0.0) for w, s, y in rows if y for v, t, z in rows if not z)
    average = sum(w * sum(v for v, t, z in rows if z and t >= s) / sum(v for v, t, _ in rows if t >= s) for w, s, y in rows if y and w) / pos
    tp, fp = sum(w for w, s, y in rows if y and s >= cut), sum(w for w, s, y in rows if not y and s >= cut)
    return {"auroc": wins / pos / neg, "average_precision": average, "recall": tp / pos, "precision": tp / (tp + fp) if tp + fp else None, "specificity": (neg - fp) / neg, "balanced_accuracy": (tp / pos + (neg - fp) / neg) / 2}


def test_intervals_match_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(f"u{rng.integers(12)}", float(rng.integers(8)) / 8, int(rng.random() < 0.4)) for _ in range(80)]
    got = {r["metric"]: r for r in resample.metric_intervals(spark.createDataFrame([*rows, ("u1", None, 1), (None, 0.5, 1), ("u2", 0.5, None)], "unit string, s double, y int"), "unit", F.col("s"), F.col("y"), 0.5, resamples=40, seed=3).collect()}
    weight = lambda b, u: 1 if b == 0 else poisson(int(hashlib.md5(f"3:{b}:{u}".encode()).hexdigest()[:8], 16) / 2**32)
    runs = [brute_metrics([(weight(b, u), s, y) for u, s, y in rows if weight(b, u)], 0.5) for b in range(41)]
    for name in resample.RANKED:
        values = [r[name] for r in runs[1:] if r and r[name] is not None]
        r = got[name]
        assert r["status"] == "estimated" and r["resamples"] == len(values) and math.isclose(r["estimate"], runs[0][name], rel_tol=1e-9)
        assert math.isclose(r["low"], np.percentile(values, 2.5), rel_tol=1e-9) and math.isclose(r["high"], np.percentile(values, 97.5), rel_tol=1e-9)
        assert r["low"] <= r["estimate"] <= r["high"]


def test_intervals_that_cannot_be_estimated(spark):
    few = spark.createDataFrame([("a", 0.1, 0), ("b", 0.9, 1)], "unit string, s double, y int")
    assert {(r["status"], r["estimate"], r["resamples"]) for r in resample.metric_intervals(few, "unit", F.col("s"), F.col("y"), 0.5).collect()} == {("fewer_than_3_units", None, 0)}
    one = spark.createDataFrame([(u, 0.1, 1) for u in "abcd"], "unit string, s double, y int")
    assert {r["status"] for r in resample.metric_intervals(one, "unit", F.col("s"), F.col("y"), 0.5).collect()} == {"resamples_lacked_both_classes"}
    assert {r["status"] for r in resample.metric_intervals(one.limit(0), "unit", F.col("s"), F.col("y"), 0.5).collect()} == {"fewer_than_3_units"}
