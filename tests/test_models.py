"""Properties of the models: what they must not see, bounds, order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import rubric
from tessera.operators import folds, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(k, k % 3, [float(v) for v in rng.normal(size=4)]) for k in range(150)]
    data = [(k, f, x, float(np.clip(50 + 40 * x[0], 0, 100)), int(x[0] + 0.2 * rng.normal() > 0)) for k, f, x in data]
    return models.as_vectors(spark.createDataFrame(data, "id int, fold int, x array<double>, stage double, y int"), "x").drop("x").cache()


def test_a_fold_is_not_learnt_from(rows):
    """Other targets in fold 0 leave the predictions of fold 0 as they were."""
    changed = rows.withColumn("stage", F.when(F.col("fold") == 0, 100 - F.col("stage")).otherwise(F.col("stage"))).withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    for fit, name in ((lambda d: models.ridge_out_of_fold(d, "fold", "stage", 3, 1.0, 0.0, 100.0), "prediction"), (lambda d: models.logistic_out_of_fold(d, "fold", "y", 3), "probability")):
        a, b = ({r["id"]: r[name] for r in fit(d).filter("fold = 0").collect()} for d in (rows, changed))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_predictions_are_clipped_and_learn(rows):
    got = models.ridge_out_of_fold(rows, "fold", "stage", 3, 1.0, 20.0, 80.0)
    low, high, error = got.agg(F.min("prediction"), F.max("prediction"), F.avg(F.abs(F.col("prediction") - F.least(F.lit(80.0), F.greatest(F.lit(20.0), F.col("stage")))))).first()
    assert low >= 20 and high <= 80 and error < 10
    assert got.count() == 150


def test_burden_is_monotone(rows):
    out = models.cumulative_thresholds(rows, "fold", "stage", [30.0, 60.0], 3).withColumn("m", rubric.monotone(F.col("p")))
    assert out.filter("m[0] < m[1] or m[0] > p[0] + 1e-12").count() == 0
    assert out.filter(~F.col("y").isNull()).select(F.corr(rubric.burden(F.col("m")), "stage")).first()[0] > 0.8


def test_recall_is_reached_by_other_folds_cuts(rows):
    got = models.recall_targeted(rows, "fold", "y", 3, 0.9)
    assert got.count() == 150 and got.select("fold", "threshold").distinct().count() == 3
    assert got.filter("(probability >= threshold) <> (predicted = 1)").count() == 0
    assert got.filter("y = 1").agg(F.avg("predicted")).first()[0] > 0.75


def test_multinomial_and_sources(rows):
    three = rows.withColumn("band", F.when(F.col("stage") < 35, 0).when(F.col("stage") < 65, 1).otherwise(2))
    got = models.multinomial_out_of_fold(three, "fold", "band", 3)
    assert got.count() == 150 and got.agg(F.avg((F.col("band") == F.col("predicted")).cast("int"))).first()[0] > 0.7
    one = models.multinomial_out_of_fold(three.withColumn("band", F.lit(1)), "fold", "band", 3)
    assert {r["predicted"] for r in one.collect()} == {1}


def test_greedy_folds_follow_the_rule(spark):
    rng = np.random.default_rng(4)
    data = [(int(g), bool(rng.random() < 0.2), int(rng.integers(100))) for g in rng.integers(0, 60, 700)]
    groups = {}
    for g, s, v in data:
        groups.setdefault(g, []).append((s, v))
    order = sorted(groups, key=lambda g: (-sum(s for s, _ in groups[g]), -max(v for _, v in groups[g]), -len(groups[g]), g))
    loads, want = [(0, 0, 0, k) for k in range(4)], {}
    for g in order:
        best = min(loads)
        want[g] = best[3]
        loads[best[3]] = (best[0] + sum(s for s, _ in groups[g]), best[1] + len(groups[g]), best[2] + sum(v for _, v in groups[g]), best[3])
    df = spark.createDataFrame(data, "g long, s boolean, v long")
    assert {r["g"]: r["fold"] for r in folds.greedy_folds(df, "g", F.col("s"), F.col("v"), 4).collect()} == want
    assert folds.greedy_folds(df.limit(0), "g", F.col("s"), F.col("v"), 4).count() == 0
