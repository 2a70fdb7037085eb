"""Screens from sums against models fitted directly on the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import screens
from tessera.operators.screens import CALIBRATED, INDICATORS, POOLED, Candidate


def direct(x, y, source, train, test, candidate, names):
    """The candidate's predictions of the test rows, fitted on the training rows in the plain way."""
    a, b = x[train][:, [names.index(c) for c in candidate.columns]], x[test][:, [names.index(c) for c in candidate.columns]]
    if candidate.sources == INDICATORS:
        for s in sorted(set(source[train]) - {""}):
            a, b = np.column_stack([a, source[train] == s]), np.column_stack([b, source[test] == s])
    mean, scale = a.mean(0), a.std(0)
    scale[scale < 1e-9] = 1
    a, b, centre = (a - mean) / scale, (b - mean) / scale, y[train].mean()
    w = np.linalg.solve(a.T @ a + candidate.strength * np.eye(a.shape[1]), a.T @ (y[train] - centre)) if a.shape[1] else np.zeros(0)
    out = centre + b @ w
    if candidate.sources == CALIBRATED:
        residual = y[train] - centre - a @ w
        out = out + np.array([residual[source[train] == s].mean() if (source[train] == s).any() else 0.0 for s in source[test]])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n, names = 240, ["a", "b", "c", "flat", "far"]
    x = rng.normal(size=(n, 5)) * [1, 30, 0.01, 0, 1] + [0, 5, 0, 7, 1e6]
    source = rng.choice(["", "u", "v", "w"], n)
    fold = np.arange(n) % 4
    source[fold == 3] = np.where(source[fold == 3] == "u", "o", source[fold == 3])  # a source that one fold alone has
    y = 40 + 3 * x[:, 0] + 0.2 * x[:, 1] + (source == "u") * 10 + rng.normal(size=n)
    return names, x, source, fold, y


SOME = [Candidate("mean", ()), Candidate("one", ("a",)), Candidate("all", ("a", "b", "c", "flat", "far"), 3.0)] + [
    Candidate(f"{kind} {k}", columns, k, kind) for kind in (POOLED, INDICATORS, CALIBRATED) for columns, k in ((("a", "b"), 1.0), (("b", "far", "flat"), 40.0), (("a", "c"), 0.0))
]


def frame(spark, data, **more):
    names, x, source, fold, y = data
    rows = [(k, *map(float, r), s or None, int(f), float(v)) for k, (r, s, f, v) in enumerate(zip(x, source, fold, y, strict=True))]
    return spark.createDataFrame(rows, f"id int, {', '.join(f'{n} double' for n in names)}, source string, fold int, y double")


def test_every_candidate_equals_a_direct_fit(spark, data):
    names, x, source, fold, y = data
    got = screens.screen(frame(spark, data), SOME, "fold", "y", "source").orderBy("id").collect()
    every = np.ones(len(y), bool)
    for k, c in enumerate(SOME):
        want = np.empty(len(y))
        for f in range(4):
            want[fold == f] = direct(x, y, source, fold != f, fold == f, c, names)
        assert np.allclose([r["out_of_fold"][k] for r in got], want, rtol=1e-7, atol=1e-6), c
        assert np.allclose([r["apparent"][k] for r in got], direct(x, y, source, every, every, c, names), rtol=1e-7, atol=1e-6), c


def test_work_does_not_grow_with_candidates(spark, data):
    df, jobs = frame(spark, data), []
    for some in (SOME[1:2], SOME):
        group = f"screen {len(some)}"
        spark.sparkContext.setJobGroup(group, group)
        screens.fit_folds(df, some, "fold", "y", "source")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[0] == jobs[1] <= 6


def test_metrics_and_choice(spark, data):
    df = frame(spark, data)
    found = screens.screen(df, SOME, "fold", "y", "source", low=35.0, high=50.0)
    flat = found.select(F.explode("out_of_fold").alias("p")).agg(F.min("p"), F.max("p")).first()
    assert flat[0] >= 35.0 and flat[1] <= 50.0
    rows = {r["candidate"]: r for r in screens.screen_metrics(found, SOME, "y").collect()}
    pandas = found.toPandas()
    for k, c in enumerate(SOME):
        off = np.array([p[k] for p in pandas["out_of_fold"]]) - pandas["y"]
        assert math.isclose(rows[c.name]["mae"], np.abs(off).mean(), rel_tol=1e-9) and math.isclose(rows[c.name]["rmse"], np.sqrt((off**2).mean()), rel_tol=1e-9)
    assert [c for c, r in rows.items() if r["chosen"]] == [min(rows, key=lambda c: (round(rows[c]["mae"], 9), c))]


def test_odd_rows(spark, data):
    df = frame(spark, data)
    odd = df.withColumn("a", F.when(F.col("id") == 0, None).when(F.col("id") == 1, float("nan")).when(F.col("id") == 2, float("inf")).otherwise(F.col("a"))).withColumn("y", F.when(F.col("id") == 3, None).otherwise(F.col("y"))).withColumn("fold", F.when(F.col("id") != 4, F.col("fold")))
    good = df.filter("id > 4")
    a, b = ({r["id"]: r for r in screens.screen(t, SOME, "fold", "y", "source").collect()} for t in (odd, good))
    assert len(a) == 240 and all(np.allclose(a[k]["out_of_fold"], b[k]["out_of_fold"]) for k in b)
    assert a[0]["out_of_fold"][1] is None and a[0]["out_of_fold"][0] is not None and a[4]["out_of_fold"] is None and a[3]["apparent"][1] is not None
    assert screens.screen(df.limit(0), SOME, "fold", "y").count() == 0
    alone = screens.screen(df.filter("fold = 1"), SOME[:2], "fold", "y").first()
    assert all(map(math.isnan, alone["out_of_fold"])) and not any(map(math.isnan, alone["apparent"]))
    with pytest.raises(ValueError):
        screens.fit_folds(df.crossJoin(spark.range(10).withColumnRenamed("id", "k")).withColumn("many", F.concat("id", F.lit("-"), "k")), SOME, "fold", "y", "many")


def test_held_out_sources(spark, data):
    names, x, source, _, y = data
    df = frame(spark, data).withColumn("own", F.col("source"))
    got = {r["source"]: r for r in screens.held_out_sources(df, names, "y", "source", 2.0, least=30, low=36.0, high=48.0).collect()}
    assert set(got) == {None, "u", "v", "w", "o"} and got["o"]["status"] == "not_estimable_small_row_count" and got["o"]["mae"] is None
    for s in ("", "u", "v", "w"):
        test = source == s
        want = np.abs(np.clip(direct(x, y, source, ~test, test, Candidate("c", tuple(names), 2.0), names), 36, 48) - y[test]).mean()
        r = got[s or None]
        assert r["status"] == "estimated" and r["test_rows"] == test.sum() and r["train_rows"] == (~test).sum() and math.isclose(r["mae"], want, rel_tol=1e-7)
    one = screens.held_out_sources(df.filter("source = 'u'"), names, "y", "source").collect()
    assert [(r["source"], r["status"]) for r in one] == [("u", "not_estimable_single_source")]
    assert screens.held_out_sources(df.limit(0), names, "y", "source").count() == 0


def test_subjects_are_added_up_once(spark, sf_dir):
    """What screens read again and again is a table of subjects, not the join of their lines."""
    from tessera.plans import screening

    rows = screening.subjects(spark, sf_dir)
    assert not any(f.endswith(("lineitem.parquet", "orders.parquet")) for f in rows.inputFiles()) and rows.count() > 0
