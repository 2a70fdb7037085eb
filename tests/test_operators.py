"""Fixed answers, edge cases and contracts of the operators."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import rubric, text
from tessera.operators import contracts, dedup, folds, gates, joins, metrics, rank, resample, strata
from tessera.sources.files import ANNOTATIONS, explode_annotations, missing_to_null, read_csv, read_json, write_csv
from tessera.streaming.latest import latest_stream


def one(df):
    return df.collect()[0]


def test_slug_and_missing(spark):
    df = spark.createDataFrame([("  A-b C! ",), ("",), (None,), ("NaN",)], "x string")
    assert [r[0] for r in df.select(text.slug(F.col("x"))).collect()] == ["a_b_c", "missing", "missing", "missing"]
    assert [r[0] for r in df.select(text.is_missing(F.col("x"))).collect()] == [False, True, True, True]


def test_dates_and_flags(spark):
    df = spark.createDataFrame([("01-31-24", "Yes"), ("other", "no"), (None, None)], "d string, f string")
    rows = df.select(text.sheet_date(F.col("d")), text.flag(F.col("f"), True)).collect()
    assert [tuple(r) for r in rows] == [("2024-01-31", True), ("other", False), (None, True)]


def test_rubric(spark):
    df = spark.createDataFrame([(s,) for s in rubric.RUBRIC], "s double")
    assert [r[0] for r in df.select(rubric.stage_index(F.col("s"))).collect()] == list(rubric.STAGES)
    assert [r[0] for r in df.select(rubric.threshold_targets(F.col("s"))).collect()][0] == [0] * 5


def test_burden(spark):
    p = F.array(*(F.lit(x) for x in (0.2, 0.8, 0.4, 0.5, 0.1)))
    row = one(spark.range(1).select(rubric.monotone(p).alias("m"), rubric.burden(rubric.monotone(p)).alias("b"), rubric.class_probabilities(rubric.monotone(p)).alias("q")))
    assert row["m"] == [0.2, 0.2, 0.2, 0.2, 0.1]
    assert row["b"] == pytest.approx(18.0)
    assert sum(row["q"]) == pytest.approx(1)


def test_prediction_set(spark):
    q = F.array(*(F.lit(x) for x in (0.1, 0.5, 0.3, 0.1)))
    assert one(spark.range(1).select(rubric.prediction_set(q, 0.8)))[0] == [1, 2]


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.5), (1, 0.5)], "id int, score double")
    with pytest.raises(contracts.ContractError, match="unsupported_score: 1 rows; duplicate id"):
        contracts.enforce(df, [contracts.allowed("score", rubric.RUBRIC)], ["id"])
    assert contracts.enforce(df.limit(0), [contracts.allowed("score", rubric.RUBRIC)], ["id"]).count() == 0


def test_latest_nulls_are_oldest(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "2020", 2), ("a", "2020", 3), ("b", None, 4)], "k string, t string, id int")
    assert {r["k"]: r["id"] for r in dedup.latest_wins(df, ["k"], ["t"], "id").collect()} == {"a": 3, "b": 4}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 0)], "k int, v string, seq int")
    assert {r["k"]: r["v"] for r in dedup.upsert(base, new, ["k"], "seq").collect()} == {1: "a", 2: "c", 3: "d"}


def test_guarded_join(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(contracts.ContractError):
        joins.guarded_left_join(left, right, ["k"])
    assert joins.guarded_left_join(left, right.filter("v = 1"), ["k"], "1:1").count() == 2


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int")
    row = one(metrics.ranking_metrics(df, F.col("p"), F.col("y")))
    assert row["auroc"] == pytest.approx(0.75) and row["average_precision"] == pytest.approx(0.8333333)
    row = one(metrics.ranking_metrics(df.filter("y = 1"), F.col("p"), F.col("y")))
    assert row["auroc"] is None and row["average_precision"] is None


def test_overlap_of_empty_sides(spark):
    df = spark.createDataFrame([("a", False, False)], "k string, t boolean, p boolean")
    row = one(metrics.overlap(df, F.col("t"), F.col("p"), ["k"]))
    assert (row["dice_zero"], row["dice_one"]) == (0.0, 1.0)


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert one(metrics.adjusted_rand(df, "a", "b"))["ari"] == pytest.approx(1)


def test_gates_and_reviews(spark):
    df = spark.createDataFrame([("x", "background", 0.5), ("y", "positive", 0.2), ("z", "positive", None)], "id string, category string, v double")
    rules = [gates.Gate("low", "v", high=0.02, category="background"), gates.Gate("high", "v", low=0.3, category="positive")]
    gated = gates.gate_rows(df, rules, "category")
    assert {r["id"]: r["passed"] for r in gated.collect()} == {"x": False, "y": False, "z": False}
    reviews = spark.createDataFrame([("y", "high", False)], "id string, gate string, counts boolean")
    assert {r["id"]: (r["passed"], r["adjudicated"]) for r in gates.adjudicate(gated, reviews, ["id", "gate"]).collect()}["y"] == (True, True)


def test_greedy_folds_balance(spark):
    df = spark.createDataFrame([(g, g % 3 == 0, float(g)) for g in range(20) for _ in range(g % 4 + 1)], "g long, s boolean, v double")
    rows = folds.greedy_folds(df, "g", F.col("s"), F.col("v"), 4).collect()
    assert sorted(r["g"] for r in rows) == list(range(20))
    load = {}
    for r in rows:
        load[r["fold"]] = load.get(r["fold"], 0) + r["severe"]
    assert max(load.values()) - min(load.values()) <= 4


def test_conformal_quantile(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", None)], "k string, r double")
    got = {r["k"]: (r["n"], r["quantile"]) for r in folds.conformal_quantiles(df, ["k"], F.col("r"), 0.9, 1.0).collect()}
    assert got == {"a": (10, 9.0), "b": (0, 1.0)}


def test_bootstrap_holds_estimate(spark):
    df = spark.createDataFrame([("k", u, float(u % 7)) for u in range(60)], "k string, u int, v double")
    row = one(resample.bootstrap_mean(df, ["k"], "u", F.col("v"), 100))
    assert row["low"] <= row["estimate"] <= row["high"] and row["units"] == 60


def test_quota_and_modes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "g string, v int")
    assert sorted(r["v"] for r in rank.quota_and_fill(df, "g", [F.col("v")], 1, 3).collect()) == [1, 2, 4]
    assert {r["g"]: r["mode"] for r in strata.mode_per_group(df, ["g"], "v").collect()} == {"a": 1, "b": 4}


def test_nested_export(spark, tmp_path):
    (tmp_path / "x.json").write_text(
        '[{"id": 1, "data": {"image": "a.png"}, "annotations": [{"id": 7, "result": [{"id": "r", "from_name": "grade", "value": {"choices": ["2"]}}]}, {"id": 8, "result": []}]}, {"id": 2, "data": {"image": "b.png"}, "annotations": []}]'
    )
    rows = explode_annotations(read_json(spark, str(tmp_path / "x.json"), ANNOTATIONS)).collect()
    assert sorted((r["task_id"], r["annotation_status"], r["choice"]) for r in rows if r["choice"]) == [(1, "annotated", "2")]
    assert sorted(r["annotation_status"] for r in rows) == ["annotated", "missing_annotation", "missing_result"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x ", float("nan"), ["a", "b"]), (" ", 1.0, None)], "s string, v double, t array<string>")
    assert missing_to_null(df).filter("s is null").count() == 1 and missing_to_null(df).filter("v is null").count() == 1
    write_csv(df, str(tmp_path / "out"))
    back = {r["v"]: (r["s"], r["t"]) for r in read_csv(spark, str(tmp_path / "out"), "s string, v double, t string").collect()}
    assert back[None] == ("x", "a|b") and back[1.0][0] is None


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = latest_stream(stream, ["user_id"], "ts", "event_id").writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = {(r["user_id"], r["event_id"]) for r in dedup.latest_wins(batch, ["user_id"], ["ts"], "event_id").collect()}
    assert {(r["user_id"], r["event_id"]) for r in spark.table("newest").collect()} == want
