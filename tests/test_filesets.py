"""Files and what is read back from them; joins by either key and by position; saved models."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, models
from tessera.operators.contracts import ContractError
from tessera.sources import inventory, provenance, publish, scratch


def put(root, files):
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)


def test_inventory_of_named_files(spark, tmp_path):
    put(tmp_path, {"a/x.PNG": b"1", "a/b/x.tif": b"22", "a/b/no suffix": b"n", "a/.hidden": b"h", "a/empty.png": b"", "a/_own": b"o", "a/b/c.tar.gz": b"zz", "a/b/.d.png": b"d"})
    rows = {r["path"]: r for r in inventory.file_inventory(spark, str(tmp_path)).collect()}
    assert {p: (r["folder"], r["stem"], r["suffix"], r["bytes"]) for p, r in rows.items()} == {"a/x.PNG": ("a", "x", ".png", 1), "a/b/x.tif": ("a/b", "x", ".tif", 2), "a/b/no suffix": ("a/b", "no suffix", "", 1), "a/b/c.tar.gz": ("a/b", "c.tar", ".gz", 2)}
    assert all(r["sha256"] == hashlib.sha256((tmp_path / p).read_bytes()).hexdigest() for p, r in rows.items())
    images = inventory.file_inventory(spark, str(tmp_path), suffixes=inventory.IMAGE_SUFFIXES, digests=False)
    assert sorted((r["path"], r["sha256"]) for r in images.collect()) == [("a/b/x.tif", None), ("a/x.PNG", None)]
    assert inventory.file_inventory(spark, f"{tmp_path}/absent").count() == 0
    assert [r["path"] for r in inventory.file_inventory(spark, str(tmp_path), "*.gz").collect()] == ["a/b/c.tar.gz"]
    assert [tuple(r) for r in inventory.first_by_stem(images, F.col("stem"), F.col("path")).collect()] == [("x", "a/b/x.tif", 2)]


def test_pairs(spark):
    rows = [("images", "s", "1"), ("masks", "s", "1_mask"), ("images", "s", "2"), ("images", "t", "1"), ("images", "t", "1"), ("masks", "t", "9_mask"), ("masks", "s", "2"), ("notes", "s", "3"), ("images", None, None)]
    files = spark.createDataFrame(rows, "kind string, subject string, stem string").withColumn("path", F.concat_ws("/", "kind", "subject", "stem"))
    got = inventory.paired(files, F.col("kind"), F.col("subject"), F.col("stem"), F.col("path")).collect()
    assert sorted((str(r["subject"]), str(r["stem"]), r["images"], r["masks"], r["status"]) for r in got) == [
        ("None", "None", 1, 0, "missing_mask"), ("s", "1", 1, 1, "matched_pair"), ("s", "2", 0, 1, "orphan_mask"), ("s", "2", 1, 0, "missing_mask"), ("t", "1", 2, 0, "duplicate_stem"), ("t", "9", 0, 1, "orphan_mask")
    ]


def test_scans_keep_bad_lines(spark, tmp_path):
    put(tmp_path, {"2024-03-01/a.csv": b"id,score,group\n1,2.5, Low \n2,two,high\n3,1\n,4,x\n", "2024-03-02/b.csv": b"id,score,group\n7.0,,mid\n"})
    rows = provenance.scan(spark, str(tmp_path), "id string, score double, group string", "csv")
    got = {(r["source_file"], r["bad_line"] or r["id"]): (r["score"], r["reason"]) for r in provenance.with_reasons(rows, ["id", "score"]).collect()}
    assert got == {("a.csv", "1"): (2.5, None), ("a.csv", "2,two,high"): (None, "unreadable_line"), ("a.csv", "3,1"): (1.0, "unreadable_line"), ("a.csv", None): (4.0, "missing_id"), ("b.csv", "7.0"): (None, "missing_score")}
    assert sorted(map(tuple, provenance.assignments(rows, "id", F.col("group")).collect())) == [("1", "2024-03-01", "low", "a.csv"), ("7", "2024-03-02", "mid", "b.csv")]
    put(tmp_path, {"2024-03-03/c.csv": b"id,score,group\n1,0,low\n"})
    with pytest.raises(ContractError, match="1"):
        provenance.assignments(provenance.scan(spark, str(tmp_path), "id string, score double, group string", "csv"), "id", F.col("group"))


def test_mappings_by_suffix(spark, tmp_path):
    put(tmp_path, {"m.csv": b"subject_image_id,legacy_path\nS1-1,a/old_mask.png\nS1-1,b/old.tif\n", "m.tsv": b"subject_image_id\tlegacy_filename\nS1-2\tx.y.jpg\n", "m.json": b'{"subject_image_id": 3, "legacy_stem": "z"}\n', "bad.csv": b"subject_image_id,legacy_stem\na,s\nb,s\n"})
    read = lambda name, column: provenance.stem_mapping(provenance.scan(spark, f"{tmp_path}/{name}", f"subject_image_id string, {column} string"))
    assert [[tuple(r) for r in read(n, c).collect()] for n, c in (("m.csv", "legacy_path"), ("m.tsv", "legacy_filename"), ("m.json", "legacy_stem"))] == [[("old", "S1-1")], [("x.y", "S1-2")], [("z", "3")]]
    with pytest.raises(ContractError):
        read("bad.csv", "legacy_stem")
    with pytest.raises(ContractError):
        read("m.csv", "other")
    with pytest.raises(ValueError):
        provenance.scan(spark, f"{tmp_path}/m.xlsx", "a string")


def test_releases(spark, tmp_path):
    path = f"file://{tmp_path}/release"
    rows = spark.range(20).withColumn("split", F.when(F.col("id") < 12, "train").otherwise("test"))
    with pytest.raises(ContractError):
        publish.published(spark, path)
    for _ in range(2):
        publish.publish(rows, path, ["split"], "one")
        assert publish.published(spark, path, "one").count() == 20
    publish.publish(rows.filter("split = 'test' and id < 15"), path, ["split"], "two")
    assert {(r["split"], r["rows"]) for r in publish.release_counts(spark, path).collect()} == {("train", 12), ("test", 3)}
    with pytest.raises(ContractError):
        publish.published(spark, path, "one")
    # a release that fails on the way leaves the old rows, and no marker: nothing half written is read
    with pytest.raises(Exception, match="halfway"):
        publish.publish(rows.withColumn("id", F.when(F.col("id") == 19, F.raise_error(F.lit("halfway"))).otherwise(F.col("id"))), path, ["split"], "three")
    with pytest.raises(ContractError):
        publish.published(spark, path)
    assert spark.read.parquet(path).count() == 15
    scratch.remove(spark, path)
    assert not scratch.exists(spark, path)


def test_either_key(spark):
    left = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, "x", None), (4, "x", "a"), (5, None, None), (1, "a", "b")], "id int, p string, q string").withColumn("v", F.lit("own")).distinct()
    right = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    out = joins.either_key(left, right, ["id"], ["p", "q"], "k", ["v"])
    assert sorted((r["id"], r["v"], r["matched_by"]) for r in out.collect()) == [(1, 1, "p"), (2, 2, "q"), (3, None, None), (4, 1, "q"), (5, None, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ContractError):
        joins.either_key(left, right.unionByName(right), ["id"], ["p"], "k", ["v"])
    assert joins.either_key(left.limit(0), right, ["id"], ["p"], "k", ["v"]).count() == 0


def test_rows_and_lists_by_position(spark):
    a, b = spark.createDataFrame([(5,), (1,), (None,), (3,)], "n int"), spark.createDataFrame([(0.5, "p"), (0.1, "q"), (0.5, "o"), (9.0, "r")], "x double, n string")
    got = joins.by_position(a, b, "n", "x", (), ["n"]).orderBy("position").collect()
    assert [(r["n"], r["x"], r["n_right"]) for r in got] == [(None, 0.1, "q"), (1, 0.5, "o"), (3, 0.5, "p"), (5, 9.0, "r")]
    with pytest.raises(ContractError):
        joins.by_position(a, b.limit(3), "n", "x")
    lists = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, [], []), (3, None, None)], "id int, u array<string>, v array<int>")
    assert [tuple(r) for r in joins.zipped_lists(lists, ["u", "v"], ["s", "t"]).collect()] == [(1, 0, "a", 1), (1, 1, "b", 2)]
    for bad in ((["a"], []), (["a"], None)):
        with pytest.raises(Exception, match="unequal lengths"):
            joins.zipped_lists(spark.createDataFrame([(1, *bad)], "id int, u array<string>, v array<int>"), ["u", "v"], ["s", "t"]).collect()


def test_saved_models_keep_their_contract(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k % 7), float(k % 3), int(k % 7 > 3)) for k in range(60)], "id int, a double, b double, y int")
    model = models.balanced_logistic(rows, ["a", "b"], "y")
    models.save_fitted(model, f"{tmp_path}/m", ["a", "b"], fold="2")
    again = models.load_fitted(f"{tmp_path}/m", ["a", "b"], fold="2")
    say = lambda m: [(r["id"], r["probability"].toArray().tolist(), r["predicted"]) for r in m.transform(rows).orderBy("id").collect()]
    assert say(model) == say(again)
    for features, fold in ((["b", "a"], "2"), (["a"], "2"), (["a", "b"], "3")):
        with pytest.raises(ContractError):
            models.load_fitted(f"{tmp_path}/m", features, fold=fold)
