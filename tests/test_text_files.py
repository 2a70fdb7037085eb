"""Files of texts, a combination of keys each: the same by tasks and by Spark's writer."""

from pathlib import Path

from pyspark.sql import functions as F

from tessera.sources import inventory


def test_tasks_write_what_sparks_writer_writes(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", f"i{k}.png", t) for k, t in enumerate(["", "x\r\ny", "é😀", "z" * 100000])] + [("b", "i0", "one"), ("b", "i0", "one")], "kind string, item string, value string")
    found = lambda root: sorted(map(tuple, inventory.file_inventory(spark, root, "*.txt").select(*(inventory.key_in_path(F.col("path"), k) for k in ("kind", "item")), "bytes", "sha256").collect()))
    inventory.write_texts(rows, f"{tmp_path}/tasks", ["kind", "item"])
    monkeypatch.setattr(inventory, "local_folder", lambda spark, root: None)
    inventory.write_texts(rows, f"{tmp_path}/spark", ["kind", "item"])
    assert len(found(f"{tmp_path}/tasks")) == 5 and found(f"{tmp_path}/tasks") == found(f"{tmp_path}/spark")
    assert not list(Path(tmp_path, "tasks").rglob("*.crc")) and not list(Path(tmp_path, "tasks").rglob("_*"))
