"""Runs whose means differ by the margin exactly: the decision follows the stored order of the lines, not how tasks get them."""

import random

import duckdb

from tessera.plans import candidates


def test_runs_at_the_margin(spark, tmp_path):
    draw = random.Random(5)
    lines = []
    for k in [None, *range(600)]:
        taxes = [draw.randrange(8) for _ in range(5)]
        lines += [(k, "N", t) for t in taxes] + [(k, "R", t + (j == 0)) for j, t in enumerate(draw.sample(taxes, 5))]
    draw.shuffle(lines)
    for part in range(4):
        rows = [(k, flag, "F", 10.0, t / 100, 0.02) for k, flag, t in lines[part::4]]
        frame = spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_linestatus string, l_quantity double, l_tax double, l_discount double")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(candidates.SQL["run_decision"]).fetchall()
    got = [tuple(r) for r in candidates.run_decision(spark, str(tmp_path)).collect()]
    assert len({r[1] for r in want}) > 2 and sorted(map(repr, got)) == sorted(map(repr, want))
