"""Distances round as their SQL rounds them, on quantities that aren't whole too."""

import duckdb

from tessera.plans import more


def test_distances_at_ties_and_large(spark, tmp_path):
    """Ties in the seventh decimal and distances beyond 2**53 millionths, beside empty sides, nulls and NaN."""
    far = [k + 5e-7 for k in range(1, 60)] + [k + 1 + j * 1e-7 for k in range(20) for j in (5, 15, 25)] + [9999999999951.998, 1e200, 0.0, -0.0, float("nan"), float("inf"), None]
    rows = [(k, 1, s, q) for k, v in enumerate(far) for s, q in (("F", 0.0), ("O", v))] + [(-1, 1, "F", 3.0), (-2, 2, None, 3.0), (None, 1, "O", 3.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_linestatus string, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(more.SQL["hausdorff_distance"]).fetchall()
    got = [tuple(r) for r in more.hausdorff_distance(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
