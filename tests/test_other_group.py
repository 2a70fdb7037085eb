"""Nearest rows of other groups against brute force, on ties, copies and unusable vectors."""

import numpy as np

from tessera.operators import neighbors


def test_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, ["a", "b", None][k % 3], [float(v) for v in rng.integers(0, 3, 3)]) for k in range(150)] + [(150, "a", [float("nan")] * 3)]
    got = neighbors.nearest_other_group(spark.createDataFrame(rows, "i long, g string, v array<double>"), "i", "g", "v", 3, 40).collect()
    want = {
        i: [c for _, c in sorted((sum((x - y) ** 2 for x, y in zip(v, w)), c) for c, h, w in rows if h != g and c != 150)[:3]] for i, g, v in rows if i != 150
    }
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == want
