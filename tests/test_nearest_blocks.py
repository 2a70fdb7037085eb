"""Nearest rows of other groups over many blocks: far from the origin, of great length, and k a query however many blocks it meets."""

import numpy as np
import pytest

from tessera.operators import neighbors


def brute(rows, k):
    return {i: [c for _, c in sorted((sum((x - y) ** 2 for x, y in zip(v, w)), c) for c, h, w in rows if h != g)[:k]] for i, g, v in rows}


@pytest.mark.parametrize("move, scale", [(1e5, 1e-4), (0.0, 1e25), (3.0, 1.0)])
def test_vectors_far_off_and_long(spark, move, scale):
    rng = np.random.default_rng(4)
    rows = [(k, "abc"[k % 3], [float(move + scale * v) for v in rng.normal(size=6)]) for k in range(200)]
    got = neighbors.nearest_other_group(spark.createDataFrame(rows, "i long, g string, v array<double>"), "i", "g", "v", 3, 16).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == brute(rows, 3)


def test_a_query_keeps_k_rows_of_all_blocks():
    rng = np.random.default_rng(5)

    def block(first):
        groups = np.sort(rng.integers(0, 2, 300))
        return np.arange(first, first + 300).tobytes(), ["a", "b"], np.searchsorted(groups, [0, 1, 2]).tobytes(), rng.integers(0, 2, (300, 3)).astype(np.float32).tobytes()

    best = neighbors._Nearest(block(0), True, 3)
    for first in range(300, 3000, 300):
        best.meet(block(first))
    rows = best.rows()
    assert len(rows) == 900 and rows.groupby("query_id").size().eq(3).all() and rows["distance"].eq(0).all()
