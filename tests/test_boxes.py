"""Components and merged boxes against flood fill and a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boxes


def runs_of(mask):
    out = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row, [0]))))
        out += [(y, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def flood(mask):
    """Components by flood fill over all eight neighbours, in the order of their first cells."""
    seen, out = np.zeros(mask.shape, bool), []
    for y0, x0 in zip(*np.nonzero(mask), strict=True):
        if seen[y0, x0]:
            continue
        seen[y0, x0], stack, cells = True, [(y0, x0)], []
        while stack:
            y, x = stack.pop()
            cells.append((int(y), int(x)))
            for v in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                for u in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                    if mask[v, u] and not seen[v, u]:
                        seen[v, u] = True
                        stack.append((v, u))
        ys, xs = zip(*cells, strict=True)
        out.append((len(cells), min(xs), min(ys), max(xs) + 1, max(ys) + 1, round(float(np.mean(xs)), 6), round(float(np.mean(ys)), 6), int(y0), int(x0)))
    return out


def table(spark, masks):
    rows = [(image, *r) for image, mask in masks.items() for r in runs_of(mask)]
    return spark.createDataFrame(rows, "image string, y int, x0 int, x1 int").repartition(5)


@pytest.mark.parametrize("strip", [1, 2, 7, 256])
def test_components_equal_flood_fill(spark, strip):
    rng = np.random.default_rng(strip)
    masks = {f"m{k}": (rng.random((rng.integers(1, 30), rng.integers(1, 25))) < share).astype(int) for k, share in enumerate((0.1, 0.3, 0.45, 0.6, 0.9))}
    spiral = np.zeros((21, 21), int)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[20 - k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = 1
        spiral[k + 2 : 21 - k, k] = 1
        spiral[k + 2, k : k + 2] = 1
    masks["spiral"] = spiral
    got = boxes.components(table(spark, masks), "image", strip).collect()
    for name, mask in masks.items():
        mine = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r[1:]) for r in got if r["image"] == name), key=lambda c: c[-2:])
        assert mine == flood(mask), name


def test_odd_runs(spark):
    rows = [("a", 0, 0, 3), ("a", 0, 3, 5), ("a", 0, 7, 7), ("a", None, 1, 2), (None, 0, 0, 1), ("a", 1, 5, 6), ("a", 3, 0, 1), ("b", 1000, 0, 2), ("c", 0, 2, 6), ("c", 0, 2, 3), ("c", 0, 5, 7)]
    runs = spark.createDataFrame(rows, "image string, y int, x0 int, x1 int").withColumn("area", F.lit("own"))
    assert sorted((r["image"], r["area"], r["first_y"], r["first_x"]) for r in boxes.components(runs, "image").collect()) == [("a", 1, 3, 0), ("a", 6, 0, 0), ("b", 2, 1000, 0), ("c", 7, 0, 2)]
    assert boxes.components(runs.limit(0), "image").count() == 0


def plain_merge(rects, least):
    """The rule as it is told: begin anew after each merge."""
    left, merges = [(list(b), [k]) for k, b in enumerate(rects)], []

    def iou(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / union if union > 0 else 0.0

    while True:
        pair = next(((i, j) for i in range(len(left)) for j in range(i + 1, len(left)) if iou(left[i][0], left[j][0]) >= least), None)
        if pair is None:
            return [(tuple(b), m) for b, m in left], merges
        i, j = pair
        (a, m), (b, n) = left[i], left[j]
        merges.append((m[0], n[0], iou(a, b)))
        left[i] = ([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])], m + n)
        del left[j]


def test_merging_equals_a_plain_loop():
    draw = random.Random(1)
    for _ in range(400):
        rects = []
        for _ in range(draw.randint(0, 14)):
            x, y = draw.randint(0, 30), draw.randint(0, 30)
            rects.append((x, y, x + draw.randint(0, 14), y + draw.randint(0, 14)))
        least = draw.choice([0.05, 0.2, 0.5, 1.0])
        assert boxes.merge_boxes(rects, least) == plain_merge(rects, least)


def test_proposals_skip_pad_merge_and_overflow(spark):
    masks = {name: np.zeros((20, 20), int) for name in ("skip", "merge", "many")}
    masks["skip"][0:3, 0:3] = masks["skip"][6:11, 7:12] = 1
    masks["skip"][5, 1] = 1
    masks["skip"][12:20, 12:20] = 1
    masks["merge"][2:6, 2:6] = masks["merge"][2:6, 8:12] = 1
    for x in (1, 6, 11):
        masks["many"][1:4, x : x + 3] = 1
    found = boxes.components(table(spark, masks), "image")
    rows = boxes.proposals(found, "image", F.lit(20), F.lit(20), 4, 40, 3, 0.2, 2).collect()
    of = lambda image, what: sorted((r["proposal_index"], r["left_index"], r["x0"], r["y0"], r["x1"], r["y1"], r["area"]) for r in rows if (r["image"], r["decision"]) == (image, what))
    assert {(r["left_index"], r["reason"]) for r in rows if r["decision"] == "skipped"} == {(2, "component_area_below_minimum"), (4, "component_area_above_maximum")}
    assert of("skip", "generated") == [(1, 1, 0, 0, 6, 6, 9), (2, 3, 4, 3, 15, 14, 25)]
    assert of("merge", "generated") == [(1, 1, 0, 0, 15, 9, 32)] and [(r["left_index"], r["right_index"]) for r in rows if r["decision"] == "merged" and r["image"] == "merge"] == [(1, 2)]
    apart = boxes.proposals(found.filter("image = 'many'"), "image", F.lit(20), F.lit(20), 4, 40, 0, 0.2, 2).collect()
    assert sorted((r["decision"], r["proposal_index"]) for r in apart) == [("generated", 1), ("generated", 2), ("overflow", 3)]
    assert boxes.proposals(found.limit(0), "image", F.lit(20), F.lit(20), 4, 40, 0, 0.2, 2).count() == 0


def test_runs_are_scanned_once(spark):
    """Components and proposals read their parts more than once, from tables, not from the runs again."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    runs = table(spark, {"one": np.eye(9, dtype=int)}).mapInArrow(count, "image string, y int, x0 int, x1 int")
    rows = boxes.proposals(boxes.components(runs, "image", 2), "image", F.lit(9), F.lit(9), 1, 40, 0, 0.2, 2).collect()
    assert [r["decision"] for r in rows] == ["generated"] and seen.value == 9
