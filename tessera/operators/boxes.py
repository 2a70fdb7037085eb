"""Connected components of run-length rows, and boxes proposed from them: padding, merging to a fixed point, limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources.scratch import written

#: Rows of an image that are joined up in one task.
STRIP = 256

_STATS = "area long, x0 long, y0 long, x1 long, y1 long, sx double, sy double, first_y long, first_x long"
_EDGES = "array<struct<y:bigint,x0:bigint,x1:bigint>>"


class Joiner:
    """Union-find over runs that come row by row: runs that touch, also at a corner, get one root. Only the last row's runs are looked at."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.before: list[tuple[int, int, int]] = []
        self.row: list[tuple[int, int, int]] = []
        self.y: int | None = None
        self.at = 0
        self.reach: tuple[int, int] = (-1, 0)

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def new(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def add(self, y: int, x0: int, x1: int, node: int) -> None:
        """A run [x0, x1) of row y that belongs to `node`; rows ascend, and starts inside a row."""
        if y != self.y:
            self.before, self.row, self.at = (self.row if self.y is not None and y == self.y + 1 else []), [], 0
            self.y = y
        if self.row and self.reach[0] >= x0:
            self.union(node, self.reach[1])
        if not self.row or x1 > self.reach[0]:
            self.reach = (x1, node)
        before = self.before
        while self.at < len(before) and before[self.at][1] < x0:
            self.at += 1
        k = self.at
        while k < len(before) and before[k][0] <= x1:
            self.union(node, before[k][2])
            k += 1
        self.row.append((x0, x1, node))


def _parts(kind: pa.DataType, strip: int):
    """Parts of components inside strips, from runs sorted by image, strip, row and start."""
    names = ["image", "strip", "part", "area", "x0", "y0", "x1", "y1", "sx", "sy", "first_y", "first_x", "edges"]
    edge = pa.list_(pa.struct([("y", pa.int64()), ("x0", pa.int64()), ("x1", pa.int64())]))
    types = [kind, pa.int64(), pa.int64(), *[pa.int64()] * 5, pa.float64(), pa.float64(), pa.int64(), pa.int64(), edge]

    def finished(key: tuple, joiner: Joiner, stats: list[list]) -> Iterator[pa.RecordBatch]:
        for k in range(len(stats) - 1, -1, -1):
            root = joiner.root(k)
            if root != k:
                a, b = stats[root], stats[k]
                merged = [a[0] + b[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5], a[6] + b[6], *min((a[7], a[8]), (b[7], b[8])), a[9] + b[9]]
                stats[root], stats[k] = merged, None
        rows = [(*key, k, *s) for k, s in enumerate(stats) if s]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, joiner, stats = None, Joiner(), []
        for batch in batches:
            for image, s, y, x0, x1 in zip(*(batch.column(c).to_pylist() for c in ("image", "strip", "y", "x0", "x1")), strict=True):
                if now != (image, s):
                    if now:
                        yield from finished(now, joiner, stats)
                    now, joiner, stats = (image, s), Joiner(), []
                joiner.add(y, x0, x1, joiner.new())
                n = x1 - x0
                on_edge = y % strip in (0, strip - 1)
                stats.append([n, x0, y, x1, y + 1, n * (x0 + x1 - 1) / 2.0, float(n * y), y, x0, [{"y": y, "x0": x0, "x1": x1}] if on_edge else []])
        if now:
            yield from finished(now, joiner, stats)

    return scan


def _links(kind: pa.DataType):
    """Which parts are one component, from their runs at strips' edges, sorted by image, row and start."""
    names, types = ["image", "strip", "part", "to_strip", "to_part"], [kind, *[pa.int64()] * 4]

    def finished(image: object, joiner: Joiner, parts: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
        by_node = {node: part for part, node in parts.items()}
        rows = [(image, *part, *by_node[joiner.root(node)]) for part, node in parts.items()]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), types, strict=True)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, joiner, parts = (), Joiner(), {}
        for batch in batches:
            for image, s, part, y, x0, x1 in zip(*(batch.column(c).to_pylist() for c in ("image", "strip", "part", "y", "x0", "x1")), strict=True):
                if now != (image,):
                    if now:
                        yield from finished(now[0], joiner, parts)
                    now, joiner, parts = (image,), Joiner(), {}
                if (s, part) not in parts:
                    parts[s, part] = joiner.new()
                joiner.add(y, x0, x1, parts[s, part])
        if now:
            yield from finished(now[0], joiner, parts)

    return scan


def components(runs: DataFrame, image: str, strip: int = STRIP) -> DataFrame:
    """(image, area, x0, y0, x1, y1, centre_x, centre_y, first_y, first_x) of the 8-connected components of `runs` (image, y, x0, x1; y >= 0, x1 exclusive).

    first_y, first_x: the component's first cell by row; it names the component in its image. Runs that touch or overlap in a row are joined, cells given twice count twice, empty
    runs and rows with nulls don't count. An image is joined up by strips of `strip` rows in different tasks; only the runs at strips' edges then meet in one task, so a large image
    is split. No runs give no rows.
    """
    kind = runs.schema[image].dataType
    arrow = to_arrow_type(kind)
    longs = [F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")]
    dealt = runs.select(F.col(image).alias("image"), *longs).filter("image is not null and y >= 0 and x1 > x0").withColumn("strip", F.floor(F.col("y") / strip))
    named = f"image {kind.simpleString()}, strip long, part long"
    parts = dealt.repartition("image", "strip").sortWithinPartitions("image", "strip", "y", "x0").mapInArrow(_parts(arrow, strip), f"{named}, {_STATS}, edges {_EDGES}")
    parts = written(parts, "parts")  # read for edges and for sums, scanned once
    edges = parts.filter(F.size("edges") > 0).select("image", "strip", "part", F.explode("edges").alias("_e")).select("image", "strip", "part", "_e.*")
    links = edges.repartition("image").sortWithinPartitions("image", "y", "x0").mapInArrow(_links(arrow), f"{named}, to_strip long, to_part long")
    joined = parts.drop("edges").join(links, ["image", "strip", "part"], "left")
    whole = joined.groupBy("image", F.coalesce("to_strip", "strip").alias("_s"), F.coalesce("to_part", "part").alias("_p")).agg(
        F.sum("area").alias("area"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        (F.sum("sx") / F.sum("area")).alias("centre_x"), (F.sum("sy") / F.sum("area")).alias("centre_y"), F.min(F.struct("first_y", "first_x")).alias("_first"),
    )
    return whole.select(F.col("image").alias(image), "area", "x0", "y0", "x1", "y1", "centre_x", "centre_y", "_first.*")


def merge_boxes(boxes: list[tuple[int, int, int, int]], least_iou: float) -> tuple[list[tuple[tuple[int, int, int, int], list[int]]], list[tuple[int, int, float]]]:
    """(what is left: box and the places that it is made of; the merges: left place, right place, overlap).

    Again and again the first pair, by place, whose intersection over union reaches the bound becomes one box in the left one's place. After a merge only pairs with the
    new box can be the first, so earlier pairs aren't tried again.
    """
    corners, made = np.array(boxes, float).reshape(-1, 4), [[k] for k in range(len(boxes))]
    alive, merges, left = list(range(len(boxes))), [], 0

    def overlaps(k: int, others: list[int]) -> np.ndarray:
        a, b = corners[k], corners[others]
        both = np.clip(np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]), 0, None) * np.clip(np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]), 0, None)
        area = lambda c: np.clip(c[..., 2] - c[..., 0], 0, None) * np.clip(c[..., 3] - c[..., 1], 0, None)
        union = area(a) + area(b) - both
        return np.divide(both, union, out=np.zeros(len(others)), where=union > 0)

    def merge(i: int, j: int, iou: float) -> None:
        a, b = alive[i], alive[j]
        merges.append((a, b, iou))
        corners[a] = [*np.minimum(corners[a, :2], corners[b, :2]), *np.maximum(corners[a, 2:], corners[b, 2:])]
        made[a] = made[a] + made[b]
        del alive[j]

    while left < len(alive):
        iou = overlaps(alive[left], alive[left + 1 :])
        hits = np.flatnonzero(iou >= least_iou)
        if not len(hits):
            left += 1
            continue
        merge(left, left + 1 + int(hits[0]), float(iou[hits[0]]))
        while left:
            iou = overlaps(alive[left], alive[:left])
            hits = np.flatnonzero(iou >= least_iou)
            if not len(hits):
                break
            merge(int(hits[0]), left, float(iou[hits[0]]))
            left = int(hits[0])
    return [(tuple(int(v) for v in corners[k]), made[k]) for k in alive], merges


def _proposed(least_iou: float, most: int):
    """Decisions on the boxes of one image a row."""
    names = ("decision", "reason", "proposal_index", "left_index", "right_index", "iou", "x0", "y0", "x1", "y1", "area")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], []
            for k, boxes in enumerate(batch.column("boxes").to_pylist()):
                left, merges = merge_boxes([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in boxes], least_iou)
                rows = [("merged", "bbox_iou_at_or_above_merge_threshold", None, boxes[i]["index"], boxes[j]["index"], iou, None, None, None, None, None) for i, j, iou in merges]
                in_order = sorted(((box, made[0], sum(boxes[m]["area"] for m in made)) for box, made in left), key=lambda x: (x[0][1], x[0][0], -x[2], x[1]))
                for n, (box, first, area) in enumerate(in_order, 1):
                    what = ("generated", "accepted") if n <= most else ("overflow", "proposal_count_above_maximum")
                    rows.append((*what, n, boxes[first]["index"], None, None, *box, area))
                out += rows
                at += [k] * len(rows)
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 5]
            columns = [pa.array([r[c] for r in out], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("image").take(pa.array(at, pa.int64())), *columns], names=["image", *names])

    return decide


def proposals(found: DataFrame, image: str, width: Column, height: Column, least_area: int, most_area: int, padding: int, least_iou: float, most: int) -> DataFrame:
    """(image, decision, reason, proposal_index, left_index, right_index, iou, x0, y0, x1, y1, area): what becomes of each of `found`, components with area and box.

    Components are numbered in an image by first cell. Those outside the areas are `skipped`. The others' boxes, padded inside [0, width) x [0, height), are `merged` by `merge_boxes` in
    that order; what is left is ordered by y0, x0 and falling area: the first `most` are `generated`, the rest are `overflow`. left_index is the component that a row is about, or begins
    with. The merging order needs an image's boxes together: they meet as one row, of a few numbers each.
    """
    place = F.row_number().over(W.partitionBy("image").orderBy("first_y", "first_x"))
    rows = written(found.withColumnRenamed(image, "image").withColumn("index", place.cast("long")), "components")  # read for skipped and for merged ones, found once
    small, large = F.col("area") < least_area, F.col("area") > most_area
    none = lambda kind: F.lit(None).cast(kind)
    skipped = rows.filter(small | large).select(
        "image", F.lit("skipped").alias("decision"), F.when(small, "component_area_below_minimum").otherwise("component_area_above_maximum").alias("reason"), none("long").alias("proposal_index"),
        F.col("index").alias("left_index"), none("long").alias("right_index"), none("double").alias("iou"), *(none("long").alias(c) for c in ("x0", "y0", "x1", "y1")), "area",
    )
    padded = rows.filter(~(small | large)).select(
        "image", "index", F.greatest(F.lit(0), F.col("x0") - padding).alias("x0"), F.greatest(F.lit(0), F.col("y0") - padding).alias("y0"),
        F.least(width.cast("long"), F.col("x1") + padding).alias("x1"), F.least(height.cast("long"), F.col("y1") + padding).alias("y1"), "area",
    )
    boxes = padded.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("index", "x0", "y0", "x1", "y1", "area"))).alias("boxes"))
    schema = T.StructType([T.StructField("image", found.schema[image].dataType), *skipped.schema.fields[1:]])
    return boxes.mapInArrow(_proposed(least_iou, most), schema).unionByName(skipped).withColumnRenamed("image", image)

