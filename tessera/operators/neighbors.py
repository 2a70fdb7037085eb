"""Exact nearest neighbours with group exclusion, anchors, centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Anchors of a block; blocks that are broadcast (of 1,000 doubles an anchor they hold 32 MB).
ANCHORS, ANCHOR_BLOCKS = 512, 8
#: Queries of a block that are compared at once; candidates that set their first bound; pairs measured exactly at once.
SLICE, SAMPLE, EXACT = 256, 1024, 1 << 16
#: Blocks that small tables are cut into, if so many have LEAST rows; parts of the queries; blocks of a part of the candidates.
BLOCKS, LEAST, QUERY_PARTS, PART = 32, 256, 64, 32


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences in double precision, in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def _blocks(df: DataFrame, blocks: int, parts: int, prefix: str) -> DataFrame:
    """Rows with finite vectors packed into `blocks` blocks in `parts` partitions: ids, group names, where groups start and vectors, as bytes; a block is one row."""
    single = dict(df.dtypes)["vector"] == "array<float>"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, groups = np.asarray(r.id, dtype=np.int64), np.asarray(r.grp, dtype=object)
                vectors = np.asarray(r.vec, dtype=np.float64).reshape(len(ids), -1)
                with np.errstate(over="ignore"):
                    kept = np.isfinite(64 * np.einsum("ij,ij->i", vectors, vectors))
                if kept.any():
                    codes, names = pd.factorize(groups[kept], use_na_sentinel=False)
                    order = np.argsort(codes, kind="stable")
                    starts = np.searchsorted(codes[order], np.arange(len(names) + 1)).astype(np.int64)
                    packed = vectors[kept][order].astype(np.float32 if single else np.float64)
                    yield pd.DataFrame({"block": [r.block], "id": [ids[kept][order].tobytes()], "grp": [[None if pd.isnull(n) else n for n in names]], "start": [starts.tobytes()], "vec": [packed.tobytes()]})

    one = F.struct("id", "grp", "vector")
    lists = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition(min(blocks, QUERY_PARTS), "block").groupBy("block").agg(F.collect_list(one).alias("_r"))
    lists = lists.select("block", F.col("_r.id").alias("id"), F.col("_r.grp").alias("grp"), F.flatten(F.transform("_r", lambda r: r["vector"])).alias("vec"))
    packed = lists.mapInPandas(pack, "block long, id binary, grp array<string>, start binary, vec binary")
    # shuffled once more: a product computes its partitions anew for each pair of them, and so only reads blocks
    return packed.repartition(parts).select(*(F.col(c).alias(f"{prefix}_{c}") for c in packed.columns))


class _Nearest:
    """The k nearest rows of other groups found so far for a block of queries."""

    def __init__(self, block: tuple, single: bool, k: int):
        self.ids, names, self.starts, self.vectors = self._read(*block, single)
        self.centre = self.vectors.mean(0)
        moved, self.squares = self._moved(self.vectors)
        self.own = {name: at for at, name in enumerate(names)}
        self.codes = np.repeat(np.arange(len(names)), np.diff(self.starts))
        with np.errstate(over="ignore"):
            self.left = np.hstack([-2 * moved, np.ones((len(self.ids), 1))]).astype(np.float32)
        self.single, self.k, self.far, self.found = single, k, np.full((len(self.ids), k), np.inf), np.zeros((len(self.ids), k), np.int64)

    @staticmethod
    def _read(ids, names, starts, vectors, single):
        ids = np.frombuffer(ids, np.int64)
        vectors = np.frombuffer(vectors, np.float32 if single else np.float64).astype(np.float64).reshape(len(ids), -1)
        return ids, names, np.frombuffer(starts, np.int64), vectors

    def _moved(self, vectors):
        moved = vectors - self.centre  # shorter vectors, tighter bounds
        return moved, np.einsum("ij,ij->i", moved, moved)

    def meet(self, block: tuple) -> None:
        """Compare with a block of candidates: in single precision, then exactly whatever its error bound leaves."""
        ids, names, starts, vectors = self._read(*block, self.single)
        moved, squares = self._moved(vectors)
        same = {self.own[name]: slice(starts[at], starts[at + 1]) for at, name in enumerate(names) if name in self.own}
        kind = np.float32 if max(squares.max(), self.squares.max()) < 1e30 else np.float64
        # a product of rows with one more element: squared distance less the query's square
        left = self.left if kind is np.float32 else np.hstack([-2 * self._moved(self.vectors)[0], np.ones((len(self.ids), 1))])
        right = np.ascontiguousarray(np.hstack([moved, squares[:, None]]).T, dtype=kind)
        error = np.finfo(kind).eps * (vectors.shape[1] + 8) * (self.squares + 2 * squares.max()) + 1e-30
        out, held, hits = np.empty((SLICE, len(ids)), kind), 0, []
        for at in range(0, len(self.ids), SLICE):
            end = min(at + SLICE, len(self.ids))
            near = np.matmul(left[at:end], right, out=out[: end - at])
            for own in range(self.codes[at], self.codes[end - 1] + 1):
                if own in same:
                    near[max(self.starts[own] - at, 0) : self.starts[own + 1] - at, same[own]] = np.inf
            bound = self.far[at:end, -1] ** 2 * (1 + 1e-12) - self.squares[at:end] + error[at:end]
            open_ = np.isinf(bound)
            some = near[open_, :: max(1, len(ids) // SAMPLE)]
            if some.shape[1] > self.k:
                bound[open_] = np.partition(some, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) + 2 * error[at:end][open_]
            bound = np.minimum(np.nextafter(bound.astype(kind), kind(np.inf)), np.finfo(kind).max)
            rows = np.flatnonzero(near.min(axis=1) <= bound)
            row, col = np.divmod(np.flatnonzero(near[rows] <= bound[rows, None]), len(ids))
            hits.append((at + rows[row], col))
            held += len(row)
            if held > EXACT or end == len(self.ids):
                row, col = (np.concatenate(x) for x in zip(*hits))
                for part in range(0, held, EXACT):
                    r, c = row[part : part + EXACT], col[part : part + EXACT]
                    self._merge(r, ids[c], np.sqrt(((vectors[c] - self.vectors[r]) ** 2).sum(1)))
                held, hits = 0, []

    def _merge(self, row, ids, far) -> None:
        some = np.unique(row)
        row = np.concatenate([row, np.repeat(some, self.k)])
        ids, far = np.concatenate([ids, self.found[some].ravel()]), np.concatenate([far, self.far[some].ravel()])
        order = np.lexsort((ids, far, row))
        row, ids, far = row[order], ids[order], far[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.far[row[best], place[best]], self.found[row[best], place[best]] = far[best], ids[best]

    def rows(self) -> pd.DataFrame:
        row, place = np.nonzero(np.isfinite(self.far))
        return pd.DataFrame({"query_id": self.ids[row], "id": self.found[row, place], "distance": self.far[row, place]})


def nearest_other_group(df: DataFrame, id_: str, group: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query_id, rank, id, distance): for every row the k nearest rows of other groups, ties to smaller ids.

    All rows are asked against all rows, in blocks: a task takes blocks of queries past a part of the candidates, in numpy, and
    keeps k a query and part, so single pairs are never rows. The work is quadratic, as exact answers for all rows are.
    """
    vectors = F.col(vector) if dict(df.dtypes).get(vector) == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(group).cast("string").alias("grp"), vectors.alias("vector"))

    single = dict(rows.dtypes)["vector"] == "array<float>"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, best = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.q_block != at:
                    if best is not None:
                        yield best.rows()
                    at, best = r.q_block, _Nearest((r.q_id, r.q_grp, r.q_start, r.q_vec), single, k)
                best.meet((r.c_id, r.c_grp, r.c_start, r.c_vec))
        if best is not None:
            yield best.rows()

    count = df.count()
    blocks = max(1, -(-count // block), min(BLOCKS, count // LEAST))
    # a product at all sizes: a broadcast of the queries would leave a task a part of the candidates
    pairs = _blocks(rows, blocks, min(blocks, QUERY_PARTS), "q").crossJoin(_blocks(rows, blocks, -(-blocks // PART), "c").drop("c_block").hint("shuffle_replicate_nl"))
    found = pairs.mapInPandas(compare, "query_id long, id long, distance double")
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): mean of each dimension, combined before the shuffle."""
    cells = df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def representatives(df: DataFrame, id_: str, group: str, vector: str, k: int) -> DataFrame:
    """(group, rank, id, distance): the k rows nearest to their group's centroid."""
    far = df.join(centroids(df, group, vector), group).withColumn("distance", F.sqrt(squared_distance(F.col(vector), F.col("centroid"))))
    order = W.partitionBy(group).orderBy(F.round("distance", 6), id_)
    return far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(group, "rank", id_, "distance")


def nearest_anchor(df: DataFrame, anchors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, anchor_id, distance): the nearest of the named anchors (anchor_id, anchor_vector); an anchor gets the nearest other one.

    Anchors are packed into blocks; a row meets a block as a whole, so pairs are never rows. Up to ANCHOR_BLOCKS blocks are broadcast,
    more meet the rows in a partitioned product.
    """
    count = anchors.count()
    blocks = max(1, -(-count // ANCHORS))
    packed = anchors.groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("anchor_id", "anchor_vector")).alias("_anchors"))
    pairs = df.select(F.col(id_).alias("_id"), F.col(vector).alias("_v")).crossJoin(F.broadcast(packed) if blocks <= ANCHOR_BLOCKS else packed)
    others = F.filter("_anchors", lambda a: a["anchor_id"] != F.col("_id"))
    far = F.transform(others, lambda a: F.struct(squared_distance(F.col("_v"), a["anchor_vector"]).alias("d"), a["anchor_id"].alias("anchor_id")))
    best = F.array_min(F.transform(far, lambda x: F.struct(F.round(F.sqrt(x["d"]), 6).alias("r"), x["anchor_id"].alias("anchor_id"), F.sqrt(x["d"]).alias("distance"))))
    near = pairs.select(F.col("_id").alias(id_), best.alias("b")).filter("b is not null")
    if blocks > 1:
        near = near.groupBy(id_).agg(F.min("b").alias("b"))
    return near.select(id_, "b.anchor_id", "b.distance")


def zscores(df: DataFrame, id_: str, vector: str, least: float = 1e-8) -> DataFrame:
    """(id, dim, z): population z-scores in long form, 0 where a dimension doesn't vary."""
    cells = df.select(id_, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = cells.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return cells.join(stats, "dim").select(id_, "dim", F.when(F.col("s") > least, (F.col("x") - F.col("m")) / F.col("s")).otherwise(F.lit(0.0)).alias("z"))


def hausdorff(df: DataFrame, key: str, side: str, x: str, y: str) -> DataFrame:
    """(key, distance): the larger of the two directed distances between the point sets of sides true and false; infinite if one is empty.

    Points of a key meet only each other.
    """
    points = df.select(key, side, x, y).distinct()
    a, b = points.filter(side).alias("a"), points.filter(~F.col(side)).alias("b")
    pairs = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(
        F.col(f"a.{key}").alias(key), F.struct(F.col(f"a.{x}"), F.col(f"a.{y}")).alias("p"), F.struct(F.col(f"b.{x}"), F.col(f"b.{y}")).alias("q"),
        F.sqrt((F.col(f"a.{x}") - F.col(f"b.{x}")) ** 2 + (F.col(f"a.{y}") - F.col(f"b.{y}")) ** 2).alias("d"),
    )
    one = lambda side_: pairs.groupBy(key, side_).agg(F.min("d").alias("m")).groupBy(key).agg(F.max("m").alias("m"))
    far = one("p").unionByName(one("q")).groupBy(key).agg(F.max("m").alias("distance"))
    return points.select(key).distinct().join(far, key, "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def farthest_first(df: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(id, centre, distance): k centres chosen farthest first from the smallest id on, and each row's nearest of them. Only the centres reach the driver."""
    first = df.orderBy(id_).limit(1).select(id_, vector).collect()
    centres = [(r[0], list(map(float, r[1]))) for r in first]

    def nearest() -> DataFrame:
        options = F.array(*(F.struct(F.sqrt(squared_distance(F.col(vector), F.array(*map(F.lit, v)))).alias("d"), F.lit(i).alias("centre")) for i, v in centres))
        return df.withColumn("_n", F.array_min(options))

    while centres and len(centres) < k:
        far = nearest().orderBy(F.round(F.col("_n.d"), 6).desc(), id_).limit(1).select(id_, vector, "_n.d").collect()[0]
        if far["d"] <= 0:
            break
        centres.append((far[0], list(map(float, far[1]))))
    return (nearest() if centres else df.withColumn("_n", F.struct(F.lit(0.0).alias("d"), F.col(id_).alias("centre")))).select(id_, "_n.centre", F.col("_n.d").alias("distance"))
