"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector minus the centroid is rotated at random and kept as one sign bit a dimension, with two scalars: its
norm, and the inner product of its direction with that of its code. The inner product of a query with
the bits, divided by the second scalar, estimates that with the vector, without bias and with a
known error bound. Only vectors whose lower distance bound reaches the best distances so far
are compared exactly, on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import small

#: Rows of the sample that sets the centroid; queries in a block; width of the error bound in standard deviations.
SAMPLE, BLOCK, EPSILON = 5000, 256, 3.0
#: Blocks whose best candidates a task carries on from one chunk to the next.
CARRIED = 64


@dataclass(frozen=True)
class Rotation:
    centroid: np.ndarray
    matrix: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray, dim: int, seed: int = 0) -> Rotation:
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
        return Rotation(rows.mean(axis=0) if len(rows) else np.zeros(dim), q * np.sign(np.diag(r)))

    def turn(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rotated unit directions from the centroid, norms); a vector at the centroid has norm 0."""
        moved = vectors - self.centroid
        norms = np.sqrt((moved**2).sum(axis=1))
        return moved @ self.matrix / np.where(norms > 0, norms, 1)[:, None], norms

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed sign bits, norms, inner products of directions with their codes)."""
        unit, norms = self.turn(vectors)
        return np.packbits(unit > 0, axis=1), norms, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])


def bit_tables(unit: np.ndarray) -> np.ndarray:
    """[query, byte, value]: inner product of the query's part at that byte with the signs that the value's bits stand for, over root dim."""
    n, dim = unit.shape
    padded = np.zeros((n, -(-dim // 8) * 8))
    padded[:, :dim] = unit / np.sqrt(dim)
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
    return np.einsum("qbi,vi->qbv", padded.reshape(n, -1, 8), signs)


def search(
    rotation: Rotation, k: int, ids: np.ndarray, vectors: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, best: list | None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (ids, distances) of its k nearest of `vectors` and of those in `best`, nearest first, ties to smaller ids."""
    bits, norms, corrections = code
    unit, query_norms = rotation.turn(queries)
    tables = bit_tables(unit)
    slack = np.where(norms > 0, np.sqrt(np.maximum(0, 1 - corrections**2)) / np.maximum(corrections, 1e-9) * EPSILON / np.sqrt(max(1, vectors.shape[1] - 1)), 0)
    out = []
    for q in range(len(queries)):
        cosine = sum(tables[q, j][bits[:, j]] for j in range(bits.shape[1])) / np.maximum(corrections, 1e-9)
        base, cross = norms**2 + query_norms[q] ** 2, 2 * norms * query_norms[q]
        lower = base - cross * np.minimum(1, cosine + slack)
        lower[ids == query_ids[q]] = np.inf
        found_ids, found = best[q] if best else (np.zeros(0, np.int64), np.zeros(0))
        tried = np.zeros(len(ids), bool)
        # the likeliest first: they set the bound for the others
        wave = np.argsort(base - cross * cosine + np.where(np.isinf(lower), np.inf, 0), kind="stable")[: 2 * k]
        wave = wave[np.isfinite(lower[wave])]
        for _ in range(2):
            tried[wave] = True
            exact = np.sqrt(((vectors[wave] - queries[q]) ** 2).sum(axis=1))
            found_ids, found = np.concatenate((found_ids, ids[wave])), np.concatenate((found, exact))
            order = np.lexsort((found_ids, found))[:k]
            found_ids, found = found_ids[order], found[order]
            limit = found[-1] ** 2 * (1 + 1e-9) + 1e-12 if len(found) == k else np.inf
            wave = np.flatnonzero(~tried & (lower <= limit) & np.isfinite(lower))
        out.append((found_ids, found))
    return out


def usable(vector: Column) -> Column:
    """Not null or zero, without null or non-finite components."""
    return F.coalesce(
        F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)
    )


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors]).reshape(-1, dim)


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `base` for each query, both (vec_id, embedding).

    Unusable vectors take no part, nor do those of another dimension than most of `base` has (of equals the
    smaller). Rows with the query's own vec_id are not its candidates; a query id that repeats is asked once, with
    its smallest vector. Other repeated rows are candidates of their own. Rows without vec_id take no part, as query or candidate; an empty side gives no rows. The base is coded where it is read; blocks of the
    stated queries meet its chunks, and each task returns its k best a query. Query blocks are broadcast if they fit the bound.
    """
    spark = base.sparkSession
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    sizes = base.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, rows = sizes[0]["dim"], sizes[0]["n"]
    base = base.filter(F.size("embedding") == dim)
    share = F.xxhash64(F.lit(seed), "vec_id").bitwiseAND(F.lit((1 << 30) - 1)) < F.lit(int(min(1.0, SAMPLE / rows) * (1 << 30)))
    rotation = Rotation.fit(_matrix([r[0] for r in base.filter(share).orderBy("vec_id", "embedding").select("embedding").collect()], dim), dim, seed)
    shared = spark.sparkContext.broadcast(rotation)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = _matrix(batch["embedding"], dim)
                bits, norms, corrections = shared.value.encode(vectors)
                blobs = [x.tobytes() for x in (batch["vec_id"].to_numpy(np.int64), vectors, bits, norms, corrections)]
                yield pd.DataFrame([blobs], columns=["ids", "vectors", "bits", "norms", "corrections"])

    chunks = base.mapInPandas(encode, "ids binary, vectors binary, bits binary, norms binary, corrections binary")

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.filter(usable(F.col("embedding")) & (F.size("embedding") == dim) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    count = asked.count()
    blocks = (
        asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(max(1, -(-count // BLOCK)))).cast("int"))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("queries"))
        .select("block", F.col("queries.vec_id").alias("query_ids"), F.flatten("queries.embedding").alias("query_vectors"))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, list]] = {}

        def emptied() -> pd.DataFrame:
            parts = [(np.full(len(i), q), i, d) for ids, found in best.values() for q, (i, d) in zip(ids, found, strict=True)]
            best.clear()
            q, i, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pd.DataFrame({"query_id": q, "vec_id": i, "score": d})

        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, query_ids = np.frombuffer(r.ids, np.int64), np.asarray(r.query_ids, np.int64)
                code = np.frombuffer(r.bits, np.uint8).reshape(len(ids), -1), np.frombuffer(r.norms), np.frombuffer(r.corrections)
                before = best.get(r.block)
                found = search(shared.value, k, ids, np.frombuffer(r.vectors).reshape(-1, dim), code, query_ids, _matrix([r.query_vectors], dim), before and before[1])
                best[r.block] = (query_ids, found)
                if len(best) > CARRIED:
                    yield emptied()
        if best:
            yield emptied()

    pairs = chunks.crossJoin(small(blocks, count, 8 * dim + 8))  # a row for each chunk and block
    found = pairs.mapInPandas(compare, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(base, base.filter(F.col("vec_id") % 100 == 0))
