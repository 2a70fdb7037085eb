"""Fold assignment by group, out-of-fold means, leakage checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_fold(key: Column, folds: int, seed: int = 0) -> Column:
    """Fold from 0 of a group key: needs no shuffle, and a group never straddles."""
    return F.pmod(F.xxhash64(F.lit(seed), key.cast("string")), F.lit(folds)).cast("int")


def greedy_folds(df: DataFrame, group: str, severe: Column, score: Column, folds: int) -> DataFrame:
    """(group, fold, severe, rows): groups in order of severity, each to the fold with the least (severe, rows, score sum).

    Each choice depends on the one before: one row a group passes through one task, sorted there, which holds no more than the folds' loads.
    """
    per = df.groupBy(F.col(group).alias("g")).agg(F.sum(severe.cast("long")).alias("sev"), F.count("*").alias("n"), F.max(score).cast("double").alias("top"), F.sum(score).cast("double").alias("total"))
    in_order = per.repartition(1).sortWithinPartitions(F.desc("sev"), F.desc("top"), F.desc("n"), "g")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, 0, 0.0, k) for k in range(folds)]
        for batch in batches:
            put = []
            for sev, n, total in zip(*(batch.column(c).to_pylist() for c in ("sev", "n", "total")), strict=True):
                least = min(loads)
                put.append(least[3])
                loads[least[3]] = (least[0] + sev, least[1] + n, least[2] + (total or 0.0), least[3])
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(put, pa.int32()), batch.column("sev"), batch.column("n")], names=["g", "fold", "sev", "n"])

    dealt = in_order.mapInArrow(deal, f"g {per.schema['g'].dataType.simpleString()}, fold int, sev long, n long")
    return dealt.select(F.col("g").alias(group), "fold", F.col("sev").alias("severe"), F.col("n").alias("rows"))


def leave_fold_mean(df: DataFrame, fold: str, value: Column) -> DataFrame:
    """(fold, rows, train_mean): mean over all other folds, from one row a fold."""
    per = df.groupBy(fold).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    total = per.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    return per.crossJoin(total).select(fold, F.col("n").alias("rows"), ((F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))).alias("train_mean"))


def leaking_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups in both."""
    return train.select(group).intersect(test.select(group))


def conformal_quantiles(df: DataFrame, keys: Sequence[str], residual: Column, coverage: float, default: float) -> DataFrame:
    """(keys, n, quantile): the residual at level min(1, ceil((n + 1) * coverage) / n), the higher neighbour; `default` for none.

    Positions are found on the distinct residuals' counts, so that no group's residuals meet in one row.
    """
    from pyspark.sql import Window as W

    per = df.filter(residual.isNotNull()).groupBy(*keys, residual.alias("r")).agg(F.count("*").alias("m"))
    cum = per.select(*keys, "r", F.sum("m").over(W.partitionBy(*keys).orderBy("r")).alias("upto"), F.sum("m").over(W.partitionBy(*keys)).alias("n"))
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * coverage - 1e-9) / F.col("n"))
    place = F.ceil(level * (F.col("n") - 1) - 1e-9) + 1
    found = cum.filter(F.col("upto") >= place).groupBy(*keys).agg(F.max("n").alias("n"), F.min("r").alias("quantile"))
    return df.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("quantile", F.lit(default)).alias("quantile"))
