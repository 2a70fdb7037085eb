"""Ranking, classification, agreement and overlap metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.rank import ratio


def _by_value(df: DataFrame, score: Column, target: Column, keys: Sequence[str]) -> DataFrame:
    """Rows and positives of each distinct score: what the ranking metrics need of a table of any size."""
    return df.groupBy(*keys, score.alias("score")).agg(F.count("*").alias("n"), F.sum(target.cast("long")).alias("pos"))


def ranking_metrics(df: DataFrame, score: Column, target: Column, keys: Sequence[str] = ()) -> DataFrame:
    """positives, negatives, auroc (rank sum with average ranks), average_precision (over distinct scores); null with one class only."""
    per = _by_value(df, score, target, keys)
    up, down = W.partitionBy(*keys).orderBy("score"), W.partitionBy(*keys).orderBy(F.desc("score"))
    total = F.sum("pos").over(W.partitionBy(*keys))
    row = per.select(
        *keys, "n", "pos", total.alias("all"),
        (F.sum("n").over(up) - F.col("n") + (F.col("n") + 1) / 2).alias("rank"),
        (F.sum("pos").over(down) / F.sum("n").over(down)).alias("precision"),
    )
    out = row.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), (F.sum("n") - F.sum("pos")).alias("negatives"), F.sum(F.col("rank") * F.col("pos")).alias("_r"), F.sum(F.col("precision") * F.col("pos")).alias("_p")
    )
    p, n = F.col("positives"), F.col("negatives")
    return out.select(*keys, "positives", "negatives", ratio(F.col("_r") - p * (p + 1) / 2, p * n).alias("auroc"), F.when((p > 0) & (n > 0), F.col("_p") / p).alias("average_precision"))


def confusion(df: DataFrame, predicted: Column, target: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, recall, precision, specificity, balanced_accuracy; null on zero denominators, rows with a null side don't count."""
    rows = df.withColumns({"_p": predicted.cast("int"), "_y": target.cast("int")}).filter("_p is not null and _y is not null")
    cell = lambda p, y: F.count_if((F.col("_p") == p) & (F.col("_y") == y))
    out = rows.groupBy(*keys).agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "specificity": ratio(tn, tn + fp)})
    return out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def average_rank(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """`df` plus the average rank of `value`; ranks come from the distinct values' counts and are joined back."""
    per = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranks = per.withColumn(name, F.sum("_n").over(W.partitionBy(*keys).orderBy(value)) - F.col("_n") + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*keys, value])


def agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean absolute error, Spearman's correlation, share equal and share within one, over rows with both values."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(both, a, "_ra", keys), b, "_rb", keys)
    gap = F.abs(F.col(a) - F.col(b))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(gap).alias("mae"), F.corr("_ra", "_rb").alias("spearman"), F.avg((gap == 0).cast("double")).alias("exact"), F.avg((gap <= 1).cast("double")).alias("within_one")
    )


def overlap(df: DataFrame, truth: Column, predicted: Column, keys: Sequence[str]) -> DataFrame:
    """Dice and Jaccard of two element flags per key, in both conventions for two empty sides (0 and 1), precision, recall, accuracy."""
    t, p = truth.cast("int"), predicted.cast("int")
    out = df.groupBy(*keys).agg(F.sum(t * p).alias("both"), F.sum(t).alias("truth"), F.sum(p).alias("predicted"), F.avg((t == p).cast("double")).alias("accuracy"))
    both, a, b = F.col("both"), F.col("truth"), F.col("predicted")
    dice, jaccard = ratio(2 * both, a + b), ratio(both, a + b - both)
    return out.withColumns({
        "dice_zero": F.coalesce(dice, F.lit(0.0)), "dice_one": F.coalesce(dice, F.lit(1.0)), "jaccard_zero": F.coalesce(jaccard, F.lit(0.0)), "jaccard_one": F.coalesce(jaccard, F.lit(1.0)),
        "precision": F.coalesce(ratio(both, b), F.lit(0.0)), "recall": F.coalesce(ratio(both, a), F.lit(0.0)),
    })


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from the contingency table; 1 where it is undefined."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(pairs("m").alias(f"s_{c}"))
    total = cells.agg(F.sum("n").alias("t"), pairs("n").alias("s"))
    out = total.crossJoin(side(a)).crossJoin(side(b))  # one row each
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / (F.col("t") * (F.col("t") - 1) / 2.0)
    best = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return out.select(F.col("t").alias("rows"), F.coalesce(ratio(F.col("s") - expected, best - expected), F.lit(1.0)).alias("ari"))
