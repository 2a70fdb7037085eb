"""Seeded cluster bootstrap whose draws are hashes, so that every run agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def poisson(u: Column) -> Column:
    """Poisson(1) draw by inversion of a uniform number in [0, 1)."""
    cumulative, term, steps = 0.0, 2.718281828459045**-1, []
    for k in range(7):
        cumulative += term
        steps.append((k, cumulative))
        term /= k + 1
    out = F.lit(7)
    for k, upto in reversed(steps):
        out = F.when(u < upto, F.lit(k)).otherwise(out)
    return out


def poisson_weight(seed: int, resample: Column, unit: Column) -> Column:
    """How often a unit is drawn in a resample: Poisson(1) by inversion of a hashed uniform number."""
    return poisson(F.xxhash64(F.lit(seed), resample, unit.cast("string")).bitwiseAND(F.lit((1 << 40) - 1)).cast("double") / float(1 << 40))


def poisson_weights(seed: int, unit: Column, resamples: int) -> Column:
    """How often a unit is drawn: in place 0 once, for the estimate, and then a Poisson(1) number a resample, from the MD5 of seed:resample:unit, so that any engine can redraw it."""
    number = lambda b: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), unit.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.transform(F.sequence(F.lit(0), F.lit(resamples)), lambda b: F.when(b == 0, F.lit(1)).otherwise(poisson(number(b))).cast("tinyint"))


def bootstrap_mean(df: DataFrame, keys: list[str], unit: str, value: Column, resamples: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(keys, units, estimate, low, high): mean of the units' means with a percentile interval.

    A resample weighs every unit by a Poisson draw, which needs no shuffle of drawn rows. Rows first fold into
    their unit, units are expanded by resample and summed on the map side.
    """
    units = df.groupBy(*keys, unit).agg(F.avg(value).alias("m"))
    point = units.groupBy(*keys).agg(F.count("*").alias("units"), F.avg("m").alias("estimate"))
    drawn = units.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", poisson_weight(seed, F.col("b"), F.col(unit)))
    means = drawn.groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col("m")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    tail = (1 - level) / 2
    ends = means.groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("e"))
    return point.join(ends, keys).select(*keys, "units", "estimate", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


RANKED = ("auroc", "average_precision", "recall", "precision", "specificity", "balanced_accuracy")


def metric_intervals(df: DataFrame, unit: str, score: Column, target: Column, cut: float, resamples: int = 200, seed: int = 0, level: float = 0.95, digits: int | None = None, least_units: int = 3) -> DataFrame:
    """(metric, status, estimate, low, high, resamples): RANKED metrics of a score for a 0/1 target, with percentile intervals over draws of whole units.

    A unit weighs a Poisson number in each resample, so all resamples come of one pass: rows are counted by unit and score, weights reach the counts as one array a
    unit, and each resample is ranked over its distinct scores (rounded to `digits`, which bounds them). Ties share ranks. A resample that lacks a class doesn't count. Rows
    with a null score, target or unit take no part; with fewer than `least_units` units, or one class only, all values are null and the status says why.
    """
    s = score.cast("double")
    rows = df.select(F.col(unit).alias("_u"), (s if digits is None else F.round(s, digits)).alias("_s"), target.cast("int").alias("_y")).filter("_u is not null and _s is not null and not isnan(_s) and _y is not null")
    counts = rows.groupBy("_u", "_s").agg(F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") != 1).alias("_neg"))
    weights = rows.select("_u").distinct().withColumn("_w", poisson_weights(seed, F.col("_u"), resamples))
    drawn = counts.join(weights, "_u").select("_s", "_pos", "_neg", F.posexplode("_w").alias("_b", "_w")).filter("_w > 0")
    per = drawn.groupBy("_b", "_s").agg(*(F.sum(F.col("_w") * F.col(c)).cast("double").alias(c) for c in ("_pos", "_neg")))
    down = W.partitionBy("_b").orderBy(F.desc("_s"))
    ranked = per.withColumns({"_above": F.sum("_pos").over(down) - F.col("_pos"), "_prec": F.sum("_pos").over(down) / F.sum(F.col("_pos") + F.col("_neg")).over(down)})
    pos, neg, hit = F.col("_pos"), F.col("_neg"), F.col("_s") >= cut
    share = lambda a, b: a / F.nullif(b, F.lit(0.0))
    sums = ranked.groupBy("_b").agg(
        F.sum(pos).alias("p"), F.sum(neg).alias("n"), F.sum(neg * (F.col("_above") + pos / 2)).alias("u"), F.sum(pos * F.col("_prec")).alias("a"),
        F.sum(F.when(hit, pos).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0.0)).alias("fp"),
    ).filter("p > 0 and n > 0")
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    values = (F.col("u") / (p * n), F.col("a") / p, tp / p, share(tp, tp + fp), (n - fp) / n, (tp / p + (n - fp) / n) / 2)
    long = sums.select("_b", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in zip(RANKED, values, strict=True)))).alias("m")).select("_b", "m.*").filter("v is not null")
    tail = (1 - level) / 2
    found = long.groupBy("metric").agg(
        F.max(F.when(F.col("_b") == 0, F.col("v"))).alias("estimate"), F.percentile(F.when(F.col("_b") > 0, F.col("v")), F.array(F.lit(tail), F.lit(1 - tail))).alias("e"), F.count_if(F.col("_b") > 0).alias("resamples")
    )
    units = weights.agg(F.count("*").alias("_units"))  # a row
    every = units.select("_units", F.explode(F.array(*map(F.lit, RANKED))).alias("metric")).join(found, "metric", "left")
    enough = F.col("_units") >= least_units
    status = F.when(~enough, f"fewer_than_{least_units}_units").when(F.coalesce("resamples", F.lit(0)) == 0, "resamples_lacked_both_classes").otherwise("estimated")
    shown = lambda c: F.when(enough, c)
    return every.select("metric", status.alias("status"), shown(F.col("estimate")).alias("estimate"), shown(F.col("e")[0]).alias("low"), shown(F.col("e")[1]).alias("high"), F.when(enough, F.coalesce("resamples", F.lit(0))).otherwise(0).alias("resamples"))
