"""Stratified and two-level aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: Sequence[str], missing: str = "missing") -> DataFrame:
    """(field, value, rows): counts of each column's values, nulls as `missing`; one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("rows"))


def two_level_mean(df: DataFrame, stratum: Sequence[str], subject: str, value: Column) -> DataFrame:
    """Per stratum: rows, subjects, row_mean, and the mean of its subjects' means."""
    inner = df.groupBy(*stratum, subject).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.avg(value).alias("_m"))
    return inner.groupBy(*stratum).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("subjects"), (F.sum("_s") / F.sum("_n")).alias("row_mean"), F.avg("_m").alias("subject_mean")
    )


def threshold_support(df: DataFrame, score: Column, group: str, stratum: str, thresholds: Sequence[float], least: int = 2) -> DataFrame:
    """Overall and per stratum, for each threshold: rows and distinct groups above and not above it; underpowered with under `least` groups on a side.

    First rows are counted by stratum, group and side of each threshold, so distinct counts never see raw rows twice.
    """
    cuts = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    rows = df.select(F.col(stratum).alias("stratum"), F.col(group).alias("g"), score.alias("s")).groupBy("stratum", "g", "s").agg(F.count("*").alias("n"))
    sided = rows.withColumn("threshold", cuts).withColumn("above", F.col("s") > F.col("threshold"))
    per = sided.groupBy("stratum", "g", "threshold").agg(F.sum(F.when(F.col("above"), F.col("n")).otherwise(0)).alias("hi"), F.sum(F.when(~F.col("above"), F.col("n")).otherwise(0)).alias("lo"))
    both = per.unionByName(per.groupBy("g", "threshold").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).withColumn("stratum", F.lit("overall")))
    out = both.groupBy("stratum", "threshold").agg(
        F.sum("hi").alias("rows_above"), F.sum("lo").alias("rows_below"), F.count_if(F.col("hi") > 0).alias("groups_above"), F.count_if(F.col("lo") > 0).alias("groups_below")
    )
    return out.withColumn("underpowered", (F.col("groups_above") < least) | (F.col("groups_below") < least))


def mode_per_group(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("mode"), F.max("n").alias("mode_rows"))


def category_share(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Per key: rows, categories and the share of the largest category."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count("*").alias("categories"), (F.max("n") / F.sum("n")).alias("max_share"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """(keys, a column for each name): exact interpolated percentiles of each key.

    Positions are found on the running counts of the distinct values, so no group's values meet in one row.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cum = per.withColumns({"_upto": F.sum("_n").over(W.partitionBy(*keys).orderBy(value)), "_all": F.sum("_n").over(W.partitionBy(*keys))})
    beyond = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    found = {}
    for name, q in at.items():
        place = (F.col("_all") - 1) * F.lit(float(q))
        low, high, rest = beyond(F.floor(place + 1e-9)), beyond(F.ceil(place - 1e-9)), F.max(place - F.floor(place + 1e-9))
        found[name] = low + (high - low) * F.greatest(rest, F.lit(0.0))
    return cum.groupBy(*keys).agg(*(c.alias(name) for name, c in found.items()))


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, sample deviation, min, median, p75, p95, max of each key."""
    per = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    at = percentiles(df, keys, value, {"median": 0.5, "p75": 0.75, "p95": 0.95}).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [per[k].eqNullSafe(at[f"_{k}"]) for k in keys]
    return per.join(at, same, "left").select(*keys, "n", "mean", "std", "min", "median", "p75", "p95", "max")


def set_coverage(df: DataFrame, keys: Sequence[str], truth: str, members: str) -> DataFrame:
    """Per key: rows, share whose prediction set holds the truth, mean set size."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(F.expr(f"CAST(array_contains({members}, {truth}) AS DOUBLE)")).alias("coverage"), F.avg(F.size(members)).alias("mean_size"))


def exact_mean(value: Column) -> Column:
    """The mean, from a sum of whole millionths where those hold each value exactly: the same however rows are dealt out. Else the plain mean."""
    x = value.cast("double")
    whole = F.rint(x * 1e6).try_cast("long")
    total = F.try_sum(whole)
    kept = F.count_if(whole / F.lit(1e6) == x) == F.count(x)
    return F.when(kept & total.isNotNull(), total / F.lit(1e6) / F.count(x)).otherwise(F.avg(x))


def cohort_stability(first: DataFrame, second: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """(key, first_mean, second_mean, gap, stable) of the keys in both."""
    mean = lambda df, name: df.groupBy(key).agg(exact_mean(F.col(value)).alias(name))
    both = mean(first, "first_mean").join(mean(second, "second_mean"), key)
    return both.withColumn("gap", F.abs(F.col("first_mean") - F.col("second_mean"))).withColumn("stable", F.col("gap") <= limit)


def contrast(df: DataFrame, flag: Column, columns: Sequence[str]) -> DataFrame:
    """(feature, mean_true, mean_false, difference) of each column by a flag, in one aggregation."""
    made = df.agg(*(F.avg(F.when(flag, F.col(c))).alias(f"t_{c}") for c in columns), *(F.avg(F.when(~flag, F.col(c))).alias(f"f_{c}") for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"t_{c}").alias("mean_true"), F.col(f"f_{c}").alias("mean_false")) for c in columns)))
    return made.select(rows.alias("r")).select("r.*").withColumn("difference", F.abs(F.col("mean_true") - F.col("mean_false")))


def feature_diagnostics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, rows, missing, non_finite, zero_variance, spread) of numeric columns, in one aggregation."""
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        bad = F.isnan(x) | (F.abs(x) == float("inf"))
        ok = F.when(~bad, x)
        cells.append(F.struct(
            F.lit(c).alias("feature"), F.count("*").alias("rows"), F.count_if(x.isNull()).alias("missing"), F.count_if(F.coalesce(bad, F.lit(False))).alias("non_finite"),
            (F.coalesce(F.var_samp(ok), F.lit(0.0)) <= 1e-12).alias("zero_variance"), (F.max(ok) - F.min(ok)).alias("spread"),
        ))
    return df.agg(*(cell.alias(f"c{k}") for k, cell in enumerate(cells))).select(F.explode(F.array(*(F.col(f"c{k}") for k in range(len(cells))))).alias("r")).select("r.*")


def exploded_counts(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """(label, rows) of the parts of a joined text; blanks don't count."""
    parts = df.select(F.explode(F.split(F.coalesce(F.col(column), F.lit("")), separator)).alias("p")).select(F.trim("p").alias("label"))
    return parts.filter("label <> ''").groupBy("label").agg(F.count("*").alias("rows"))
