"""Bucketed top-k, quotas, splits, diverse examples and threshold choices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.running import numbered, running_totals


def top_per_bucket(df: DataFrame, bucket: str, order: Sequence[Column], k: int, total: int | None = None, bucket_order: Sequence[Column] = ()) -> DataFrame:
    """The first k rows of each bucket as `rank`; then, if `total` is given, the first `total` of these by bucket_order and rank.

    Spark limits each task to k rows a bucket before the shuffle, so a hot bucket doesn't gather.
    """
    out = df.withColumn("rank", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).filter(F.col("rank") <= k)
    return out if total is None else out.orderBy(*bucket_order, "rank", *order).limit(total)


def quota_and_fill(df: DataFrame, bucket: str, order: Sequence[Column], quota: int, size: int) -> DataFrame:
    """The first `quota` rows of each bucket, then the next rows by `order` up to `size`; picked says which. `order` is total.

    Both parts are top-k, so no bucket is sorted whole. The fill loses at most the quotas' rows to them: it is among the first rows of the
    table, as many as wanted and as the quotas hold, and the first of these in their bucket are the quotas'.
    """
    best = top_per_bucket(df, bucket, order, quota).drop("rank").withColumn("picked", F.lit("quota"))
    first = df.orderBy(*order).limit(size + best.count())
    fill = first.withColumn("_r", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).filter(F.col("_r") > quota).drop("_r").withColumn("picked", F.lit("fill"))
    return best.unionByName(fill).orderBy(F.when(F.col("picked") == "quota", 0).otherwise(1), *order).limit(size)


def split_by_rank(groups: DataFrame, order: str, fractions: Sequence[tuple[str, float]], last: str) -> DataFrame:
    """`groups` (a row each) in order of a unique numeric column, cut at cumulative fractions of their number; plus split and place inside it."""
    total, done, low = groups.count(), 0.0, F.lit(0).cast("bigint")
    out, start = None, None
    for name, share in fractions:
        done += share
        cut = int(total * done + 1e-9)
        cond = F.col("_at") <= cut
        out = F.when(cond, name) if out is None else out.when(cond, name)
        start = F.when(cond, low) if start is None else start.when(cond, low)
        low = F.lit(cut).cast("bigint")
    placed = numbered(groups, order, "_at")
    return placed.withColumns({"split": out.otherwise(last), "place": (F.col("_at") - start.otherwise(low)).cast("int")}).drop("_at")


def diverse_examples(df: DataFrame, category: str, subject: str, image: str, order: Sequence[Column], k: int) -> DataFrame:
    """k rows a category: first the best of each unseen subject, then of each unseen image, then the rest.

    Only the first k + 1 rows of an image can be among the k: a limit that tasks apply before the shuffle.
    """
    one = df.withColumn("_i", F.row_number().over(W.partitionBy(category, subject, image).orderBy(*order))).filter(F.col("_i") <= k + 1).withColumn("_again", F.col("_i") > 1)
    unseen = F.row_number().over(W.partitionBy(category, subject, "_again").orderBy(*order)) == 1
    tiered = one.withColumn("tier", F.when(F.col("_again"), 3).when(unseen, 1).otherwise(2))
    return tiered.withColumn("rank", F.row_number().over(W.partitionBy(category).orderBy("tier", *order))).filter(F.col("rank") <= k).drop("_i", "_again")


def threshold_curve(df: DataFrame, probability: Column, target: Column, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of p >= t for each threshold and key, in one aggregation of the distinct probabilities."""
    base = df.select(*keys, probability.alias("p"), target.cast("int").alias("y")).groupBy(*keys, "p", "y").agg(F.count("*").alias("n"))
    cut = base.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    cell = lambda hit, y: F.sum(F.when((F.col("p") >= F.col("threshold")) == F.lit(hit), F.when(F.col("y") == y, F.col("n")).otherwise(0)).otherwise(0))
    return cut.groupBy(*keys, "threshold").agg(cell(True, 1).alias("tp"), cell(True, 0).alias("fp"), cell(False, 1).alias("fn"), cell(False, 0).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero denominator."""
    return F.when(b != 0, a / b)


def operating_threshold(curve: DataFrame) -> DataFrame:
    """The threshold with the best balanced accuracy, then recall, specificity, nearness to one half."""
    c = {n: F.col(n) for n in ("tp", "fp", "fn", "tn")}
    scored = curve.withColumns({"recall": ratio(c["tp"], c["tp"] + c["fn"]), "specificity": ratio(c["tn"], c["tn"] + c["fp"])})
    scored = scored.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
    best = F.max_by(F.struct("threshold", "balanced_accuracy", "recall", "specificity"), F.struct(F.round("balanced_accuracy", 9), F.round("recall", 9), F.round("specificity", 9), F.round(-F.abs(F.col("threshold") - 0.5), 9), -F.col("threshold")))
    return scored.agg(best.alias("b")).select("b.*")


def recall_threshold(df: DataFrame, probability: Column, target: Column, least: float) -> DataFrame:
    """The distinct probability with the best precision (then the larger) among those with recall >= `least`.

    Counts are cumulated over ranges of the distinct probabilities, not over rows.
    """
    per = df.groupBy(probability.alias("threshold")).agg(F.sum(target.cast("long")).alias("pos"), F.count("*").alias("n"))
    total = per.agg(F.sum("pos").alias("all"))
    cum = running_totals(per, "threshold", {"tp": F.col("pos"), "taken": F.col("n")}, descending=True).crossJoin(F.broadcast(total))  # one row
    scored = cum.select("threshold", (F.col("tp") / F.col("taken")).alias("precision"), ratio(F.col("tp"), F.col("all")).alias("recall"))
    best = F.max_by(F.struct("threshold", "precision", "recall"), F.struct(F.round("precision", 9), "threshold"))
    return scored.filter(F.col("recall") >= least - 1e-12).agg(best.alias("b")).select("b.*")


def limited_threshold(rows: DataFrame, family: str, threshold: str, background: Column, recall: Column, limit: float) -> DataFrame:
    """Thresholds whose worst family keeps its mean background within `limit`; of these the best (recall, -background, -threshold)."""
    per = rows.groupBy(family, threshold).agg(F.avg(background).alias("bg"), F.avg(recall).alias("rec"))
    worst = per.groupBy(threshold).agg(F.max("bg").alias("worst_background"), F.avg("rec").alias("mean_recall")).filter(F.col("worst_background") <= limit)
    key = F.struct(F.round("mean_recall", 9), F.round(-F.col("worst_background"), 9), -F.col(threshold))
    return worst.agg(F.max_by(F.struct(threshold, "worst_background", "mean_recall"), key).alias("b")).select("b.*")


def buckets_without_replacement(df: DataFrame, id_: str, buckets: Sequence[tuple[str, Column, Sequence[Column], int]]) -> DataFrame:
    """Rows picked by ordered buckets (name, condition, order, k): each bucket takes its first k rows that no earlier bucket took.

    A bucket may lose at most as many of its best rows as the earlier ones took, so it is enough to look at
    its first (k + all earlier k) rows; the choice among these few rows is one small aggregation.
    """
    taken, parts = 0, []
    for place, (name, cond, order, k) in enumerate(buckets):
        best = df.filter(cond).orderBy(*order, id_).limit(k + taken)
        numbered = best.withColumn("_at", F.row_number().over(W.orderBy(*order, id_)))
        parts.append(numbered.select(F.col(id_).alias("id"), F.lit(place).alias("place"), "_at", F.lit(name).alias("bucket"), F.lit(k).alias("k")))
        taken += k
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ordered = F.array_sort(F.collect_list(F.struct("place", F.col("_at").alias("at"), "id", "bucket", "k")))
    start = F.array().cast("array<struct<place:int,at:int,id:bigint,bucket:string,k:int>>")

    def take(done: Column, x: Column) -> Column:
        used = F.exists(done, lambda r: r["id"] == x["id"])
        full = F.size(F.filter(done, lambda r: r["place"] == x["place"])) >= x["k"]
        one = F.struct(x["place"].alias("place"), x["at"].alias("at"), x["id"].cast("bigint").alias("id"), x["bucket"].alias("bucket"), x["k"].alias("k"))
        return F.when(used | full, done).otherwise(F.concat(done, F.array(one)))

    picked = out.agg(F.aggregate(ordered, start, take).alias("p")).select(F.posexplode("p").alias("order", "r"))
    return picked.select((F.col("order") + 1).alias("order"), F.col("r.id").alias(id_), "r.bucket")


def weighted_repeats(df: DataFrame, order: str, weight: float) -> DataFrame:
    """Each row floor(weight) times, and once more the first ceil(n * rest) by `order`, a unique numeric column; copy numbers them."""
    whole = int(weight)
    extra = math.ceil(df.count() * (weight - whole) - 1e-9)
    times = F.lit(whole) + (F.col("_at") <= extra).cast("int")
    return numbered(df, order, "_at").withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).drop("_at")


def first_share(df: DataFrame, group: str, order: Sequence[str], share: float) -> DataFrame:
    """The first ceil(n * share) rows of each group by `order`, with their place as `rank` and the group's size as `available`.

    A group is ranked in one task, as any window does: meant for groups that no single one of dominates the table.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("available"))
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.join(sizes, group).filter(F.col("rank") <= F.ceil(F.col("available") * share - 1e-9))


def review_queue(df: DataFrame, id_: str, image: str, probability: str, wrong: Column, missing: Column, severe: Column, cluster: str, most_sure: int = 18, most_near: int = 10, middle: float = 0.5) -> DataFrame:
    """(id, image, review_bucket, review_priority, cluster, cluster_size): cases to look at, from five buckets, each with its own range of priorities.

    From 10: the surest wrong case of each cluster, by cluster; from 100 the surest wrong cases, from 200 those nearest the middle; from 300 all missing ones, from 400 all severe ones, by id. A
    case may be in several buckets, an image once a bucket: its first row stays. `id_` is numeric and tells rows apart; ties go by it. Large buckets are numbered on two levels, small ones
    after a top-k; null flags are false.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    rows = df.select(id_, image, F.col(probability).cast("double").alias("_p"), F.col(cluster).cast("int").alias("cluster"), true(wrong).alias("_wrong"), true(missing).alias("_missing"), true(severe).alias("_severe"))
    off = rows.filter("_wrong")
    sure, near = [F.desc("_p"), F.col(id_)], [F.abs(F.col("_p") - middle), F.col(id_)]
    heads = off.groupBy("cluster").agg(F.min_by(F.struct(id_, image), F.struct(-F.col("_p"), id_)).alias("_h"), F.count("*").alias("cluster_size"))
    none = F.lit(None)

    def out(rows: DataFrame, name: str, priority: Column, cluster: Column, size: Column) -> DataFrame:
        return rows.select(id_, image, F.lit(name).alias("review_bucket"), priority.cast("long").alias("review_priority"), cluster.cast("int").alias("cluster"), size.cast("long").alias("cluster_size"))

    def ranked(order: list[Column], k: int, name: str, start: int) -> DataFrame:
        return out(off.orderBy(*order).limit(k), name, F.row_number().over(W.orderBy(*order)) - 1 + start, F.col("cluster"), none)  # a few rows

    def counted(flag: str, name: str, start: int) -> DataFrame:
        return out(numbered(rows.filter(flag), id_, "_n"), name, F.col("_n") - 1 + start, none, none)

    queue = out(heads.select("_h.*", "cluster", "cluster_size"), "cluster_representative_false_positive", F.col("cluster") + 10, F.col("cluster"), F.col("cluster_size"))
    for part in (ranked(sure, most_sure, "highest_confidence_false_positive", 100), ranked(near, most_near, "threshold_boundary_false_positive", 200), counted("_missing", "segmentation_miss", 300), counted("_severe", "human_severe_reference", 400)):
        queue = queue.unionByName(part)
    first = F.min_by(F.struct(id_, "review_priority", "cluster", "cluster_size"), F.struct("review_priority", id_)).alias("_f")
    return queue.groupBy(image, "review_bucket").agg(first).select("_f." + id_, image, "review_bucket", "_f.review_priority", "_f.cluster", "_f.cluster_size")
