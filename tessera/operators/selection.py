"""Features chosen inside folds, from counts, sums and squares by class; class probabilities over preset classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scaled features are cut to this many deviations.
CLIP = 20.0


def class_sums(df: DataFrame, features: Sequence[str], fold: str, target: str) -> DataFrame:
    """(fold, class, feature, n, s, q): count, sum and sum of squares. One aggregation, combined in tasks; rows with a null fold, class or value don't count."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in features))).alias("_p")
    x = F.col("_p.x")
    long = df.select(F.col(fold).cast("int").alias("fold"), F.col(target).alias("class"), pairs).filter("fold is not null and class is not null and _p.x is not null and not isnan(_p.x)")
    return long.groupBy("fold", "class", F.col("_p.feature").alias("feature")).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))


def fold_scores(df: DataFrame, features: Sequence[str], fold: str, target: str) -> DataFrame:
    """(fold, feature, f_score, variance) of each fold's training rows, all rows outside it.

    f_score is that of a one-way analysis of variance by class, null for a feature that doesn't vary inside classes or with one class only; variance is the
    population's. Every training set is the total less the fold, so rows are read once.
    """
    sums = class_sums(df, features, fold, target)
    total = sums.groupBy("class", "feature").agg(*(F.sum(c).alias(f"_{c}") for c in "nsq"))
    held = sums.select("fold").distinct()
    train = held.crossJoin(total).join(sums, ["fold", "class", "feature"], "left")  # a row a fold, class and feature
    train = train.select("fold", "feature", *((F.col(f"_{c}") - F.coalesce(c, F.lit(0.0))).alias(c) for c in "nsq")).filter("n > 0.5")
    per = train.groupBy("fold", "feature").agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    n, c, s, q, b = (F.col(x) for x in "ncsqb")
    score = F.when((c > 1) & (n > c) & (q - b > 1e-9 * q), (b - s * s / n) / (c - 1) / ((q - b) / (n - c)))
    return per.select("fold", "feature", score.alias("f_score"), F.greatest(F.lit(0.0), q / n - s * s / n / n).alias("variance"))


def chosen(scores: DataFrame, by: str, columns: int, name: str) -> DataFrame:
    """`scores` plus boolean `name`: whether a feature is among its fold's `columns` greatest by `by`; null is least, ties go by name."""
    place = F.row_number().over(W.partitionBy("fold").orderBy(F.col(by).desc_nulls_last(), "feature"))  # over a row a feature
    return scores.withColumn(name, place <= columns)


def selected_out_of_fold(df: DataFrame, features: Sequence[str], fold: str, target: str, classes: Sequence[int], columns: int, by: str = "f_score", strength: float = 1.0, balanced: bool = True) -> DataFrame:
    """`df` plus probabilities array<double>, one a preset class, and predicted, the likeliest class, by a multinomial logistic model of the other folds.

    Each fold's training rows choose their `columns` features by F score or variance, scale and clip them. A class that the training rows lack has probability 0; with one class it
    has 1; without training rows both are null. Rows with a missing fold, class or value teach nothing and a missing value is the training mean. One fit a fold.
    """
    keep = chosen(fold_scores(df, features, fold, target), by, columns, "_keep").filter("_keep")
    names: dict[int, list[str]] = {}
    for row in keep.orderBy("fold", "feature").collect():  # some names a fold
        names.setdefault(row["fold"], []).append(row["feature"])
    counts = df.filter(F.col(fold).isNotNull() & F.col(target).isin(*classes)).groupBy(F.col(fold).cast("int").alias("f"), F.col(target).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()  # a row a fold and class
    clean = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    rows, parts = df.withColumns({"_f": F.col(fold).cast("int"), "_y": F.col(target).cast("int")}), []
    for k in sorted({r["f"] for r in counts} | set(names)):
        n = {c: sum(r["n"] for r in counts if r["f"] != k and r["y"] == c) for c in classes}
        present = [c for c in classes if n[c]]
        test = rows.filter(F.col("_f") == k)
        if len(present) < 2:
            one = F.array(*(F.lit(float(c in present)) for c in classes)) if present else F.lit(None).cast("array<double>")
            parts.append(test.withColumn("probabilities", one))
            continue
        train = rows.filter((F.col("_f") != k) & F.col("_y").isin(*present))
        means = train.agg(*(F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(names[k]))).first()
        filled = array_to_vector(F.array(*(F.coalesce(clean(c), F.lit(float(means[i] or 0.0))) for i, c in enumerate(names[k]))))
        whole = F.lit(True)
        for c in names[k]:
            whole = whole & clean(c).isNotNull()
        scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(train.filter(whole).withColumn("_v", filled))
        cut = array_to_vector(F.transform(vector_to_array("_z"), lambda z: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))))
        ready = lambda d: scaler.transform(d.withColumn("_v", filled)).withColumn("_x", cut)  # noqa: B023, E731
        dense = F.array_position(F.array(*map(F.lit, present)), F.col("_y")).cast("double") - 1
        size = sum(n.values())
        weight = F.element_at(F.create_map(*(x for c in present for x in (F.lit(c), F.lit(size / (len(present) * n[c]) if balanced else 1.0)))), F.col("_y"))
        model = LogisticRegression(featuresCol="_x", labelCol="_t", weightCol="_w", family="multinomial", regParam=strength / size, standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred")
        fitted = model.fit(ready(train.filter(whole)).withColumns({"_t": dense, "_w": weight}))
        aligned = F.array(*(F.col("_pa")[present.index(c)] if c in present else F.lit(0.0) for c in classes))
        parts.append(fitted.transform(ready(test)).withColumn("_pa", vector_to_array("_p")).withColumn("probabilities", aligned).drop("_v", "_z", "_x", "_p", "_raw", "_pred", "_pa"))
    out = rows.limit(0).withColumn("probabilities", F.lit(None).cast("array<double>"))
    for part in parts:
        out = out.unionByName(part)
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position("probabilities", F.array_max("probabilities")).cast("int"))
    return out.withColumn("predicted", F.when(F.col("probabilities").isNotNull(), best)).drop("_f", "_y")
