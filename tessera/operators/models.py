"""Out-of-fold models on MLlib: ridge, logistic, clustering, principal components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.contracts import ContractError
from tessera.operators.rank import recall_threshold


def as_vectors(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def _scaled(train: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with features standardised by the training rows alone."""
    model = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    return model.transform(train), model.transform(other)


def ridge_out_of_fold(df: DataFrame, fold: str, target: str, folds: int, strength: float = 1.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """`df` (features, fold, target) plus prediction by a ridge model of the other folds, clipped to [low, high]. One fit a fold."""
    parts = []
    for k in range(folds):
        train, test = _scaled(df.filter(F.col(fold) != k), df.filter(F.col(fold) == k))
        # the mean loss divides the usual penalty by the number of rows
        rows = train.count()
        model = LinearRegression(featuresCol="scaled", labelCol=target, regParam=strength / max(1, rows), elasticNetParam=0.0, standardization=False)
        parts.append(model.fit(train).transform(test).drop("scaled"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    p = F.col("prediction")
    if low is not None:
        p = F.greatest(p, F.lit(low))
    if high is not None:
        p = F.least(p, F.lit(high))
    return out.withColumn("prediction", p)


def logistic_out_of_fold(df: DataFrame, fold: str, target: str, folds: int, strength: float = 1.0) -> DataFrame:
    """`df` (features, fold, target 0/1) plus probability by a class-balanced logistic model of the other folds; their constant where they have one class."""
    parts = []
    for k in range(folds):
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        counts = {r[target]: r["n"] for r in train.groupBy(target).agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            parts.append(test.withColumn("probability", F.lit(float(next(iter(counts), 0)))))
            continue
        n = sum(counts.values())
        weight = F.when(F.col(target) == 1, n / (2 * counts.get(1, n))).otherwise(n / (2 * counts.get(0, n)))
        train, test = _scaled(train.withColumn("_w", weight), test)
        model = LogisticRegression(featuresCol="scaled", labelCol=target, weightCol="_w", regParam=strength / n, standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred")
        parts.append(model.fit(train).transform(test).withColumn("probability", vector_to_array("_p")[1]).drop("scaled", "_p", "_raw", "_pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cluster(df: DataFrame, counts: list[int], seed: int = 0) -> DataFrame:
    """`df` plus kmeans and gmm labels; the number of clusters has the best silhouette, the smaller of equals."""
    judge, best = ClusteringEvaluator(predictionCol="kmeans"), None
    for k in sorted(counts):
        model = KMeans(k=k, seed=seed, predictionCol="kmeans").fit(df)
        value = judge.evaluate(model.transform(df))
        if best is None or value > best[0] + 1e-12:
            best = (value, k, model)
    _, k, model = best
    return GaussianMixture(k=k, seed=seed, predictionCol="gmm", probabilityCol="_gp").fit(df).transform(model.transform(df)).drop("_gp")


def principal_components(df: DataFrame, k: int) -> DataFrame:
    """`df` plus pca array<double>: the first k components of the standardised features, each with its largest loading positive."""
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(df).transform(df)
    model = PCA(k=k, inputCol="scaled", outputCol="_pca").fit(scaled)
    loadings = model.pc.toArray()
    signs = [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in loadings.T]
    return model.transform(scaled).withColumn("pca", F.zip_with(vector_to_array("_pca"), F.array(*map(F.lit, signs)), lambda a, s: a * s)).drop("scaled", "_pca")


def cumulative_thresholds(df: DataFrame, fold: str, score: str, cuts: list[float], folds: int) -> DataFrame:
    """`df` plus p array<double>: out-of-fold probabilities that the score exceeds each cut."""
    out = df.withColumn("p", F.array().cast("array<double>"))
    for cut in cuts:
        out = logistic_out_of_fold(out.withColumn("_y", (F.col(score) > cut).cast("int")), fold, "_y", folds).withColumn("p", F.concat("p", F.array("probability"))).drop("_y", "probability")
    return out


def contributions(df: DataFrame, target: str, names: list[str], top: int = 3) -> DataFrame:
    """`df` (features) plus the names of the `top` features with the largest positive and negative share z * coefficient of a logistic model."""
    scaled, _ = _scaled(df, df)
    model = LogisticRegression(featuresCol="scaled", labelCol=target, regParam=0.01, standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred").fit(scaled)
    parts = F.zip_with(vector_to_array("scaled"), F.array(*(F.lit(float(c)) for c in model.coefficients)), lambda z, c: z * c)
    named = F.zip_with(parts, F.array(*map(F.lit, names)), lambda v, n: F.struct(F.round(v, 6).alias("v"), n.alias("n")))
    out = scaled.withColumn("_s", F.array_sort(named)).drop("scaled")
    say = lambda rows: F.array_join(F.transform(rows, lambda r: r["n"]), "|")
    return out.withColumns({
        "negative": say(F.slice(F.filter("_s", lambda r: r["v"] < 0), 1, top)), "positive": say(F.slice(F.reverse(F.filter("_s", lambda r: r["v"] > 0)), 1, top)),
    }).drop("_s")


def recall_targeted(df: DataFrame, fold: str, target: str, folds: int, recall: float) -> DataFrame:
    """`df` plus probability out of fold, threshold and predicted: each fold is cut where the other folds' probabilities reach the recall with the best precision; 0.5 where none does."""
    scored = logistic_out_of_fold(df, fold, target, folds)
    cuts = None
    for k in range(folds):
        one = recall_threshold(scored.filter(F.col(fold) != k), F.col("probability"), F.col(target), recall).select(F.lit(k).alias("_fold"), "threshold")
        cuts = one if cuts is None else cuts.unionByName(one)
    out = scored.join(F.broadcast(cuts), F.col(fold) == F.col("_fold"), "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))  # a row a fold
    return out.withColumn("predicted", (F.col("probability") >= F.col("threshold")).cast("int")).drop("_fold")


def multinomial_out_of_fold(df: DataFrame, fold: str, target: str, folds: int, strength: float = 1.0) -> DataFrame:
    """`df` (features, fold, target from 0) plus predicted class by a multinomial logistic model of the other folds; their class where they have one."""
    parts = []
    for k in range(folds):
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        counts = {r[target]: r["n"] for r in train.groupBy(target).agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            parts.append(test.withColumn("predicted", F.lit(next(iter(counts), None)).cast("int")))
            continue
        train, test = _scaled(train, test)
        model = LogisticRegression(featuresCol="scaled", labelCol=target, family="multinomial", regParam=strength / sum(counts.values()), standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred")
        parts.append(model.fit(train).transform(test).withColumn("predicted", F.col("_pred").cast("int")).drop("scaled", "_p", "_raw", "_pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_fitted(model: PipelineModel, path: str, features: Sequence[str], **contract: str) -> None:
    """A fitted pipeline and, written last, what it was fitted on: its columns in order and any further facts, such as the fold."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(list(features), contract)], "features array<string>, contract map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/contract")


def load_fitted(path: str, features: Sequence[str], **contract: str) -> PipelineModel:
    """The pipeline again; other columns, another order or another fact than those it was saved with are an error."""
    saved = SparkSession.active().read.schema("features array<string>, contract map<string,string>").json(f"{path}/contract").first()
    if saved is None or list(saved["features"]) != list(features):
        raise ContractError(f"the model takes {', '.join(saved['features'] if saved else ())}")
    wrong = {k: v for k, v in contract.items() if (saved["contract"] or {}).get(k) != v}
    if wrong:
        raise ContractError(f"the model was saved with {saved['contract']}, not {wrong}")
    return PipelineModel.load(f"{path}/model")


def balanced_logistic(df: DataFrame, features: Sequence[str], target: str, strength: float = 1.0) -> PipelineModel:
    """Columns gathered, scaled and fed to a class-balanced logistic model, fitted as one pipeline; prediction columns are probability and predicted."""
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}  # a row a class
    n = sum(counts.values())
    weight = F.element_at(F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.lit(n / (len(counts) * v))))), F.col(target))
    steps = [
        VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="error"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_z", labelCol=target, weightCol="_w", regParam=strength / n, standardization=False, probabilityCol="probability", rawPredictionCol="_raw", predictionCol="predicted"),
    ]
    return Pipeline(stages=steps).fit(df.withColumn("_w", weight))
