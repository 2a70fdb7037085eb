"""Screens of ridge candidates from additive sums: one aggregation serves every candidate, strength, fold and held-out source.

The products of all pairs of columns (a constant one, the features, the target) add up over rows. Summed by fold and source they
give every training set as a sum of parts, every candidate as a part of the matrix and source indicators as further blocks, so that
nothing but small systems of equations is left to solve. Columns are taken around their means, which keeps the sums exact enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sums by fold and source that the driver solves from; more is an error, see held_out_sources for sources without bound.
MOST_BLOCKS = 2000
#: Bytes of sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20
#: Variances below this share of 1 + the mean's square count as none.
FLAT = 1e-12

POOLED, INDICATORS, CALIBRATED = "pooled", "source_indicator", "within_source_calibration"


@dataclass(frozen=True)
class Candidate:
    """A ridge model of standardised columns. sources: pooled, source_indicator (a column a source of the training rows) or
    within_source_calibration (the mean training residual of a row's source is added). Without columns it is the mean."""

    name: str
    columns: tuple[str, ...]
    strength: float = 1.0
    sources: str = POOLED


def centres(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """The mean of each column; 0 without finite values."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    row = df.agg(*(F.avg(finite(c)).alias(f"_{k}") for k, c in enumerate(columns))).first()
    return [float(v or 0.0) for v in row]


def product_sums(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str], around: Sequence[float]) -> DataFrame:
    """(by, i, j, total) with i <= j: sums of products of the columns 0 (one), 1.. (features), last (target), each less its value in `around`.

    Rows with a null or non-finite feature or target don't count. Tasks add their rows up in numpy and hand on one matrix a
    combination of `by`, so a hot one costs a matrix a task.
    """
    columns, width = [*features, target], len(features) + 2
    upper = np.triu_indices(width)
    typed = df.select(*by, *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)))
    types = [typed.schema[c].dataType for c in by]
    schema = T.StructType([*(T.StructField(c, t) for c, t in zip(by, types, strict=True)), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("total", T.DoubleType())])
    shift = np.array(around, float)

    def batch_of(sums: dict[tuple, np.ndarray], fields: list[pa.Field]) -> pa.RecordBatch:
        keys, m = list(sums), len(upper[0])
        out = [pa.array([key[k] for key in keys for _ in range(m)], f.type) for k, f in enumerate(fields)]
        out += [pa.array(np.tile(side.astype(np.int32), len(keys))) for side in upper] + [pa.array(np.concatenate([sums[key][upper] for key in keys]))]
        return pa.RecordBatch.from_arrays(out, names=[*by, "i", "j", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        fields: list[pa.Field] = []
        for batch in batches:
            fields = [batch.schema.field(c) for c in by]
            x = np.column_stack([batch.column(f"_x{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))]) - shift
            good = np.isfinite(x).all(1)
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * len(x)
            numbers: dict[tuple, int] = {}
            codes = np.fromiter((numbers.setdefault(key, len(numbers)) for key in keys), np.int64, len(keys))
            for key, number in numbers.items():
                part = x[good & (codes == number)]
                rows = np.column_stack([np.ones(len(part)), part])
                sums[key] = sums.get(key, 0.0) + rows.T @ rows
            if len(sums) * width * width * 8 > HELD_BYTES:
                yield batch_of(sums, fields)
                sums = {}
        if sums:
            yield batch_of(sums, fields)

    return typed.mapInArrow(add, schema).groupBy(*by, "i", "j").agg(F.sum("total").alias("total"))


def _matrices(sums: DataFrame, by: Sequence[str], width: int) -> dict[tuple, np.ndarray]:
    """The sums as symmetric matrices on the driver: a matrix a combination, of a bounded number."""
    packed = sums.groupBy(*by).agg(F.collect_list(F.struct("i", "j", "total")).alias("entries")).limit(MOST_BLOCKS + 1).collect()
    if len(packed) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} combinations of {', '.join(by)}")
    return {tuple(row[:-1]): symmetric(row["entries"], width) for row in packed}


def symmetric(entries: Sequence, width: int) -> np.ndarray:
    """A matrix from its upper half, entries with i, j and total."""
    out = np.zeros((width, width))
    for e in entries:
        out[e["i"], e["j"]] = out[e["j"], e["i"]] = e["total"]
    return out


def solve_ridge(products: np.ndarray, columns: Sequence[int], strength: float) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a ridge model with standardised columns, from sums of products whose first column is the constant and last the target.

    Deviations are those of the population; a constant column has weight 0. NaN without rows.
    """
    n = products[0, 0]
    if n < 0.5:
        return float("nan"), np.full(len(columns), np.nan)
    at = list(columns)
    mean, centre = products[0, at] / n, products[0, -1] / n
    spread = products[np.ix_(at, at)] / n - np.outer(mean, mean)
    variance = np.clip(np.diag(spread), 0, None)
    flat = variance <= FLAT * (1 + mean**2)
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance)))
    left = n * spread / np.outer(scale, scale) + strength * np.eye(len(at))
    right = n * (products[at, -1] / n - mean * centre) / scale
    left[flat], left[:, flat], right[flat] = 0.0, 0.0, 0.0
    weights = np.linalg.lstsq(left, right, rcond=None)[0] / scale if len(at) else np.zeros(0)
    return float(centre - weights @ mean), weights


def _with_indicators(by_source: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, list[str]]:
    """Sums of products with a column a source put before the target."""
    names = sorted(s for s, m in by_source.items() if s and m[0, 0] > 0.5)
    total = sum(by_source.values(), np.zeros((width, width)))
    keep = [*range(width - 1), *range(width, width + len(names)), width - 1]
    out = np.zeros((width + len(names),) * 2)
    out[:width, :width] = total
    for k, name in enumerate(names, width):
        out[k, :width] = out[:width, k] = by_source[name][0]
        out[k, k] = by_source[name][0, 0]
    return out[np.ix_(keep, keep)], names


@dataclass(frozen=True)
class Fitted:
    """What a candidate learnt from one training set: prediction = intercept + weights of columns + offset of the row's source."""

    intercept: float
    weights: dict[str, float]
    offsets: dict[str, float]


def fit_candidate(candidate: Candidate, by_source: dict[str, np.ndarray], features: Sequence[str], around: Sequence[float]) -> Fitted:
    """The candidate on the rows whose sums are given by source ('' for none)."""
    width = len(features) + 2
    places = [1 + features.index(c) for c in candidate.columns]
    total = sum(by_source.values(), np.zeros((width, width)))
    offsets: dict[str, float] = {}
    if candidate.sources == INDICATORS:
        products, names = _with_indicators(by_source, width)
        intercept, weights = solve_ridge(products, [*places, *range(width - 1, width - 1 + len(names))], candidate.strength)
        offsets = dict(zip(names, map(float, weights[len(places) :]), strict=True))
        weights = weights[: len(places)]
    else:
        intercept, weights = solve_ridge(total, places, candidate.strength)
    if candidate.sources == CALIBRATED:
        for name, m in by_source.items():
            if m[0, 0] > 0.5:
                offsets[name] = float((m[0, -1] - weights @ m[0, places]) / m[0, 0] - intercept)
    shift = around[-1] + intercept - float(weights @ np.array([around[p - 1] for p in places]))
    return Fitted(shift, dict(zip(candidate.columns, map(float, weights), strict=True)), offsets)


def fit_folds(df: DataFrame, candidates: Sequence[Candidate], fold: str, target: str, source: str | None = None) -> dict[tuple[int | None, str], Fitted]:
    """{(fold, candidate): what it learnt of all other folds}; fold None: of all rows. One aggregation, however many candidates."""
    features = sorted({c for x in candidates for c in x.columns})
    rows = df.withColumns({"_fold": F.col(fold).cast("int"), "_source": F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")})
    around, width = centres(rows, [*features, target]), len(features) + 2
    blocks = _matrices(product_sums(rows.filter("_fold is not null"), features, target, ["_fold", "_source"], around), ["_fold", "_source"], width)
    out = {}
    for held in [None, *sorted({k for k, _ in blocks})]:
        part: dict[str, np.ndarray] = {}
        for (k, s), m in blocks.items():
            if k != held:
                part[s] = part.get(s, 0.0) + m
        for c in candidates:
            out[held, c.name] = fit_candidate(c, part, features, around)
    return out


_MODEL = pa.struct([("intercept", pa.float64()), ("weights", pa.list_(pa.float64())), ("offsets", pa.map_(pa.string(), pa.float64()))])


def _models_by_fold(df: DataFrame, learnt: dict[tuple[int | None, str], Fitted], candidates: Sequence[Candidate], features: Sequence[str], name: str) -> DataFrame:
    """(_k, name): the candidates' models as one array a fold; null for all rows. Bounded: folds times candidates times columns and sources."""
    rows: dict[int | None, list[dict]] = {}
    for held in dict.fromkeys(k for k, _ in learnt):
        models = (learnt[held, c.name] for c in candidates)
        rows[held] = [{"intercept": m.intercept, "weights": [m.weights.get(c, 0.0) for c in features], "offsets": sorted(m.offsets.items())} for m in models]
    return df.sparkSession.createDataFrame(pa.table({"_k": pa.array(list(rows), pa.int32()), name: pa.array(list(rows.values()), pa.list_(_MODEL))}))


def screen(df: DataFrame, candidates: Sequence[Candidate], fold: str, target: str, source: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """`df` plus out_of_fold and apparent, arrays of a prediction a candidate: by the other folds, and by all rows; clipped to [low, high].

    Folds should keep a group's rows together. Rows with a null or non-finite column, target or fold teach nothing; a prediction is null where a
    column that it weighs is, and NaN where nothing could be learnt. Existing columns of these two names are replaced. Work on the rows is one aggregation and one
    projection beside a broadcast row a fold; candidates only add small systems of equations.
    """
    features = sorted({c for x in candidates for c in x.columns})
    learnt = fit_folds(df, candidates, fold, target, source)
    models = _models_by_fold(df, learnt, candidates, features, "_held")
    every = models.filter("_k is null").select(F.col("_held").alias("_all"))  # a row
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in features)).cast("array<double>")
    name = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    rows = df.withColumns({"_fold": F.col(fold).cast("int"), "_x": values, "_s": name}).join(F.broadcast(models.filter("_k is not null")), F.col("_fold") == F.col("_k"), "left").crossJoin(F.broadcast(every))

    def by(models: str) -> Column:
        weigh = lambda x, w: F.when(w == 0, F.lit(0.0)).otherwise(x * w)
        raw = F.transform(models, lambda m: m["intercept"] + F.aggregate(F.zip_with("_x", m["weights"], weigh), F.lit(0.0), lambda t, v: t + v) + F.coalesce(m["offsets"][F.col("_s")], F.lit(0.0)))
        clip = lambda p: F.least(F.greatest(p, F.lit(float("-inf" if low is None else low))), F.lit(float("inf" if high is None else high)))
        return F.transform(raw, lambda p: F.when(p.isNull() | F.isnan(p), p).otherwise(clip(p)))

    return rows.withColumns({"out_of_fold": by("_held"), "apparent": by("_all")}).drop("_fold", "_x", "_s", "_k", "_held", "_all")


def screen_metrics(screened: DataFrame, candidates: Sequence[Candidate], target: str, predictions: str = "out_of_fold") -> DataFrame:
    """(candidate, columns, rows, mae, rmse, bias, chosen): errors of each candidate over rows with a finite prediction; the smallest MAE to nine places is chosen, then the first name."""
    long = screened.select(F.col(target).cast("double").alias("_y"), F.posexplode(predictions).alias("_k", "_p")).filter("_p is not null and not isnan(_p) and _y is not null")
    off = F.col("_p") - F.col("_y")
    per = long.groupBy("_k").agg(F.count("*").alias("rows"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("bias"))
    names = F.array(*(F.lit(c.name) for c in candidates))
    per = per.select(names[F.col("_k")].alias("candidate"), F.array(*(F.lit(len(c.columns)) for c in candidates))[F.col("_k")].alias("columns"), "rows", "mae", "rmse", "bias")
    best = per.agg(F.min_by("candidate", F.struct(F.round("mae", 9), "candidate")).alias("_best"))  # a row
    return per.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("candidate") == F.col("_best")).drop("_best")


def held_out_sources(df: DataFrame, features: Sequence[str], target: str, source: str, strength: float = 1.0, least: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """(source, status, train_rows, test_rows, mae): each source predicted by a ridge model of all others, clipped to [low, high].

    Every source has a row: `estimated`, or `not_estimable_small_row_count` with a null mae where it or the rest has fewer than `least` rows,
    or all are `not_estimable_single_source`. Models are solved in tasks from each source's sums and the total's, so sources are unbounded; null sources are one source.
    """
    features = list(features)
    width, named = len(features) + 2, df.withColumn("_source", F.col(source).cast("string"))
    around = centres(named, [*features, target])
    sums = product_sums(named, features, target, ["_source"], around)
    total = sums.groupBy("i", "j").agg(F.sum("total").alias("total")).agg(F.collect_list(F.struct("i", "j", "total")).alias("all"))  # a matrix
    per = sums.groupBy("_source").agg(F.collect_list(F.struct("i", "j", "total")).alias("own"))
    shift = np.array(around)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, every in zip(batch.column("own").to_pylist(), batch.column("all").to_pylist(), strict=True):
                mine = symmetric(own, width)
                rest = symmetric(every, width) - mine
                intercept, weights = solve_ridge(rest, range(1, width - 1), strength)
                rows.append((round(rest[0, 0]), round(mine[0, 0]), float(shift[-1] + intercept - weights @ shift[:-1]), weights.tolist()))
            columns = [batch.column("_source"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))))]
            yield pa.RecordBatch.from_arrays(columns, names=["_source", "train_rows", "test_rows", "intercept", "weights"])

    models = per.crossJoin(F.broadcast(total)).mapInArrow(solve, "_source string, train_rows long, test_rows long, intercept double, weights array<double>")
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in features))
    rows = named.select("_source", F.col(target).cast("double").alias("_y"), values.alias("_x")).join(models.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    p = F.col("intercept") + F.aggregate(F.arrays_zip("_x", "weights"), F.lit(0.0), lambda t, z: t + z["_x"] * z["weights"])
    p = F.greatest(p, F.lit(float(low))) if low is not None else p
    p = F.least(p, F.lit(float(high))) if high is not None else p
    off = F.abs(p - F.col("_y"))
    counted = lambda c: F.coalesce(F.max(c), F.lit(0)).alias(c)
    found = rows.groupBy("_source").agg(F.max("train_rows").alias("train_rows"), counted("test_rows"), F.avg(F.when(~F.isnan(off), off)).alias("mae"))
    status = F.when(F.col("train_rows") == 0, "not_estimable_single_source").when((F.col("train_rows") < least) | (F.col("test_rows") < least), "not_estimable_small_row_count").otherwise("estimated")
    return found.select(F.col("_source").cast(df.schema[source].dataType).alias(source), status.alias("status"), "train_rows", "test_rows", F.when(status == "estimated", F.col("mae")).alias("mae"))
