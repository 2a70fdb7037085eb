"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what toxic text has besides it:
the runs of characters whose share of toxic documents is far above that of ordinary ones.
Each window of a text is compressed with the ordinary dictionary alone and with the toxic one set before it; the bytes
saved are the window's distance. A logistic calibration on held-back documents turns the savings
beyond thresholds into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean_batches, small
from tessera.llm.langid import remainder, sample

#: Bound of the training sample: about so many documents of each class, a third of which only calibrates.
PER_CLASS = 2400
#: Words in a window; characters in a run; bytes of the ordinary and the toxic dictionary; compression level.
WORDS, RUN, ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 8, 5, 32768, 4096, 6
#: A run tells toxic text if it is in so many and in this share of toxic documents, and so many times as frequent there.
LEAST_TEXTS, LEAST_SHARE, TIMES = 4, 0.004, 40.0
#: Windows of sampled ordinary text that train the ordinary dictionary at most: a part of the bounded sample of labelled rows.
ORDINARY_WINDOWS = 40_000
#: What a share of ordinary texts counted as toxic weighs against the same share of toxic texts found.
CAUTION = 3.0
#: Scores of this or more count as toxic; the calibration puts its best threshold here.
CUT = 0.7
CHUNK_CHARS = 1 << 20

_NOT_WORD = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, anything but letters and digits as single spaces."""
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def windows(text: str) -> list[bytes]:
    """WORDS words each, with a space around; a last shorter one; an empty text has one empty window."""
    words = text.split(" ")
    return [f" {' '.join(words[i : i + WORDS])} ".encode("utf-8", "replace") for i in range(0, len(words), WORDS)]


def _lengths(compressor: zstd.ZstdCompressor, data: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, compressor.multi_compress_to_buffer(data)), np.int64, len(data)) if data else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """ordinary, toxic: dictionaries; weights: of the features and a constant."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            table = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(level=LEVEL)
            made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made[0], made[1]


def features(compressors, texts: list[str]) -> np.ndarray:
    """For each normalised text: savings a window beyond 0 and 1 byte (log scale), the largest saving, the share of windows with one."""
    if not texts:
        return np.zeros((0, 5))
    each = [windows(t) for t in texts]
    flat = [w for ws in each for w in ws]
    saved = _lengths(compressors[0], flat) - _lengths(compressors[1], flat)
    counts = np.fromiter(map(len, each), np.int64, len(each))
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    over = [np.add.reduceat(np.maximum(0, saved - t), starts) for t in (0, 1)]
    return np.column_stack([
        np.log1p(100 * over[0] / (counts + 4)), np.log1p(100 * over[1] / (counts + 4)), np.minimum(12, np.maximum(0, np.maximum.reduceat(saved, starts))) / 4,
        np.add.reduceat(saved > 1, starts) / (counts + 4) * 10, np.log1p(np.add.reduceat(saved > 1, starts)),
    ])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method, classes weighed alike; the last weight is the constant's."""
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(30):
        p = _sigmoid(x1 @ w)
        grad = x1.T @ (weight * (p - y)) + 1e-2 * w
        hess = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def _trained(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """A dictionary of the samples; of too few for the trainer, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=match).as_bytes() if len(samples) > 20 else b"".join(samples)[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def _runs(text: str) -> set[str]:
    spaced = f" {text} "
    return {spaced[i : i + RUN] for i in range(len(spaced) - RUN + 1)}


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Dictionaries from two thirds of the texts, calibration on the others."""
    rng = np.random.default_rng(seed)
    texts = [normal(t) for t in texts]
    learn = [k % 3 != 2 for k in range(len(texts))]
    toxic = sorted({t for t, y, use in zip(texts, labels, learn, strict=True) if use and y == 1})
    ordinary = sorted({t for t, y, use in zip(texts, labels, learn, strict=True) if use and y == 0})
    in_toxic, in_ordinary = Counter(), Counter()
    for text in toxic:
        in_toxic.update(_runs(text))
    telling = {r for r, n in in_toxic.items() if n >= max(LEAST_TEXTS, LEAST_SHARE * len(toxic))}
    for text in ordinary:
        in_ordinary.update(_runs(text) & telling)
    telling = {r for r in telling if in_toxic[r] / len(toxic) > TIMES * (in_ordinary[r] + 0.5) / (len(ordinary) + 1)}
    samples = []
    for text in toxic:
        for word in text.split():
            spaced = f" {word} "
            hits = [i for i in range(len(spaced) - RUN + 1) if spaced[i : i + RUN] in telling]
            if hits:
                samples.append(spaced[hits[0] : hits[-1] + RUN].encode("utf-8", "replace"))
    usual = [w for t in ordinary for w in windows(t)]
    usual = [usual[k] for k in rng.permutation(len(usual))[:ORDINARY_WINDOWS]]
    once = sorted(Counter(samples).items(), key=lambda kv: (kv[1], kv[0]))
    if sum(len(x) for x, _ in once) <= TOXIC_BYTES:  # they fit as they are, the most frequent nearest
        special = b"".join(x for x, _ in once)
    else:
        special = _trained([samples[k] for k in rng.permutation(len(samples))], TOXIC_BYTES, 16, 6)
    model = Model(_trained(usual, ORDINARY_BYTES, 64, 8), special, np.zeros(6))
    held = [(t, y) for t, y, use in zip(texts, labels, learn, strict=True) if not use]
    y = np.array([v for _, v in held], float)
    if not 0 < y.sum() < len(y):
        return model
    x = features(model.compressors(), [t for t, _ in held])
    weights = _logistic(x, y)
    z = np.column_stack([x, np.ones(len(x))]) @ weights
    # the threshold with the best balance is moved to CUT; of equals, the middle
    order = np.unique(z)
    between = np.concatenate(([order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]))
    at_least = lambda v: len(v) - np.searchsorted(np.sort(v), between)
    balance = at_least(z[y == 1]) / y.sum() - CAUTION * at_least(z[y == 0]) / (1 - y).sum()
    best = between[np.flatnonzero(balance >= balance.max() - 1e-9)]
    weights[-1] += np.log(CUT / (1 - CUT)) - best[len(best) // 2]
    return Model(model.ordinary, model.toxic, weights)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of the documents that `labels` (doc_id, toxic) marks; of repeated labels the highest counts."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # the sample is drawn without the texts; only its own are fetched
    some = sample(docs.filter("text is not null").select("doc_id").join(marks, "doc_id"), "toxic", per_class)
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in some], "doc_id long, toxic int").distinct()
    texts = docs.filter("text is not null").select("doc_id", "text").join(small(ids, len(some), 16), "doc_id")
    # a text a doc_id, the smallest of several, however often it repeats
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_column(model: Broadcast, text: Column) -> Column:
    """double in (0, 1) for every whole text, null as empty."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        compressors = m.compressors()
        for texts in batches:
            out, run, chars = [], [], 0
            for k, text in enumerate(texts):
                run.append(normal(text))
                chars += len(run[-1])
                if chars >= CHUNK_CHARS or k == len(texts) - 1:
                    out.append(_sigmoid(features(compressors, run) @ m.weights[:-1] + m.weights[-1]))
                    run, chars = [], 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double").asNondeterministic()(text)  # evaluated once


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` plus score and predicted (1 if score >= CUT); existing columns of these names are replaced. No shuffle. Rows that repeat get the same score.

    Texts are scored whole, however long, a null text as an empty one; an empty table gives no rows.
    """
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("score", score_column(shared, F.col("text"))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from labelled documents that aren't held out; score every whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = train(docs.filter(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")
