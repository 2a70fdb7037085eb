"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its letter bigrams and trigrams, hashed into a
table; a linear softmax on it gives the language. Both are trained by stochastic gradient descent
in numpy on a bounded sample. A temperature is fitted on held-back documents, and below a
confidence fitted on them a prediction counts as rejected. At prediction, embedding and output layer fold
into one table of logits a bucket, so a text costs one lookup a subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean_batches

#: Bound of the training sample: about so many documents a language.
PER_LANGUAGE = 600
BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 16, 6, 20.0
#: Share of accepted predictions that must be right on the held-back documents.
PRECISION = 0.99
CHUNK_CHARS = 1 << 20
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def chunks(texts, chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Whole texts in runs of about `chars` characters; null as empty. Ends with a run that may be empty."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1]) + 1
        if size >= chars:
            yield run
            run, size = [], 0
    yield run


def arrow_chunks(column: pa.Array, chars: int, rows: int = 256) -> Iterator[list[str]]:
    """Whole texts of an Arrow column in runs of about `chars` characters; only a few hundred rows are Python strings at a time."""
    for start in range(0, len(column), rows):
        yield from (run for run in chunks(column.slice(start, rows).to_pylist(), chars) if run)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by one line feed, and the start of each text."""
    joined = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return joined, np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the bigram and trigram at each position, BUCKETS where there is none; letter mask; starts)."""
    points, starts = codes([t.lower() if len(t.lower()) == len(t) else "".join(c.lower()[0] for c in t) for t in texts])
    is_letter = letters()[points]
    c = np.where(is_letter, points, 1).astype(np.uint64)
    ends = np.zeros(len(c), bool)
    ends[starts[1:] - 1] = ends[-1] = True
    out = np.full((2, len(c)), BUCKETS, np.int64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    has = (is_letter[:-1] | is_letter[1:]) & ~ends[:-1]
    out[0, :-1][has] = ((two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)[has]
    if len(c) > 2:
        three = two[:-1] * np.uint64(0xD6E8FEB86659FD93) + c[2:] * np.uint64(0xA0761D6478BD642F)
        has = has[:-1] & is_letter[1:-1] & ~ends[1:-1]
        out[1, :-2][has] = ((three ^ (three >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(np.int64)[has]
    return out, is_letter, starts


@dataclass(frozen=True)
class Model:
    """logits: of each bucket, a zero row last; score = softmax(mean logits / temperature)."""

    languages: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language index or -1, score) of each text."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0)
        buckets, is_letter, starts = subwords(texts)
        total = sum(np.add.reduceat(self.logits[b], starts, axis=0, dtype=np.float64) for b in buckets)
        count = sum(np.add.reduceat(b < BUCKETS, starts, dtype=np.int64) for b in buckets)
        known = np.add.reduceat(is_letter, starts, dtype=np.int64) > 0
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return np.where(known, p.argmax(axis=1), -1), np.where(known, p.max(axis=1), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 0) -> Model:
    """Train on parallel lists; every fifth text only calibrates. Short windows are added, so that short texts are learnt too."""
    languages = tuple(sorted(set(langs)))
    if not languages:
        return Model((), np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    examples: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
    for at, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        windows = [text]
        for size in (12, 40, 150):
            if len(text) > size:
                first = int(rng.integers(len(text) - size))
                windows.append(text[first : first + size])
        for window in windows:
            found = subwords([window])[0].ravel()
            found = found[found < BUCKETS]
            if len(found):
                ids, n = np.unique(found, return_counts=True)
                examples.append((ids, n / n.sum(), languages.index(lang), at % 5 == 4))
    embed, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(languages))), np.zeros(len(languages))
    train = [e for e in examples if not e[3]] or examples
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(train)):
            ids, share, y, _ = train[k]
            mean = share @ embed[ids]
            grad = _softmax(mean @ out + bias)
            grad[y] -= 1
            back = out @ grad
            out -= 0.01 * rate * np.outer(mean, grad)
            bias -= 0.001 * rate * grad
            embed[ids] -= rate * share[:, None] * back
    held = [e for e in examples if e[3]] or examples
    z = np.array([share @ embed[ids] @ out + bias for ids, share, _, _ in held])
    y = np.array([e[2] for e in held])
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()) if len(held) else 1.0
    p = _softmax(z / temperature) if len(held) else np.ones((1, 1))
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= PRECISION)
    accept = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return Model(languages, np.vstack([embed @ out, np.zeros((1, len(languages)))]).astype(np.float32), bias, float(temperature), accept)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def sample(labelled: DataFrame, by: str, per_class: int) -> list:
    """About `per_class` different rows of each class, by a hash of the whole row: rows that share a doc_id are drawn by themselves, and equal ones count once. At most a few times the bound reach the driver, sorted."""
    rows = {r[by]: r["n"] for r in labelled.groupBy(by).agg(F.count("*").alias("n")).collect()}
    if not rows:
        return []
    rate = F.create_map(*(F.lit(x) for value, n in rows.items() for x in (value, min(1.0, per_class / n))))
    share = (F.xxhash64(F.lit("sample"), *labelled.columns).bitwiseAND(F.lit((1 << 30) - 1))).cast("double") / float(1 << 30)
    return labelled.filter(share < rate[F.col(by)]).distinct().orderBy(*labelled.columns).collect()


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the rows of `docs` (doc_id, text, lang) whose text and lang are given, from a bounded sample of them."""
    rows = sample(docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang"), "lang", per_language)
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict_column(model: Broadcast, text: Column) -> Column:
    """struct<lang_pred, score, accepted> of whole texts; null or without a letter: `und`, 0, false."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for texts in batches:
            found = [m.predict(run) for run in chunks(texts)]
            lang, score = (np.concatenate(x) for x in zip(*found, strict=True))
            lang = np.where(lang < len(m.languages), lang, -1)
            yield pd.DataFrame({"lang_pred": names[lang], "score": score, "accepted": (lang >= 0) & (score >= m.accept)})

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, "lang_pred string, score double, accepted boolean").asNondeterministic()(text)  # evaluated once


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` plus lang_pred, score, accepted (existing columns of these names, and `_found`, are replaced). No shuffle.

    Equally likely languages: the first by name. Rows that repeat get the same answer, each by itself. Texts are read whole, however long; a null
    text has no letters and is `und`; an empty table gives no rows.
    """
    lean_batches(docs.sparkSession)
    column = predict_column(docs.sparkSession.sparkContext.broadcast(model), F.col("text"))
    out = docs.withColumn("_found", column)
    return out.withColumns({c: F.col("_found")[c] for c in ("lang_pred", "score", "accepted")}).drop("_found")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents that aren't held out; predict every whole text. accepted: the score reaches the calibrated bound."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)))
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
