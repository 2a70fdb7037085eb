"""The corpus pipeline: quality classifier, line dedup, near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet to the
shared folder and hands it on. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import digests, tokenized
from tessera.llm.common import Saved
from tessera.llm.line_dedup import deduplicate_lines
from tessera.llm.mixing import mix, names, size_of, weighed
from tessera.llm.near_dedup import deduplicated
from tessera.llm.quality import judge
from tessera.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """COLUMNS, and any further columns as one struct: their names can't clash with an operator's."""
    more = [c for c in docs.columns if c not in COLUMNS]
    return docs.select(*COLUMNS, *([F.struct(*(F.col(f"`{c}`") for c in more)).alias("extras")] if more else []))


def _unpacked(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, in its order."""
    return kept.select(*(F.col(c) if c in COLUMNS else F.col("extras")[c].alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, null and empty texts among them. Repeated rows are judged alike; a null doc_id or lang is a value of its own; no documents give none."""
    return _unpacked(judge(_packed(docs), _labels(spark, sf_dir)).filter("keep"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all it has goes with them. n_chars is counted anew, null for a null text.

    The first document by doc_id keeps a line, null ids come last, and rows equal in doc_id and text lose the same lines.
    """
    cut = deduplicate_lines(_packed(docs))
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    kept = cut.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long"))
    return _unpacked(kept, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, one with the smallest doc_id, null last; rows equal in doc_id and text count as one. Null and wordless texts are only like equal ones."""
    return _unpacked(deduplicated(_packed(docs)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those without words, null texts among them, and those beyond the budget, not at all.

    Equal keys go by doc_id, null last, then size; a missing doc_id draws by its text; null is a source of its own.
    """
    sized = names(_packed(docs).withColumn("size", size_of(F.col("text"))))
    mixed = mix(weighed(sized, _labels(spark, sf_dir)))
    return _unpacked(mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of what they decode to. A null text is empty and has no ids; repeated rows are encoded alike."""
    return digests(tokenized(docs.select("doc_id", "source", "text")), "source", "token_ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: No SQL trains the classifier; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    ship_package(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            now = Saved(docs, f"stage{k}")
            if before:
                before.drop()  # the last result reads only its own input
            before, docs = now, now.df
    return docs
