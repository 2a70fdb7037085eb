"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight. Within a source the
documents are sorted by key and their sizes prefix-summed: complete epochs of the source come first,
and the rest of its token budget takes documents in key order. The prefix sum runs in two
levels, over slices of the key range and then inside a slice, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import private

#: What counts as a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
#: Rows that a slice of a source's key range holds on average at most.
SLICE_ROWS = 50_000
#: Quality weights of documents labelled 1, labelled 0, and not labelled.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.5


def size_of(text: Column) -> Column:
    """Words in `text`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row a source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the total; a target stops at
    `max_epochs` times its source's size and the excess is shared again by weight. Sorted
    by cap / weight, the capped sources are a prefix: the first source at which
    the level (rest of the total / rest of the weights) doesn't exceed cap / weight ends it.
    Works on one row a source, never on documents.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    weighed = (
        sizes.withColumn("weight", ((F.row_number().over(in_order) - 1) % 3 + 1).cast("long"))
        .withColumn("cap", F.lit(max_epochs).cast("long") * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    )
    levelled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    final = F.coalesce(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source", "level"))).over(everything)["level"], F.lit(0.0))
    return levelled.withColumn("final", final).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target")
    )


def _uniform(key: Column) -> Column:
    """In (0, 1), from the first 52 bits of the key's MD5: the same in every run."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def names(docs: DataFrame) -> DataFrame:
    """`docs` plus draw: the MD5 of the text where doc_id is missing."""
    return docs.withColumn("draw", F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("binary"))))


def mix(docs: DataFrame, slices: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`docs` (doc_id, source, size, weight > 0; more columns pass) plus source_size, target, copies, taken.

    copies: how often the mix takes the document, complete epochs included, 0 for a document without words; taken = copies * size.
    The last document of the fractional epoch is taken if at least half of it fits the budget.
    Weights must lie in [BAD, GOOD] for the slices to be even; any others stay right. Equal keys are ordered
    by doc_id, nulls last, then size; repeated rows share a fate only by their place in that order. Documents of size 0 take 0.
    Documents without doc_id draw their key from column `draw`, if there is one: as names() makes it, before texts are joined or shuffled. Slices are as many as keep SLICE_ROWS rows each.
    Existing columns with the names of results, or that begin with an underscore, are dropped. Only sizes count here, so texts may be of any length; an empty table gives no rows.
    """
    docs = docs.drop("source_size", "target", "copies", "taken", *private(docs))
    slices = slices or max(1024, -(-docs.count() // SLICE_ROWS))
    nameless = F.concat(F.lit("null"), F.coalesce("draw", F.lit(""))) if "draw" in docs.columns else F.lit("null")
    key = -F.log(_uniform(F.coalesce(F.col("doc_id").cast("string"), nameless))) / F.col("weight")
    keyed = docs.withColumn("_key", key).withColumn(
        # a monotone image of the key in [0, 1) that no weight can crowd by more than GOOD / BAD
        "_slice", F.least(F.lit(slices - 1), F.floor(F.lit(float(slices)) * (1 - F.exp(-F.lit(BAD) * F.col("_key"))))).cast("int")
    )
    # null sources meet in joins as a flag beside an empty name
    keyed = keyed.withColumns({"_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    sums = keyed.groupBy("source", "_none", "_source", "_slice").agg(F.sum("size").alias("_sum"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), max_epochs)
    targets = targets.withColumns({"_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}).drop("source")
    earlier = W.partitionBy("_none", "_source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sums.drop("source")
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
        .join(targets, ["_none", "_source"])
    )
    within = W.partitionBy("_none", "_source", "_slice").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    # which side of the join is split for a hot source is left to AQE; the window's groups are single slices
    joined = keyed.join(offsets, ["_none", "_source", "_slice"])
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - epochs * F.col("source_size")
    upto = F.col("_before") + F.sum("size").over(within)
    extra = (upto.cast("double") - F.col("size").cast("double") / 2 <= rest) & (rest > 0)
    return (
        joined.withColumn("copies", F.when(F.col("size") > 0, epochs + F.when(extra, 1).otherwise(0)).otherwise(0).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_key", "_slice", "_none", "_source", "_before", "draw")
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of labelled documents, a row a doc_id: repeated labels are averaged."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.when(F.avg("quality") >= 0.5, F.lit(GOOD)).otherwise(F.lit(BAD)).alias("weight")
    )


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` plus weight, UNKNOWN where not labelled."""
    return docs.drop("weight").join(quality_weights(labels), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(UNKNOWN)))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = names(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "draw", size_of(F.col("text")).alias("size"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(weighed(docs, labels)).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str) -> str:
    """DuckDB SQL for the mix of the rows of `docs`, with copies."""
    return rf"""
  SELECT d.*, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size,
    coalesce(l.weight, 0.5::DOUBLE) AS weight
  FROM {docs} d LEFT JOIN (
    SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS weight
    FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) l USING (doc_id)"""


def mixed_sql(docs: str) -> str:
    """CTEs ending in `mixed`: the rows of `docs` with size, source_size, target, copies, taken."""
    return f"""sized AS ({mix_sql(docs)}),
keyed AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null' || coalesce(md5(text), ''))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS k FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
wt AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM per),
lv AS (SELECT *, cap::DOUBLE / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM wt),
tg AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, ratio) FROM lv WHERE ratio >= level), 0::DOUBLE) * w) AS target FROM lv),
up AS (SELECT keyed.*, source_size, target, floor(target / greatest(source_size, 1)) AS epochs,
    sum(size) OVER (PARTITION BY keyed.source ORDER BY k, keyed.doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed JOIN tg ON keyed.source IS NOT DISTINCT FROM tg.source),
mixed AS (SELECT *, (epochs + CASE WHEN target - epochs * source_size > 0 AND upto::DOUBLE - size::DOUBLE / 2 <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM up)"""


OP6_SQL = f"""WITH {mixed_sql("documents")}
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"""
