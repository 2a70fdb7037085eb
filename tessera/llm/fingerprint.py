"""Document fingerprints: a homomorphic multiset hash, in DataFrame expressions only.

A fingerprint is a vector of 85 lanes modulo 2**60, the sum of vectors hashed from the parts of a text:
- lane 0 counts sentences; lanes 1 to 4 add 240 bits of each paragraph's SHA-256: these decide equality;
- lanes 5 to 84 pack 240 counters of 20 bits, each counting the sentences whose SHA-256 has one certain bit set.
Sums don't depend on order; parts are inserted by adding and deleted by subtracting their vectors.
Each counter is a random-sign sum of the sentences, so the cosine of two fingerprints' counters
estimates that of their sentence multisets, for texts of any length up to 2**20 sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import private

MASK = (1 << 60) - 1
FIELDS = 1 | 1 << 20 | 1 << 40
FIELD = (1 << 20) - 1
#: Runs of these end a sentence.
SENTENCE_END = r"[.!?|\n][.!?|\n ]*"
#: About so many rows share a bucket when documents are put in order; more where that would take more than so many buckets.
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 16
#: Even ranges of doc_id whose rows are counted before they are cut into buckets.
CELLS = 1 << 12


def _long(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _hashes(text: Column) -> Column:
    """struct(p: SHA-256 of each paragraph, s: SHA-256 of each sentence); empty parts don't count."""
    digests = lambda pattern: F.transform(F.filter(F.split(text, pattern), lambda x: x != ""), lambda x: F.sha2(x.cast("binary"), 256))
    return F.struct(digests("\n").alias("p"), digests(SENTENCE_END).alias("s"))


def _quarter(digests: Column, k: int) -> Column:
    """Digits 15 * k to 15 * k + 14 of each digest as a number."""
    return F.transform(digests, lambda x: _long(F.substring(x, 1 + 15 * k, 15)))


def _sum(of: Column, value) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda acc, x: (acc + value(x)).bitwiseAND(F.lit(MASK)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` plus array<bigint> `name`, the fingerprint of column `text` (null: as empty, all zero)."""
    hashed = df.withColumn("_h", _hashes(F.coalesce(F.col(text), F.lit(""))))
    hashed = hashed.withColumns({f"_{part}{k}": _quarter(F.col(f"_h.{part}"), k) for part in "ps" for k in range(4)})
    lanes = [F.size("_s0").cast("long")] + [_sum(F.col(f"_p{k}"), lambda x: x) for k in range(4)]

    def counters(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(19)), lambda j: _sum(F.col(f"_s{k}"), lambda x: F.call_function("shiftright", x, j).bitwiseAND(F.lit(FIELDS))))

    return hashed.withColumn(name, F.concat(F.array(*lanes), *(counters(k) for k in range(4)))).drop("_h", *(f"_{part}{k}" for part in "ps" for k in range(4)))


def inserted(whole: Column, part: Column) -> Column:
    """Fingerprint of the union of both multisets of parts."""
    return F.zip_with(whole, part, lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))


def deleted(whole: Column, part: Column) -> Column:
    """Fingerprint without the parts of `part`, which must be in it."""
    return F.zip_with(whole, part, lambda a, b: (a - b).bitwiseAND(F.lit(MASK)))


def as_text(fingerprint: Column) -> Column:
    """15 lower-case hex digits a lane."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _signs(fingerprint: Column) -> Column:
    """The 240 counters as sums of signs: 2 * count - sentences."""
    lanes = F.slice(fingerprint, 6, 80)
    return F.transform(
        F.flatten(F.transform(lanes, lambda x: F.array(*(F.shiftright(x, 20 * f).bitwiseAND(F.lit(FIELD)) for f in range(3))))),
        lambda count: 2 * count - fingerprint[0],
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda acc, x: acc + x).cast("double")


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` plus a double in [0, 1] for each name -> two fingerprint columns.

    1 for equal fingerprints, 0 if one of two different ones has no sentences; else the cosine of the sign sums, at least 0.
    """
    used = sorted({c for pair in pairs.values() for c in pair})
    out = df.withColumns({f"_v_{c}": _signs(F.col(c)) for c in used}).withColumns({f"_n_{c}": F.sqrt(_dot(F.col(f"_v_{c}"), F.col(f"_v_{c}"))) for c in used})
    for name, (a, b) in pairs.items():
        norm = F.col(f"_n_{a}") * F.col(f"_n_{b}")
        cosine = F.when(norm > 0, _dot(F.col(f"_v_{a}"), F.col(f"_v_{b}")) / norm).otherwise(F.lit(0.0))
        out = out.withColumn(name, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))))
    return out.drop(*(f"_v_{c}" for c in used), *(f"_n_{c}" for c in used))


def _places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` plus _cell and _pos, which put rows in order of doc_id (null last, there by the first six bytes of text); and (_cell, n, low, high) of the cells."""
    low, high = docs.select(F.min("doc_id").cast("double"), F.max("doc_id").cast("double")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    share = (F.col("doc_id").cast("double") - F.lit(low)) / F.lit(max(high - low, 1.0))
    cell = F.when(F.col("doc_id").isNull(), F.lit(CELLS)).otherwise(F.least(F.lit(CELLS - 1), F.floor(share * CELLS)).cast("int"))
    start = F.conv(F.rpad(F.hex(F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")
    placed = docs.withColumns({"_cell": cell, "_pos": F.coalesce(F.col("doc_id").cast("long"), start)})
    return placed, placed.groupBy("_cell").agg(F.count("*").alias("_n"), F.min("_pos").alias("_low"), F.max("_pos").alias("_high"))


def with_next(docs: DataFrame, carried: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`docs` plus next_<c> for each carried column: that of the next row by doc_id (null last), then text; after the last, of the first.

    Rows are dealt into buckets: even ranges of doc_id are counted, and each is cut into even parts of the range that its rows
    really span, as many as its rows ask for, so that a far-off id or a dense region doesn't gather the rest. The first row of each bucket goes to the bucket before
    as well, and one shuffle brings each row beside its successor. Cells and buckets are tables of bounded size and are broadcast.
    """
    placed, cells = _places(docs)
    rows = docs.count()
    each = max(bucket_rows, -(-rows // MOST_BUCKETS))
    parts = F.ceil(F.col("_n") / F.lit(each))
    cells = cells.select("_cell", "_low", (F.floor((F.col("_high") - F.col("_low")) / parts) + 1).alias("_width"))
    dealt = placed.join(F.broadcast(cells), "_cell").withColumn("_part", F.floor((F.col("_pos") - F.col("_low")) / F.col("_width")).cast("long")).drop("_low", "_width")
    firsts = dealt.groupBy("_cell", "_part").agg(F.min("_pos").alias("_first"))
    inorder, everything = W.orderBy("_cell", "_part"), W.partitionBy(F.lit(1))  # over a row a bucket
    own = F.struct(F.col("_cell").alias("c"), F.col("_part").alias("p"))
    firsts = firsts.withColumn("_before", F.coalesce(F.lag(own).over(inorder), F.max(own).over(everything)))
    copies = F.array_compact(F.array(F.struct(own.alias("b"), F.lit(False).alias("extra")), F.when(F.col("_pos") == F.col("_first"), F.struct(F.col("_before").alias("b"), F.lit(True).alias("extra")))))
    spread = dealt.join(F.broadcast(firsts), ["_cell", "_part"]).withColumn("_to", F.explode(copies)).drop("_first", "_before", "_part")
    order = W.partitionBy("_to.b").orderBy("_to.extra", "_cell", "_pos", F.col("text").asc_nulls_first())
    return spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).filter(~F.col("_to.extra")).drop("_cell", "_pos", "_to")


def edited_text(text: Column, other: Column) -> Column:
    """`text` with its last quarter (rounded down, in code points) replaced by the first as many of `other`, or all of it."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - quarter), F.left(other, quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text; more columns pass) plus n_chars, edited, and the fingerprints own, edited_own, next_own.

    Null texts count as empty; rows that repeat are ordered by text and fingerprinted alike. Empty input gives an empty result.
    Existing columns with the names of results, or that begin with an underscore, are dropped.
    """
    docs = docs.drop("n_chars", "own", "edited", "edited_own", "next_own", "next_text", *private(docs))
    own = with_fingerprint(docs.withColumn("text", F.coalesce("text", F.lit(""))), "text", "own")
    moved = with_next(own, ["text", "own"]).withColumn("n_chars", F.length("text").cast("long"))
    return with_fingerprint(moved.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).drop("next_text"), "edited", "edited_own")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = found.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "edited")
    return with_likeness(digest, {"near_edited": ("own", "edited_own"), "near_next": ("own", "next_own")}).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited_own")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


_LANES_SQL = """list_concat([len({h}.s)::BIGINT], list_concat(
      list_transform(range(4), lambda k: (coalesce(list_sum(list_transform({h}.p, lambda x: ('0x' || substr(x, (1 + 15 * k)::BIGINT, 15))::BIGINT::HUGEINT)), 0) % 1152921504606846976)::BIGINT),
      list_transform(range(80), lambda j: (coalesce(list_sum(list_transform({h}.s, lambda x: ((x[(1 + j // 20)::BIGINT] >> (j % 20)::BIGINT) & 1099512676353)::HUGEINT)), 0) % 1152921504606846976)::BIGINT)))"""
_HASHES_SQL = r"""struct_pack(
      p := list_transform(list_filter(string_split({t}, chr(10)), lambda x: x <> ''), lambda x: sha256(x)),
      s := list_transform(list_filter(string_split_regex({t}, '[.!?|\n][.!?|\n ]*'), lambda x: x <> ''), lambda x: list_transform(range(4), lambda k: ('0x' || substr(sha256(x), (1 + 15 * k)::BIGINT, 15))::BIGINT)))"""
_SIGNS_SQL = "list_transform(range(240), lambda i: 2 * (({f}[(6 + i // 3)::BIGINT] >> (20 * (i % 3))::BIGINT) & 1048575) - {f}[1])"
_LIKE_SQL = """CASE WHEN {a} = {b} THEN 1::DOUBLE
    WHEN sqrt(list_dot_product(v{a}::DOUBLE[], v{a}::DOUBLE[])) * sqrt(list_dot_product(v{b}::DOUBLE[], v{b}::DOUBLE[])) > 0 THEN
      least(1::DOUBLE, greatest(0::DOUBLE, list_dot_product(v{a}::DOUBLE[], v{b}::DOUBLE[]) / (sqrt(list_dot_product(v{a}::DOUBLE[], v{a}::DOUBLE[])) * sqrt(list_dot_product(v{b}::DOUBLE[], v{b}::DOUBLE[])))))
    ELSE 0::DOUBLE END"""
_TEXT_SQL = "list_aggregate(list_transform({f}, lambda x: printf('%015x', x)), 'string_agg', '')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id NULLS LAST, text)) AS nx FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 4) || left(nx, length(text) // 4) AS edited FROM n),
h AS (SELECT *, {_HASHES_SQL.format(t="text")} AS ho, {_HASHES_SQL.format(t="edited")} AS he, {_HASHES_SQL.format(t="nx")} AS hn FROM e),
f AS (SELECT *, {_LANES_SQL.format(h="ho")} AS a, {_LANES_SQL.format(h="he")} AS b, {_LANES_SQL.format(h="hn")} AS c FROM h),
v AS (SELECT *, {_SIGNS_SQL.format(f="a")} AS va, {_SIGNS_SQL.format(f="b")} AS vb, {_SIGNS_SQL.format(f="c")} AS vc FROM f)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_TEXT_SQL.format(f="a")} AS fingerprint, {_TEXT_SQL.format(f="b")} AS edited_fingerprint,
  {_LIKE_SQL.format(a="a", b="b")} AS near_edited, {_LIKE_SQL.format(a="a", b="c")} AS near_next
FROM v
"""
