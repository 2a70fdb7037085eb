"""Line deduplication over the whole corpus within one edit, in DataFrame expressions only.

A line goes if the same line, or one within one character edit of it, stands earlier: in a
document with a smaller doc_id, or further up in its own. Equal lines meet by their hash. For lines one edit apart
the deletion neighbourhood is joined: every variant with one character deleted is emitted as a hashed
key, and lines with a common variant are one edit apart. Two lossless steps before keep that small: one
half of such lines is intact, so only lines that share a half (and the length it implies) with another line go on;
of these, only pieces of PIECE characters whose surroundings are shared emit variants.
Each group only yields its earliest member, so a hot group costs one row a member and no pairs.

The plan is the same at every size. Texts and lines are not shuffled to be looked up: Bloom filters of
bounded size let those pass that may be concerned, and only they go to the exact joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bloom import Bloom
from tessera.llm.common import Saved, private

#: By default, shorter lines only go if an equal one stands earlier: in them one edit is not small. 0 puts all lines under the edit bound.
LEAST_CHARS = 20
PIECE = 64
_SPACE = " \t\r"
_LAST = (1 << 63) - 1


def _document(docs: DataFrame) -> tuple[Column, Column]:
    """(doc, row): doc_id with null as the last, a hash of the text; documents are in this order."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)), F.xxhash64(docs["text"])


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, row, idx, line, h1, h2) of each line that isn't blank; line is trimmed."""
    doc, row = _document(docs)
    split = docs.filter("text is not null").select(doc.alias("doc"), row.alias("row"), F.posexplode(F.split("text", "\n")).alias("idx", "raw"))
    trimmed = split.select("doc", "row", "idx", F.btrim("raw", F.lit(_SPACE)).alias("line")).filter("line <> ''")
    return trimmed.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def _halves(line: Column) -> list[Column]:
    """The four hashes of an intact half: of the line as the shorter or equal one of a pair, and as the longer one."""
    n = F.length(line)
    out = []
    for long in (0, 1):
        base = n - F.lit(long)
        front = F.floor(base / 2).cast("int")
        out += [F.xxhash64(F.lit("front"), base, F.left(line, front)), F.xxhash64(F.lit("back"), base, F.right(line, base - front))]
    return out


def _keys(lines: DataFrame, least_chars: int) -> Saved:
    """(half, key): hashes of whole lines (half false) that occur twice or more, and of halves that different lines of `least_chars` or more have."""
    whole = F.struct(F.lit(False).alias("half"), F.col("h1").alias("key"))
    halves = [F.struct(F.lit(True).alias("half"), key.alias("key")) for key in _halves(F.col("line"))]
    keys = F.when(F.length("line") >= least_chars, F.array(whole, *halves)).otherwise(F.array(whole))
    keyed = lines.select("h2", F.explode(keys).alias("k")).select("k.half", "k.key", "h2")
    found = keyed.groupBy("half", "key").agg(F.count("*").alias("n"), F.min("h2").alias("low"), F.max("h2").alias("high"))
    return Saved(found.filter(F.when(F.col("half"), F.col("low") != F.col("high")).otherwise(F.col("n") > 1)).select("half", "key"), "line-keys")


def _pieces(lines: DataFrame) -> DataFrame:
    """(key, long, piece, h1, h2, at): each line as base (long false) and as the longer one, once for each half taken as intact and each piece of the other half."""
    n = F.length("line")
    cut = []
    for long in (0, 1):
        base = n - F.lit(long)
        front = F.floor(base / 2).cast("int")
        for side, intact, other, size in (("front", F.left(F.col("line"), front), F.right(F.col("line"), n - front), base - front), ("back", F.right(F.col("line"), base - front), F.left(F.col("line"), front + long), front)):
            cut.append(F.struct(F.xxhash64(F.lit(side), base, intact).alias("context"), F.lit(bool(long)).alias("long"), other.alias("x"), size.alias("k")))
    rows = lines.select("h1", "h2", "at", F.explode(F.array(*cut)).alias("c")).select("h1", "h2", "at", "c.*")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("k") / PIECE).cast("int") - 1))))
    before, after = F.col("j") * PIECE, F.greatest(F.lit(0), F.col("k") - (F.col("j") + 1) * PIECE)
    size = F.length("x") - before - after
    return rows.select(
        F.xxhash64("context", "j", F.left(F.col("x"), before), F.right(F.col("x"), after)).alias("key"), "long", F.substring(F.col("x"), before + 1, size).alias("piece"), "h1", "h2", "at"
    )


def _variants(pieces: DataFrame) -> DataFrame:
    """(kind, key, long, h1, h2, at): hashed keys of the pieces' deletion neighbourhoods.

    A base piece emits each place with its character deleted (for substitutions) and itself; a longer one emits itself without each of its characters.
    """
    without = lambda i: F.concat(F.left(F.col("piece"), i), F.substring(F.col("piece"), i + 2, F.length("piece")))
    places = F.when(F.length("piece") > 0, F.sequence(F.lit(0), F.length("piece") - 1)).otherwise(F.array().cast("array<int>"))
    deleted = F.transform(places, lambda i: F.struct(F.lit("insert").alias("kind"), F.xxhash64(F.lit("i"), F.col("key"), without(i)).alias("key")))
    swapped = F.transform(places, lambda i: F.struct(F.lit("swap").alias("kind"), F.xxhash64(F.lit("s"), F.col("key"), i, without(i)).alias("key")))
    itself = F.array(F.struct(F.lit("insert").alias("kind"), F.xxhash64(F.lit("i"), F.col("key"), F.col("piece")).alias("key")))
    emitted = F.when(F.col("long"), deleted).otherwise(F.concat(swapped, itself))
    return pieces.select(F.explode(emitted).alias("v"), "long", "h1", "h2", "at").select("v.kind", "v.key", "long", "h1", "h2", "at")


def earlier_neighbours(lines: DataFrame) -> Saved:
    """(h1, h2, near) of the lines of (h1, h2, line, at) that have an earlier line within one edit; near is the `at` of the earliest. The edit distance is verified on the texts before the earliest is picked."""
    pieces = Saved(_pieces(lines), "pieces")
    common = pieces.df.groupBy("key").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).filter("low <> high").select("key")
    variants = Saved(_variants(pieces.df.join(common, "key", "left_semi")), "variants")
    place = F.struct("at", "h1", "h2")
    firsts = variants.df.groupBy("kind", "key").agg(
        F.min(F.when(~F.col("long"), place)).alias("base"), F.min(F.when(F.col("long"), place)).alias("longer"), F.min("h2").alias("low"), F.max("h2").alias("high")
    ).filter("low <> high")
    other = F.when((F.col("kind") == "swap") | F.col("long"), F.col("base")).otherwise(F.col("longer"))
    met = variants.df.join(firsts, ["kind", "key"]).withColumn("other", other).filter(F.col("other")["at"] < F.col("at"))
    pairs = met.select("h1", "h2", "other.at", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).distinct()
    text = lambda a, b, name: lines.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("line").alias(name))
    both = pairs.join(text("h1", "h2", "own"), ["h1", "h2"]).join(text("o1", "o2", "their"), ["o1", "o2"])
    near = both.filter(F.levenshtein(F.col("own"), F.col("their"), 1) >= 0).groupBy("h1", "h2").agg(F.min("at").alias("near"))
    out = Saved(near, "near-lines")
    pieces.drop()
    variants.drop()
    return out


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> Saved:
    """(doc, row, gone): for each document that loses lines, the places (from 0) of the lost ones."""
    lines, place = _lines(docs), F.struct("doc", "row", "idx")
    keys = _keys(lines, least_chars)
    repeated, shared = keys.df.filter("not half").select("key"), Bloom(keys.df.filter("half").select("key"))

    # lines that may share a half with another line, with their text and first place
    halves = _halves(F.col("line"))
    likely = lines.filter(F.length("line") >= least_chars).withColumns({f"half{k}": half for k, half in enumerate(halves)})
    for k in range(len(halves)):
        likely = shared.mark(likely, F.col(f"half{k}"), f"may{k}")
    likely = likely.filter(" or ".join(f"may{k}" for k in range(len(halves))))
    likely = Saved(likely.groupBy("h1", "h2").agg(F.min("line").alias("line"), F.min(place).alias("at")), "likely-lines")
    near = earlier_neighbours(likely.df)

    # each occurrence of a repeated line, or of one with an earlier neighbour, against its limit: the first place of the line or the neighbour's
    wanted = repeated.unionByName(near.df.select(F.col("h1").alias("key"))).distinct()
    wanted = Saved(wanted, "wanted-lines")
    maybe = Bloom(wanted.df)
    places = Saved(maybe.mark(lines.drop("line"), F.col("h1"), "may").filter("may").drop("may").join(wanted.df, F.col("h1") == F.col("key"), "left_semi"), "line-places")
    firsts = places.df.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    limits = firsts.join(near.df, ["h1", "h2"], "left").select("h1", "h2", F.least("first", "near").alias("limit"))
    limits = Saved(limits, "line-limits")
    gone = places.df.join(limits.df, ["h1", "h2"]).filter(place > F.col("limit"))
    out = Saved(gone.groupBy("doc", "row").agg(F.array_sort(F.collect_set("idx")).alias("gone")), "dropped-lines")
    for t in (keys, shared, likely, near, wanted, maybe, places, limits):
        t.drop()
    return out


def deduplicate_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """`docs` (doc_id, text; more columns pass) with the lost lines cut from text, plus n_lines and n_dropped.

    A line is lost if an equal one stands earlier, or, for lines of `least_chars` characters or more, one within one edit; with 0 that is
    so for all lines. No document gives no rows, and texts may be of any length.

    Lines end at line feeds; they are compared trimmed of spaces, tabs and carriage returns, and blank ones stay; the others stay as
    they are. A null doc_id comes last; documents that share a doc_id (or have none) are in the order of a hash of their texts, and rows equal in
    doc_id and text are one document: they lose the same lines. Null texts stay null with 0 lines; an empty text has one empty line.
    Existing columns n_lines, n_dropped and those that begin with an underscore are dropped.
    """
    docs = docs.drop("n_lines", "n_dropped", *private(docs))
    gone = dropped_lines(docs, least_chars)
    lost = gone.df.withColumnsRenamed({"doc": "_doc", "row": "_row", "gone": "_gone"})
    key = Bloom(gone.df.select(F.xxhash64("doc", "row").alias("key")))
    doc, row = _document(docs)
    rows = key.mark(docs, F.xxhash64(doc, row), "_may")
    whole = rows.filter("not _may").withColumn("_gone", F.lit(None).cast("array<int>"))
    hit = rows.filter("_may")
    doc, row = _document(hit)
    cut = hit.join(lost, (doc == F.col("_doc")) & (row == F.col("_row")), "left").drop("_doc", "_row")
    rows = whole.unionByName(cut).drop("_may")
    rows = rows.withColumn("_lines", F.split("text", "\n")).withColumn("_left", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")))
    kept = F.array_join(F.transform("_left", lambda i: F.col("_lines")[i]), "\n")
    return rows.withColumns({
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long"),
        "n_dropped": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long"),
    }).drop("_gone", "_lines", "_left")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how many lines it has and loses, and the digest of what stays."""
    found = deduplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def deduplicated_sql(docs: str) -> str:
    """CTEs ending in `line_kept`: the rows of `docs` (unique doc_id) with `kept` for the new text, n_lines and n_dropped."""
    return rf"""lraw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM {docs} WHERE text IS NOT NULL),
lall AS (SELECT doc_id, idx, raw, nullif(trim(raw, E' \t\r'), '') AS line FROM lraw),
lfirst AS (SELECT line, min(struct_pack(d := doc_id, i := idx)) AS pos FROM lall WHERE line IS NOT NULL GROUP BY line),
lvar AS (SELECT line, pos, length(line) AS n, i, hash(left(line, i - 1) || substr(line, i + 1)) AS v FROM (SELECT *, unnest(range(1, length(line) + 1)) AS i FROM lfirst WHERE length(line) >= 20)),
lwhole AS (SELECT * FROM lfirst WHERE length(line) >= 20),
lswap AS (SELECT n, i, v, min(pos) AS pos FROM lvar GROUP BY n, i, v HAVING count(*) > 1),
lnear AS (
  SELECT a.line, b.pos FROM lvar a JOIN lswap b ON a.n = b.n AND a.i = b.i AND a.v = b.v WHERE b.pos < a.pos
  UNION ALL SELECT a.line, b.pos FROM lvar a JOIN lwhole b ON a.v = hash(b.line) AND length(b.line) = a.n - 1 WHERE b.pos < a.pos
  UNION ALL SELECT b.line, a.pos FROM lvar a JOIN lwhole b ON a.v = hash(b.line) AND length(b.line) = a.n - 1 WHERE a.pos < b.pos),
llimit AS (SELECT line, min(pos) AS pos FROM (SELECT line, pos FROM lfirst UNION ALL SELECT line, pos FROM lnear) GROUP BY line),
lmark AS (SELECT doc_id, idx, raw, coalesce(struct_pack(d := doc_id, i := idx) > llimit.pos, false) AS gone FROM lall LEFT JOIN llimit USING (line)),
ltext AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY idx) FILTER (NOT gone) AS kept, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM lmark GROUP BY doc_id),
line_kept AS (SELECT d.*, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM {docs} d LEFT JOIN ltext USING (doc_id))"""


OP5_SQL = f"""WITH {deduplicated_sql("documents")}
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS text_sha256 FROM line_kept"""
