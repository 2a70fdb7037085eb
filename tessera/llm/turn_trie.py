"""The trie of conversations by their turns: ternary search trees over range shards, merged at their boundary nodes.

A turn's code is a hash of its role, text and place; the exclusive or of a prefix's codes names its node. Conversations
become sequences of codes, in pieces of CHUNK turns, and are sorted into ranges. Each range is one shard: a ternary search
tree over the shard's dictionary of codes, into which the median of the sorted sequences goes first, so that its searches
stay balanced. Nodes whose members lie in one shard are done there. The others (the paths of a shard's first and last sequence, and
those above a piece that goes on) leave partial sums that add up over the shards and then over what lies below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import Saved, lean_batches, small

#: Turns of a sequence that are sorted as one; longer conversations go on in a further piece below.
CHUNK = 1024
#: Sequences, and turns, of a shard.
SHARD_ROWS, SHARD_TURNS = 20_000, 400_000
#: Ids of members that end at a boundary node, in one row.
PIECE_IDS = 4096
#: Copies of a boundary node's name in the join with its children.
SALTS = 8

_DONE, _OPEN, _ENDS = 0, 1, 2
_NODES = (
    "kind int, ka long, kb long, pa long, pb long, parent_conv_id long, conv_id long, depth long, words long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def words_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def turn_code(role: Column, text: Column) -> Column:
    """128 bits that stand for a role and a text."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, code, words) of `conversations` (conv_id, turn, role, text): pos counts a conversation's turns from 0.

    Order is by turn, null first, then code; a null role or text is empty; rows without conv_id take no part. Turns are numbered
    inside ranges of (conv_id, turn), and ranges of one conversation by their counts: a conversation may be any part of the table. Texts don't leave the scan.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    coded = conversations.filter("conv_id is not null").select("conv_id", "turn", turn_code(role, text).alias("code"), words_of(text).alias("words"))
    dealt = Saved(coded.repartitionByRange("conv_id", "turn", "code").withColumn("_part", F.spark_partition_id()), "turns").df
    before = W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over a row a range
    starts = dealt.groupBy("conv_id", "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.sum("_n").over(before)).filter("_start > 0").drop("_n")
    inside = W.partitionBy("_part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "code")
    return dealt.withColumn("_row", F.row_number().over(inside)).join(starts, ["conv_id", "_part"], "left").select(
        "conv_id", (F.col("_row") - 1 + F.coalesce("_start", F.lit(0))).alias("pos"), "code", "words"
    )


def sequences(turns: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pieces of the members' sequences, `chunk` turns at most: chunk, base_a, base_b (what lies above), a, b, words (arrays), conv_id, goes_on."""
    coded = turns.select("conv_id", "pos", "words", F.floor(F.col("pos") / chunk).alias("chunk"), *(F.xxhash64("code", F.lit(k), "pos").alias(c) for k, c in ((1, "a"), (2, "b"))))
    pieces = coded.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("turns"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    in_order = W.partitionBy("conv_id").orderBy("chunk")
    above = in_order.rowsBetween(W.unboundedPreceding, -1)
    whole = pieces.withColumns({
        "base_a": F.bit_xor("xa").over(above), "base_b": F.bit_xor("xb").over(above), "goes_on": F.lead("chunk").over(in_order).isNotNull(),
    })
    none = F.array().cast("array<bigint>")
    field = lambda name: F.coalesce(F.transform("turns", lambda t: t[name]), none).alias(name)
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return members.select("conv_id").join(whole, "conv_id", "left").select(
        zero("chunk"), zero("base_a"), zero("base_b"), field("a"), field("b"), field("words"), "conv_id", F.coalesce("goes_on", F.lit(False)).alias("goes_on")
    )


class TernaryTrie:
    """A trie whose children are binary search trees; node 0 is its top. Parents come before their children."""

    def __init__(self, a: int, b: int, depth: int):
        self.code, self.low, self.high, self.first, self.up = [-1], [0], [0], [0], [0]
        self.a, self.b, self.depth, self.words = [a], [b], [depth], [0]

    def insert(self, codes: list[int], tokens: list[tuple[int, int]], words: list[int]) -> int:
        """The node of a sequence of codes, made if it isn't there."""
        node = 0
        for code, (a, b), n in zip(codes, tokens, words, strict=True):
            child, side, at = self.first[node], self.first, node
            while child and self.code[child] != code:
                side, at = (self.low, child) if code < self.code[child] else (self.high, child)
                child = side[child]
            if not child:
                child = side[at] = len(self.code)
                self.code.append(code)
                for links in (self.low, self.high, self.first):
                    links.append(0)
                self.up.append(node)
                self.a.append(self.a[node] ^ a)
                self.b.append(self.b[node] ^ b)
                self.depth.append(self.depth[node] + 1)
                self.words.append(n)
            node = child
        return node


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle of each part before its halves."""
    parts = [(0, n)]
    while parts:
        lo, hi = parts.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            parts += [(lo, mid), (mid + 1, hi)]


def group_nodes(top: tuple[int, int, int], rows: list[tuple[list, list, int, bool]], first: bool, last: bool, piece_ids: int) -> Iterator[tuple]:
    """Rows of _NODES of the trie below one node. top: its depth and name; rows: (tokens, words, conv_id, goes_on), sorted.

    first, last: whether the shard begins or ends with these rows, so that others may have members of the same nodes.
    """
    depth, a, b = top
    trie = TernaryTrie(a, b, depth)
    dictionary = {t: k for k, t in enumerate(sorted({t for tokens, *_ in rows for t in tokens}))}
    starts = [k for k, row in enumerate(rows) if not k or row[0] != rows[k - 1][0]] + [len(rows)]
    distinct = [(starts[k], starts[k + 1]) for k in range(len(starts) - 1)]
    ends: dict[int, list[int]] = {}
    entered, going, outer = [0] * len(distinct), set(), set()
    for k in medians(len(distinct)):
        tokens, words = rows[distinct[k][0]][:2]
        entered[k] = trie.insert([dictionary[t] for t in tokens], tokens, words)
    size = len(trie.code)
    n, least, kids, leaves, saved, opened = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [False] * size
    for k, ((lo, hi), node) in enumerate(zip(distinct, entered, strict=True)):
        n[node] = hi - lo
        least[node] = min(conv for _, _, conv, _ in rows[lo:hi])
        if stay := [conv for _, _, conv, on in rows[lo:hi] if not on]:
            ends[node] = stay
        if len(stay) < hi - lo:
            going.add(node)
        if first and k == 0 or last and k == len(distinct) - 1:
            outer.add(node)
    for node in going | outer:
        opened[node] = True
    # what is below a node was made after it
    for x in range(size - 1, 0, -1):
        u = trie.up[x]
        n[u] += n[x]
        least[u] = least[x] if least[u] is None else min(least[u], least[x])
        if opened[x]:
            opened[u] = True
            continue
        leaves[x] += not kids[x]
        saved[x] += (n[x] - 1) * trie.words[x]
        kids[u] += 1
        leaves[u] += leaves[x]
        saved[u] += saved[x]
    opened[0] = True
    for x in range(size):
        u, mine = trie.up[x], ends.get(x, [])
        name, above = (trie.a[x], trie.b[x]), (trie.a[u], trie.b[u])
        if not opened[x]:
            digest = hashlib.sha256(",".join(map(str, mine)).encode()).hexdigest()
            yield (_DONE, *name, *(above if opened[u] else (None, None)), None if opened[u] else least[u], least[x], trie.depth[x], trie.words[x], n[x], kids[x], leaves[x], saved[x], digest)
        elif x or not depth:
            yield (_OPEN, *name, *(above if x else (None, None)), None, least[x], trie.depth[x], trie.words[x], n[x], kids[x], leaves[x], saved[x], None)
        else:  # counted at the end of the piece above
            yield (_OPEN, *name, None, None, None, None, None, None, 0, kids[x], leaves[x], saved[x], None)
        if opened[x]:
            for k in range(0, len(mine), piece_ids):
                yield (_ENDS, *name, None, None, None, mine[k], None, None, None, None, None, None, ",".join(map(str, mine[k : k + piece_ids])))


def _shard(chunk: int, piece_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes the nodes of one range of sequences."""
    types, names = [pa.int32(), *[pa.int64()] * 12, pa.string()], [f.split()[0] for f in _NODES.split(", ")]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[tuple, list]] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("chunk", "base_a", "base_b", "a", "b", "words", "conv_id", "goes_on")]
            for k, base_a, base_b, a, b, words, conv, on in zip(*columns, strict=True):
                top = (k * chunk, base_a, base_b)
                if not groups or groups[-1][0] != top:
                    groups.append((top, []))
                groups[-1][1].append((list(zip(a, b, strict=True)), words, conv, on))
        for k, (top, rows) in enumerate(groups):
            out = list(group_nodes(top, rows, k == 0, k == len(groups) - 1, piece_ids))
            for start in range(0, len(out), 10_000):
                columns = zip(*out[start : start + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return nodes


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, joined by commas; only the hash's state is held."""
    schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("ends", pa.string())])
    now, state = None, None
    for batch in batches:
        for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ends")), strict=True):
            if now == (a, b):
                state.update(b"," + piece.encode())
                continue
            if now:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, state.hexdigest()), schema, strict=True)], schema=schema)
            now, state = (a, b), hashlib.sha256(piece.encode())
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, state.hexdigest()), schema, strict=True)], schema=schema)


def _below(nodes: DataFrame) -> DataFrame:
    """(ka, kb, n_leaves, saved_tokens) summed over everything below each open node, itself included.

    Sums reach twice as far each round, as does the ancestor that each node knows: rounds grow with the logarithm of the depth.
    """
    now = Saved(nodes.select("ka", "kb", F.col("pa").alias("ja"), F.col("pb").alias("jb"), "n_leaves", "saved_tokens"), "sums")
    while now.df.filter("ja is not null").limit(1).count():
        gained = now.df.filter("ja is not null").groupBy("ja", "jb").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")).withColumnsRenamed({"ja": "ka", "jb": "kb"})
        far = now.df.select(F.col("ka").alias("ja"), F.col("kb").alias("jb"), F.col("ja").alias("_ja"), F.col("jb").alias("_jb"))
        after = now.df.join(gained, ["ka", "kb"], "left").join(far, ["ja", "jb"], "left").select(
            "ka", "kb", F.col("_ja").alias("ja"), F.col("_jb").alias("jb"), *((F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_leaves", "_leaves"), ("saved_tokens", "_saved")))
        )
        after = Saved(after, "sums")
        now.drop()
        now = after
    return now.df.drop("ja", "jb")


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, shards: int | None = None, chunk: int = CHUNK, piece_ids: int = PIECE_IDS) -> DataFrame:
    """RESULT, a row a node, of numbered turns (conv_id, pos from 0 without gaps, code, words).

    A node is a distinct sequence of first turns; conv_id is its smallest member, n_leaves and saved_tokens cover what is
    below it too, ends_sha256 is the digest of the members that end there. `members` (conv_id) may have conversations without turns: they end at
    the top node. Codes name nodes by 128 bits. A conversation's codes meet by `chunk` turns at most, a shard holds about SHARD_ROWS pieces, members of one
    sequence may span shards; nothing passes through the driver but counts. Equal conversations are members of the same nodes; no conversations give no rows.
    """
    spark = turns.sparkSession
    lean_batches(spark)
    everyone = (turns if members is None else members).filter("conv_id is not null").select("conv_id").distinct()
    held = Saved(sequences(turns, everyone, chunk), "sequences")
    rows = held.df
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("a")), F.lit(0))).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_ROWS), -(-total // SHARD_TURNS))
    order = ["chunk", "base_a", "base_b", F.arrays_zip("a", "b"), "conv_id"]
    nodes = Saved(rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(_shard(chunk, piece_ids), _NODES), "nodes").df
    held.drop()

    partial = nodes.filter(F.col("kind") == _OPEN).groupBy("ka", "kb").agg(
        *(F.max(c).alias(c) for c in ("pa", "pb", "depth", "words")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    partial = Saved(partial, "boundary").df
    kids = partial.filter("pa is not null").groupBy("pa", "pb").agg(F.count("*").alias("_kids")).withColumnsRenamed({"pa": "ka", "pb": "kb"})
    merged = partial.join(kids, ["ka", "kb"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    own = merged.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
    ends = nodes.filter(F.col("kind") == _ENDS).select("ka", "kb", "conv_id", "ends").repartition("ka", "kb").sortWithinPartitions("ka", "kb", "conv_id").mapInArrow(_joined_digests, "ka long, kb long, ends string")
    done = own.drop("n_leaves", "saved_tokens").join(_below(own), ["ka", "kb"]).join(ends, ["ka", "kb"], "left")
    open_rows = done.withColumns({"ends": F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())), "parent_conv_id": F.lit(None).cast("long")})

    columns = ("pa", "pb", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    both = nodes.filter(F.col("kind") == _DONE).select(*columns).unionByName(open_rows.select(*columns))
    names = partial.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("_above"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = both.withColumn("_salt", F.pmod("conv_id", F.lit(SALTS)).cast("int"))
    return salted.join(small(names, partial.count() * SALTS, 40), ["pa", "pb", "_salt"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), *RESULT[3:7], F.col("ends").alias("ends_sha256")
    )


def grafted(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Numbered turns in which each conversation c begins with the first h turns of conversation c - c % every, and goes on after its own first h; and all conv_ids.

    h is crc32 of the decimal c modulo `most`. Conversations may lose all turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    members = turns.select("conv_id").distinct()
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("_base"), "pos", "code", "words")
    lent = members.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % every, "_h": h}).join(heads, "_base").filter("pos < _h")
    shift = lent.groupBy("conv_id").agg(F.count("*").alias("_lent"))
    own = turns.filter(F.col("pos") >= h).join(shift, "conv_id", "left").withColumn("pos", F.col("pos") - h + F.coalesce("_lent", F.lit(0)))
    columns = ("conv_id", "pos", "code", "words")
    return lent.select(*columns).unionByName(own.select(*columns)), members


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, whose heads are shared first."""
    turns = Saved(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "numbered").df
    return prefix_trie(*grafted(turns))


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, code, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) - 1 AS pos
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
bits(conv_id, s, k, crc) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM t
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(crc, ascii(s[k // 8 + 1])::BIGINT) ELSE crc END AS x FROM bits WHERE k < 8 * length(s))),
c AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM bits WHERE k = 8 * length(s)),
r AS (
  SELECT c.conv_id, 0 AS own, pos, code, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos < h
  UNION ALL SELECT conv_id, 1, pos, code, words FROM c JOIN t USING (conv_id) WHERE pos >= h),
m AS (
  SELECT conv_id, list(code) OVER w AS path, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, [], 0 FROM c),
k AS (SELECT conv_id, array_to_string(path, ',') AS node, len(path) AS depth, array_to_string(path[1:len(path) - 1], ',') AS above, path, words, len(path) = max(len(path)) OVER (PARTITION BY conv_id) AS ends FROM m),
n AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(above) AS above, any_value(path) AS path, any_value(words) AS words, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM k GROUP BY node),
kids AS (SELECT above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
sums AS (
  SELECT array_to_string(path[1:j], ',') AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN sums USING (node) LEFT JOIN f p ON f.depth > 0 AND p.node = f.above
"""
