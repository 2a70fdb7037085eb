"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A text's weighted set holds its runs of five words, each weighing its count times a damped idf. Document
frequencies of all documents are kept in a table of fixed width (a count-min sketch of one row), so
they are exact up to a share of the corpus that doesn't depend on its size. Consistent weighted samples
agree with the weighted Jaccard similarity as probability; they are banded, and texts that share a
band are candidates. Candidates are verified by the weighted Jaccard similarity of the whole texts.

Within a band's bucket every text is first compared with one centre, the member that shares most buckets. Only texts that this leaves outside the centre's component
are then compared with the other members, in blocks, so a large group of copies costs one
comparison a member, and no link between texts that share a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bloom import Bloom
from tessera.llm.common import Saved, lean_batches, private
from tessera.llm.components import components
from tessera.llm.langid import arrow_chunks, codes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
#: Counters of document frequencies; share of the corpus below which frequencies weigh alike; weight of the idf beside the plain count.
COUNTERS, RARE, DAMPING = 1 << 18, 1 / 64, 0.25
#: Most members, and most shingles, of a bucket that meet as one block on average.
BLOCK, BLOCK_SHINGLES = 400, 1 << 18
CHUNK_CHARS = 1 << 19
#: Shingles are told apart by this many bits.
_HASH_BITS = np.uint64(44)

_WORDLIKE: list[np.ndarray] = []
_POWERS: list[np.ndarray] = []


def _wordlike() -> np.ndarray:
    if not _WORDLIKE:
        _WORDLIKE.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _WORDLIKE[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        p = 0x9E3779B97F4A7C15
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))), dtype=np.uint64) for b in (p, pow(p, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles of each text, sorted by text and hash.

    Words are runs of letters and digits in lower case. A text of fewer than five words has one shingle of all of
    them; one without words has none. At most 2**20 texts at a time.
    """
    points, starts = codes([t.lower() for t in texts])
    word = np.concatenate(([False], _wordlike()[points], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edges[::2], edges[1::2]
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none.astype(np.uint64), none
    power, inverse = _powers(len(points) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    hashes = _mix((sums[end] - sums[begin]) * inverse[begin])
    owner = np.searchsorted(starts, begin, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    # a shingle starts at each word with four more of its text behind it, or at the first word of a short text
    place = np.arange(len(hashes)) - first[owner]
    lead = (place + WORDS <= count[owner]) | (place == 0)
    at = np.flatnonzero(lead)
    length = np.minimum(WORDS, count[owner[at]])
    total = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        has = k < length
        total[has] = _mix(total[has] * np.uint64(0x9FB21C651E98DF25) + hashes[at[has] + k])
    keys = owner[at].astype(np.uint64) << _HASH_BITS | total >> (np.uint64(64) - _HASH_BITS)
    keys.sort()
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(np.concatenate((new, [len(keys)])))
    keys = keys[new]
    return (keys >> _HASH_BITS).astype(np.int64), keys & ((np.uint64(1) << _HASH_BITS) - np.uint64(1)), times


def document_counts(docs: DataFrame) -> DataFrame:
    """(counter, n): documents in which a shingle of each counter occurs; at most COUNTERS rows. A task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in arrow_chunks(batch.column(0), CHUNK_CHARS):
                _, hashes, _ = shingles(part)
                total += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["counter", "n"])

    return docs.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))


def damped_idf(docs: DataFrame) -> np.ndarray:
    """For each counter a weight from 1 (in all documents) to 1 + DAMPING (in few), linear in the log of the share of documents.

    The damping keeps a large group of near copies together: its shared shingles are frequent, its edits are rare.
    """
    rows = document_counts(docs).toPandas()
    share = np.zeros(COUNTERS)
    share[rows["counter"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64) / max(1, docs.count())
    return (1 + DAMPING * np.maximum(0, np.log(1 / (np.minimum(1, share) + RARE)) / np.log(1 / RARE))).astype(np.float32)


def weighted(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, weight) of the distinct shingles, sorted."""
    owner, hashes, times = shingles(texts)
    return owner, hashes, times.astype(np.float32) * idf[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]


def consistent_samples(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, samples: int = BANDS * ROWS) -> np.ndarray:
    """[text, sample]: 64 bits of the sampled shingle and its quantised weight; 0 for texts without shingles.

    Ioffe's scheme in logarithms: r and c are Gamma(2, 1), b uniform, t = floor(log w / r + b); the smallest
    log c - r * (t - b) - r wins.
    """
    out = np.zeros((texts, samples), np.uint64)
    if not len(hashes):
        return out
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    rows, counts = owner[starts], np.diff(np.concatenate((starts, [len(owner)])))
    log_w, unit, low = np.log(weights), np.float32(2.0**-21), np.uint64((1 << 21) - 1)

    def uniform(bits: np.ndarray) -> np.ndarray:
        return ((bits & low).astype(np.float32) + np.float32(0.5)) * unit

    for k in range(samples):
        one = _mix(hashes ^ np.uint64((0xA24BAED4963EE407 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF))
        two = _mix(one + np.uint64(0x9E3779B97F4A7C15))
        r = -np.log(uniform(one) * uniform(one >> np.uint64(21)))
        b = uniform(one >> np.uint64(42))
        t = np.floor(log_w / r + b)
        value = np.log(-np.log(uniform(two) * uniform(two >> np.uint64(21)))) - r * (t - b) - r
        least = np.minimum.reduceat(value, starts)
        hits = np.flatnonzero(value == np.repeat(least, counts))
        won = hits[np.searchsorted(hits, starts)]
        out[rows, k] = _mix(hashes[won] ^ (t[won].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """(doc_id, node, weight, keys): node is the MD5 of the text, weight its total, keys a hash of each band (none without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in arrow_chunks(batch.column("text"), CHUNK_CHARS):
                owner, hashes, w = weighted(part, idf.value)
                found = consistent_samples(owner, hashes, w, len(part))
                total = np.bincount(owner, w, len(part)).astype(np.float64)  # of no shingles it would be integers
                band = np.zeros((len(part), BANDS), np.uint64)
                for k in range(ROWS):
                    band = _mix(band * np.uint64(0x9FB21C651E98DF25) + found[:, k::ROWS])
                band = _mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                has = total > 0
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * BANDS))), pa.int32()), pa.array(band[has].view(np.int64).ravel()))
                mine = batch.slice(done, len(part))
                yield pa.RecordBatch.from_arrays([mine.column("doc_id"), mine.column("node"), pa.array(total), keys], names=["doc_id", "node", "weight", "keys"])
                done += len(part)

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text")).mapInArrow(
        sign, "doc_id long, node binary, weight double, keys array<long>"
    )


def similarities(a: list[str], b: list[str], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair: sum of the smaller weights over sum of the larger; 0 if neither has words."""
    (owner_a, hash_a, w_a), (owner_b, hash_b, w_b) = weighted(a, idf), weighted(b, idf)
    key = lambda owner, h: owner.astype(np.uint64) << _HASH_BITS | h
    _, in_a, in_b = np.intersect1d(key(owner_a, hash_a), key(owner_b, hash_b), assume_unique=True, return_indices=True)
    shared = np.bincount(owner_a[in_a], np.minimum(w_a[in_a], w_b[in_b]).astype(np.float64), len(a))
    total = np.bincount(owner_a, w_a, len(a)) + np.bincount(owner_b, w_b, len(b)) - shared
    return np.where(total > 0, shared / np.where(total > 0, total, 1), 0.0)


def _chunked(batch: pa.RecordBatch, *texts: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose columns `texts` hold about CHUNK_CHARS characters."""
    if batch.num_rows:
        size = sum(pc.utf8_length(batch.column(t)).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts).cumsum() // CHUNK_CHARS
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), batch.num_rows]
        for start, stop in pairwise(cuts):
            yield batch.slice(start, stop - start)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, idf: Broadcast, similarity: float) -> Saved:
    """The pairs (a, b) of distinct nodes whose texts are at least so similar; `pairs` may repeat. Texts come from `docs`, one document for each node."""
    wanted = Saved(pairs.select("a", "b").distinct(), "pairs")
    ends = wanted.df.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    picked = Saved(ends.join(nodes, "node").select("first_id", "no_id", "node"), "wanted")
    near = _texts(docs, picked)
    both = wanted.df.join(near.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(near.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunked(batch, "text_a", "text_b"):
                found = similarities(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), idf.value)
                yield part.select(["a", "b"]).take(pa.array(np.flatnonzero(found >= similarity)))

    out = Saved(both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary").distinct(), "verified")
    wanted.drop()
    picked.drop()
    return out


def _members(nodes: DataFrame) -> Saved:
    """(band, key, node, weight, centre) of the nodes in buckets of two or more.

    The centre is the member that shares buckets with the most others over all bands (of equals the largest node): of a group of
    copies with different edits that is the original or one near it. What a bucket has in common is written before its
    members meet it: a join of two plain tables, in which a hot bucket's rows can be split.
    """
    keyed = nodes.select("node", "weight", F.posexplode("keys").alias("band", "key"))
    shared = Saved(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    sized = Saved(keyed.join(shared.df, ["band", "key"]), "buckets")
    degree = Saved(sized.df.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    centres = Saved(sized.df.join(degree.df, "node").groupBy("band", "key").agg(F.max(F.struct("degree", "node"))["node"].alias("centre")), "centres")
    out = Saved(sized.df.drop("n").join(centres.df, ["band", "key"]), "members")
    for t in (shared, sized, degree, centres):
        t.drop()
    return out


def _texts(docs: DataFrame, picked: Saved) -> DataFrame:
    """(node, text) of one document for each row (first_id, no_id, node) of `picked`, so copies don't multiply. Only texts that a Bloom filter of `picked` passes are shuffled."""
    node = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    given = docs.select(F.coalesce(docs["doc_id"], F.lit(0)).alias("first_id"), docs["doc_id"].isNull().alias("no_id"), node.alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    likely = Bloom(picked.df.select(F.xxhash64("first_id", "node").alias("key"))).mark(given, F.xxhash64("first_id", "node"), "may").filter("may")
    return likely.join(picked.df, ["first_id", "no_id", "node"], "left_semi").select("node", "text")


def shared_weights(sets: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([row, set] weight shared by the sets numbered `rows` and each set, total of each set) of sets (hashes, counts).

    A shingle that occurs n times is n items of one weight, so shared weights are sums over common items: those in
    many sets as a matrix product, the others by listing their few pairs.
    """
    hashes = np.concatenate([h for h, _ in sets])
    times = np.concatenate([n for _, n in sets]).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    weight = idf[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.float64)
    total = np.bincount(owner, weight * times, len(sets))
    level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    hashes, owner, weight = np.repeat(hashes, times), np.repeat(owner, times), np.repeat(weight, times)
    items = _mix(hashes + level.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(items, kind="stable")
    items, owner, weight = items[order], owner[order], weight[order]
    starts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(items)])))
    size = np.repeat(sizes, sizes)
    place = np.full(len(sets), -1)
    place[rows] = np.arange(len(rows))
    shared = np.zeros((len(rows), len(sets)))
    often = np.flatnonzero(size >= 16)
    column = np.repeat(np.arange(len(sizes)), sizes)
    for first in range(0, len(often), 1 << 18):
        at = often[first : first + (1 << 18)]
        names, col = np.unique(column[at], return_inverse=True)
        for low in range(0, len(names), 1024):
            some = at[(col >= low) & (col < low + 1024)]
            local = col[(col >= low) & (col < low + 1024)] - low
            x = np.zeros((len(sets), min(1024, len(names) - low)))
            x[owner[some], local] = np.sqrt(weight[some])
            shared += x[rows] @ x.T
    seldom = np.flatnonzero((size > 1) & (size < 16))
    flat = shared.ravel()
    for apart in range(1, 16):
        one = seldom[seldom + apart < len(items)]
        one = one[column[one] == column[one + apart]]
        for left, right in ((one, one + apart), (one + apart, one)):
            asked = place[owner[left]] >= 0
            flat += np.bincount(place[owner[left[asked]]] * len(sets) + owner[right[asked]], weight[left[asked]], len(flat))
    return flat.reshape(shared.shape), total


def _left_over(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, idf: Broadcast, similarity: float) -> Saved:
    """Links (a, b) between components that the centres missed: of each member outside its centre's component with the bucket's other members.

    Blocks of outside members meet blocks of all, with their whole weighted sets: pairs are never rows, a bucket with few outside
    costs each member a row a block of these, and of the links found between two components one is returned.
    """
    label = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    known = Saved(
        members.join(label("node"), "node", "left").join(label("centre"), "centre", "left")
        .withColumns({"of": F.coalesce("node_label", "node"), "at": F.coalesce("centre_label", "centre")})
        .select("band", "key", "node", "weight", "of", (F.col("of") != F.col("at")).alias("out"), (F.col("node") == F.col("centre")).alias("middle")),
        "known-members",
    )
    part = lambda only: F.greatest(
        F.lit(1), F.ceil(F.sum(only.cast("int")) / BLOCK).cast("int"), F.ceil(F.sum(F.when(only, F.col("weight")).otherwise(0.0)) / BLOCK_SHINGLES).cast("int")
    )
    buckets = known.df.groupBy("band", "key").agg(F.count("*").alias("n"), F.max("out").alias("any"), part(F.col("out")).alias("asking"), part(F.lit(True)).alias("blocks"))
    buckets = Saved(buckets.filter("any and n > 2").select("band", "key", "asking", "blocks"), "open-buckets")
    rows = Saved(known.df.filter("not middle").join(buckets.df, ["band", "key"]).select("band", "key", "node", "of", "out", "asking", "blocks"), "left-over")
    picked = Saved(rows.df.select("node").distinct().join(nodes, "node").select("first_id", "no_id", "node"), "left-over-nodes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunked(batch, "text"):
                owner, hashes, times = shingles(part.column("text").to_pylist())
                cuts = np.searchsorted(owner, np.arange(1, part.num_rows))
                blobs = [[x.tobytes() for x in np.split(values, cuts)] for values in (hashes, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("node"), *(pa.array(b, pa.binary()) for b in blobs)], names=["node", "hashes", "times"])

    whole = Saved(_texts(docs, picked).mapInArrow(sets, "node binary, hashes binary, times binary").dropDuplicates(["node"]), "sets")
    place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asking = rows.df.filter("out").withColumns({"asks": F.lit(True), "i": place("asking")}).withColumn("j", each("blocks"))
    asked = rows.df.withColumns({"asks": F.lit(False), "j": place("blocks")}).withColumn("i", each("asking"))
    dealt = asking.unionByName(asked).drop("out", "asking", "blocks").join(whole.df, "node")

    def compare(group: pa.Table) -> pa.Table:
        def links(a: list[bytes], b: list[bytes]) -> pa.Table:
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        asks, node = group["asks"].to_numpy(), group["node"].to_pylist()
        of = np.unique(group["of"].to_pylist(), return_inverse=True)[1]
        ask, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(ask) or not len(other) or len(np.unique(of)) < 2:
            return links([], [])
        whole = [(np.frombuffer(h, np.uint64), np.frombuffer(t, np.int32)) for h, t in zip(group["hashes"].to_pylist(), group["times"].to_pylist(), strict=True)]
        shared, total = shared_weights(whole, ask, idf.value)
        shared = shared[:, other]
        union = total[ask][:, None] + total[other][None, :] - shared
        hit = (shared >= (similarity - 1e-7) * union) & (union > 0) & (of[ask][:, None] != of[other][None, :])
        r, c = np.nonzero(hit)
        pairs = np.sort(np.column_stack((of[ask[r]], of[other[c]])), axis=1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        return links([node[k] for k in ask[r[first]]], [node[k] for k in other[c[first]]])

    out = Saved(dealt.groupBy("band", "key", "i", "j").applyInArrow(compare, "a binary, b binary").distinct(), "more-links")
    for t in (known, buckets, rows, picked, whole):
        t.drop()
    return out


def _classes(docs: DataFrame, similarity: float) -> tuple[Saved, Saved]:
    """(doc_id, node) of each row, and (node, class_id, class_size, first_node) of each text; first_node is the smallest of the class's texts that have its smallest doc_id."""
    spark = docs.sparkSession
    lean_batches(spark)
    idf = spark.sparkContext.broadcast(damped_idf(docs))
    signed = Saved(signatures(docs, idf), "signatures")
    nodes = Saved(
        signed.df.groupBy("node").agg(
            F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.max("weight").alias("weight"), F.max("keys").alias("keys")
        ).withColumns({"first_id": F.coalesce("least", F.lit(0)), "no_id": F.col("least").isNull()}),
        "nodes",
    )
    members = _members(nodes.df)
    stars = members.df.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda name: nodes.df.select(F.col("node").alias(name), F.col("weight").alias(f"weight_{name}"))
    stars = stars.join(side("a"), "a").join(side("b"), "b").filter(F.least("weight_a", "weight_b") >= similarity * F.greatest("weight_a", "weight_b") * (1 - 1e-6))
    linked = verified(stars, docs, nodes.df, idf, similarity)
    first = components(linked.df)
    more = _left_over(members.df, first.df, nodes.df, docs, idf, similarity)
    links = linked.df.unionByName(more.df)
    labels = components(links) if more.df.limit(1).count() else first
    named = nodes.df.select("node", "least", "rows").join(labels.df, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    whole = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"), firsts["node"].alias("first_node"))
    by_node = Saved(named.join(whole, "label").select("node", "class_id", "class_size", "first_node"), "classes")
    for t in {id(t): t for t in (nodes, members, linked, more, first, labels)}.values():
        t.drop()
    return signed, by_node


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, class_id, class_size): a row for each row of `docs` (doc_id, text; other columns don't count).

    Texts are linked if they are equal or their weighted Jaccard similarity reaches `similarity`; a class is what links
    connect, class_id its smallest doc_id (null only if all are), class_size its rows.
    Null counts as the empty text; texts without words are only linked to equal ones. Rows that repeat count as rows. Whole texts of any
    length are compared, the longest as one weighted set in a task; an empty table gives no rows.
    """
    signed, by_node = _classes(docs, similarity)
    return signed.df.select("doc_id", "node").join(by_node.df, "node").select("doc_id", "node", "class_id", "class_size")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` for each class, with all its columns: one with the smallest doc_id (null last), of several texts that share it the one with the smallest MD5.

    Of rows equal in doc_id and text any one stays. Rows that may go are found by a Bloom filter; the others aren't shuffled.
    Columns that begin with an underscore are dropped.
    """
    docs = docs.drop(*private(docs))
    signed, by_node = _classes(docs, similarity)
    found = signed.df.select("doc_id", "node").join(by_node.df, "node")
    found = found.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first_node")))
    # a row a document that goes, or that repeats
    changed = found.groupBy("doc_id", "node").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
    changed = Saved(changed.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), F.col("stays").alias("_stays")), "dropped")
    node = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    rows = Bloom(changed.df.select(F.xxhash64("_id", "_node").alias("key"))).mark(docs.withColumn("_md5", node), F.xxhash64(docs["doc_id"].cast("long"), F.col("_md5")), "_may")
    hit = rows.filter("_may").join(changed.df, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_node")), "left")
    once = hit.filter("_stays").dropDuplicates(["doc_id", "_md5"])
    kept = rows.filter("not _may").unionByName(hit.filter("_stays is null").select(rows.columns)).unionByName(once.select(rows.columns))
    for t in (signed, by_node):
        t.drop()
    return kept.drop("_md5", "_may")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size")
