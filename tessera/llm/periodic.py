"""Periodic runs of words: a suffix automaton of the words so far, with link-cut access to its suffix-link tree.

A node's colour is the last word at which one of its strings ended. Appending a word accesses the new prefix's
path to the root, as link-cut trees do: the path falls into segments of one colour each (the preferred paths),
and all of it takes the new colour. A segment of colour j whose deepest string has m words says that the last m words
also ended at j and that no longer suffix did. If the distance to j is at most m, the words of both form a square, and
the square's stretch with that period began m words before j. Squares of one period at successive words are one run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lean_batches

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Characters of text taken apart at a time; a longer text is taken alone.
CHUNK_CHARS = 1 << 20
#: What the operator adds.
ADDED = {"n_words": T.LongType(), "runs": T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])), "collapsed": T.StringType()}

Run = tuple[int, int, int]


def squares_to_runs(words: list[int], least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> list[Run]:
    """(start, length, period) of every maximal stretch of `words` with smallest period p and at least max(least, exponent * p) words, exponent >= 2.

    Amortised time is a logarithm a word. Memory is a few hundred bytes a word.
    """
    # the automaton: longest string, suffix link and transitions of each state; state 0 is the empty string
    longest, link, follows = [0], [-1], [{}]
    # splay trees of preferred paths, ordered by depth; up is the parent in the tree or, of its root, the node above the path.
    # State 0 stays outside: it can't be part of a square. Only the colour of a tree's root counts.
    left, right, up, colour = [0], [0], [0], [-1]
    found: list[Run] = []
    open_runs: dict[int, list[int]] = {}  # period -> first word, last word

    def splay(v: int) -> None:
        while True:
            p = up[v]
            if not p:
                return
            if left[p] == v:
                on_left = True
            elif right[p] == v:
                on_left = False
            else:
                return
            g = up[p]
            if g and left[g] == p:
                above = up[g]
                if on_left:
                    a, b = right[p], right[v]
                    left[g], right[p], left[p], right[v] = a, g, b, p
                    if a:
                        up[a] = g
                    if b:
                        up[b] = p
                    up[g], up[p] = p, v
                else:
                    a, b = left[v], right[v]
                    right[p], left[g], left[v], right[v] = a, b, p, g
                    if a:
                        up[a] = p
                    if b:
                        up[b] = g
                    up[p] = up[g] = v
            elif g and right[g] == p:
                above = up[g]
                if on_left:
                    a, b = left[v], right[v]
                    right[g], left[p], left[v], right[v] = a, b, g, p
                    if a:
                        up[a] = g
                    if b:
                        up[b] = p
                    up[p] = up[g] = v
                else:
                    a, b = left[p], left[v]
                    right[g], left[p], right[p], left[v] = a, g, b, p
                    if a:
                        up[a] = g
                    if b:
                        up[b] = p
                    up[g], up[p] = p, v
            else:
                above, colour[v] = g, colour[p]
                if on_left:
                    b = right[v]
                    left[p], right[v] = b, p
                else:
                    b = left[v]
                    right[p], left[v] = b, p
                if b:
                    up[b] = p
                up[p], up[v] = v, above
                return
            up[v], colour[v] = above, colour[g]
            if above:
                if left[above] == g:
                    left[above] = v
                elif right[above] == g:
                    right[above] = v

    def close(period: int, first: int, last: int) -> None:
        if last - first + 1 >= max(least, exponent * period):
            found.append((first, last - first + 1, period))

    last = 0
    for i, word in enumerate(words):
        # append the word: a new state, and perhaps a clone between another state and its link
        now = len(longest)
        longest.append(i + 1)
        follows.append({})
        left.append(0)
        right.append(0)
        colour.append(-1)
        p = last
        while p >= 0 and word not in follows[p]:
            follows[p][word] = now
            p = link[p]
        if p < 0:
            above = 0
        else:
            above = follows[p][word]
            if longest[p] + 1 != longest[above]:
                old, above = above, now + 1
                link.append(-1)
                up.append(0)
                longest.append(longest[p] + 1)
                follows.append(dict(follows[old]))
                link.append(link[old])
                # until now the clone's strings ended where those of the old state did: it joins that path, just above
                splay(old)
                rest = left[old]
                left.append(rest)
                right.append(0)
                up.append(old)
                colour.append(-1)
                left[old] = above
                if rest:
                    up[rest] = above
                while p >= 0 and follows[p].get(word) == old:
                    follows[p][word] = above
                    p = link[p]
                link[old] = link[now] = above
                up[now] = above
        if len(link) == now:
            link.append(above)
            up.append(above)
        last = now
        # access: recolour the path, segment by segment
        v, below = now, 0
        while v:
            splay(v)
            ended = colour[v]
            deeper = right[v]
            if deeper:
                colour[deeper] = ended
            right[v] = below
            if ended >= 0:
                period, size = i - ended, longest[v]
                if period <= size:
                    first = ended - size + 1
                    seen = open_runs.get(period)
                    if seen and seen[1] == i - 1 and seen[0] == first:
                        seen[1] = i
                    else:
                        if seen:
                            close(period, *seen)
                        open_runs[period] = [first, i]
            below, v = v, up[v]
        colour[below] = i
    for period, (first, end) in open_runs.items():
        close(period, first, end)
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(texts: np.ndarray, words: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """[from, to) of the stretches of words that may hold runs; texts: the number of each word's text, ascending.

    Every word of a run occurs in it at least `exponent` times. So a word that its stretch has less often belongs to no run of
    the stretch and cuts it; the parts are looked at again until nothing changes. No run is lost or cut.
    """
    place, stretch, width = np.arange(len(words)), texts.astype(np.int64), int(words.max(initial=0)) + 1
    while len(place):
        _, same, times = np.unique(stretch * width + words[place], return_inverse=True, return_counts=True)
        keep = times[same] >= exponent
        kept = place[keep]
        if not len(kept):
            return []
        cut = np.concatenate(([True], (np.diff(kept) > 1) | (np.diff(stretch[keep]) > 0)))
        number = np.cumsum(cut) - 1
        sizes = np.bincount(number)
        long_enough = (sizes >= least)[number]
        if keep.all() and long_enough.all():
            starts = kept[cut]
            return list(zip(starts.tolist(), (starts + sizes).tolist(), strict=True))
        place, stretch = kept[long_enough], number[long_enough].astype(np.int64)
    return []


def runs_of(texts: list[str | None], least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> Iterator[tuple[int, list[Run], str]]:
    """(words, runs, collapsed text) of each text; words are what ASCII blanks part."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(w) for w in split]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.fromiter((numbers[w] for words in split for w in words), np.int64, int(starts[-1]))
    runs: dict[int, list[Run]] = defaultdict(list)
    for a, b in stretches(np.repeat(np.arange(len(split)), sizes), ids, least, exponent):
        text = int(np.searchsorted(starts, a, "right")) - 1
        offset = a - int(starts[text])
        runs[text] += [(s + offset, n, p) for s, n, p in squares_to_runs(ids[a:b].tolist(), least, exponent)]
    for k, words in enumerate(split):
        own = sorted(runs.get(k, ()), key=lambda r: (r[0], r[2]))
        if own:
            drop = np.zeros(len(words) + 1, np.int64)
            for s, n, p in own:
                drop[s + p] += 1
                drop[s + n] -= 1
            words = [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]
        yield sizes[k], own, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """`docs` (needs text; other columns pass) plus n_words long, runs array<struct<start, length, period>> and collapsed string.

    runs: every run of at least max(least, exponent * period) words, by start, then period; starts count words from 0. collapsed: the text without
    the words that a run contains after its first period, words joined by one space. Whole texts: a null or blank text has no words, no runs and an
    empty collapsed text; a long one is read in one piece, in memory that grows with its longest stretch of repeated words. Rows are
    independent: repeated rows get the same answer, an empty table gives none, columns of these names are replaced. No shuffle.
    """
    lean_batches(docs.sparkSession)
    plain = docs.drop(*ADDED)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, chars = batch.column("text").to_pylist(), 0, 0
            for k, text in enumerate(texts):
                chars += len(text or "")
                if chars < CHUNK_CHARS and k < len(texts) - 1:
                    continue
                part = batch.slice(start, k + 1 - start)
                rows = list(runs_of(texts[start : k + 1], least, exponent))
                start, chars = k + 1, 0
                added = {
                    "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
                    "runs": pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for _, runs, _ in rows], pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                    "collapsed": pa.array([t for _, _, t in rows], pa.string()),
                }
                columns = {name: part.column(name) for name in part.schema.names} | added
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return plain.mapInArrow(find, T.StructType([*plain.schema.fields, *(T.StructField(n, t) for n, t in ADDED.items())]))


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equals the first. Null without runs."""
    one = "struct<start:bigint,length:bigint,period:bigint>"
    return F.aggregate(runs, F.lit(None).cast(one), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id and digests of what periodic_runs returns."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("_best", greatest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"_best.{n}").alias(n) for n in ("start", "length", "period")),
        F.floor(F.expr("1000 * _best.length div _best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_cycles(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a hash of doc_id, repeats some of its words to its end; all others stay. Null ids stay."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, n, a, p, g = (F.col(c) for c in ("_words", "_n", "_a", "_p", "_g"))
    return (
        docs.select("doc_id", "text", F.floor(hashed / 10).cast("long").alias("_g"), F.when(hashed % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("_words"))
        .withColumn("_n", F.when(F.size("_words") > 0, F.size("_words")))
        .withColumn("_a", (g % n).cast("int"))
        .withColumn("_p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
        .select(
            "doc_id",
            F.when(
                n.isNotNull(),
                F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)), " "),
            ).otherwise(F.col("text")).alias("text"),
        )
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which has been given cycles first."""
    return run_digests(periodic_runs(with_cycles(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))
