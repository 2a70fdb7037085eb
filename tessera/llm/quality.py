"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts runs of ORDER characters in all trusted text. Tasks count their own share, and
the sums, continuation counts, discounts and interpolated probabilities are aggregations and
joins sharded by run. Scoring looks runs up in hash tables rather than joining them, which would shuffle about
a row a character: the table of log probabilities and back-off weights is cut into shards of bounded size by a hash
of the whole context, one shard at a time is broadcast, and a document's log likelihood is the sum over the shards.
A document is rejected if its
perplexity is above the quantile that trusted documents of its language reach, each under a model of the other folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Saved, lean_batches, private, small
from tessera.llm.langid import arrow_chunks, codes

ORDER = 5
#: Rows of the model that are broadcast at a time.
SHARD_ROWS = 2_000_000
#: Trusted documents of a language stay below its threshold in this share; that of all counts for it like so many documents.
QUANTILE, PRIOR = 0.99, 50
#: A threshold is widened by this over the root of a text's characters: short texts have uncertain perplexities.
SHORT = 3.0
#: For the thresholds each of so many parts of the trusted documents is scored by a model of the others.
FOLDS = 5
CHUNK_CHARS = 1 << 18
#: A run's key adds its code points, each times a power of this from the last on, and is mixed.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def runs(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(code points, for each length k from 0 the key of the run of k that ends at each position, whether the position counts, start of each text).

    Before a text stand line feeds; those and the ones between texts don't count. NUL is read as U+FFFD.
    """
    points, starts = codes(["\n" * (ORDER - 1) + t for t in texts])
    points = np.where(points == 0, 0xFFFD, points).astype(np.uint32)
    sums, power = [np.zeros(len(points), np.uint64)], np.uint64(1)
    for back in range(ORDER):
        total = sums[-1].copy()
        total[back:] += (points[: len(points) - back].astype(np.uint64) + np.uint64(1)) * power
        sums.append(total)
        power = np.uint64(int(power) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
    counts = np.ones(len(points), bool)
    for k in range(ORDER - 1):
        counts[starts + k] = False
    counts[starts[1:] - 1] = counts[-1] = False
    return points, [_mixed(x) for x in sums], counts, starts


def keys_of(texts: list[str], length: int) -> np.ndarray:
    """The keys of runs of `length` characters, as in `runs`."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), length).astype(np.uint64)
    total, power = np.zeros(len(texts), np.uint64), np.uint64(1)
    for back in range(length):
        total += (points[:, length - 1 - back] + np.uint64(1)) * power
        power = np.uint64(int(power) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)
    return _mixed(total)


def count_runs(texts: DataFrame) -> DataFrame:
    """(run string, n) of the runs of ORDER characters over column text of all rows: each task adds up its own, then the tasks' counts are summed by run."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, first, where = np.unique(np.concatenate([k for k, _, _ in parts]), return_index=True, return_inverse=True)
            n = np.bincount(where, np.concatenate([n for _, n, _ in parts]), len(keys)).astype(np.int64)
            return keys, n, np.concatenate([c for _, _, c in parts])[first]

        def table(_: np.ndarray, n: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(letters).view(f"<U{ORDER}").ravel().tolist(), pa.string()), pa.array(n)], names=["run", "n"])

        for batch in batches:
            for part in arrow_chunks(batch.column(0), CHUNK_CHARS):
                points, keys, counts, _ = runs(part)
                at = np.flatnonzero(counts)
                if not len(at):
                    continue
                own, first, n = np.unique(keys[ORDER][at], return_index=True, return_counts=True)
                parts.append((own, n, points[at[first][:, None] + np.arange(1 - ORDER, 1)]))
                held += len(own)
                if held > 1 << 19:
                    whole = merged()
                    if len(whole[0]) > 1 << 18:
                        yield table(*whole)
                        parts, held = [], 0
                    else:
                        parts, held = [whole], len(whole[0])
        if parts:
            yield table(*merged())

    return texts.select("text").mapInArrow(count, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))


def left_out(counts: DataFrame, folds: int) -> DataFrame:
    """(fold, run, n) of each fold's text as counts of all text but that fold's; those of all text are fold number `folds`."""
    whole = counts.groupBy("run").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own"))
    each = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds))))
    return each.select("fold", "run", (F.col("total") - F.coalesce(F.try_element_at("own", F.col("fold")), F.lit(0))).alias("n")).filter("n > 0")


def _by_fold(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))[F.col("fold")]


def _discount(count: Column, d: list[tuple[float, float, float]]) -> Column:
    d1, d2, d3 = (_by_fold(list(v)) for v in zip(*d, strict=True))
    return F.when(count == 1, d1).when(count == 2, d2).otherwise(d3)


def _discounts(grams: DataFrame, models: int) -> list[tuple[float, float, float]]:
    """D1, D2, D3+ of each model from the counts of counts; the usual guesses where some are missing."""
    found = {(r["fold"], r["n"]): r["c"] for r in grams.filter("n <= 4").groupBy("fold", "n").agg(F.count("*").alias("c")).collect()}
    out = []
    for fold in range(models):
        n1, n2, n3, n4 = (found.get((fold, k), 0) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            out.append((0.5, 1.0, 1.5))
            continue
        y = n1 / (n1 + 2 * n2)
        raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        out.append(tuple(min(k + 0.95, max(0.05, d)) for k, d in enumerate(raw)))
    return out


def model_table(counts: DataFrame, models: int = 1) -> Saved:
    """(fold, kind, k, run, value, step) from (fold, run, n), a model for each fold below `models`.

    Kind p: log probability of the last of the k characters of `run`, step: less that without its first; kind g: log back-off weight of the context `run` before a k-th.
    Lower orders count distinct left neighbours. The row of kind p with k 0 is the log probability of any character never seen.
    Each order is written before the next uses it, so no aggregation runs twice.
    """
    made: list[Saved] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(Saved(df, name))
        return made[-1].df

    grams = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        grams[k] = kept(grams[k + 1].groupBy("fold", F.right("run", F.lit(k)).alias("run")).agg(F.count("*").alias("n")), f"runs{k}")
    seen = dict(grams[1].groupBy("fold").agg(F.count("*").alias("c")).collect())
    symbols = _by_fold([seen.get(fold, 0) + 1 for fold in range(models)])
    lower, tables = None, []
    for k in range(1, ORDER + 1):
        d = _discounts(grams[k], models)
        context = F.left("run", F.lit(k - 1))
        contexts = grams[k].groupBy("fold", context.alias("ctx")).agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("spared"))
        contexts = kept(contexts.select("fold", "ctx", "total", (F.col("spared") / F.col("total")).alias("gamma")), f"contexts{k}")
        rows = grams[k].withColumn("ctx", context).join(contexts, ["fold", "ctx"])
        own = F.greatest(F.lit(0.0), (F.col("n") - _discount(F.col("n"), d)) / F.col("total"))
        if lower is None:
            rows = rows.withColumn("p", own + F.col("gamma") / symbols).withColumn("p_low", F.lit(1.0))
            tables.append(contexts.select("fold", F.lit("p").alias("kind"), F.lit(0).alias("k"), F.lit("").alias("run"), F.log(F.col("gamma") / symbols).alias("value"), F.lit(0.0).alias("step")))
        else:
            rows = rows.withColumn("low", F.right("run", F.lit(k - 1))).join(lower, ["fold", "low"]).withColumn("p", own + F.col("gamma") * F.col("p_low"))
            tables.append(contexts.select("fold", F.lit("g").alias("kind"), F.lit(k).alias("k"), F.col("ctx").alias("run"), F.log("gamma").alias("value"), F.lit(0.0).alias("step")))
        rows = kept(rows.select("fold", "run", "p", "p_low"), f"probabilities{k}")
        tables.append(rows.select("fold", F.lit("p").alias("kind"), F.lit(k).alias("k"), "run", F.log("p").alias("value"), F.log(F.col("p") / F.col("p_low")).alias("step")))
        lower = rows.select("fold", F.col("run").alias("low"), F.col("p").alias("p_low"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    whole = Saved(out, "run-model")
    for t in made:
        t.drop()
    return whole


class Lookup:
    """A hash table of 64-bit keys in two numpy arrays; absent keys give NaN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(4, int(1.4 * len(keys)).bit_length())) - 1
        self.keys, self.values = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, np.nan, np.float32)
        taken = np.zeros(self.mask + 1, bool)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = ~taken[slots]
            at = slots[free]
            _, first = np.unique(at, return_index=True)
            put = left[free][first]
            self.keys[at[first]], self.values[at[first]] = keys[put], values[put]
            taken[at[first]] = True
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, slots = left[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        out, known = self.values[slots], self.keys[slots] == keys
        left = np.flatnonzero(~known & ~np.isnan(out))
        out[~known] = np.nan
        at = slots[left]
        while len(left):
            at = (at + 1) & self.mask
            value, same = self.values[at], self.keys[at] == keys[left]
            hit = same & ~np.isnan(value)
            out[left[hit]] = value[hit]
            go = ~same & ~np.isnan(value)
            left, at = left[go], at[go]
        return out


@dataclass(frozen=True)
class Shard:
    """Log probabilities by length, log back-off weights by length, of an unseen character; and which shard of how many this is.

    One among several holds steps in place of log probabilities: with a seen run all its ends are seen, so the log probability of the
    longest seen one is the sum of the steps, and each order can be looked up where its own context is. Single characters are in shard 0.
    """

    p: dict[int, Lookup]
    g: dict[int, Lookup]
    unseen: float
    number: int
    of: int

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the log probabilities of this shard's positions, characters) of each text."""
        if not texts:
            return np.zeros(0), np.zeros(0, np.int64)
        _, keys, counts, starts = runs(texts)
        at = np.flatnonzero(counts)
        each = np.zeros(len(counts))
        each[at] = self._whole(keys, at) if self.of == 1 else self._part(keys, at)
        return np.add.reduceat(each, starts), np.add.reduceat(counts, starts, dtype=np.int64)

    def _whole(self, keys: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log probability of the character at each of the positions `at`."""
        total, left = np.zeros(len(at)), np.arange(len(at))
        for k in range(ORDER, 0, -1):
            found = self.p[k].get(keys[k][at[left]])
            hit = ~np.isnan(found)
            total[left[hit]] += found[hit]
            left = left[~hit]
            if k > 1 and len(left):
                total[left] += np.nan_to_num(self.g[k].get(keys[k - 1][at[left] - 1]), nan=0.0)
        total[left] += self.unseen
        return total

    def _part(self, keys: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """This shard's share of it."""
        total = np.zeros(len(at))
        for k in range(2, ORDER + 1):
            context = keys[k - 1][at - 1]
            mine = np.flatnonzero(_shard_of(context, self.of) == self.number)
            found = self.p[k].get(keys[k][at[mine]])
            total[mine] += np.where(np.isnan(found), np.nan_to_num(self.g[k].get(context[mine]), nan=0.0), found)
        if self.number == 0:
            found = self.p[1].get(keys[1][at])
            total += np.where(np.isnan(found), self.unseen, found)
        return total


def _shard_of(context: np.ndarray, of: int) -> np.ndarray:
    return (context >> np.uint64(8)) % np.uint64(of)


def with_keys(model: DataFrame) -> DataFrame:
    """(fold, k, is_p, key, place, value, step) of model_table's rows: the run's key, and bits of its context's key by which shards are dealt."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_p, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("is_p", "k"))
            run = np.array(batch.column("run").to_pylist(), object)
            key, place = np.zeros(len(run), np.uint64), np.zeros(len(run), np.uint64)
            for k in range(1, ORDER + 1):
                for p in (True, False):
                    at = np.flatnonzero((is_p == p) & (length == k))
                    if len(at):
                        key[at] = keys_of(list(run[at]), k if p else k - 1)
                        place[at] = keys_of([r[: k - 1] for r in run[at]], k - 1) >> np.uint64(8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), batch.column("k"), batch.column("is_p"), pa.array(key.view(np.int64)), pa.array(place.view(np.int64)), batch.column("value"), batch.column("step")],
                names=["fold", "k", "is_p", "key", "place", "value", "step"],
            )

    rows = model.select("fold", F.col("k").cast("byte").alias("k"), (F.col("kind") == "p").alias("is_p"), "run", F.col("value").cast("float").alias("value"), F.col("step").cast("float").alias("step"))
    return rows.mapInArrow(add, "fold int, k byte, is_p boolean, key long, place long, value float, step float")


def load_shard(model: DataFrame, number: int = 0, of: int = 1) -> Shard:
    """The rows of one shard of with_keys on the driver: runs whose context falls into it, and such contexts."""
    if of > 1:
        model = model.filter(F.when(F.col("k") < 2, F.lit(number == 0)).otherwise(F.col("place") % F.lit(of) == number))
    value = F.when(F.col("is_p") & (F.col("k") > 1), F.col("step")).otherwise(F.col("value")) if of > 1 else F.col("value")
    rows = model.select("is_p", "k", "key", value.alias("value")).toArrow()
    is_p, length, key, value = (rows[c].to_numpy() for c in ("is_p", "k", "key", "value"))
    del rows
    picked = lambda kind, k: (is_p == (kind == "p")) & (length == k)
    table = lambda at: Lookup(key[at].view(np.uint64), value[at])
    unseen = value[picked("p", 0)]
    return Shard({k: table(picked("p", k)) for k in range(1, ORDER + 1)}, {k: table(picked("g", k)) for k in range(2, ORDER + 1)}, float(unseen[0]) if len(unseen) else -np.log(0x110000), number, of)


class Shards(Sequence):
    """The shards of a model, each loaded and broadcast when it is asked for."""

    def __init__(self, model: DataFrame, of: int):
        self.model, self.of = model, of

    def __len__(self) -> int:
        return self.of

    def __getitem__(self, number: int) -> Broadcast:
        if not 0 <= number < self.of:
            raise IndexError(number)
        return self.model.sparkSession.sparkContext.broadcast(load_shard(self.model, number, self.of))


def likelihood_column(shard: Broadcast, text: Column) -> Column:
    """struct<total double, chars long> of whole texts, null as empty."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shard.value.log_likelihoods(run) for run in arrow_chunks(texts, CHUNK_CHARS)] or [(np.zeros(0), np.zeros(0, np.int64))]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([t for t, _ in found])), pa.array(np.concatenate([n for _, n in found]))], names=["total", "chars"])

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # not evaluated anew for each use of its results
    return F.arrow_udf(score, "total double, chars long").asNondeterministic()(text)


class Perplexity:
    """A model in the shared folder, ready to score: a single shard is loaded once, several one after the other."""

    def __init__(self, trusted: DataFrame, shard_rows: int = SHARD_ROWS):
        counts = Saved(count_runs(trusted).withColumn("fold", F.lit(0)), "run-counts")
        runs_table = model_table(counts.df)
        table = Saved(with_keys(runs_table.df), "keyed-model")
        counts.drop()
        runs_table.drop()
        self._load(table.df, shard_rows)
        if len(self.shards) == 1:
            table.drop()

    @classmethod
    def of_table(cls, model: DataFrame, shard_rows: int = SHARD_ROWS) -> Perplexity:
        """The model whose rows of with_keys are given."""
        out = cls.__new__(cls)
        out._load(model, shard_rows)
        return out

    def _load(self, model: DataFrame, shard_rows: int) -> None:
        self.rows = model.count()
        of = max(1, -(-self.rows // shard_rows))
        shards = Shards(model, of)
        self.shards = [shards[0]] if of == 1 else shards

    def free(self) -> None:
        """Give up what is held once nothing is scored any more."""
        if isinstance(self.shards, list):
            self.shards[0].destroy()

    def score(self, docs: DataFrame) -> DataFrame:
        """`docs` (needs text) plus perplexity; null for an empty or null text. With one shard a pass without a shuffle; else a pass a shard, and the texts' sums are joined by two hashes."""
        if len(self.shards) == 1:
            out = docs.withColumn("_part", likelihood_column(self.shards[0], F.col("text")))
            total, chars = F.col("_part")["total"], F.col("_part")["chars"]
            return out.withColumn("perplexity", F.when(chars > 0, F.exp(-total / chars))).drop("_part")
        hashes = [F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit("second"), "text").alias("_h2")]
        parts: list[Saved] = []
        for number in range(len(self.shards)):
            shard = self.shards[number]
            found = docs.select(*hashes, likelihood_column(shard, F.col("text")).alias("part")).select("_h1", "_h2", F.lit(number).alias("number"), "part.*")
            parts.append(Saved(found.groupBy("_h1", "_h2", "number").agg(F.max("total").alias("total"), F.max("chars").alias("chars")), "shard-sums"))
            shard.destroy()
        sums = parts[0].df
        for part in parts[1:]:
            sums = sums.unionByName(part.df)
        whole = Saved(sums.groupBy("_h1", "_h2").agg(F.sum("total").alias("_total"), F.max("chars").alias("_chars")), "text-sums")
        for part in parts:
            part.drop()
        out = docs.withColumns({"_h1": hashes[0], "_h2": hashes[1]}).join(small(whole.df, whole.df.count(), 32), ["_h1", "_h2"], "left")
        score = F.when(F.col("_chars") > 0, F.exp(-F.col("_total") / F.col("_chars")))
        return out.withColumn("perplexity", score).drop("_h1", "_h2", "_total", "_chars")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents whose quality labels average one half or more."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    return marked.filter("q >= 0.5").select("doc_id")


def cross_fit(trusted: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[Perplexity, Saved]:
    """A model of all of `trusted` (doc_id, text, lang), and (lang, perplexity) of each of its documents under the model of the folds it isn't in.

    Folds go by a hash of doc_id. A fold that holds all the text has no model of the others and gives no rows.
    """
    own = Saved(trusted.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "trusted")
    parts = [own.df.filter(F.col("fold") == k) for k in range(FOLDS)]
    counts = count_runs(parts[0]).withColumn("fold", F.lit(0))
    for k in range(1, FOLDS):
        counts = counts.unionByName(count_runs(parts[k]).withColumn("fold", F.lit(k)))
    counts = Saved(counts, "run-counts")
    models_counts = Saved(left_out(counts.df, FOLDS), "left-out-counts")
    runs_table = model_table(models_counts.df, FOLDS + 1)
    table = Saved(with_keys(runs_table.df), "keyed-model")
    runs_table.drop()
    scored: list[Saved] = []
    for k in range(FOLDS):
        model = Perplexity.of_table(table.df.filter(F.col("fold") == k), shard_rows)
        if model.rows:
            scored.append(Saved(model.score(parts[k]).select("lang", "perplexity"), "left-out-scores"))
        model.free()
    out = own.df.limit(0).select("lang", F.lit(None).cast("double").alias("perplexity"))
    for part in scored:
        out = out.unionByName(part.df)
    whole, found = Perplexity.of_table(table.df.filter(F.col("fold") == FOLDS), shard_rows), Saved(out, "trusted-scores")
    for t in (own, counts, models_counts, *scored):
        t.drop()
    if len(whole.shards) == 1:
        table.drop()
    return whole, found


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> tuple[list[tuple[str | None, float]], float | None]:
    """(lang, threshold) of each language of (lang, perplexity), and that of all.

    A language's logarithm is the mean of its own quantile's, weighted by its documents, and that of all languages, weighted by PRIOR.
    """
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000)).alias("at")
    found = scored.rollup("lang").agg(F.grouping("lang").alias("all"), F.count("perplexity").alias("n"), at).collect()
    overall = next((r["at"] for r in found if r["all"]), None)
    own = [r for r in found if not r["all"] and r["n"]]
    return [(r["lang"], float(np.exp((r["n"] * np.log(r["at"]) + PRIOR * np.log(overall)) / (r["n"] + PRIOR)))) for r in own], overall


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`docs` (doc_id, text, lang; more columns pass) plus perplexity, threshold, keep.

    The model learns from all trusted documents; they also set a threshold for each language, scored by models that
    haven't seen them (null is a language of its own). Empty and null texts have no perplexity and aren't kept; neither a row's label nor its doc_id
    is used for its own score. Characters are whole code points; NUL counts as U+FFFD. Without trusted text everything else is kept. Repeated rows are judged alike.
    Texts are scored whole, however long; an empty table gives no rows.
    Existing columns with the names of results, or that begin with an underscore, are dropped.
    """
    docs = docs.drop("perplexity", "threshold", "keep", *private(docs))
    lean_batches(docs.sparkSession)
    ids = trusted_ids(labels)
    trusted = docs.select("doc_id", "text", "lang").filter("text is not null and text <> ''").join(small(ids, ids.count(), 16), "doc_id", "left_semi")
    model, scored = cross_fit(trusted, shard_rows)
    found, overall = thresholds(scored.df, quantile)
    scored.drop()
    # an Arrow table: of a list Spark would make rows in further Python workers
    table = docs.sparkSession.createDataFrame(pa.table({
        "_lang": pa.array([lang or "" for lang, _ in found], pa.string()), "_none": pa.array([lang is None for lang, _ in found], pa.bool_()), "_at": pa.array([at for _, at in found], pa.float64()),
    }))
    out = model.score(docs)
    same = (F.coalesce(out["lang"], F.lit("")) == table["_lang"]) & (out["lang"].isNull() == table["_none"])
    threshold = F.coalesce(F.col("_at"), F.lit(overall).cast("double")) * (1 + F.lit(SHORT) / F.sqrt(F.greatest(F.lit(1), F.length("text"))))
    return (
        out.join(small(table, len(found), 64), same, "left")
        .withColumn("threshold", threshold)
        .withColumn("keep", F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))))
        .drop("_lang", "_none", "_at")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by a model of the documents that `labels` calls good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "lang", "perplexity", "threshold", "keep")
