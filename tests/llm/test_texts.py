"""Operators on single texts: tokenizer, languages, toxicity, quality, fingerprints."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, langid, quality, toxicity

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
BPE = bpe.PrefixBPE(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.text(st.sampled_from("ab 'lsétü\n\t  !!#aeiothn中🙂0129"), max_size=40)

DOCS = "doc_id long, text string, lang string, source string, score string, _key int"
ODD = [(1, None, "en", "a", "x", 1), (2, "", None, None, "x", 1), (None, "the cat and the dog", "en", "a", None, 2), (4, "the cat and the dog", "en", "a", None, 2), (4, "the cat and the dog", "en", "a", None, 2), (5, "123 !!!", "fr", "b", "", 3), (6, "le chat et " * 20000, "fr", "b", "", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 40), st.integers(0, 40), TEXTS)
def test_edits_encode_as_anew(text, a, b, new):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    coded = bpe.EncodedText(BPE, public_tokenizers.PATTERN, text)
    assert coded.ids() == REFERENCE.encode_ordinary(text)
    coded.edit(a, b, new)
    coded.append("'l")
    coded.append("l x")
    want = text[:a] + new + text[b:] + "'ll x"
    assert coded.text == want and coded.ids() == REFERENCE.encode_ordinary(want)


def test_long_piece_edit_is_local():
    data = b"tionthandnterlything" * 500
    state = bpe.PrefixState(BPE, data)
    state.edit(5000, 5001, b"xyz")
    assert state.redone < 200
    assert state.ids() == BPE.encode(data[:5000] + b"xyz" + data[5001:]) == REFERENCE.encode_ordinary((data[:5000] + b"xyz" + data[5001:]).decode())


def test_bpe_on_odd_rows(odd):
    rows = bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = r["text"] or ""
        assert r["token_ids"] == REFERENCE.encode_ordinary(text) and bytes(r["decoded"]).decode() == text
    assert bpe.encode_documents(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_digests(spark, sf_dir):
    got = {r["doc_id"]: r for r in bpe.op8_byte_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = REFERENCE.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_languages(spark, sf_dir, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = langid.train(docs.filter("doc_id % 7 <> 0"))
    rows = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 5)] == ["und"] * 3 and rows[1]["score"] == 0
    assert rows[6]["lang_pred"] == "fr" and rows[4]["lang_pred"] == "en"
    none = langid.train(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_toxicity(spark, odd):
    clean = [f"the cat number {k} sat on the long mat and saw the other cat near tree {k % 17}" for k in range(120)]
    bad = [f"the {w} cat number {k} sat on the mat you {w} fool" for k, w in enumerate(["horrid", "vilest"] * 60)]
    model = toxicity.fit([x for p in zip(clean, bad, strict=True) for x in p], [0, 1] * 120)
    test = spark.createDataFrame([(1, "the horrid dog ran, you horrid fool"), (2, "the dog ran over the mat near tree 3"), (3, None), (4, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(test, model).collect()}
    assert rows[1]["predicted"] == 1 and rows[2]["predicted"] == 0
    assert rows[3]["score"] == rows[4]["score"] and 0 <= rows[3]["score"] < 0.7
    assert len(toxicity.score_documents(odd, model).collect()) == len(ODD)
    empty = toxicity.train(odd.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(odd, empty).filter("score between 0 and 1").count() == len(ODD)


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([("abracadabra abba",), ("cabbage bad",), (None,), ("",)], "text string")
    shard = quality.Perplexity(texts.filter("text is not null")).shards[0].value
    symbols = sorted({c for t in ("abracadabra abba", "cabbage bad") for c in t})
    for context in ("abra", "zzzz", "cabb", "\n\n\n\n", "\U0001f600b"):
        found, _ = shard.log_likelihoods([context, *(context + c for c in [*symbols, "€"])])
        assert np.exp(found[1:] - found[0]).sum() == pytest.approx(1, abs=1e-4)


def brute_kneser_ney(trusted, order):
    """Log probability of a character after a context by interpolated modified Kneser-Ney counts in dictionaries."""
    padded = ["\n" * (order - 1) + t for t in trusted]
    counts = {order: Counter(t[i - order : i] for t in padded for i in range(order, len(t) + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(run[1:] for run in counts[k + 1])
    discounts = {}
    for k, found in counts.items():
        n1, n2, n3, n4 = (sum(n == c for n in found.values()) for c in (1, 2, 3, 4))
        raw = [0.5, 1.0, 1.5]
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            raw = [min(j + 0.95, max(0.05, j + 1 - (j + 2) * y * b / a)) for j, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]
        discounts[k] = lambda n, raw=raw: raw[min(n, 3) - 1]

    def p(context, c):
        k = len(context) + 1
        after = {run: n for run, n in counts[k].items() if run[:-1] == context}
        lower = p(context[1:], c) if context else 1 / (len(counts[1]) + 1)
        if not after:
            return lower
        total, n = sum(after.values()), after.get(context + c, 0)
        spared = sum(discounts[k](m) for m in after.values()) / total
        return (max(0, n - discounts[k](n)) / total if n else 0) + spared * lower

    return lambda context, c: np.log(p(context, c))


def test_perplexity_matches_brute_force(spark):
    trusted = ["abracadabra abba", "cabbage bad \U0001f600\U0001f601 dab", "a bad cab, a dab", "bad\x00dab"]
    asked = ["abba cab", "zebra \U0001f601\U0001f600", "dab", "\x00b"]
    want = brute_kneser_ney([t.replace("\x00", "\ufffd") for t in trusted], quality.ORDER)
    model = quality.Perplexity(spark.createDataFrame([(t,) for t in trusted], "text string"))
    got = {r["text"]: r["perplexity"] for r in model.score(spark.createDataFrame([(t,) for t in asked], "text string")).collect()}
    for text in asked:
        plain = "\n" * (quality.ORDER - 1) + text.replace("\x00", "\ufffd")
        each = [want(plain[i - quality.ORDER + 1 : i], plain[i]) for i in range(quality.ORDER - 1, len(plain))]
        assert got[text] == pytest.approx(np.exp(-np.mean(each)), rel=1e-4)


def test_shards_agree_with_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    one, many = quality.Perplexity(docs), quality.Perplexity(docs, shard_rows=4000)
    assert len(one.shards) == 1 and len(many.shards) > 2
    a = {r["doc_id"]: r["perplexity"] for r in one.score(docs).collect()}
    b = {r["doc_id"]: r["perplexity"] for r in many.score(docs).collect()}
    assert all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)


def test_a_hot_character_is_split_between_shards(spark, odd):
    spark_texts = spark.createDataFrame([("".join(chr(97 + (i * j) % 23) + " " + chr(97 + j % 19) for j in range(1, 200)),) for i in range(1, 12)], "text string")
    model = quality.Perplexity(spark_texts, shard_rows=300)
    of = len(model.shards)
    assert of > 2
    loaded = [s.value for s in model.shards]
    whole = quality.Perplexity(spark_texts).shards[0].value
    rows = lambda s: sum(int((~np.isnan(t.values)).sum()) for t in [*s.p.values(), *s.g.values()])
    assert sum(map(rows, loaded)) == rows(whole) and max(map(rows, loaded)) < 2 * rows(whole) / of
    after_space = quality.keys_of([a + " " + b for a in map(chr, range(97, 120)) for b in map(chr, range(97, 120))], 3)
    assert sum((~np.isnan(s.p[3].get(after_space))).any() for s in loaded) > 1
    a, b = ([r["perplexity"] for r in m.score(odd).orderBy("doc_id", "_key").collect()] for m in (model, quality.Perplexity(spark_texts)))
    assert len(a) == len(ODD) and all((x is None and y is None) or x == pytest.approx(y, rel=1e-5) for x, y in zip(a, b, strict=True))


def test_quality_on_odd_rows(spark, odd):
    marks = spark.createDataFrame([(4, 1), (6, 1), (6, 1), (None, 1), (5, None), (1, 0)], "doc_id long, quality int")
    rows = quality.judge(odd.withColumn("keep", F.lit("x")), marks).collect()
    assert len(rows) == len(ODD)
    assert all(not r["keep"] and r["perplexity"] is None for r in rows if not r["text"])
    assert quality.judge(odd.limit(0), marks).count() == 0
    assert all(r["keep"] for r in quality.judge(odd, marks.limit(0)).collect() if r["text"])


def test_every_trusted_document_sets_thresholds(spark):
    rows = [(k, f"the small cat number {k} sat near the {w} tree and slept", "en" if k % 3 else None) for k, w in enumerate(["old", "tall", "green"] * 20)]
    trusted = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, scored = quality.cross_fit(trusted)
    assert scored.df.count() == len(rows) and scored.df.filter("perplexity is null").count() == 0
    own = quality.Perplexity(trusted)
    a, b = (sorted(r["perplexity"] for r in m.score(trusted).collect()) for m in (model, own))
    assert a == pytest.approx(b, rel=1e-5)
    # out of sample: the score under counts without the document's fold, as learnt from the other folds alone
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS))
    want = [r["perplexity"] for k in range(quality.FOLDS) for r in quality.Perplexity(trusted.filter(fold != k)).score(trusted.filter(fold == k)).collect()]
    assert sorted(r["perplexity"] for r in scored.df.collect()) == pytest.approx(sorted(want), rel=1e-5)


def test_small_languages_lean_on_all(spark):
    rows = [("a", 4.0)] * 1000 + [("b", 9.0)] * 49 + [("c", 9.0)] * 50 + [(None, 9.0)]
    found, overall = quality.thresholds(spark.createDataFrame(rows, "lang string, perplexity double"), 0.5)
    at = dict(found)
    assert overall == 4 and at["a"] == pytest.approx(4)
    assert 4 < at[None] < 4.1 and 0 < at["c"] - at["b"] < 0.05 and at["c"] == pytest.approx(6)


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a", "one. two.\nthree four."), ("b", "three four.\none. two."), ("c", "one. two."), ("d", "three four.")], "k string, text string")
    rows = {r["k"]: r for r in fingerprint.with_fingerprint(df, "text", "f").collect()}
    assert rows["a"]["f"] == rows["b"]["f"] != rows["c"]["f"]
    pair = spark.createDataFrame([(rows["a"]["f"], rows["c"]["f"], rows["d"]["f"])], "a array<bigint>, c array<bigint>, d array<bigint>")
    got = pair.select(fingerprint.inserted(F.col("c"), F.col("d")).alias("sum"), fingerprint.deleted(F.col("a"), F.col("d")).alias("rest")).first()
    assert got["sum"] == rows["a"]["f"] and got["rest"] == rows["c"]["f"]


def test_fingerprints_on_odd_rows(spark, odd):
    rows = fingerprint.fingerprints(odd.withColumn("own", F.lit(1))).collect()
    assert len(rows) == len(ODD)
    assert len({tuple(r["own"]) for r in rows if r["text"] == "the cat and the dog"}) == 1
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0
    single = fingerprint.fingerprints(odd.filter("doc_id = 5")).collect()
    assert single[0]["edited"] == "123 !!1"


def test_next_document_over_small_buckets(spark):
    ids = [5, 1, 90, 17, 4000, 4001, 4002, -3, 12]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(df, ["text"], bucket_rows=2).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_next_document_with_far_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "CELLS", 8)
    ids = [*range(100, 160), (1 << 63) - 1, -(1 << 63), 5_000_000, 5_000_001]
    rows = [(i, f"t{i}") for i in ids] + [(None, f"n{k:03}") for k in range(40)] + [(None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed, cells = fingerprint._places(df)
    assert placed.count() == len(rows) and cells.count() <= 9
    got = {r["text"]: r["next_text"] for r in fingerprint.with_next(df, ["text"], bucket_rows=5).collect()}
    order = [t for _, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_samples_hold_repeated_ids_once(spark):
    df = spark.createDataFrame([(1, "same", "en")] * 500 + [(2, f"text {k}", "en") for k in range(500)], "doc_id long, text string, lang string")
    rows = langid.sample(df, "lang", 100)
    assert len(rows) == len({(r["doc_id"], r["text"]) for r in rows}) and 20 < sum(r["doc_id"] == 2 for r in rows) < 100


def test_conflicting_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more text number {k}") for k in range(30)] * 2, "doc_id long, text string")
    marks = spark.createDataFrame([(k, j) for k in range(30) for j in (0, 1 if k < 10 else 0)], "doc_id long, toxic int")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "fit", lambda texts, labels: seen.append((len(texts), sum(labels))))
        toxicity.train(docs, marks)
    assert seen == [(30, 10)]


def test_embeddings_fold_into_logits():
    """Predictions from the folded table against the mean of embeddings and the output layer, by hand."""
    texts = ["the cat sat on the mat near the old tree", "der Hund lief durch den Wald nach Hause"] * 20
    model = langid.fit(texts, ["en", "de"] * 20)
    for text in ("a cat near the tree", "ein Hund im Wald", "x", ""):
        found = [b for b in langid.subwords([text])[0].ravel() if b < langid.BUCKETS]
        z = (sum(model.logits[b].astype(float) for b in found) / max(1, len(found)) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        lang, score = (x[0] for x in model.predict([text]))
        assert (lang == -1 and score == 0) if not text else (lang == p.argmax() and score == pytest.approx((p / p.sum()).max(), rel=1e-4))


def test_window_lengths_by_hand():
    model = toxicity.fit([f"plain words number {k} in a row of text" for k in range(60)] + [f"you vile wretch number {k} of all" for k in range(60)], [0] * 60 + [1] * 60)
    compressors = model.compressors()
    text = toxicity.normal("You VILE wretch, take these plain words number seven in a row of text!")
    saved = [len(compressors[0].compress(w)) - len(compressors[1].compress(w)) for w in toxicity.windows(text)]
    got = toxicity.features(compressors, [text])[0]
    n = len(saved)
    want = [np.log1p(100 * sum(max(0, s) for s in saved) / (n + 4)), np.log1p(100 * sum(max(0, s - 1) for s in saved) / (n + 4)), min(12, max(0, *saved)) / 4, sum(s > 1 for s in saved) / (n + 4) * 10, np.log1p(sum(s > 1 for s in saved))]
    assert got == pytest.approx(want)
