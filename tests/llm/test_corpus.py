"""Operators over whole corpora against SQL or brute force: neighbours, lines, mixing, near duplicates, urls, pipeline."""

import importlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import canonical
from pyspark.sql import functions as F

from tessera.llm import ann, bloom, components, line_dedup, mixing, near_dedup, queries, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(name, spark, duck, sf_dir):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck(queries.ORACLE_SQL[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def brute_nearest(rows, k=10):
    out = {}
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    for i, v in rows:
        if i % 100 == 0:
            far = np.sqrt(((vectors - np.array(v)) ** 2).sum(1))
            far[ids == i] = np.inf
            order = np.lexsort((ids, far))[:k]
            out[i] = [(int(ids[o]), float(far[o])) for o in order if np.isfinite(far[o])]
    return out


def test_neighbours_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows)
    got = defaultdict(list)
    for r in ann.op2_nearest_vectors(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(abs(dict(want[q]).get(i, s) - s) < 1e-12 for q in got for i, s in got[q])


def test_neighbours_on_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [3.0, 4.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [float("inf"), 1.0]), (200, [3.0, 4.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(base, base.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7), (0, 4, 200), (200, 1, 7), (200, 2, 0), (200, 3, 1), (200, 4, 2)]
    assert ann.nearest(base.limit(0), base).count() == 0 and ann.nearest(base, base.limit(0)).count() == 0


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1 :]


def brute_lines(docs, least=line_dedup.LEAST_CHARS):
    """doc_id -> kept text, by comparing every line with all before it."""
    before, out = [], {}
    for i, text in sorted(docs):
        kept = []
        for raw in text.split("\n"):
            line = raw.strip(" \t\r")
            long = [b for b in before if len(b) >= least] if len(line) >= least else []
            gone = line != "" and (line in before or any(within_one(line, b) for b in long))
            before += [line] if line else []
            if not gone:
                kept.append(raw)
        out[i] = "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdé 中"), n)) for n in (20, 21, 40, 63, 64, 65, 130, 131, 200, 400)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(4):
            s = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                at, kind = int(rng.integers(len(s))), rng.integers(3)
                s[at : at + (kind != 1)] = [] if kind == 0 else [str(rng.choice(list("xyz")))]
            lines.append("".join(s))
        docs.append((i, "\n".join(["short", f"short {i % 7}", *lines, "", " \t"])))
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_short_lines_under_the_bound(spark):
    """With least_chars 0 the edit bound holds for all lines, down to single characters."""
    rng = np.random.default_rng(11)
    docs = [(i, "\n".join("".join(rng.choice(list("abcd"), rng.integers(0, 9))) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (0, 5):
        assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(df, least).collect()} == brute_lines([(i, t) for i, t in docs], least)


def test_lines_on_odd_rows(spark):
    line = "a line that is long enough to count"
    rows = [(1, None, 1), (2, "", 1), (3, line, 1), (4, line + "s", 1), (4, line + "s", 1), (None, line, 1), (5, f"{line}\n{line}\nother " + "x" * 100000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = sorted((r["doc_id"] or 99, r["text"], r["n_dropped"]) for r in line_dedup.deduplicate_lines(df).collect() if r["text"] is not None)
    assert got == [(2, "", 0), (3, line, 0), (4, "", 1), (4, "", 1), (5, "other " + "x" * 100000, 2), (99, "", 1)]
    assert line_dedup.deduplicate_lines(df.limit(0)).count() == 0


def test_lines_of_repeated_rows_stay(spark):
    text = "a line that is long enough to count\nshort\nlast"
    df = spark.createDataFrame([(1, text), (1, text), (2, "other\nshort"), (None, "new\nlast"), (None, "new\nlast too"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 9, r["text"] or "", r["n_dropped"]) for r in line_dedup.deduplicate_lines(df).collect()), key=str)
    assert got[:3] == [(1, text, 0), (1, text, 0), (2, "other", 1)]
    rest = got[3:]
    # of the two texts without a doc_id one comes first and keeps the line they share
    assert sorted(n for _, _, n in rest) in ([0, 0, 2], [0, 1, 1]) and sum(t.split("\n")[0] == "new" for _, t, _ in rest) == 1


def test_lines_without_spare_bits(spark, monkeypatch):
    """With Bloom filters so full that everything passes, the exact joins give the same lines."""
    monkeypatch.setattr(bloom, "MAX_BLOCKS", 1)
    monkeypatch.setattr(bloom.blocks_for, "__defaults__", (bloom.BITS_PER_KEY, 1))
    base = [f"line number {k} of the common stock, long enough" for k in range(400)]
    docs = [(i, "\n".join([base[(i * j) % 400] + "x" * (j % 2) for j in range(1, 9)])) for i in range(120)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_mix_targets_and_limits(spark):
    rows = [(i, s, 10 + i % 7, 1.0) for i in range(400) for s in (["a"] if i % 4 else ["b", None])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, weight double"), slices=16).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    total = got["size"].sum()
    by = got.groupby(got["source"].fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert abs(by["target"].sum() - total) < 1e-6 and (by["target"] <= 3 * by["size"] + 1e-9).all()
    assert (abs(by["taken"] - by["target"]) <= 20).all()


def test_mix_on_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 0, 1.0, 5), (1, "a", 0, 1.0, 5), (1, "a", 0, 1.0, 5), (2, "b", 7, 0.25, 5)], "doc_id long, source string, size long, weight double, target int")
    rows = mixing.mix(df).collect()
    assert len(rows) == 4 and sum(r["taken"] for r in rows) == 7
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("size = 0")).agg(F.sum("taken")).first()[0] == 0


def test_missing_ids_draw_by_text(spark):
    df = mixing.names(spark.createDataFrame([(None, f"text {k}", "a", 10, 1.0) for k in range(300)] + [(k, "t", "b", 1, 1.0) for k in range(10)], "doc_id long, text string, source string, size long, weight double"))
    a, b = (sorted((r["text"], r["copies"]) for r in mixing.mix(df, slices=8).filter("source = 'a'").collect()) for _ in range(2))
    assert a == b and len({c for _, c in a}) == 2 and "draw" not in mixing.mix(df).columns


def test_query_draws_missing_ids_apart(spark, duck, tmp_path):
    rows = [(None if k % 2 else k, f"w{k} " * (1 + k % 5), "a" if k % 3 else None) for k in range(60)] + [(None, None, "a"), (None, "w1 w1 ", "a"), (None, "w1 w1 ", "a")]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        (spark.createDataFrame(rows, "doc_id long, text string, source string") if name == "documents" else empty).coalesce(1).write.parquet(f"{tmp_path}/raw/{name}")
        next((tmp_path / "raw" / name).glob("part-*")).rename(tmp_path / f"{name}.parquet")
    got, want = mixing.op6_mix_sources(spark, str(tmp_path)).toPandas(), duck(mixing.OP6_SQL, str(tmp_path))
    assert canonical(got) == canonical(want)
    keyed = mixing.names(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert keyed.filter("doc_id is null").select("draw").distinct().count() == 31  # by text, and one for no text


def test_consistent_samples_estimate_similarity():
    a = [f"w{i}" for i in range(300)]
    texts = [" ".join(a), " ".join(a[:240] + [f"v{i}" for i in range(60)])]
    idf = np.ones(near_dedup.COUNTERS, np.float32)
    found = near_dedup.consistent_samples(*near_dedup.weighted(texts, idf), 2, 1500)
    assert abs((found[0] == found[1]).mean() - near_dedup.similarities(texts[:1], texts[1:], idf)[0]) < 0.05


def test_classes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{rng.integers(5000)}" for _ in range(60)] for _ in range(6)]
    docs = []
    for i in range(150):
        words = list(base[rng.integers(6)])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(60)] = f"x{rng.integers(10**6)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    idf = near_dedup.damped_idf(df)
    label = list(range(150))
    for i in range(150):
        for j, s in enumerate(near_dedup.similarities([docs[i][1]] * i, [t for _, t in docs[:i]], idf)):
            if s >= near_dedup.SIMILARITY and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()} == dict(enumerate(label))


def test_classes_on_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, 0), (2, "", 0), (3, "one two", 0), (4, "one two", 0), (None, "one two", 0), (5, text, 0), (6, text + " more", 0), (7, "!!!", 0), (7, "!!!", 0), (8, " ".join(f"long{i}" for i in range(100000)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = {(r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.classes(df).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 3), (4, 3, 3), (None, 3, 3), (5, 5, 2), (6, 5, 2), (7, 7, 2), (8, 8, 1)}
    assert sorted(r["doc_id"] for r in near_dedup.deduplicated(df).collect()) == [1, 3, 5, 7, 8]
    assert near_dedup.classes(df.limit(0)).count() == 0


def test_classes_of_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, " ")], "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.classes(df).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)}
    assert sorted(r["doc_id"] for r in near_dedup.deduplicated(df).collect()) == [1, 3, 4]


def test_one_row_of_a_class_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (1, text + " more", "b"), (None, "lone words here", "c"), (None, "lone words here", "c"), (2, text, "d"), (None, text, "e")]
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, more string")).collect()
    assert len(kept) == 2 and {r["doc_id"] for r in kept} == {1, None} and {r["more"] for r in kept} <= {"a", "b", "c"}


def test_left_over_members_are_compared(spark):
    """A bucket whose centre is unlike its members: they still find one another, in any number of blocks."""
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{rng.integers(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(30):
        own = words(50)
        texts += [" ".join([*own, "extra", str(k)]) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(words(50))])), "doc_id long, text string")
    idf = spark.sparkContext.broadcast(near_dedup.damped_idf(docs))
    nodes = near_dedup.signatures(docs, idf).withColumnsRenamed({"doc_id": "first_id"}).withColumn("no_id", F.lit(False)).cache()
    centre = nodes.filter(F.col("first_id") == 90).first()["node"]
    members = nodes.select(F.lit(0).alias("band"), F.lit(1).cast("long").alias("key"), "node", "weight", F.lit(centre).alias("centre"))
    none = spark.createDataFrame([], "node binary, label binary")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(near_dedup, "BLOCK", 20)
        links = near_dedup._left_over(members, none, nodes, docs, idf, 0.8).df.collect()
    number = {bytes(r["node"]): r["first_id"] for r in nodes.collect()}
    found = {tuple(sorted((number[bytes(r["a"])], number[bytes(r["b"])]))) for r in links}
    assert found == {(3 * k + a, 3 * k + b) for k in range(30) for a, b in ((0, 1), (0, 2), (1, 2))}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20] + [(7, 7)], "a int, b int")
    got = {r["node"]: r["label"] for r in components.components(links).df.collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(41)}
    assert components.components(links.limit(0)).df.count() == 0


def test_urls_on_odd_rows(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/7x?q"), (5, "http://a.example.com/en/8"), (5, "http://a.example.com/en/8"), (6, "http://badexample.com/en/7"), (7, "http://x.net/de/8"), (8, "http://www.listed.xyz/p/#f"), (9, "http://com"), (10, "s://h.org/es/" + "y" * 100000)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in urls], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("listed.xyz/p",), (None,)], "canonical string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.RULES, listed).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("", None, "allow")] * 3
    assert got[4] == ("example.com", "example.com/en/7", "allow") and got[5][1:] == ("com/en/", "block") and got[6][1:] == ("com/en/", "block")
    assert got[7][1:] == ("net/de/", "block") and got[8] == ("www.listed.xyz", None, "block") and got[9][1:] == (None, "allow") and got[10][1:] == ("org/es/", "block")
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES, listed).count() == 0
    assert url_filter.filter_urls(pages, url_filter.RULES, listed.limit(0)).count() == len(urls)


def test_one_url_and_one_canonical_form_of_many_pages(spark):
    same = [(k, "https://www.hot.org/x/") for k in range(300)] + [(1000 + k, f"https://hot.org/x?{k}") for k in range(300)] + [(2000 + k, None) for k in range(100)] + [(3000, "https://cold.org/x")]
    pages = spark.createDataFrame(same, "page_id long, url string")
    listed = spark.createDataFrame([("hot.org/x",), ("hot.org/x",), (None,)], "canonical string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, url_filter.RULES, listed).collect()}
    assert len(got) == 701 and all(v == ("block" if k < 2000 else "allow") for k, v in got.items())


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = url_filter.bloom_blocks(keys, 141)
    assert url_filter.may_contain(keys, blocks, 141).count() == 3000
    others = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("key"))
    assert url_filter.may_contain(others, blocks, 141).count() < 150


def test_pipeline_against_plain_versions(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = pipeline.quality_classifier(spark, docs, sf_dir).cache()
    assert kept.columns == pipeline.COLUMNS and 0 < kept.count() <= docs.count()
    lines = pipeline.line_dedup(spark, kept, sf_dir).cache()
    want = {i: t for i, t in brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()]).items()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t for i, t in want.items() if t.strip() or t == kept.filter(F.col("doc_id") == i).first()["text"]}
    near = pipeline.near_dedup(spark, lines, sf_dir).cache()
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(lines).collect()}
    assert {r["doc_id"] for r in near.collect()} == set(classes.values())
    mixed = pipeline.mix_sources(spark, near, sf_dir).cache()
    assert mixed.columns == pipeline.COLUMNS
    words = lambda d: d.agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert abs(words(mixed) - words(near)) < 0.35 * words(near)
    coded = pipeline.byte_bpe(spark, mixed, sf_dir)
    assert coded.count() == mixed.count() and coded.filter("size(token_ids) <> n_tokens").count() == 0
    assert [name for name, _ in pipeline.STAGES] and pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_odd_rows(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    text = "the cat sat on the mat and looked at the other cat near the tall tree"
    rows = [(1, text, "en", "a", 9, "p", 1), (1, text, "en", "a", 9, "p", 1), (None, text, None, None, None, None, None), (2, None, "en", "b", 0, "q", 2), (3, "", None, "b", 0, "q", 2), (4, "word " * 30000, "en", "b", 1, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, _key int")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = sorted((r["doc_id"] or 99 for r in out.collect()))
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    judged, lines, near, mixed, coded = seen.values()
    # empty texts are rejected; the copy without doc_id loses its only line; one row of each class stays
    assert set(judged) <= {1, 4, 99} and judged.count(1) in (0, 2)
    assert lines == [1, 1, 2, 3, 4]
    assert near == [1, 2, 4]
    assert set(mixed) <= {1, 4, 99} and coded == [1, 1, 2, 3, 4, 99]
    kept = pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"], r["size"]) for r in kept) == [(1, "p"), (2, "q"), (4, "")]
