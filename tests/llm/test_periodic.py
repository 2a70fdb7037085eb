"""Periodic runs against comparison at every distance."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tessera.llm import periodic


def brute_runs(words, least=periodic.LEAST_WORDS, exponent=periodic.LEAST_EXPONENT):
    """The runs by comparing words at every distance."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    draw = random.Random(5)
    for _ in range(1500):
        n = draw.randint(0, 60)
        words = [draw.randrange(draw.choice((1, 2, 3, 5))) for _ in range(n)]
        if n > 4 and draw.random() < 0.5:
            a = draw.randrange(n)
            p = 1 + draw.randrange((n - a) // 3 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        for least, exponent in ((0, 2), (2, 3), (6, 4)):
            assert periodic.squares_to_runs(words, least, exponent) == brute_runs(words, least, exponent), words
        ((size, runs, _),) = periodic.runs_of([" ".join(map(str, words))])
        assert (size, runs) == (n, brute_runs(words))


def test_stretches_keep_texts_apart():
    texts = ["a a a a a a", "a a a", "b c " * 9 + "x " + "a a a a a a a", "a a a a a a"]
    assert [runs for _, runs, _ in periodic.runs_of(texts)] == [[(0, 6, 1)], [], [(0, 18, 2), (19, 7, 1)], [(0, 6, 1)]]
    assert [t for _, _, t in periodic.runs_of(texts)] == ["a", "a a a", "b c x a", "a"]


def test_query_matches_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in periodic.op11_periodic_runs(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    sha, some = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs, r = brute_runs(words), got[doc_id]
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{size},{q}\n" for s, size, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
        some += bool(runs)
    assert some > 5


def test_odd_rows(spark):
    odd = [(1, None, 7), (2, "", None), (None, "ä " * 8, 1), (2, " \t\n", 2), (3, "x y z " * 12_000, 3), (3, "x y z " * 12_000, 3), (4, "a b\u00a0a", 4)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, runs int")
    got = periodic.periodic_runs(docs.withColumn("start", F.lit("s"))).collect()
    assert len(got) == len(odd) and got[0].asDict().keys() == {"doc_id", "text", "start", "n_words", "runs", "collapsed"}
    by_id = {(r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got}
    assert by_id == {(1, 0): ([], ""), (2, 0): ([], ""), (None, 8): ([(0, 8, 1)], "ä"), (3, 36_000): ([(0, 36_000, 3)], "x y z"), (4, 2): ([], "a b\u00a0a")}
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    digests = periodic.run_digests(periodic.periodic_runs(periodic.with_cycles(docs))).collect()
    assert len(digests) == len(odd) and all(r["runs_sha256"] and r["collapsed_sha256"] for r in digests)


def test_ties_go_to_the_first_run(spark):
    text = "a a a a a a x b b b b b b y " + "c d " * 12
    row = periodic.run_digests(periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row["start"], row["length"], row["period"], row["exponent_milli"], row["n_runs"]) == (14, 24, 2, 12000, 3)
    row = periodic.run_digests(periodic.periodic_runs(spark.createDataFrame([(1, "a a a a a a x b b b b b b")], "doc_id long, text string"))).first()
    assert (row["start"], row["length"], row["period"]) == (0, 6, 1)
