"""Tries of conversations against nested dictionaries."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import turn_trie


def brute_nodes(paths):
    """Rows of the trie of {conv_id: [(code, words), ...]}."""
    nodes = defaultdict(lambda: {"members": [], "ends": [], "kids": set(), "words": 0})
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            node = nodes[tuple(c for c, _ in path[:d])]
            node["members"].append(conv)
            node["words"] = path[d - 1][1] if d else 0
            if d < len(path):
                node["kids"].add(path[d][0])
            else:
                node["ends"].append(conv)
    out = []
    for key, node in nodes.items():
        below = [v for k, v in nodes.items() if k[: len(key)] == key]
        ends = ",".join(map(str, sorted(node["ends"])))
        out.append((
            min(node["members"]), len(key), min(nodes[key[:-1]]["members"]) if key else None, len(node["members"]), len(node["kids"]),
            sum(not v["kids"] for v in below), sum((len(v["members"]) - 1) * v["words"] for v in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie(spark, paths, **options):
    turns = spark.createDataFrame([(c, k, code, n) for c, p in paths.items() for k, (code, n) in enumerate(p)], "conv_id long, pos long, code string, words long")
    members = spark.createDataFrame([(c,) for c in paths], "conv_id long")
    return sorted((tuple(r) for r in turn_trie.prefix_trie(turns, members, **options).select(*turn_trie.RESULT).collect()), key=repr)


def test_shards_and_pieces_match_brute_force(spark):
    draw = random.Random(3)
    size = {"a": 3, "b": 5, "c": 7}
    paths = {c: [(x, size[x]) for x in draw.choices("abc", k=draw.randint(0, 7))] for c in range(-5, 40)}
    paths |= {100 + c: [("a", 3), ("b", 5)] for c in range(30)}  # a hot group of copies
    paths[7] = [(draw.choice("ab"), 4) for _ in range(40)]
    paths[8] = paths[7][:33]
    paths = {c: [(x, size[x]) for x, _ in p] for c, p in paths.items()}
    want = brute_nodes(paths)
    assert trie(spark, paths, shards=9, chunk=3, piece_ids=2) == want
    assert trie(spark, paths, shards=1) == want


def test_medians_keep_searches_short():
    assert sorted(turn_trie.medians(100)) == list(range(100))
    grown = turn_trie.TernaryTrie(0, 0, 0)
    for k in turn_trie.medians(1023):
        grown.insert([k], [(k, k)], [1])
    depth = {grown.first[0]: 1}
    for x in range(1, len(grown.code)):
        for side in (grown.low[x], grown.high[x]):
            if side:
                depth[side] = depth[x] + 1
    assert max(depth.values()) == 10


def test_turns_are_numbered_over_ranges(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (1, 2, 3) for t in range(400 if c == 2 else 5)]
    random.Random(1).shuffle(rows)
    got = turn_trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).join(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", turn_trie.turn_code(F.col("role"), F.col("text")).alias("code")), ["conv_id", "code"]
    )
    assert got.count() == len(rows) and got.filter("pos <> turn").count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "a b"), (1, 1, "user", ""), (2, 1, "", ""), (2, 1, "", ""), (None, 1, "user", "lost"), (3, 5, "user", "w " * 50_000), (3, 5, "user", "w " * 50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("x"), "code": F.lit(1)})
    got = sorted((tuple(r) for r in turn_trie.prefix_trie(turn_trie.numbered_turns(table)).select(*turn_trie.RESULT).collect()), key=repr)
    w = ("w", 50_000)
    assert got == brute_nodes({1: [("", 0), ("user", 0), ("user a b", 2)], 2: [("", 0), ("", 0)], 3: [w, w]})
    none = turn_trie.numbered_turns(table.limit(0))
    assert turn_trie.prefix_trie(none).count() == 0
    assert turn_trie.prefix_trie(*turn_trie.grafted(none)).count() == 0
    alone = trie(spark, {5: [], 9: []})
    assert alone == brute_nodes({5: [], 9: []})


def test_code_parts_role_from_text(spark):
    pairs = [("a", "bc"), ("ab", "c"), ("", "abc"), ("1:a", "")]
    assert spark.createDataFrame(pairs, "role string, text string").select(turn_trie.turn_code(F.col("role"), F.col("text"))).distinct().count() == 4
