"""License scans against regular expressions over the same words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses

SCANNER = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)


def filled(markup, draw):
    """A text that a template accepts: regions kept or left out, words of its own choice."""
    out, skipped = [], []
    for k, part in enumerate(re.split(r"<<(.*?)>>", markup, flags=re.S)):
        if part == "endOptional":
            skipped.pop()
        elif part == "beginOptional":
            skipped.append(draw.random() < 0.5)
        elif any(skipped):
            continue
        elif k % 2 == 0:
            out.append(part)
        else:
            pattern = re.search(r'match="(.*?)"', part, re.S)[1]
            bounds = re.fullmatch(r"\.\{(\d+),(\d+)\}", pattern)
            out.append(" ".join(draw.choices(["Zorro", "née", "12", "X"], k=draw.randint(*map(int, bounds.groups())))) if bounds else draw.choice(pattern.split("|")))
    return " ".join(out)


def test_filled_templates_are_accepted_and_changed_words_are_not():
    draw = random.Random(4)
    for _ in range(30):
        for label, markup in licenses.TEMPLATES:
            text = filled(markup, draw)
            automaton = licenses.compile_template(markup)
            words = licenses.words_of(text)
            assert automaton.longest(words, 0) == len(words), (label, text)
            mandatory = licenses.words_of(re.sub(r"<<beginOptional>>.*?<<endOptional>>|<<.*?>>", " ", markup, flags=re.S))
            last = len(words) - 1
            assert words[last] == mandatory[-1]
            assert automaton.longest([*words[:last], b"otherwise"], 0) == 0


def test_scan_matches_regular_expressions():
    draw = random.Random(9)
    for _ in range(60):
        parts = [draw.choice(["under", "the", "MIT license", "GPL", "Copyright 2020 Zorro", "Released", "Version 2.0", filled(draw.choice(licenses.TEMPLATES)[1], draw)]) for _ in range(draw.randint(0, 12))]
        text = " ".join(parts)
        line = "".join(f"<{w.decode()}>" for w in licenses.words_of(text))
        _, _, _, labels, _, spans = SCANNER.scan(text)
        found = {label for label, markup in licenses.TEMPLATES if re.search(licenses.as_regex(markup), line)}
        assert {label for *_, label in spans} == found and found <= labels
        for label, markup in licenses.TEMPLATES:
            sizes = sorted(m.count("<") for m in re.findall(licenses.as_regex(markup), line))
            assert sorted(b - a for a, b in licenses.compile_template(markup).matches(licenses.words_of(text), range(len(licenses.words_of(text))))) == sizes


def test_base_phrases_and_score():
    n, starts, base, labels, score, spans = SCANNER.scan("MIT-License, the mit  license; GNU General public LICENSE mit licenses äMIT license")
    assert (n, sorted(starts), base, labels) == (13, [0, 3, 6], {"mit", "gpl"}, {"mit", "gpl"}) and score == 4 / 13 and not spans
    assert SCANNER.scan("Released under the MIT License.")[4:] == (1.0, [(0, 5, "mit")])


@pytest.mark.parametrize("markup", ["<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>", "<<other>> a", '<<var;match=".{1,2}">> a', ""])
def test_faulty_templates(markup):
    with pytest.raises(ValueError):
        licenses.compile_template(markup)


def test_subsets_are_bounded(monkeypatch):
    monkeypatch.setattr(licenses, "KEPT_SUBSETS", 5)
    automaton = licenses.compile_template('<<var;match="a|b">> <<var;match=".{0,20}">> a b')
    draw = random.Random(2)
    words = [draw.choice([b"a", b"b"]) for _ in range(500)]
    line = "".join(f"<{w.decode()}>" for w in words)
    want = [(m.start() // 3, m.end() // 3) for m in re.finditer("<[ab]>(?:<[^>]*>){0,20}<a><b>", line)]
    assert automaton.matches(words, range(len(words))) == want and len(automaton.moves) <= 5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (None, "Licensed under the Apache License, Version 2.0."), (4, "word " * 40_000 + "mit license"), (5, "mit license " * 3), (5, "mit license " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"labels": F.lit(1), "phrase": F.lit("x")})
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan_licenses(docs).collect()}
    assert {k: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for k, r in got.items()} == {
        (1, 0): (0, None, None, "", ""), (2, 0): (0, None, None, "", ""), (3, 0): (0, None, None, "", ""), (None, 8): (1, 3, 3, "apache", "apache,apache-2.0"),
        (4, 40_002): (1, 40_000, 40_000, "mit", "mit"), (5, 6): (3, 0, 4, "mit", "mit"),
    }
    assert got[None, 8]["score"] == 1.0 and got[5, 6]["score"] == 1.0 and got[1, 0]["score"] == 0.0 and got[1, 0]["phrase"] == "x"
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
