"""License scans by template markup: templates become token automata, which accept texts with exactly the mandatory wording.

Markup of a template: plain words are mandatory; `<<beginOptional>> ... <<endOptional>>` may be absent, also nested;
`<<var;name="..";match=".{0,30}">>` stands for 0 to 30 words of any kind, and `match="one two|three"` for one of these wordings.
A template compiles to a nondeterministic automaton over words; its subsets of states are made while texts are read, and kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.common import lean_batches

#: Subsets of states that an automaton keeps before it begins anew.
KEPT_SUBSETS = 20_000

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: License wordings with their labels, as their authors publish them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    (
        "mit",
        """<<beginOptional>><<beginOptional>>The<<endOptional>> MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>>
        <<beginOptional>>Copyright <<var;name="copyright";match=".{1,30}">><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";match=".{1,12}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var;name="copyright";match=".{1,30}">><<endOptional>>
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";match=".{1,12}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";match=".{1,12}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """<<beginOptional>>Copyright <<var;name="copyright";match=".{1,30}">><<endOptional>> <<beginOptional>>All rights reserved.<<endOptional>>
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>><<var;name="bullet";match="1|a">><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>><<var;name="bullet";match="2|b">><<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.
        <<beginOptional>><<beginOptional>><<var;name="bullet";match="3|c">><<endOptional>> Neither the name of <<var;name="holder";match=".{1,12}">> nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;name="holder";match=".{1,12}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>>http<<beginOptional>>s<<endOptional>>://<<beginOptional>>www.<<endOptional>>apache.org/licenses/LICENSE-2.0<<endOptional>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """<<var;name="work";match="This program|This file|This library">> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version <<var;name="version";match="2|3">> of the License, or (at your option) any later version.""",
    ),
    ("mit", """<<var;name="verb";match="Released|Licensed|Distributed|Available">> under <<beginOptional>>the terms of<<endOptional>> the MIT License"""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0"""),
    (
        "gpl-3.0",
        """<<var;name="verb";match="Released|Licensed|Distributed|Available">> under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License<<beginOptional>>,<<endOptional>> version 3""",
    ),
    ("cc-by-nc-4.0", """<<var;name="verb";match="Released|Licensed|Distributed|Available">> under <<beginOptional>>a Creative Commons license<<endOptional>> CC BY-NC 4.0"""),
)

#: Everything that parts words, to a blank; bytes of other alphabets stay.
_PARTS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as bytes: runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PARTS).split()


_TAG = re.compile(r"<<(.*?)>>", re.S)
_ANY = re.compile(r"\.\{(\d+),(\d+)\}")


@dataclass
class Automaton:
    """The words of a template, its branches, and the subsets of states met so far."""

    #: (state, word or None for any word, next state)
    steps: list[tuple[int, bytes | None, int]] = field(default_factory=list)
    #: (state, state that it may go on as without a word)
    skips: list[tuple[int, int]] = field(default_factory=list)
    last: int = 0
    #: the state that accepts
    final: int = 0

    def word(self, state: int, word: bytes | None) -> int:
        self.last += 1
        self.steps.append((state, word, self.last))
        return self.last

    def finish(self) -> Automaton:
        """Tables of moves, once all steps are there."""
        near: dict[int, list[int]] = {}
        for a, b in self.skips:
            near.setdefault(a, []).append(b)
        self.reach = []
        for state in range(self.last + 1):
            seen, todo = {state}, [state]
            while todo:
                for b in near.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            self.reach.append(frozenset(seen))
        self.by_word: dict[int, dict[bytes | None, list[int]]] = {}
        for a, word, b in self.steps:
            self.by_word.setdefault(a, {}).setdefault(word, []).append(b)
        self.start = self.reach[0]
        self.moves: dict[frozenset[int], dict[bytes | None, frozenset[int]]] = {}
        self.known = {word for _, word, _ in self.steps}
        self.first = {w for s in self.start for w in self.by_word.get(s, ())}
        if self.final in self.start or None in self.first:
            raise ValueError("a template needs a mandatory word and can't begin with any word")
        return self

    def moved(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        """The states after one more word."""
        word = word if word in self.known else None  # all other words are alike
        table = self.moves.get(states)
        if table is None:
            if len(self.moves) >= KEPT_SUBSETS:
                self.moves.clear()
            table = self.moves[states] = {}
        found = table.get(word)
        if found is None:
            heads = (b for s in states for w in {word, None} for b in self.by_word.get(s, {}).get(w, ()))
            found = table[word] = frozenset().union(*(self.reach[b] for b in heads))
        return found

    def longest(self, words: Sequence[bytes], start: int) -> int:
        """The end of the longest accepted stretch from `start`; `start` itself if there is none."""
        states, best = self.start, start
        for at in range(start, len(words)):
            states = self.moved(states, words[at])
            if not states:
                break
            if self.final in states:
                best = at + 1
        return best

    def matches(self, words: Sequence[bytes], places: Sequence[int]) -> list[tuple[int, int]]:
        """[from, to) of the accepted stretches, leftmost longest, apart from each other. places: ascending, those where a stretch may begin."""
        out, at, first = [], 0, self.first
        for start in places:
            if start >= at and words[start] in first:
                end = self.longest(words, start)
                if end > start:
                    out.append((start, end))
                    at = end
        return out


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; an unknown or unbalanced tag is an error."""
    made, state, opened = Automaton(), 0, []
    for k, part in enumerate(_TAG.split(markup)):
        if k % 2 == 0:
            for word in words_of(part):
                state = made.word(state, word)
            continue
        tag, *pairs = re.split(r";(?=\w+=)", part.strip())
        options = dict(p.split("=", 1) for p in pairs)
        if tag == "beginOptional":
            opened.append(state)
        elif tag == "endOptional" and opened:
            made.skips.append((opened.pop(), state))
        elif tag == "var" and "match" in options:
            pattern = options["match"].strip('"')
            if any_words := _ANY.fullmatch(pattern):
                least, most = map(int, any_words.groups())
                leave = []
                for n in range(most):
                    if n >= least:
                        leave.append(state)
                    state = made.word(state, None)
                made.skips += [(s, state) for s in leave]
            else:
                begin, ends = state, []
                for wording in pattern.split("|"):
                    state = begin
                    for word in words_of(wording):
                        state = made.word(state, word)
                    ends.append(state)
                made.skips += [(s, state) for s in ends[:-1]]
        else:
            raise ValueError(f"unknown or unbalanced tag {part!r}")
    if opened:
        raise ValueError("an optional region isn't closed")
    made.final = state
    return made.finish()


class Scanner:
    """Phrases and templates, compiled once a task."""

    def __init__(self, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]]):
        self.phrases = [(tuple(words_of(phrase)), label) for phrase, label in phrases.items()]
        self.templates = [(label, compile_template(markup)) for label, markup in templates]
        self.heads = {p[0] for p, _ in self.phrases}.union(*(a.first for _, a in self.templates))

    def scan(self, text: str | None) -> tuple[int, list[int], set[str], set[str], float, list[tuple[int, int, str]]]:
        """Words, starts of phrases, labels of phrases, all labels, score, spans of templates (from, to, label)."""
        words = words_of(text)
        heads = self.heads
        places = [i for i, w in enumerate(words) if w in heads]
        starts, base, most, spans = [], set(), 0, []
        for phrase, label in self.phrases:
            size = len(phrase)
            found = [i for i in places if tuple(words[i : i + size]) == phrase]
            if found:
                starts += found
                base.add(label)
                most = max(most, size * len(found))
        for label, automaton in self.templates:
            found = automaton.matches(words, places)
            spans += [(a, b, label) for a, b in found]
            most = max(most, sum(b - a for a, b in found))
        return len(words), starts, base, base | {label for *_, label in spans}, min(1.0, most / len(words)) if words else 0.0, sorted(spans)


_SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())])
ADDED = {
    "n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(),
    "labels": T.StringType(), "score": T.DoubleType(), "spans": T.ArrayType(_SPAN),
}


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """`docs` (needs text; other columns pass) plus the columns of ADDED.

    n_base, first_word, last_word: all places of phrases, their smallest and largest first word (from 0; null without any). spans: stretches
    [first, end) of words that a template accepts, of each template the leftmost and longest ones, apart from each other. score: the share of the text's words
    that the phrase or template covers which covers most (0 without words). Whole texts of any length; a null text is empty, without labels.
    Rows are independent: repeated rows get equal answers, an empty table gives none; columns of these names are replaced. No shuffle. A start costs at most
    the longest text that its template accepts, so time is linear in a text's words.
    """
    lean_batches(docs.sparkSession)
    plain, rules, wording = docs.drop(*ADDED), dict(phrases), tuple(templates)
    Scanner(rules, wording)  # a faulty template fails here

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, wording)
        for batch in batches:
            rows = [scanner.scan(text.as_py()) for text in batch.column("text")]
            added = {
                "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "n_base": pa.array([len(r[1]) for r in rows], pa.int64()),
                "first_word": pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                "last_word": pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                "base_labels": pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                "labels": pa.array([",".join(sorted(r[3])) for r in rows], pa.string()),
                "score": pa.array([r[4] for r in rows], pa.float64()),
                "spans": pa.array([[{"first": a, "end": b, "label": x} for a, b, x in r[5]] for r in rows], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
            }
            columns = {name: batch.column(name) for name in batch.schema.names} | added
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return plain.mapInArrow(scan, T.StructType([*plain.schema.fields, *(T.StructField(n, t) for n, t in ADDED.items())]))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license wordings of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text", "spans")


def as_regex(markup: str) -> str:
    """The template as a regular expression over words in angle brackets: how SQL and tests find what the automaton finds."""
    out = []
    for k, part in enumerate(_TAG.split(markup)):
        if k % 2 == 0:
            out += [f"<{w.decode()}>" for w in words_of(part)]
        elif part.startswith("var"):
            pattern = re.search(r'match="(.*?)"', part, re.S)[1]
            wordings = ["".join(f"<{w.decode()}>" for w in words_of(p)) for p in pattern.split("|")]
            out.append(f"(?:<[^>]*>){{{','.join(_ANY.fullmatch(pattern).groups())}}}" if _ANY.fullmatch(pattern) else f"(?:{'|'.join(wordings)})")
        else:
            out.append("(?:" if part == "beginOptional" else ")?")
    return "".join(out)


def _sql() -> str:
    phrases = ", ".join(f"('{label}', '{phrase}')" for phrase, label in PHRASES.items())
    found = ",\n  ".join(f"struct_pack(label := '{label}', n := len(regexp_extract_all(array_to_string(regexp_extract_all(line, '{as_regex(markup)}'), ''), '<')))" for label, markup in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(label, phrase) AS (VALUES {phrases}),
b AS (
  SELECT doc_id, label, len(string_split(phrase, ' ')) AS size, unnest(list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase)) AS i
  FROM d, p WHERE list_contains(w, 'license')),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS names FROM b GROUP BY 1),
most AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, sum(size) AS n FROM b GROUP BY doc_id, label) GROUP BY 1),
t AS (SELECT *, list_filter([{found}], lambda x: x.n > 0) AS hits FROM (SELECT doc_id, w, '<' || array_to_string(w, '><') || '>' AS line FROM d))
SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(names), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), list_transform(hits, lambda x: x.label)))), ',') AS labels,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE least(1.0, greatest(coalesce(most.n, 0), coalesce(list_max(list_transform(hits, lambda x: x.n)), 0)) / len(w)::DOUBLE) END AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN most USING (doc_id)
"""


OP13_SQL = _sql()
