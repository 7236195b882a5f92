"""License scan by template markup: optional and replaceable regions compiled into token automata.

Markup of a template:

    <<beginOptional>> ... <<endOptional>>        wording that may be missing (regions nest)
    <<var;name="...";match="..."[;max=N]>>       words that match the expression in full, each: 1..N, or any number

A region of any number of words goes on until the mandatory words that follow it lead to the template's end for the first
time; a template without such words is an error.

All other words are mandatory and have to match exactly, in order and without gaps. Words are those of
`common.word_bytes`; case and punctuation don't count. A template is accepted where its automaton, started at a word,
reaches its end. Only words that can start a template are tried, and only in texts that hold all the template's
mandatory words.

Besides, fixed phrases are looked up ("base" places).

Nulls and edge cases: a null or empty text has no words and no places, and score 0; repeated rows come out each; a
null doc_id stays null; extra columns are ignored; there is no limit on a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import word_bytes

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: "version 3", "v3", "v. 3", "3.0": a release in any of the usual forms, for %.
VERSION = '<<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> <<var;name="version";match="v?%s";max=1>> <<beginOptional>>0<<endOptional>>'

#: Public wording of notices, in template markup, by label.
TEMPLATES = {
    "apache-2.0": f"licensed under the apache license {VERSION % 2} <<beginOptional>> (the License); you may not use this file except in compliance with the License<<endOptional>>",
    "gpl-2.0": f"<<beginOptional>>the<<endOptional>> gnu general public license<<beginOptional>> as published by the free software foundation; either<<endOptional>> {VERSION % 2} <<beginOptional>> of the license, or (at your option) any later version<<endOptional>>",
    "gpl-3.0": f"<<beginOptional>>the<<endOptional>> gnu general public license<<beginOptional>> as published by the free software foundation; either<<endOptional>> {VERSION % 3} <<beginOptional>> of the license, or (at your option) any later version<<endOptional>>",
    "cc-by-4.0": "licensed under <<beginOptional>>a <<endOptional>>cc by 4.0<<beginOptional>> international license<<endOptional>>",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a <<endOptional>>cc by sa 4.0<<beginOptional>> international license<<endOptional>>",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a <<endOptional>>cc by nc 4.0<<beginOptional>> international license<<endOptional>>",
    "mit-notice": '<<beginOptional>>released <<endOptional>><<beginOptional>>licensed <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>mit license',
    "mit-text": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "copyright-notice": 'copyright <<beginOptional>>c <<endOptional>><<var;name="year";match="(19|20)[0-9][0-9]">> <<var;name="holder";match=".+">> all rights reserved',
}

SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long, spans array<struct<label:string,first:long,last:long>>"


@dataclass
class Automaton:
    """States with steps by word or by expression, and empty steps. State 0 starts, `final` ends."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    tests: list[list[tuple[re.Pattern, int]]] = field(default_factory=lambda: [[]])
    empty: list[list[int]] = field(default_factory=lambda: [[]])
    mandatory: list[bytes] = field(default_factory=list)
    #: State of a region of any number of words, and the state behind the mandatory words after it: those words.
    loops: dict[tuple[int, int], list[bytes]] = field(default_factory=dict)
    final: int = 0

    def state(self) -> int:
        self.words.append({})
        self.tests.append([])
        self.empty.append([])
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def starts(self) -> tuple[set[bytes], bool]:
        """Words that can come first; whether an expression can."""
        own = self.closure({0})
        return {w for s in own for w in self.words[s]}, any(self.tests[s] for s in own)

    def match(self, words: list[bytes], at: int, last: dict[int, int] | None = None) -> int:
        """End of the longest match that starts at word `at`, regions of any number of words being as short as can be; -1
        if there is none. last: where the words that end such a region are met last, by its state."""
        states, end, i = self.closure({0}), -1, at
        while states:
            if self.final in states:
                end = i
                states = {s for s in states if not any(low <= s < high for low, high in self.loops)}
            if last:
                states = {s for s in states if last.get(s, i) >= i}
            if i == len(words):
                break
            w, after = words[i], set()
            for s in states:
                if w in self.words[s]:
                    after.add(self.words[s][w])
                after.update(to for test, to in self.tests[s] if test.fullmatch(w))
            states, i = self.closure(after), i + 1
        return end


def compile_template(label: str, markup: str) -> Automaton:
    a, at, open_regions, waiting = Automaton(label), 0, [], []
    for part in re.split(r"(<<.*?>>)", markup):
        if part == "<<beginOptional>>":
            open_regions.append(at)
        elif part == "<<endOptional>>":
            if not open_regions:
                raise ValueError(f"{label}: a region ends that didn't begin")
            to = a.state()
            a.empty[at].append(to)
            a.empty[open_regions.pop()].append(to)
            at = to
        elif part.startswith("<<var;"):
            test = re.compile(re.search(r'match="(.*?)"', part)[1].encode())
            most = int(m[1]) if (m := re.search(r"max=(\d+)", part)) else 0
            if not most:
                to = a.state()
                a.tests[at].append((test, to))
                a.tests[to].append((test, to))
                waiting.append((to, len(open_regions)))
                at = to
                continue
            ends = []
            for _ in range(most):
                to = a.state()
                a.tests[at].append((test, to))
                ends.append(to)
                at = to
            for s in ends[:-1]:
                a.empty[s].append(at)
        elif part.startswith("<<"):
            raise ValueError(f"{label}: unknown markup {part}")
        else:
            for w in word_bytes(part):
                to = a.state()
                a.words[at][w] = to
                at = to
                if not open_regions:
                    a.mandatory.append(w)
            if word_bytes(part):
                a.loops.update({(s, at): word_bytes(part) for s, depth in waiting if depth >= len(open_regions)})
                waiting = [w for w in waiting if w[1] < len(open_regions)]
    if open_regions:
        raise ValueError(f"{label}: a region didn't end")
    if waiting:
        raise ValueError(f"{label}: no mandatory words end a region of any number of words")
    a.final = at
    return a


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(b" " + b" ".join(word_bytes(p)) + b" ", label) for p, label in phrases.items()]
        self.automata = [compile_template(label, m) for label, m in templates.items()]
        for a in self.automata:
            if not a.mandatory or a.starts()[1]:
                raise ValueError(f"{a.label}: a template has to start with a word and to hold mandatory ones")
        self.first = [a.starts()[0] for a in self.automata]
        #: The longest mandatory word is a rare one; a text without it is done with.
        self.rare = [b" " + max(a.mandatory, key=len) + b" " for a in self.automata]

    def scan(self, text: str | None) -> tuple:
        words = word_bytes(text)
        if not words:
            return 0, 0, None, None, "", "", 0.0, 0, []
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.phrases:
            at, before, word = joined.find(phrase), 0, 0
            while at >= 0:
                word, before = word + joined.count(b" ", before, at), at
                places.append(word)
                base.add(label)
                at = joined.find(phrase, at + 1)
        spans, known = [], None
        for a, first, rare in zip(self.automata, self.first, self.rare, strict=True):
            if rare not in joined:
                continue
            known = known or set(words)
            if not known.issuperset(a.mandatory):
                continue
            last = {}
            for (state, _), ends in a.loops.items():
                found = joined.rfind(b" " + b" ".join(ends) + b" ")
                last[state] = joined.count(b" ", 0, found) if found >= 0 else -1
            i = 0
            while i < len(words):
                end = a.match(words, i, last) if words[i] in first else -1
                if end > i:
                    spans.append((a.label, i, end - 1))
                    i = end
                else:
                    i += 1
        found = sorted(base | {s[0] for s in spans})
        score = 1.0 if spans else 0.5 if places else 0.0
        return (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(found), score,
            len(spans), [{"label": label, "first": a, "last": b} for label, a, b in spans],
        )


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Labels, places and spans (in words, from 0) of each whole text. One narrow pass, no shuffle.

    score: 1 where a template's wording is met, 0.5 where only a phrase is, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))]
        names = [c.strip().split()[0] for c in SCANNED.split("spans")[0].split(",") if c.strip()] + ["spans"]
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = [scanner.scan(t) for t in b.column(1).slice(at, 1024).to_pylist()]
                yield pa.record_batch([b.column(0).slice(at, 1024), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)
