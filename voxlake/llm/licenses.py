"""License scan: template markup compiled to token automata, run over the words of each text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm import textops

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: License wording in template markup. <<beginOptional>>...<<endOptional>> may be left out;
#: <<var;name=...;match=...>> stands for words that match the pattern, joined by single spaces.
DISCLAIMER = """ IN NO EVENT SHALL <<var;name=holder;match=.{1,200}>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. """
AS_IS = """THIS SOFTWARE IS PROVIDED BY <<var;name=provider;match=.{1,200}>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
TEMPLATES = {
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at<<beginOptional>> http://www.apache.org/licenses/LICENSE-2.0<<endOptional>><<beginOptional>> https://www.apache.org/licenses/LICENSE-2.0<<endOptional>> Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """<<beginOptional>><<beginOptional>>The <<endOptional>>MIT License<<beginOptional>> (MIT)<<endOptional>><<endOptional>> <<beginOptional>>Copyright (c) <<var;name=copyright;match=.{0,200}>><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice<<beginOptional>> (including the next
paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;match=.{1,200}>> BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright (c) <<var;name=copyright;match=.{0,200}>><<endOptional>> Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>>
distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND <<var;name=author;match=.{1,200}>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL <<var;name=holder;match=.{1,200}>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": BSD + AS_IS + DISCLAIMER,
    "BSD-3-Clause": BSD + """<<beginOptional>>3. <<endOptional>>Neither the name of <<var;name=organization;match=.{1,200}>> nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """ + AS_IS + DISCLAIMER,
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version <<var;name=version;match=[23]>> of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.<<beginOptional>> You
should have received a copy of the GNU General Public License along with this program.<<beginOptional>> If not, see<<beginOptional>>
<<var;name=address;match=(https? )?www gnu org licenses>><<endOptional>><<endOptional>><<endOptional>>""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "MIT-statement": """<<var;name=verb;match=released|licensed|distributed|available>> under the <<beginOptional>>terms of the <<endOptional>>MIT License""",
}
MARK = re.compile(r"<<(.*?)>>", re.S)
BOUNDED = re.compile(r"\.\{\d*,(\d+)\}")


def widest(pattern: str) -> float:
    """Characters that a pattern can match at most: b of ``.{a,b}``; a pattern without repetition or escapes, one for each of its own; of others, no limit."""
    if m := BOUNDED.fullmatch(pattern):
        return int(m[1])
    return math.inf if re.search(r"[+*{\\]", pattern) else len(pattern)


class Automaton:
    """A nondeterministic token automaton. ``step[s]`` lists (word, next), ``free[s]`` next states without a word,
    and ``var[s]`` (pattern, its widest match, next): some words whose joined text matches the pattern."""

    def __init__(self, template: str):
        self.step: list[dict[str, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.var: list[list[tuple[re.Pattern, float, int]]] = [[]]
        self.mandatory = 0
        at, opened, place = 0, [], 0
        for m in [*MARK.finditer(template), None]:
            for word in WORD.findall(template[place : m.start() if m else len(template)].lower()):
                new = self._state()
                self.step[at].setdefault(word, []).append(new)
                at = new
                self.mandatory += not opened
            if m is None:
                break
            place, kind = m.end(), m[1].split(";", 1)[0].strip()
            if kind == "beginOptional":
                opened.append(at)
            elif kind == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                new = self._state()
                self.free[at].append(new)
                self.free[opened.pop()].append(new)
                at = new
            elif kind == "var":
                new = self._state()
                given = re.search(r"match=(.*)$", m[1], re.S)
                pattern = given[1] if given else r".+"
                self.var[at].append((re.compile(pattern), widest(pattern), new))
                at = new
            else:
                raise ValueError(f"unknown markup: {m[0]}")
        if opened:
            raise ValueError("beginOptional without endOptional")
        if not self.mandatory:
            raise ValueError("a template needs mandatory wording")
        self.final = at
        #: Mandatory words; a text without one of them can't match.
        self.needed = {w for s, d in enumerate(self.step) for w, to in d.items() if self._cut(s, w)}

    def _state(self) -> int:
        self.step.append({})
        self.free.append([])
        self.var.append([])
        return len(self.step) - 1

    def _cut(self, state: int, word: str) -> bool:
        """Whether the final state can't be reached without this step."""
        seen, todo = set(), [0]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.free[s] + [n for *_, n in self.var[s]] + [n for w, to in self.step[s].items() if (s, w) != (state, word) for n in to]
        return self.final not in seen

    def _closure(self, states: set[int]) -> set[int]:
        todo = [*states]
        while todo:
            for n in self.free[todo.pop()]:
                if n not in states:
                    states.add(n)
                    todo.append(n)
        return states

    @property
    def starts(self) -> tuple[set[str], bool]:
        """Words that can come first, and whether a variable region can."""
        first = self._closure({0})
        return {w for s in first for w in self.step[s]}, any(self.var[s] for s in first)

    def longest(self, words: list[str], begin: int) -> int:
        """End of the longest run of words from ``begin`` that is accepted, or -1."""
        best, at, waiting, now = -1, begin, {}, self._closure({0})
        while now or waiting:
            if self.final in now:
                best = at
            for s in now:
                for pattern, most, new in self.var[s]:
                    taken = ""
                    for k in range(len(words) - at + 1):
                        taken += (" " if k > 1 else "") + words[at + k - 1] if k else ""
                        if len(taken) > most:
                            break
                        if pattern.fullmatch(taken):
                            if k:
                                waiting.setdefault(at + k, set()).add(new)
                            elif new not in now:
                                waiting.setdefault(at, set()).add(new)
            if more := waiting.pop(at, None):
                now = self._closure({*now, *more})
                continue
            if at == len(words):
                break
            now = self._closure({n for s in now for n in self.step[s].get(words[at], ())} | waiting.pop(at + 1, set()))
            at += 1
        return best


@lru_cache(16)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(name, Automaton(text)) for name, text in templates]


def scan(words: list[str], phrases: dict[str, str], automata: list[tuple[str, Automaton]]) -> dict:
    """Places of phrases and accepted templates in one text's words."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    base, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        found = [i for i in places.get(p[0], ()) if words[i : i + len(p)] == p]
        base += found
        labels |= {label} if found else set()
    covered, spans = np.zeros(len(words), bool), []
    for name, a in automata:
        if not all(w in places for w in a.needed):
            continue
        first, anywhere = a.starts
        begins = range(len(words)) if anywhere else sorted({i for w in first for i in places.get(w, ())})
        done = 0
        for i in begins:
            if i >= done and (end := a.longest(words, i)) > i:
                spans.append((name, i, end))
                covered[i:end] = True
                done = end
    return {"base": base, "base_labels": labels, "spans": spans, "covered": int(covered.sum())}


def license_scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Every row of ``docs`` with one more column, the struct ``license``.

    Words are runs of ASCII letters and digits and of any other non-ASCII characters, with A-Z lower-cased.
    ``spans``: accepted templates as (template, first word, end word), the longest from each start, not overlapping
    for one template. ``labels``: the phrases' labels and the names of accepted templates. ``score``: the share of
    the text's words inside accepted templates. A template's mandatory words must all be there, in order;
    a variable region takes as many words as its pattern can match. A pattern whose matches have no bound is
    tried on all that follows, in quadratic time; the given ones have one.

    Null and empty texts have no words and no labels, and score 0. Texts are read whole. Repeated rows get
    equal results each. A column named ``license`` that was there before is replaced.
    """
    table = bytes(ord(" ") if textops.NOT_ALNUM[i] else i for i in range(256))
    listed = tuple(templates.items())
    #: A text can only hold a phrase or template if it holds one of these.
    hints = sorted({min(p.split(), key=lambda w: (-len(w), w)).encode() for p in phrases})

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<template: string, first: int, end: int>>, score double")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = compiled(listed)
        keys = [*{*hints, *(max(sorted(a.needed), key=len).encode() for _, a in automata)}]
        for texts in batches:
            rows = []
            for t in texts:
                b = (t if isinstance(t, str) else "").encode().lower().translate(table)
                n = len(b.split())
                if not any(k in b for k in keys):
                    rows.append((n, 0, None, None, [], [], [], 0.0))
                    continue
                r = scan([w.decode() for w in b.split()], phrases, automata)
                rows.append((n, len(r["base"]), min(r["base"], default=None), max(r["base"], default=None), sorted(r["base_labels"]), sorted(r["base_labels"] | {x[0] for x in r["spans"]}), [dict(zip(("template", "first", "end"), x, strict=True)) for x in r["spans"]], r["covered"] / max(n, 1)))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.withColumn("license", scanned(F.col(text_col)))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    r = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = [F.array_join(f"license.{c}", ",").alias(c) for c in ("base_labels", "labels")]
    return r.select("doc_id", *(f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word")), *joined, "license.score", F.size("license.spans").alias("n_spans"))
