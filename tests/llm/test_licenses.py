"""Templates against whole license texts, and the scan's columns against plain counting."""

import re

import pytest
from pyspark.sql import functions as F

from voxlake.llm import licenses

MARKUP = re.compile(r"<<(beginOptional|endOptional|var;name=(\w+);match=.*?)>>", re.S)
FILL = {"holder": "the copyright holders and contributors", "provider": "ACME Corp.", "copyright": "2020 A. Person", "author": "THE AUTHOR", "organization": "the ACME project", "version": "3", "address": "https www gnu org licenses", "verb": "Released"}


def filled(template, optional):
    """The template's wording, with or without its optional parts."""
    out, depth, at = [], 0, 0
    for m in [*MARKUP.finditer(template), None]:
        if optional or not depth:
            out.append(template[at : m.start() if m else len(template)])
        if m is None:
            return "".join(out)
        at, kind = m.end(), m[1]
        depth += (kind == "beginOptional") - (kind == "endOptional")
        if kind.startswith("var") and (optional or not depth):
            out.append(FILL[m[2]])


def found(text):
    words = licenses.WORD.findall(text.lower())
    return {s[0]: s[1:] for s in licenses.scan(words, licenses.PHRASES, licenses.compiled(tuple(licenses.TEMPLATES.items())))["spans"]}


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
@pytest.mark.parametrize("optional", [False, True])
def test_whole_texts_are_accepted_and_changed_ones_are_not(name, optional):
    text = filled(licenses.TEMPLATES[name], optional)
    words = licenses.WORD.findall(text.lower())
    first, end = found(f"some text before; {text}\n\nand after it")[name]
    assert (end - first, first) == (len(words), 3)
    # all of the mandatory wording has to be there
    needed = licenses.WORD.findall(filled(licenses.TEMPLATES[name], False).lower())
    for drop in {len(needed) // 3, len(needed) // 2, len(needed) - 1}:
        if needed[drop] not in " ".join(FILL.values()).lower():
            assert name not in found(" ".join(needed[:drop] + needed[drop + 1 :]))


ROWS = [(1, None), (2, ""), (3, "The GNU General Public-License, or Apache\nLicense; CC BY. cc-by MIT license mit licenses"), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "x " * 50000 + "apache license"), (4, "É-mit License ß")]


def test_scan_equals_plain_counting(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", F.lit("clash").alias("license"), F.lit("c").alias("score"))
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(ROWS) and licenses.license_scan(docs.where("false")).count() == 0
    for (i, text), r in zip(ROWS, got, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = r.license
        assert (r.doc_id, x.n_words, x.n_base, x.base_labels) == (i, len(w), len(places), sorted({label for _, label in places}))
        assert (x.first_word, x.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert x.labels == sorted({*x.base_labels, *(s.template for s in x.spans)}) and x.score == sum(s.end - s.first for s in x.spans) / max(len(w), 1)


@pytest.mark.parametrize("n,accepted", [(40, True), (41, True), (100, True), (101, False)])
def test_variable_regions_take_what_their_pattern_takes(n, accepted):
    """A holder of n words of one letter has 2 n - 1 characters; the pattern takes 200."""
    holder = " ".join("x" * n)
    text = MARKUP.sub(lambda m: holder if m[2] else "", licenses.TEMPLATES["ISC"])
    assert ("ISC" in found(text)) == accepted


def test_widest_matches():
    assert [licenses.widest(p) for p in (".{1,200}", "a|bc", "(https? )?x", ".+", r"\d")] == [200, 4, 11, float("inf"), float("inf")]
