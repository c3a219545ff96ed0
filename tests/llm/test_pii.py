"""Base spans against the plain patterns, and sanitisation against counting in plain Python."""

import math
import re
import time

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def good(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m[0])]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("a@.-+ 1é", max_size=30), st.text("0123456789. -+()", max_size=40), st.lists(st.sampled_from(["a.b@c-d.e", "@", "_x@y.z", "4111 1111 1111 1111", "1.2.3.4", ".255", "256.1.1.1", "+1 (234) 555-0000", "٣", " ", "."]), max_size=8).map("".join)))
@example("a@b.c_d@e.f@g.h")
@example("1.2.3.4.5.6.7.8.9")
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["1" * 10**6, "@" + "a" * 10**6, "a" * 10**6 + "@", "1." * 500_000, "1 " * 500_000, "+" + "1(" * 500_000, "+1" * 500_000, "a@" * 500_000, "a@b.c" * 200_000])
def test_base_spans_of_long_texts_take_linear_time(text):
    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 5


def plain_sanitise(rows, alpha=0.95, support=2):
    """{row: (base, terms, clean)} by counting over the distinct texts."""
    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    kind = lambda t: "<NUMBER>" if re.search(r"[0-9]", t) else "<NAME>" if re.match(r"[A-ZÀ-Þ]", t) else "<WORD>"
    texts = {t or "" for _, t in rows}
    terms, entities = {}, {}
    for t in texts:
        base = plain_spans(t)
        entities[t] = {(k, re.sub(r"[\x20\x09-\x0D]", "_", t[s:e])) for k, s, e in base}
        free = [m for m in words.finditer(t) if not any(s < m.end() and m.start() < e for _, s, e in base)]
        terms[t] = {m[0] for m in free} | {kind(m[0]) for m in free}
    n = len(texts)
    # a term's own count is over all its places, beside spans too
    holds = {t: {m[0] for m in words.finditer(t)} | {kind(m[0]) for m in words.finditer(t)} for t in texts}
    told = {}
    for c in {c for e in entities.values() for c in e}:
        mine = [t for t in texts if c in entities[t]]
        if len(mine) < support or len(mine) == n:
            continue
        known = set()
        for w in {w for t in mine for w in terms[t]}:
            both = sum(w in terms[t] for t in mine)
            if both >= support and math.log2(both * n / (len(mine) * sum(w in holds[t] for t in texts))) >= alpha * math.log2(n / len(mine)) - 1e-12:
                known.add(w)
        for w in known:
            if w not in pii.SHAPES:
                told[w] = told.get(w, True) and kind(w) not in known
    out = []
    for i, t in rows:
        base = plain_spans(t or "")
        hits = [("generalise" if told[m[0]] else "remove", *m.span(), kind(m[0])) for m in words.finditer(t or "") if m[0] in told and not any(s < m.end() and m.start() < e for _, s, e in base)]
        out.append((i, t, base, hits))
    return out


ROWS = [
    (1, "ann@x.org wrote. " + "filler word " * 30 + "Signed Annabel Smith"),
    (2, "Annabel Smith says hello from far away; nothing more of the filler word"),
    (3, "mail ann@x.org " + "some filler word here " * 20 + "Annabel é Smith, tel +1 234 555 0000"),
    (4, "call +1 234 555 0000 or see 10.0.0.255"),
    (5, "a clean text about nothing at all, word for word"),
    (5, "a clean text about nothing at all, word for word"),
    (6, "another clean text"),
    (7, "ann@x.org wrote. " + "filler word " * 30 + "Signed Annabel Smith"),
    (8, None),
    (9, ""),
    (None, "no id, Smith, card 4111 1111 1111 1111"),
    (10, "once only bob@y.org knows Rumpelstiltskin"),
    *((100 + i, f"text number {i} with filler word and more of it here") for i in range(30)),
]


@pytest.mark.parametrize("alpha", [0.8, 0.95])
def test_sanitise_equals_counting(spark, alpha):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("key", "k0", "h0", "row", "maybe", "base_spans", "spans", "term")))
    got = [(r.doc_id, r.text, [tuple(x) for x in r.base_spans], [tuple(x) for x in r.term_spans], r.clean_text, r.key) for r in pii.sanitise(docs, alpha=alpha).collect()]
    key = lambda r: (str(r[0]), str(r[1]))
    wanted = sorted(plain_sanitise(ROWS, alpha), key=key)
    assert [r[:4] for r in sorted(got, key=key)] == wanted
    clean = {r[0]: r[4] for r in got}
    # what discloses the address goes in texts without it too; what only one text has stays
    assert (alpha > 0.8 or "Annabel" not in clean[2]) and "Rumpelstiltskin" in clean[10] and clean[8] is None and clean[5] == ROWS[4][1]
    assert "<EMAIL>" in clean[1] and "<CARD>" in clean[None] and all(r[5] == "clash" for r in got)
    assert pii.sanitise(docs.where("false")).count() == 0


def test_near_copies_of_a_long_list_of_entities(spark):
    """3000 addresses with their names in two near copies: entities of the same texts are taken together, not each with each term."""
    listed = "\n".join(f"name{i} name{i}@host{i}.org" for i in range(3000))
    rows = [(1, listed), (2, listed + "\nmore words")] + [(i, f"other text {i}") for i in range(3, 40)]
    began = time.time()
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60 and len(got) == 39
