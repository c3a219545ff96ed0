"""Common lines against plain counting, by both ways of finding them."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_docs, min_chars):
    split = [(t or "").split("\n") for _, t in rows]
    found = Counter(k for ls in split for k in {key_of(x) for x in ls} if len(k) >= max(min_chars, 1))
    out = []
    for (i, _), ls in zip(rows, split, strict=True):
        kept = [x for x in ls if found[key_of(x)] < min_docs]
        out.append((str(i), len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def rows_of(rng):
    line = lambda: "".join(rng.choice([*"ab É\0"], int(rng.integers(0, 5))))
    rows = [(i, "\n".join(line() for _ in range(int(rng.integers(1, 8))))) for i in range(120)]
    rows += [(200 + i, f"  Shared LINE\t\r\nown {i}\n\n") for i in range(6)] + [(300, None), (300, None), (None, "shared line"), (None, ""), (301, "\n\n\n"), (302, " \n\t"), (303, "word " * 30000 + "\nshared line\n" + "x\n" * 50000)]
    return rows + [(400, "a\nSHARED line\na")] * 3


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (3, 3), (1, 2)])
@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_equals_plain_counting(spark, monkeypatch, min_docs, min_chars, sent):
    monkeypatch.setattr(lines, "MOST_SENT", sent)
    rows = rows_of(np.random.default_rng(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).select("*", *(F.lit("own").alias(c) for c in ("key", "lines", "row", "t0", "n", "id", "common")))
    got = lines.drop_lines(docs, min_docs=min_docs, min_chars=min_chars)
    assert set(got.columns) == set(docs.columns) and got.where("row <> 'own' or key <> 'own' or t0 <> 'own' or common <> 'own'").count() == 0
    assert sorted((str(r.doc_id), r.lines.n_lines, r.lines.n_dropped, r.lines.kept) for r in got.collect()) == plain(rows, min_docs, min_chars)
    assert lines.drop_lines(docs.where("false")).count() == 0


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_the_first_document_keeps_its_first_line(spark, monkeypatch, sent):
    monkeypatch.setattr(lines, "MOST_SENT", sent)
    rows = [(3, "b\nx\nB"), (2, "x\n b \nb\ny"), (5, "y\nz"), (5, "y\nz")]
    got = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_docs=2, keep_first=True)
    wanted = [(2, "x\n b \ny"), (3, ""), (5, "z"), (5, "z")]
    assert sorted((r.doc_id, r.lines.kept) for r in got.collect()) == wanted


def test_filters_hold_all_that_repeats_and_few_others(spark):
    rows = [(i, f"only here {i}\nin two {i // 2}") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    held = lines.twice_seen(docs, "text", 1)
    of = lambda texts: lines.suspects(held, lines.Lines([t.encode() for t in texts]).hash)
    assert of([f"in two {i}" for i in range(10000)]).all()
    assert of([f"only here {i}" for i in range(20000)]).mean() < 0.02
