"""Recall by kind of edit and length, exact distances, and the stage against a plain search."""

import time

import numpy as np
import pytest

from voxlake.llm import decontaminate


def plain_distance(item, words):
    """Least edit distance of the item to any run of the words, and the end of the first such run, by the whole table."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row), row.index(min(row))


def edit(rng, words, kind, share=decontaminate.EDITED):
    x = list(words)
    for _ in range(int(share * len(words))):
        at, what = int(rng.integers(len(x))), int(rng.integers(3)) if kind == 3 else kind
        x[at : at + (what != 1)] = [f"new{rng.integers(10**6)}"] if what != 2 else []
    return x


def words_of(rng, n):
    return [f"w{int(x)}" for x in rng.zipf(1.3, n) % 5000]


@pytest.mark.parametrize("low,high", [(5, 15), (15, 40), (40, 120), (120, 500)])
def test_edited_copies_are_found(low, high):
    rng = np.random.default_rng(high)
    texts = [words_of(rng, int(rng.integers(low, high))) for _ in range(60 if high < 200 else 25)]
    items = decontaminate.Items([*range(len(texts))], [" ".join(t) for t in texts])
    assert min(items.recall.values()) >= decontaminate.RECALL
    for kind in range(4):
        held = items.matches([" ".join(words_of(rng, 30) + edit(rng, t, kind) + words_of(rng, 50)).encode() for t in texts])
        assert np.mean([any(m[0] == i for m in ms) for i, ms in enumerate(held)]) >= 0.95


def test_distances_are_exact():
    rng = np.random.default_rng(2)
    texts = [words_of(rng, int(rng.integers(5, 60))) for _ in range(30)]
    items = decontaminate.Items([*range(30)], [" ".join(t) for t in texts])
    for i, t in enumerate(texts):
        whole = words_of(rng, 20) + edit(rng, t, 3, 0.15) + words_of(rng, 20) + edit(rng, t, 3, 0.1)
        for item, distance, n, end in items.matches([" ".join(whole).encode()])[0]:
            assert (distance, end) == plain_distance(texts[item], whole) and n == len(texts[item]) and distance <= int(decontaminate.EDITED * n)


def test_regions_lose_no_run():
    """Distances and ends equal a search of the whole text, with few words, so that items overlap and repeat."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, word = int(rng.integers(5, 30)), lambda k: [f"w{int(x)}" for x in rng.integers(0, 9, k)]  # noqa: B023, E731
        item, text = word(n), word(int(rng.integers(0, 60)))
        text += edit(rng, item, 3, 0.1) + word(int(rng.integers(0, 40))) + item * int(rng.integers(0, 2))
        items = decontaminate.Items([0], [" ".join(item)])
        wanted = plain_distance(item, text)
        assert items.matches([" ".join(text).encode()])[0] in ([(0, wanted[0], n, wanted[1])], [] if wanted[0] else None)


def test_a_text_of_many_items_takes_linear_time():
    rng = np.random.default_rng(4)
    texts = [[f"w{int(x)}" for x in rng.integers(0, 20000, 60)] for _ in range(3000)]
    items = decontaminate.Items([*range(len(texts))], [" ".join(t) for t in texts])
    began = time.time()
    held = items.matches([" ".join(w for t in texts for w in t).encode()])[0]
    assert time.time() - began < 30 and [m[:3] for m in sorted(held)] == [(i, 0, 60) for i in range(len(texts))]


def test_stage_equals_a_plain_search(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = [words_of(rng, 25) for _ in range(12)]
    bench = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, None), (51, ""), (0, "once more W1 w2 w3 w4")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, " ".join(words_of(rng, 40))) for i in range(40)]
    rows += [(100 + 2 * i, " ".join(words_of(rng, 10) + edit(rng, t, i % 4) + words_of(rng, 9))) for i, t in enumerate(texts)]
    rows += [(200 + i, " ".join(words_of(rng, 10) + edit(rng, t, i % 4, 0.5) + words_of(rng, 9))) for i, t in enumerate(texts)]
    rows += [(None, None), (1, ""), (2, "ONCE, more: w1/w2/w3 (w4)"), (2, "ONCE, more: w1/w2/w3 (w4)"), (3, "x " * 30000)]
    docs = spark.createDataFrame([(*r, "clash", "c") for r in rows], "doc_id long, text string, leaks string, item string")

    def clean(text):
        w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return not any(plain_distance(t, w)[0] <= int(decontaminate.EDITED * len(t)) for t in [*texts, "once more w1 w2 w3 w4".split()])

    key = lambda r: (str(r[0]), str(r[1]))
    got = decontaminate.stage_decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted([r for r in rows if clean(r[1])], key=key)
    assert decontaminate.stage_decontaminate(spark, docs.where("false"), str(tmp_path)).count() == 0
