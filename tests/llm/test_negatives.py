"""Hard negatives against brute force; the curve, the bounds, and what is read of clustered vectors."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import negatives


def plain(rows, every=10, k=5):
    """From (id, label, vector) by row: sorted (anchor, positive, rank, negative, positive score, negative score)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    order = lambda i: (i is not None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, label, v) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted(((-dot(v, w), order(j), j, other) for m, (j, other, w) in enumerate(rows) if m != n), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3] == label][:k]:
            good = [(j, -t) for t, _, j, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, p, r, j, -s, t) for r, (j, t) in enumerate(good, 1)]
    return sorted(out, key=str)


def got(spark, rows, every=10, kind="int", **k):
    df = spark.createDataFrame(rows, f"vec_id long, label {kind}, v array<long>").repartition(3)
    return sorted((tuple(r) for r in negatives.mine(df.withColumn("block", F.lit("own")).withColumn("id", F.lit("own")), F.col("vec_id") % every == 0, **k).collect()), key=str)


def vectors(rng, n, dims, spread, clusters=6):
    centers = rng.integers(-900, 900, (clusters, dims))
    return [(int(i), int(c % 4), [int(x) for x in centers[c] + rng.integers(-spread, spread + 1, dims)]) for i, c in enumerate(rng.integers(0, clusters, n))]


@pytest.mark.parametrize("block,most", [(512, 1 << 16), (7, 9)])
@pytest.mark.parametrize("spread", [3, 1500])
def test_equals_brute_force(spark, monkeypatch, block, most, spread):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "MOST_ANCHORS", most)
    rows = vectors(np.random.default_rng(spread), 300, 6, spread)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 4)
    rows = [(0, 1, [1, 2]), (10, 1, [1, 2]), (10, 1, [1, 2]), (20, None, [1, 2]), (30, 1, None), (40, 2, [1, None]), (50, 2, []), (60, 2, [1]), (70, 3, [0, 2, 9]), (None, 3, [1, 2]), (None, 1, [1, 2]), (80, 3, [1, 2]), (81, 3, [1, 2]), (90, 7, [-5, -5]), (91, 7, [5, 5])]
    assert got(spark, rows) == plain(rows)
    assert got(spark, [(i, i % 2, [7, 7]) for i in range(60)]) == plain([(i, i % 2, [7, 7]) for i in range(60)])
    assert got(spark, []) == [] and got(spark, [(10, 1, [1])]) == [] and got(spark, [(1, 1, [1]), (2, 1, [2])]) == []
    assert got(spark, [(i, f"l{i % 3}", [i, 1]) for i in range(50)], kind="string") == plain([(i, f"l{i % 3}", [i, 1]) for i in range(50)])


def test_large_scores_are_exact(spark):
    rows = [(i, i % 2, [10**8 + i, 10**8 - 3 * i]) for i in range(40)]
    assert got(spark, rows) == plain(rows)


def test_neighbours_on_the_curve_differ_by_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2), (2, 1)):
        cells = np.array([*itertools.product(range(1 << bits), repeat=dims)])
        keys = negatives.curve_key(cells, bits)
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_clusters_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = vectors(np.random.default_rng(1), 1200, 8, 20, 24)
    df = spark.createDataFrame(rows, "id long, label int, v array<long>").withColumn("anchor", F.col("id") % 10 == 0)
    blocks = negatives.laid_out(df, 8, -1000, 1000)
    own = negatives.anchors_of(blocks, 8, np.float64, 5).toPandas()
    a = negatives.Anchors(own, 8, np.float64)
    for r in blocks.collect():
        low, high = (negatives._rows(bytes(x), 8).astype(float) for x in (r.low, r.high))
        least, most = a.bounds(np.arange(len(own)), low, high)
        scores = a.v @ negatives._rows(bytes(r.vectors), 8).T
        assert (least <= scores.min(axis=1, keepdims=True)).all() and (most >= scores.max(axis=1, keepdims=True)).all()
    sent = spark.sparkContext.broadcast(a)
    read = sum(len(r.anchors) // 4 for r in negatives.to_read(blocks, sent, 8, np.float64, None, (80, 100, 100)).collect())
    of_label = sum(int((a.label == r.label).sum()) for r in blocks.select("label").collect())
    assert read < 0.6 * of_label
