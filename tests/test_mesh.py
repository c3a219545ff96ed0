"""Meshes: closed surfaces of known shape, random signs, missing voxels, colors; features at points."""

from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import mesh, points


def volume(spark, tsdf, weight=None, **columns):
    """A table of the voxels of an array; NaN is not stored."""
    rows = []
    for i, j, k in product(*map(range, tsdf.shape)):
        if not np.isnan(tsdf[i, j, k]):
            rows.append((i, j, k, float(tsdf[i, j, k]), 1.0 if weight is None else float(weight[i, j, k]), *(float(c[i, j, k]) for c in columns.values())))
    return spark.createDataFrame(rows, "i long, j long, k long, tsdf double, weight double" + "".join(f", {c} double" for c in columns))


def ball(n, radius):
    c = (np.indices((n, n, n)) + 0.5 - n / 2) * 0.1
    return np.clip((np.sqrt((c**2).sum(axis=0)) - radius) / 0.3, -1, 1)


def directed(faces):
    return Counter((f[x], f[y]) for f in faces for x, y in (("a", "b"), ("b", "c"), ("c", "a")))


def test_a_ball_is_closed_and_round(spark):
    v, f = mesh.mesh(volume(spark, ball(16, 0.5)), (16, 16, 16), origin=-0.8)
    v, f = {r.vertex: np.array([r.x, r.y, r.z]) for r in v.collect()}, f.collect()
    lines = directed(f)
    assert set(lines.values()) == {1} and all(lines[b, a] == 1 for a, b in lines)
    assert {x for r in f for x in (r.a, r.b, r.c)} == set(v)
    assert len(v) - len(lines) // 2 + len(f) == 2
    assert max(abs(np.linalg.norm(p) - 0.5) for p in v.values()) < 0.02
    # counter-clockwise as seen from outside: the volume is that of the ball
    held = sum(np.dot(v[r.a], np.cross(v[r.b], v[r.c])) / 6 for r in f)
    assert held == pytest.approx(4 / 3 * np.pi * 0.5**3, rel=0.03)


@pytest.mark.parametrize("seed", range(4))
def test_random_signs_have_no_cracks(spark, seed):
    rng = np.random.default_rng(seed)
    tsdf = rng.uniform(-1, 1, (6, 5, 7))
    tsdf[[0, -1]], tsdf[:, [0, -1]], tsdf[:, :, [0, -1]] = 1.0, 1.0, 1.0
    f = mesh.faces(volume(spark, tsdf), (6, 5, 7)).collect()
    lines = directed(f)
    assert len(f) > 50 and set(lines.values()) == {1} and all(lines[b, a] == 1 for a, b in lines)


def test_missing_and_light_voxels_are_free_space(spark):
    tsdf, weight = np.full((4, 4, 4), 1.0), np.full((4, 4, 4), 1.0)
    tsdf[1, 1, 1] = -0.5
    tsdf[2, 1, 1] = np.nan
    tsdf[1, 2, 1], weight[1, 2, 1] = -0.5, 0.5
    voxels = volume(spark, tsdf, weight)
    odd = spark.createDataFrame([(None, 1, 1, -1.0, 1.0), (3, 3, 3, None, 1.0)], voxels.schema)
    v, f = mesh.mesh(voxels.union(odd), (4, 4, 4))
    assert (v.count(), f.count()) == (6, 8)
    assert max(r.x for r in v.collect()) == pytest.approx(0.1 * (1.5 + 1 / 3))  # -0.5 to +1, where nothing is stored
    assert mesh.faces(voxels.where("false"), (4, 4, 4)).count() == 0 == mesh.vertices(voxels.where("false"), (4, 4, 4)).count()


def test_colors_are_the_nearer_voxels(spark):
    tsdf = np.full((3, 3, 3), 1.0)
    tsdf[1, 1, 1], tsdf[2, 1, 1] = -1.0, 0.25
    red = np.zeros((3, 3, 3))
    red[1, 1, 1], red[2, 1, 1] = 300.7, 9.9
    got = {tuple(round(x, 3) for x in (r.x, r.y, r.z)): r.red for r in mesh.vertices(volume(spark, tsdf, red=red), (3, 3, 3), colors=("red",)).collect()}
    assert got == {(0.23, 0.15, 0.15): 9, (0.1, 0.15, 0.15): 255, (0.15, 0.2, 0.15): 0, (0.15, 0.1, 0.15): 255, (0.15, 0.15, 0.2): 0, (0.15, 0.15, 0.1): 255}


def test_features_and_colors_at_points(spark):
    rng = np.random.default_rng(2)
    tsdf, red = rng.uniform(-1, 1, (3, 3, 3)), rng.uniform(-50, 300, (3, 3, 3))
    voxels = volume(spark, tsdf, red=red).withColumn("feat", F.when(F.col("i") != 1, F.array(F.col("i") * 1.0, F.col("j") * 2.0, F.lit(1.0))))
    at = rng.uniform(-0.1, 0.4, (40, 3))
    table = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(at)] + [(None, 0.0, 0.0, 0.0), (99, None, 0.0, 0.0)], "id long, x double, y double, z double")
    feature = lambda i, j: np.array([i, 2.0 * j, 1.0]) if i != 1 else np.zeros(3)
    got = {r.id: r for r in points.trilinear(table, voxels, (3, 3, 3), {"tsdf": 1.0}, colors=("red",), vectors={"feat": 3}).collect()}
    near = {r.id: r for r in points.nearest(table, voxels, (3, 3, 3), {"tsdf": 1.0}, colors=("red",), vectors={"feat": 3}).collect()}
    assert set(got) == set(near) == set(range(40))
    for n, p in enumerate(at):
        g = p / 0.1 - 0.5
        low = np.clip(np.floor(g), 0, 2).astype(int)
        part = np.clip(g - low, 0, 1)
        value, color, feat = 0.0, 0.0, np.zeros(3)
        for o in product((0, 1), repeat=3):
            at_ = tuple(np.minimum(low + o, 2))
            share = np.prod(np.where(o, part, 1 - part))
            value, color, feat = value + share * tsdf[at_], color + share * red[at_], feat + share * feature(*at_[:2])
        assert (got[n].tsdf, *got[n].feat) == pytest.approx((value, *feat)) and got[n].red == int(np.clip(color, 0, 255))
        cell = tuple(np.clip(np.floor(p / 0.1), 0, 2).astype(int))
        assert near[n].tsdf == tsdf[cell] and near[n].red == int(np.clip(red[cell], 0, 255)) and near[n].feat == [*feature(*cell[:2])]


def test_points_meet_cells_and_their_vectors_are_not_exchanged_by_point(spark):
    """Short, long and null vectors, null numbers, repeated voxels and points of one id, against sums over corners."""
    rng = np.random.default_rng(4)
    voxels = [(i, j, k, float(rng.normal()) if rng.random() < 0.8 else None, float(rng.uniform(0, 90)), [float(x) for x in rng.normal(size=rng.integers(0, 5))] if rng.random() < 0.8 else None) for i in range(4) for j in range(3) for k in range(3) if rng.random() < 0.8]
    voxels += [voxels[3], (None, 0, 0, 1.0, 1.0, [1.0])]
    voxels[5] = (*voxels[5][:5], [1.0, None, 2.0])
    at = [(n, *map(float, rng.uniform(-0.1, 0.6, 3))) for n in range(40)]
    at += [(7, 0.21, 0.2, 0.1), (7, 0.21, 0.2, 0.1), (None, 0.1, 0.1, 0.1), (50, None, 0.1, 0.1)]
    wanted = {}
    for n, *p in at:
        if n is None or None in p:
            continue
        g = [x / 0.1 - 0.5 for x in p]
        low = [min(max(int(np.floor(x)), 0), d - 1) for x, d in zip(g, (4, 3, 3), strict=True)]
        f = [min(max(x - a, 0.0), 1.0) for x, a in zip(g, low, strict=True)]
        row = wanted.setdefault(n, np.zeros(5))
        for o in np.ndindex(2, 2, 2):
            share = np.prod([b if c else 1 - b for b, c in zip(f, o, strict=True)])
            corner = tuple(min(a + c, d - 1) for a, c, d in zip(low, o, (4, 3, 3), strict=True))
            for v in [v for v in voxels if v[:3] == corner] or [(*corner, None, 0.0, None)]:
                feat = [x or 0.0 for x in [*(v[5] or []), 0.0, 0.0, 0.0][:3]]
                row += share * np.array([1.0 if v[3] is None else v[3], v[4], *feat])
    table = spark.createDataFrame(voxels, "i long, j long, k long, tsdf double, red double, feat array<float>")
    look = lambda rows: points.trilinear(spark.createDataFrame(rows, "id long, x double, y double, z double"), table, (4, 3, 3), {"tsdf": 1.0}, colors=("red",), vectors={"feat": 3})
    got = {r.id: [r.tsdf, r.red, *r.feat] for r in look(at).collect()}
    assert set(got) == set(wanted)
    for n, row in wanted.items():
        assert got[n] == pytest.approx([row[0], int(round(min(row[1], 255.0), 9)), *row[2:]], abs=1e-6)
    assert "hashpartitioning(id" not in look(at[:40])._jdf.queryExecution().executedPlan().toString()
