import random
from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxlake import camera_queries, evaluation_queries, fusion_queries, map_queries, mesh_queries, queries, scene_queries, stream_queries, view_queries, volume_queries  # noqa: F401
from voxlake.operators import camera, fold, grounding, points, quantile, surface, temporal
from voxlake.operators.components import connected_components
from voxlake.plans import modes
from voxlake.sources import maps
from voxlake.streaming import frames, live_map, sync

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "part", "customer", "supplier", "orders", "nation", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)

    def rows(d):
        text = lambda v: "null" if pd.isna(v) else f"{float(v) + 0.0:.5f}" if isinstance(v, Number) and not isinstance(v, bool) else str(v)
        return sorted(tuple(map(text, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))

    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100), (None, 1)]
    root = {x: x for e in edges if None not in e for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("cap", [5, 32])
def test_running_mean_equals_the_fold(spark, cap):
    rng = random.Random(cap)
    xs = [rng.random() for _ in range(90)]
    t = w = 0.0
    for x in xs:
        t, w = (t * w + x) / (w + 1), min(w + 1, cap)
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(xs)], "g int, k int, x double")
    r = fold.running_mean(df, ["g"], ["k"], F.col("x"), cap).first()
    assert r["mean"] == pytest.approx(t, abs=1e-12) and r["weight"] == cap


def test_nearest_takes_the_earlier_of_ties_and_crosses_buckets(spark):
    left = spark.createDataFrame([(1, 10), (2, 1000), (3, 5)], "id long, t long")
    right = spark.createDataFrame([(7, 8), (8, 12), (9, 40)], "id long, t long")
    assert {r.id: r.match_id for r in temporal.nearest(left, right, 10).collect()} == {1: 7, 2: 9, 3: 7}


def test_ground_needs_a_cut(spark):
    with pytest.raises(ValueError):
        grounding.seeds(spark.range(1), None, None, 1.0, False, False)


def test_live_map_goes_on_over_batches(spark, tmp_path):
    rng, cap = random.Random(4), 5
    xs = [(g, k, rng.random()) for k in range(40) for g in (1, 2) if g == 1 or k < 4]
    for part in range(3):
        spark.createDataFrame([x for x in xs if x[1] % 40 // 14 == part], "g int, k int, x double").coalesce(1).write.parquet(f"{tmp_path}/t/{part}")
        spark.read.parquet(f"{tmp_path}/t/{part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    last = live_map.run(sync.source(spark, f"{tmp_path}/all", 1), ["g"], ["k"], F.col("x"), cap)
    for r in last.collect():
        t = w = n = 0
        for g, _, x in xs:
            if g == r.g:
                t, w, n = (t * w + x) / (w + 1), min(w + 1, cap), n + 1
        assert r["mean"] == pytest.approx(t, abs=1e-12) and r.n == n


def test_trilinear_clamps_and_takes_defaults(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 2.0), (1, 0, 0, 4.0)], "i long, j long, k long, v double")
    at = spark.createDataFrame([(1, -5.0, 0.0, 0.0), (2, 1.0, 0.5, 0.5), (3, 9.0, 0.5, 0.5), (4, None, 0.0, 0.0)], "id int, x double, y double, z double")
    got = {r.id: r.v for r in points.trilinear(at, voxels, (3, 1, 1), {"v": 1.0}, 0.0, 1.0).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: 1.0}


def test_crossings_count_missing_voxels_as_outside(spark):
    voxels = spark.createDataFrame([(0, 0, 0, -1.0, 1.0), (1, 0, 0, 0.0, 1.0), (0, 1, 0, -1.0, 0.0), (None, 0, 0, -1.0, 1.0)], "i long, j long, k long, tsdf double, weight double")
    got = {(r.i, r.j, r.k, r.axis): (r.x, r.y, r.z) for r in surface.crossings(voxels, (3, 2, 1), 0.0, 1.0).collect()}
    assert got == {(0, 0, 0, 0): (1.5, 0.5, 0.5), (0, 0, 0, 1): (0.5, 1.0, 0.5)}
    assert surface.crossings(voxels.limit(0), (3, 2, 1)).count() == 0


def test_visible_blocks_of_plain_cases(spark):
    pose = "frame_id int, qx double, qy double, qz double, qw double, tx double, ty double, tz double"
    frames = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.5, 0.5, 0.0), (2, 0.0, 2.0, 0.0, 0.0, 0.5, 0.5, 0.0), (3, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.0), (4, None, 0.0, 0.0, 1.0, 0.5, 0.5, 0.0)], pose)
    blocks = spark.createDataFrame([(0, 0, 2), (0, 0, 2), (0, 0, -3), (0, 0, 9), (9, 0, 2)], "bx long, by long, bz long")
    got = {(r.frame_id, r.bx, r.by, r.bz) for r in camera.visible_blocks(frames, blocks, 1.0, 1.0, 2, 2, 4.0).collect()}
    assert got == {(1, 0, 0, 2), (2, 0, 0, -3)}


def test_visible_blocks_equal_all_against_all(spark):
    rng = np.random.default_rng(3)
    q, t, b = rng.normal(size=(300, 4)), rng.uniform(-2, 2, (300, 3)), np.stack(np.meshgrid(*[np.arange(-8, 8)] * 3), -1).reshape(-1, 3)
    frames = spark.createDataFrame([(n, *map(float, (*q[n], *t[n]))) for n in range(300)], "frame_id int, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    got = {tuple(r) for r in camera.visible_blocks(frames, spark.createDataFrame(b.tolist(), "bx long, by long, bz long"), 0.8, 60.0, 80, 60, 2.0).collect()}
    x, y, z, w = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    r = 0.4 * 3**0.5
    p = np.einsum("rcn,nmr->cnm", turn, (b + 0.5)[None] * 0.8 - t[:, None])
    seen = (p[2] >= -r) & (p[2] <= 2 + r) & (p[2] * 2 / 3 - abs(p[0]) >= -r * (1 + 4 / 9) ** 0.5) & (p[2] * 0.5 - abs(p[1]) >= -r * 1.25**0.5)
    assert got == {(int(n), *map(int, b[m])) for n, m in zip(*np.nonzero(seen), strict=True)}


def test_saved_map_refuses_another_model(spark, tmp_path):
    voxels = spark.createDataFrame([(0, 0, 0, 1.0), (9, 0, 0, 2.0), (None, 0, 0, 3.0)], "i long, j long, k long, tsdf double")
    maps.save(voxels, f"{tmp_path}/m", "a", 0.1, slab=4)
    assert maps.load(spark, f"{tmp_path}/m", "a").count() == 3 and maps.load(spark, f"{tmp_path}/m").where("i is null").count() == 1
    assert [r.i for r in maps.load(spark, f"{tmp_path}/m", "", 4, 9).collect()] == [9]
    with pytest.raises(ValueError):
        maps.load(spark, f"{tmp_path}/m", "b")


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    """Ties, nulls, NaN, small groups and brackets narrower than the groups."""
    monkeypatch.setattr(quantile, "ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.normal(size=900)] + [("b", float(x)) for x in rng.integers(0, 4, 500)] + [("c", 1.5), ("d", 2.0), ("d", 7.0), ("a", None), ("b", float("nan")), ("e", None)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"low": 0.0, "some": 0.37, "most": 0.9, "top": 1.0}
    known = {g: [x for h, x in rows if h == g and x is not None and x == x] for g in "abcd"}
    got = {r.g: r for r in quantile.quantiles(df, "x", shares, ["g"]).collect()}
    assert sorted(got) == sorted(known)
    for g, xs in known.items():
        assert [got[g][k] for k in shares] == pytest.approx(list(np.quantile(xs, list(shares.values()))), abs=1e-12) and got[g].n == len(xs)
    one = quantile.quantiles(df, "x", shares).collect()
    assert [one[0][k] for k in shares] == pytest.approx(list(np.quantile(sum(known.values(), []), list(shares.values()))), abs=1e-12) and len(one) == 1
    assert [tuple(r) for r in quantile.quantiles(df.where("g = 'e'"), "x", {"q": 0.5}).collect()] in ([(0, None, None)], [])


@pytest.mark.parametrize("eps,side", [(1, 64), (2, 64), (2, 4), (3, 8)])
def test_clusters_equal_flooding(spark, monkeypatch, eps, side):
    monkeypatch.setattr(grounding, "BLOCK", side)
    rng, r = random.Random(eps * side), 2 * (eps - 1) + 1
    seeds = {(rng.randrange(40) - 9, rng.randrange(14), rng.randrange(14)) for _ in range(160)}
    label, rest = {}, set(seeds)
    while rest:
        todo = [min(rest)]
        first = todo[0]
        while todo:
            p = todo.pop()
            if p in rest:
                rest.remove(p)
                label[p] = first
                todo += [q for q in rest if max(abs(a - b) for a, b in zip(p, q, strict=True)) <= r]
    got = {(x.i, x.j, x.k): tuple(x.label) for x in grounding.clusters(spark.createDataFrame([*seeds] * 2, "i long, j long, k long"), eps).collect()}
    assert got == label


def test_stride_counts_on_over_batches(spark, tmp_path):
    rows = [(s, i, i) for i in range(31) for s in ("a", None) if s == "a" or i % 2]
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 8 == part], "scene string, id long, t long").coalesce(1).write.parquet(f"{tmp_path}/{part}")
        spark.read.parquet(f"{tmp_path}/{part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    kept = sync.drained(frames.every_nth(sync.source(spark, f"{tmp_path}/all", 1), "scene", "id", "t", 3), "stride").collect()
    for scene in ("a", None):
        assert sorted(r.id for r in kept if r.scene == scene) == [i for s, i, _ in rows if s == scene][2::3]


def test_poses_of_a_stream_cross_buckets_and_drop_what_none_enclose(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 10), (3, 95), (4, 300), (5, 301), (6, None)], "id long, t long").coalesce(1).write.parquet(f"{tmp_path}/s")
    poses = spark.createDataFrame([(1, 10, 1.0), (2, 10, 9.0), (3, 110, 3.0), (4, 300, 0.0), (5, None, 7.0)], "id long, t long, x double")
    got = sync.drained(frames.with_pose(sync.source(spark, f"{tmp_path}/s"), poses, 20), "posed").collect()
    assert {r.id: r.x for r in got} == pytest.approx({2: 1.0, 3: 2.7, 4: 0.0}) and len(got) == 3


@pytest.mark.parametrize("x", [131.1566705, 264.2946305, -131.1566705, 0.0000005])
def test_halves_are_rounded_as_in_sql(spark, tmp_path, x):
    rows = [(0, 0, "purchase", x), (1, 10, "click", 0.0), (2, 20, "purchase", x)]
    pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), kind, v) for i, s, kind, v in rows], columns=["event_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    ours, (theirs,) = queries.QUERIES["j10_pose_at_time"](spark, str(tmp_path)).collect(), con.execute(queries.ORACLE_SQL["j10_pose_at_time"]).fetchall()
    assert [(r.id, r.x) for r in ours] == [(1, theirs[2])]


def test_grid_equals_single_runs(spark):
    rng = random.Random(8)
    rows = [(i, j, k, 1.0, 0.1, [rng.random(), rng.random()] if rng.random() < 0.9 else None) for i in range(9) for j in range(8) for k in range(8)]
    v = spark.createDataFrame(rows, "i long, j long, k long, weight double, tsdf double, feat array<double>")
    cases = {"a": ([1.0, 0.2], None), "b": ([0.1, 1.0], [0.3, 0.3])}
    settings = [grounding.Setting(0.02), grounding.Setting(0.05, min_voxels=40, subtract_mean=True), grounding.Setting(None, 0.4, True), grounding.Setting(None, 99.0)]
    got = {}
    for r in grounding.ground_grid(v, cases, settings, (9, 8, 8), missing="zero").collect():
        got.setdefault((r.case, r.setting), []).append(tuple(r)[2:])
    for name, (q, n) in cases.items():
        for at, s in enumerate(settings):
            one = grounding.ground(v, q, (9, 8, 8), n, s.top_percentile, s.threshold, subtract_mean=s.subtract_mean, min_voxels=s.min_voxels, missing="zero")
            assert [pytest.approx(tuple(r)) for r in sorted(one.collect())] == sorted(got.get((name, at), []))
    assert ("a", 0) in got and ("b", 3) not in got


def test_features_have_to_fit_the_volume():
    modes.check(512, 512)
    with pytest.raises(ValueError, match="512"):
        modes.check(512, 768)


def test_heatmap_of_equal_scores(spark):
    v = spark.createDataFrame([(1, 1, 1, 1.0, 0.0, 0.5), (2, 1, 1, 1.0, 0.0, 0.5), (3, 1, 1, 0.0, 0.0, 0.9), (4, 1, 1, 1.0, 0.9, 0.9), (5, 1, 1, 1.0, 0.0, None)], "i long, j long, k long, weight double, tsdf double, score double")
    got = sorted(grounding.heatmap(v, [(0, 0, 0), (10, 20, 30)]).collect())
    assert [(r.i, r.red, r.green, r.blue) for r in got] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert grounding.heatmap(v.where("false"), [(0, 0, 0), (10, 20, 30)]).count() == 0
