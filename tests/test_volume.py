"""Versioned volumes: integrations that add up, versions that stay, writes that fail; and chains that go on."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import fold, fusion
from voxlake.plans.chain import Chain
from voxlake.sources.volume import Channels, Volume, listed

SCHEMA = "i long, j long, k long, at long, x double, f double, near boolean"


def rows_of(rng, n, start, low=0, high=20):
    at = rng.integers(low, high, (n, 3))
    return [(*map(int, p), start + i, float(x), float(f), bool(g)) for i, (p, x, f, g) in enumerate(zip(at, rng.normal(size=n), rng.normal(size=n), rng.random(n) < 0.6))]


def plain(rows, cap):
    """The fold one by one: voxel -> [mean, f or None, weight, n, gated]."""
    out: dict = {}
    for i, j, k, _, x, f, near in sorted(rows, key=lambda r: r[3]):
        mean, feat, n, gated = out.get((i, j, k), (0.0, 0.0, 0, 0))
        w = min(n, cap)
        out[i, j, k] = (mean * w + x) / (w + 1), (feat * w + f) / (w + 1) if near else feat, n + 1, gated + near
    return {p: [m, f if g else None, min(n, cap), n, g] for p, (m, f, n, g) in out.items()}


def held(volume, version=None):
    return {(r.i, r.j, r.k): [r.tsdf, r.f, r.weight, r.n, r.gated_n] for r in volume.read(version).collect()}


def same(got, wanted):
    return set(got) == set(wanted) and all(got[p] == pytest.approx(wanted[p]) for p in wanted)


def integrate(spark, volume, rows, **more):
    return volume.integrate(spark.createDataFrame(rows, SCHEMA).repartition(3), ["at"], {"tsdf": F.col("x")}, {"f": F.col("f")}, F.col("near"), **more)


def test_integrations_add_up_and_versions_stay(spark, tmp_path):
    rng, path = np.random.default_rng(5), str(tmp_path / "v")
    make = lambda: Volume(spark, path, Channels({"tsdf": 1.0}, ("f",)), (32, 32, 32), 0.1, cap=2, full_every=3)
    parts = [rows_of(rng, 600, 0, 0, 12), rows_of(rng, 600, 1000, 0, 12) + [(None, 1, 1, 1, 1.0, 1.0, True)], rows_of(rng, 40, 2000, 17, 20), rows_of(rng, 300, 3000, 0, 20)]
    assert make().version() == 0 and make().read().count() == 0
    seen, states = [], {}
    for n, part in enumerate(parts):
        version = integrate(spark, make(), part, tag=f"part{n}")
        seen += [r for r in part if r[0] is not None]
        states[version] = plain(seen, 2)
        assert make().version() == version and same(held(make()), states[version])
    assert integrate(spark, make(), parts[0], tag="part0") == make().version() and same(held(make()), states[make().version()])
    assert all(same(held(make(), v), state) for v, state in states.items())
    # the third part touched one block; after three versions one holds all blocks
    names = dict(make().versions())
    assert spark.read.parquet(f"{path}/{names[3]}").select("bx", "by", "bz").distinct().count() == 1
    assert [n for n in names.values() if n.endswith("-full")] == ["v-000000004-full"]
    assert make().reset() == make().version() and held(make()) == {} and same(held(make(), 3), states[4])
    assert integrate(spark, make(), [], tag="none") == make().version()


def test_a_write_that_fails_leaves_the_last_version(spark, tmp_path):
    rng, path = np.random.default_rng(6), str(tmp_path / "v")
    volume = Volume(spark, path, Channels({"tsdf": 1.0}, ("f",)), (32, 32, 32), 0.1)
    first = rows_of(rng, 50, 0)
    integrate(spark, volume, first)
    broken = spark.createDataFrame(rows_of(rng, 50, 100), SCHEMA).withColumn("x", F.when(F.col("at") == 120, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        volume.integrate(broken, ["at"], {"tsdf": F.col("x")}, {"f": F.col("f")}, F.col("near"))
    assert volume.version() == 1 and same(held(volume), plain(first, 32))
    # what another writer left half-written doesn't count, and is written over
    volume.read().limit(3).write.parquet(f"{path}/v-000000002-part")
    (tmp_path / "v" / "v-000000002-part" / "_SUCCESS").unlink()
    assert volume.version() == 1
    more = rows_of(rng, 50, 200)
    assert integrate(spark, volume, more) == 2 and same(held(volume), plain(first + more, 32))


def test_queries_and_meshes_read_one_version(spark, tmp_path):
    volume = Volume(spark, str(tmp_path / "v"), Channels({"tsdf": 1.0}, ("f",)), (8, 8, 8), 0.1)
    integrate(spark, volume, [(2, 2, 2, 0, -1.0, 3.0, True)])
    integrate(spark, volume, [(2, 2, 2, 1, 3.0, 5.0, True)])
    at = spark.createDataFrame([(1, 0.25, 0.25, 0.25), (2, 0.3, 0.25, 0.25), (3, 0.71, 0.7, 0.7)], "id long, x double, y double, z double")
    got = {r.id: (r.tsdf, r.weight, r.feat[0]) for r in volume.query(at).collect()}
    assert got == {1: pytest.approx((1.0, 2.0, 4.0)), 2: pytest.approx((1.0, 1.0, 2.0)), 3: pytest.approx((1.0, 0.0, 0.0))}
    near = {r.id: (r.tsdf, r.weight, r.feat[0]) for r in volume.query(at, version=1, interpolate=False).collect()}
    assert near == {1: (-1.0, 1.0, 3.0), 2: near[2], 3: (1.0, 0.0, 0.0)}
    assert [x.count() for x in volume.extract_mesh(version=1)] == [6, 8] and [x.count() for x in volume.extract_mesh()] == [0, 0]


@pytest.mark.parametrize("cap", [0, 1, 5])
def test_folds_go_on_from_a_state(spark, cap):
    rows = rows_of(np.random.default_rng(cap), 500, 0, 0, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    go = lambda part, state: fold.means_and_gated(df.where(part), ["i", "j", "k"], ["at"], {"tsdf": F.col("x")}, {"f": F.col("f")}, F.col("near"), cap, state)
    early = go("at < 200", None)
    late = go("at >= 200", early)
    wanted = plain(rows, cap)
    got = {(r.i, r.j, r.k): [r.tsdf, r.f, r.weight, r.n, r.gated_n] for r in late.collect()}
    assert len(got) > 50 and all(got[p] == pytest.approx(wanted[p]) for p in got)


@pytest.mark.parametrize("cap", [0, 1, 5, 40])
def test_segments_fold_as_the_whole(spark, cap):
    rows = rows_of(np.random.default_rng(cap), 700, 0, 0, 3)
    df = spark.createDataFrame([*rows, (None, 0, 0, 1, 2.0, 3.0, True)], SCHEMA)
    folded = fold.means_by_segments(df, ["i", "j", "k"], ["at"], F.floor(F.col("at") / 90), {"tsdf": F.col("x")}, {"f": F.col("f")}, F.col("near"), cap)
    got = {(r.i, r.j, r.k): [r.tsdf, r.f, r.weight, r.n, r.gated_n] for r in folded.collect()}
    assert got.pop((None, 0, 0)) == [2.0, 3.0, min(1, cap), 1, 1] and same(got, plain(rows, cap))


def test_a_fold_never_looks_ahead(spark):
    """A frame of following rows is worked out anew for each row, so a voxel's time would grow with the square of its samples."""
    df = spark.createDataFrame([(0, 0, 0, n, 1.0, 2.0, True) for n in range(5)], SCHEMA)
    folded = fold.means_and_gated(df, ["i", "j", "k"], ["at"], {"tsdf": F.col("x")}, {"f": F.col("f")}, F.col("near"), 32)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition" in plan and not re.search(r"RowFrame, (?!unboundedpreceding)[^,]*, unboundedfollowing", plan)


def test_a_fold_keeps_groups_without_samples(spark):
    rows = rows_of(np.random.default_rng(9), 60, 0, 0, 4)
    first, rest = [r for r in rows if r[0] < 2], [r for r in rows if r[0] >= 2]
    go = lambda part, state: fold.means_and_gated(spark.createDataFrame(part, SCHEMA), ["i", "j", "k"], ["at"], {"tsdf": F.col("x")}, {"f": F.col("f")}, F.col("near"), 2, state)
    assert same({(r.i, r.j, r.k): [r.tsdf, r.f, r.weight, r.n, r.gated_n] for r in go(rest, go(first, None)).collect()}, plain(rows, 2))


def test_an_integration_works_out_its_samples_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    volume, rng = Volume(spark, str(tmp_path / "v"), Channels({"tsdf": 1.0}, ("f",)), (32, 32, 32), 0.1), np.random.default_rng(1)
    blocks = spark.createDataFrame([(a, b, c) for a in range(3) for b in range(3) for c in range(3)], "bx long, by long, bz long")
    parts = [rows_of(rng, 100, 0), rows_of(rng, 100, 1000)]
    for part in parts:
        obs = spark.createDataFrame(part, SCHEMA).mapInPandas(counted, SCHEMA)
        volume.integrate(obs, ["at"], {"tsdf": F.col("x")}, {"f": F.col("f")}, F.col("near"), touched=blocks)
    assert read.value == 200 and same(held(volume), plain(parts[0] + parts[1], 32))


def test_observations_equal_voxels_projected_one_by_one(spark):
    rng = np.random.default_rng(2)
    poses = [(n, *map(float, (*rng.normal(size=4), *rng.uniform(0, 1.6, 3)))) for n in range(12)]
    depths = [[float(x) if x > 0 else None for x in rng.uniform(-0.3, 4, 64)] for _ in poses]
    depths[3], depths[4], depths[5] = None, depths[4][:20], [float("nan")] * 64
    frames = spark.createDataFrame([(*p, d, f"name {p[0]}") for p, d in zip(poses, depths, strict=True)], "frame_id long, qx double, qy double, qz double, qw double, tx double, ty double, tz double, depth array<double>, name string")
    blocks = spark.createDataFrame([(a, b, 0) for a in range(-2, 3) for b in range(2)], "bx int, by int, bz int")
    got = {(r.frame_id, r.i, r.j, r.k): (r.z, r.depth, r.sample, r.name) for r in fusion.observations(frames, blocks, 0.1, 6.0, 8, 8, 0.4, 4.4, ("name",)).collect()}
    grid = np.stack(np.meshgrid(np.arange(-16, 24), np.arange(16), np.arange(8), indexing="ij"), -1).reshape(-1, 3)
    wanted = {}
    for (n, qx, qy, qz, qw, *t), depth in zip(poses, depths, strict=True):
        s = 2 / (qx * qx + qy * qy + qz * qz + qw * qw)
        turn = np.array([[1 - s * (qy * qy + qz * qz), s * (qx * qy - qz * qw), s * (qx * qz + qy * qw)], [s * (qx * qy + qz * qw), 1 - s * (qx * qx + qz * qz), s * (qy * qz - qx * qw)], [s * (qx * qz - qy * qw), s * (qy * qz + qx * qw), 1 - s * (qx * qx + qy * qy)]])
        for p, (x, y, z) in zip(grid, ((grid + 0.5) * 0.1 - t) @ turn, strict=True):
            u, v = (np.rint(6 * c / (z + 1e-8) + 3.5) for c in (x, y))
            if z > 0 and 0 <= u < 8 and 0 <= v < 8 and depth is not None and int(v * 8 + u) < len(depth):
                d = depth[int(v * 8 + u)]
                if d is not None and d > 0 and d - z >= -0.4:
                    wanted[n, *map(int, p)] = (z, d, max(min((d - z) / 0.4, 1.0), -1.0), f"name {n}")
    assert len(wanted) > 1000 and set(got) == set(wanted)
    assert all(got[p][:3] == pytest.approx(wanted[p][:3]) and got[p][3] == wanted[p][3] for p in wanted)


def test_a_chain_goes_on_after_its_done_steps(spark, tmp_path):
    made = []

    def make(name, df):
        made.append(name)
        return df

    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("x"))
    chain = Chain(spark, str(tmp_path))
    assert chain.step("one", lambda: make("one", spark.range(5))).count() == 5
    with pytest.raises(Exception, match="lost"):
        chain.step("two", lambda: make("two", broken))
    again = Chain(spark, str(tmp_path))
    assert again.done() == ["one"] and listed(spark, f"{tmp_path}/nothing") == []
    assert again.step("one", lambda: make("one", broken)).count() == 5
    assert again.step("two", lambda: make("two", spark.range(2))).count() == 2
    assert made == ["one", "two", "two"] and again.done() == ["one", "two"]
