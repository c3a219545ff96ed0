"""Streams with keyed state: folds over batches and restarts, matches of three topics, batches by count and time-out."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import camera, temporal
from voxlake.streaming import block_map, matched


@pytest.mark.parametrize("cap", [0, 3, 50])
def test_folded_equals_the_fold_one_by_one(cap):
    rng = np.random.default_rng(cap)
    mean, n = np.zeros((2, 8)), np.zeros(8, np.int64)
    plain, count = np.zeros((2, 8)), np.zeros(8, np.int64)
    for size in (5, 0, 40, 1, 30):
        local, samples = rng.integers(0, 8, size), rng.normal(size=(2, size))
        block_map.folded(mean, n, local, samples, cap)
        for v, s in zip(local, samples.T):
            w = min(count[v], cap)
            plain[:, v] = (plain[:, v] * w + s) / (w + 1)
            count[v] += 1
        assert (n == count).all() and np.allclose(mean, plain)


def rows_of(rng, n, blocks):
    return [(int(b), int(v), int(i), float(x)) for i, (b, v, x) in enumerate(zip(rng.choice(blocks, n), rng.integers(0, 512, n), rng.normal(size=n)))]


def test_map_goes_on_after_restarts_and_touches_few_blocks(spark, tmp_path):
    schema, rng = "block long, local int, at long, x double", np.random.default_rng(1)
    path, parts = str(tmp_path / "map"), [rows_of(rng, 300, [1, 2]), rows_of(rng, 100, [2]), rows_of(rng, 50, [7]) + [(None, 1, 1, 1.0), (1, None, 1, 1.0), (1, 1, 1, None)]]
    plain: dict = {}
    progress = block_map.Progress(spark, f"{path}/progress")
    spark.streams.addListener(progress)
    try:
        for number, part in enumerate(parts):
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{path}/in")
            held = block_map.BlockMap(spark, path, ["block"], ["at"], {"x": F.col("x")}, 4)  # a new one each time: all it knows is in the folder
            held.start(spark.readStream.schema(schema).parquet(f"{path}/in"), availableNow=True).awaitTermination()
            for b, v, _, x in [r for r in part if None not in r]:
                mean, n = plain.get((b, v), (0.0, 0))
                w = min(n, 4)
                plain[b, v] = (mean * w + x) / (w + 1), n + 1
            got = {(r.block, r.local): (r.x, r.n) for r in held.snapshot().collect()}
            assert set(got) == set(plain) and all(got[k] == pytest.approx(plain[k]) for k in plain)
            changed = spark.read.parquet(f"{path}/changes/batch={number}").select("block").distinct()
            assert {r[0] for r in changed.collect()} == {r[0] for r in part if None not in r}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(progress)
    rows = spark.read.schema(progress.SCHEMA).parquet(f"{path}/progress").where("rows > 0").orderBy("batch").collect()
    assert [(r.batch, r.rows, r.keys) for r in rows] == [(0, 300, 2), (1, 100, 2), (2, 53, 3)]


def test_preview_is_bounded_and_uniform(spark):
    surface = spark.range(1000).select(F.col("id").alias("i"), F.lit(1).alias("j"))
    seen = np.zeros(1000)
    for seed in range(40):
        shown = [r.i for r in block_map.preview(surface, ["i", "j"], 100, seed).collect()]
        assert len(shown) == len(set(shown)) == 100
        seen[shown] += 1
    tenths = seen.reshape(10, 100).sum(axis=1)  # 400 each, within four standard deviations
    assert abs(tenths - 400).max() <= 4 * (4000 * 0.1 * 0.9) ** 0.5
    assert block_map.preview(surface.limit(5), ["i"], 100).count() == 5


def test_nearest_within_takes_the_smallest_id_of_ties():
    t = np.array([10, 20, 30, 100])
    found, gap = matched.nearest_within(t, np.array([8, 12, 20, 20, 37]), np.array([5, 3, 9, 4, 1]), 7)
    assert found[gap >= 0].tolist() == [3, 4, 1] and gap.tolist() == [2, 0, 7, -1]
    assert (matched.nearest_within(t, np.zeros(0, np.int64), np.zeros(0, np.int64), 7)[1] == -1).all()


def test_threes_wait_for_partners_and_drop_late_rows(spark, tmp_path):
    schema = "source string, topic int, id long, ts timestamp"
    second = lambda s: datetime.fromtimestamp(1_700_000_000 // 60 * 60, timezone.utc) + timedelta(microseconds=round(s * 1e6))
    parts = [
        # partners in the next batch, across a bucket's border, a tie of gaps, another source, no second partner, nulls
        [("a", 0, 1, second(59.99)), ("a", 1, 2, second(60.01)), ("a", 0, 3, second(30)), ("a", 1, 9, second(29.98)), ("a", 1, 8, second(30.02)), ("a", 2, 7, second(30)), ("b", 0, 4, second(60)), ("a", 0, 5, second(10)), ("a", 1, 6, second(10)), (None, 0, 1, second(1)), ("a", 0, None, second(1))],
        [("a", 2, 10, second(60.0)), (None, None, None, second(600))],
        [("a", 0, 11, second(30)), ("a", 2, 12, second(10)), (None, None, None, second(1200))],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        threes = matched.in_threes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 50_000)
        with block_map.rocks(spark):
            threes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = [(r.source, r.id, r.first_id, r.second_id, r.gap) for r in spark.read.schema(threes.schema).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == [("a", 1, 2, 10, 30_000), ("a", 3, 8, 7, 20_000)]


def test_batches_are_full_or_timed_out_and_none_is_lost(spark, tmp_path):
    schema = "source long, id long"
    for start in (0, 100):
        rows = [(i % 2, i) for i in range(start, start + 19)] + [(None, 5), (1, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        batches = matched.by_count_or_timeout(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 4, 200)
        with block_map.rocks(spark):
            stream = batches.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="100 milliseconds").start()
        matched.settle(stream, 200)
    got: dict = {}
    for r in spark.read.schema(batches.schema).parquet(f"{tmp_path}/out").orderBy("source", "number", "place").collect():
        got.setdefault((r.source, r.number), []).append(r.id)
    assert [len(got[k]) for k in sorted(got)] == [4, 4, 2, 4, 4, 2, 4, 4, 1, 4, 4, 1]
    assert [i for k in sorted(got) if k[0] == 0 for i in got[k]] == [*range(0, 19, 2), *range(100, 119, 2)]


def test_poses_turn_along_the_shorter_arc(spark):
    half = 0.5**0.5
    turn = lambda angle: (0.0, 0.0, float(np.sin(angle / 2)), float(np.cos(angle / 2)))
    poses = [
        (1, 0, 0.0, 0.0, 0.0, *turn(0.2)), (2, 100, 1.0, 2.0, 4.0, *(-3 * x for x in turn(1.0))),  # of another sign and length
        (3, 200, 1.0, 2.0, 4.0, *turn(1.0)), (4, 300, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (5, 200, 9.0, 9.0, 9.0, half, 0.0, 0.0, half),
    ]
    table = spark.createDataFrame(poses, "id long, t long, tx double, ty double, tz double, qx double, qy double, qz double, qw double").select("id", "t", camera.pose().alias("x"))
    left = spark.createDataFrame([(10, 25), (11, 0), (12, 100), (13, 150), (14, 250), (15, 301), (16, -1)], "id long, t long")
    got = {r.id: [r.x[c] for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")] for r in temporal.pose_at(left, table, 60, camera.pose_between).collect()}
    assert set(got) == {10, 11, 12, 13, 14}
    assert got[10] == pytest.approx([0.25, 0.5, 1.0, *turn(0.4)]) and got[11] == pytest.approx([0, 0, 0, *turn(0.2)])
    assert got[12] == pytest.approx([1, 2, 4, *(-x for x in turn(1.0))]) and got[13] == pytest.approx([1, 2, 4, *(-x for x in turn(1.0))])
    assert got[14][:3] == [0.5, 1.0, 2.0] and got[14][3:] == [None] * 4
