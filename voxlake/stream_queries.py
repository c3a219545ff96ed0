"""Queries of streams of frames, and of frame tables, over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.operators import grounding
from voxlake.plans import lifts as L
from voxlake.queries import _ground_sql, query, r6
from voxlake.storage import new_path
from voxlake.streaming import frames, sync


@query("""
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_id FROM n WHERE k % 3 = 0""")
def st7_stream_stride(spark, sf_dir):
    """Every third event of each user, from a stream with a counter for each."""
    e = sync.source(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return sync.drained(frames.every_nth(e, "user_id", "event_id", "ts", 3), "stride")


@query("""
WITH c AS (SELECT event_id AS id, epoch_us(ts::TIMESTAMP) AS t FROM events WHERE event_type = 'click'),
w AS (SELECT epoch_us(ts::TIMESTAMP) AS t, arg_min(value, event_id) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1),
lo AS (SELECT c.id, c.t, w.t AS t0, w.x AS x0 FROM c ASOF JOIN w ON c.t >= w.t), hi AS (SELECT c.id, w.t AS t1, w.x AS x1 FROM c ASOF JOIN w ON c.t <= w.t)
SELECT lo.id, t, round(CASE WHEN t1 > t0 THEN x0 + (x1 - x0) * ((t - t0) / (t1 - t0)) ELSE x0 END, 6) AS x FROM lo JOIN hi USING (id)""")
def st2_stream_poses(spark, sf_dir):
    """A stream of clicks with the pose at their time, from a table of purchases."""
    e = sync.source(spark, f"{sf_dir}/events.parquet").where("event_type = 'click'").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    p = L.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"))
    posed = sync.drained(frames.with_pose(e, p, 3_600_000_000), "posed")
    return posed.select("id", "t", r6(F.col("x"), "x"))


@query("""
SELECT event_id AS frame_id, event_type AS scene, epoch_us(ts::TIMESTAMP) / 1000000.0 AS ts, round(value / 10, 6) AS tx, user_id % 7 AS camera FROM events""")
def k7_frame_table(spark, sf_dir):
    """Frames written as a table by scene, with their times in seconds, and read back."""
    path = new_path(spark, "frames")
    e = L.table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("event_type").alias("scene"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("ts"), r6(F.col("value") / 10, "tx"), (F.col("user_id") % 7).alias("camera"))
    e.write.partitionBy("scene").parquet(path)
    return spark.read.schema(e.schema).parquet(path)


_CASES = {"first": (0, None), "second": (2, None), "less": (3, 1)}
_SETTINGS = [grounding.Setting(p, t, m, n) for m in (False, True) for p, t, n in ((0.1, None, 1), (0.2, None, 30), (0.05, None, 1), (None, 0.1, 20))]


def _grid_sql(case: str, number: int) -> str:
    (q, n), s = _CASES[case], _SETTINGS[number]
    sql = _ground_sql("ignore").replace("vec_id = 0)", f"vec_id = {q})").replace("vec_id = 1)", f"vec_id = {1 if n is None else n})")
    if n is not None:
        sql = sql.replace("list_inner_product(emb, q)", "list_inner_product(emb, q) - list_inner_product(emb, g)").replace("FROM v, q)", "FROM v, q, g)")
    mean = "m" if s.subtract_mean else "0.0"
    sql = sql.replace("quantile_cont(score, 0.9) AS cut", f"quantile_cont(score, {1 - s.top_percentile}) AS cut" if s.threshold is None else f"{s.threshold} + {'avg(score)' if s.subtract_mean else '0.0'} AS cut")
    sql = sql.replace("avg(value) AS sc", f"avg(value - {mean}) AS sc").replace("FROM m2 GROUP BY label)", f"FROM m2, c GROUP BY label HAVING count(*) >= {s.min_voxels})")
    return f"(SELECT '{case}' AS \"case\", {number} AS setting, * FROM ({sql}))"


@query(" UNION ALL ".join(_grid_sql(c, n) for c in _CASES for n in range(len(_SETTINGS))))
def u8_p11_grid(spark, sf_dir):
    """Every case under each setting of a grid, in one job that reads the voxels once."""
    vectors = {i: L.vector_of(spark, sf_dir, i) for i in {x for pair in _CASES.values() for x in pair if x is not None}}
    cases = {name: (vectors[q], None if n is None else vectors[n]) for name, (q, n) in _CASES.items()}
    r = grounding.ground_grid(L.voxels(spark, sf_dir), cases, _SETTINGS, L.DIMS)
    return r.select("case", "setting", F.col("rank").cast("long").alias("rank"), "count", *(r6(F.col(c), c) for c in ("center_i", "center_j", "center_k", "min_i", "max_i", "score")))
