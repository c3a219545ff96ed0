"""Queries of poses, visible blocks and surfaces over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.operators import camera, surface
from voxlake.plans import lifts as L
from voxlake.queries import query, r6

_Q = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS qx, CAST(embedding[2] AS DOUBLE) AS qy, CAST(embedding[3] AS DOUBLE) AS qz, CAST(embedding[4] AS DOUBLE) AS qw FROM embeddings"


def _quaternions(spark, sf_dir, *more):
    v = L.table(spark, sf_dir, "embeddings")
    return v.select("vec_id", *more, *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("qx", "qy", "qz", "qw"))))


@query(f"WITH q AS ({_Q}), n AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) * CASE WHEN qw < 0 THEN -1 ELSE 1 END AS n FROM q) SELECT vec_id, round(qx / n, 6) AS x, round(qy / n, 6) AS y, round(qz / n, 6) AS z, round(qw / n, 6) AS w FROM n")
def g7_quaternion_round_trip(spark, sf_dir):
    q = _quaternions(spark, sf_dir)
    m = q.select("vec_id", *(c.alias(f"m{i}") for i, c in enumerate(camera.matrix([F.col(c) for c in ("qx", "qy", "qz", "qw")]))))
    back = camera.quaternion([F.col(f"m{i}") for i in range(9)])
    return m.select("vec_id", *(r6(c, n) for c, n in zip(back, "xyzw", strict=True)))


_R = "1 - s * (qy * qy + qz * qz) AS r0, s * (qx * qy - qz * qw) AS r1, s * (qx * qz + qy * qw) AS r2, s * (qx * qy + qz * qw) AS r3, 1 - s * (qx * qx + qz * qz) AS r4, s * (qy * qz - qx * qw) AS r5, s * (qx * qz - qy * qw) AS r6, s * (qy * qz + qx * qw) AS r7, 1 - s * (qx * qx + qy * qy) AS r8"


@query(f"""WITH v AS ({L.VOXEL_SQL}), q AS (SELECT *, 2.0 / (qx * qx + qy * qy + qz * qz + qw * qw) AS s FROM ({_Q})), f AS (SELECT vec_id AS frame_id, vec_id / 640.0 AS tx, 0.4 AS ty, -0.5 AS tz, {_R} FROM q),
b AS (SELECT DISTINCT i // 8 AS bx, j // 8 AS by, k // 8 AS bz FROM v), d AS (SELECT f.*, bx, "by", bz, (bx + 0.5) * 0.8 - tx AS dx, ("by" + 0.5) * 0.8 - ty AS dy, (bz + 0.5) * 0.8 - tz AS dz FROM f, b),
p AS (SELECT frame_id, bx, "by", bz, r0 * dx + r3 * dy + r6 * dz AS x, r1 * dx + r4 * dy + r7 * dz AS y, r2 * dx + r5 * dy + r8 * dz AS z FROM d)
SELECT frame_id, bx, "by", bz FROM p WHERE z BETWEEN -0.4 * sqrt(3) AND 2 + 0.4 * sqrt(3) AND z * (2.0 / 3) - abs(x) >= -0.4 * sqrt(3) * sqrt(1 + 4.0 / 9) AND z * 0.5 - abs(y) >= -0.4 * sqrt(3) * sqrt(1.25)""")
def p6_j2_visible_blocks(spark, sf_dir):
    q = _quaternions(spark, sf_dir)  # every vector stands for a frame's pose
    frames = q.select(F.col("vec_id").alias("frame_id"), "qx", "qy", "qz", "qw", (F.col("vec_id") / 640.0).alias("tx"), F.lit(0.4).alias("ty"), F.lit(-0.5).alias("tz"))
    blocks = L.voxels(spark, sf_dir).select(F.expr("i div 8").alias("bx"), F.expr("j div 8").alias("by"), F.expr("k div 8").alias("bz"))
    return camera.visible_blocks(frames, blocks, 0.8, 60.0, 80, 60, 2.0)


_EDGES = " UNION ALL ".join(
    f"SELECT {', '.join(f'{c} - {o} AS {c}' if c == axis else c for c in 'ijk')}, {n} AS axis, {'tsdf' if not o else 'NULL::DOUBLE'} AS a, {'tsdf' if o else 'NULL::DOUBLE'} AS b FROM v WHERE weight > 0 AND {axis} {'> 0' if o else f'< {size - 1}'}"
    for n, (axis, size) in enumerate(zip("ijk", L.DIMS, strict=True))
    for o in (0, 1)
)


@query(f"WITH v AS ({L.VOXEL_SQL}), e AS ({_EDGES}), g AS (SELECT i, j, k, axis, CAST(coalesce(min(a), 1) AS DOUBLE) AS a, CAST(coalesce(min(b), 1) AS DOUBLE) AS b FROM e GROUP BY ALL), t AS (SELECT *, a / (a - b) AS t FROM g WHERE (a < 0) <> (b < 0)) SELECT i, j, k, axis, " + ", ".join(f"round(({c} + 0.5 + CASE WHEN axis = {n} THEN t ELSE 0 END) * 0.1, 6) AS {x}" for n, (c, x) in enumerate(zip("ijk", "xyz", strict=True))) + " FROM t")
def g6_surface_crossings(spark, sf_dir):
    s = surface.crossings(L.voxels(spark, sf_dir), L.DIMS)
    return s.select("i", "j", "k", "axis", *(r6(F.col(c), c) for c in "xyz"))
