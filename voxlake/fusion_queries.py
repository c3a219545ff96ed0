"""Queries of frames fused to voxels over the driver tables, each with SQL for the same rows. Vectors stand for frames: their numbers for depths, maps and poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.camera_queries import _R, _quaternions
from voxlake.functions import geometry
from voxlake.operators import fold, fusion
from voxlake.plans import lifts as L
from voxlake.queries import ORDER, query, r6

_FRAMES = "(SELECT count(*) FROM embeddings)"


def _gated_sql(first: str, dim: int, where: str) -> str:
    """An ordered fold over the samples whose vector begins at ``first``, all of which count for the weight."""
    parts = []
    for d in range(dim):
        xs = f"list([CAST(embedding[{first} + {d}] AS DOUBLE), CAST(g AS DOUBLE)] ORDER BY l_shipdate, l_orderkey, l_linenumber)"
        steps = f"list_transform({xs}, lambda x, i: [x[1], CAST(least(i - 1, 32) AS DOUBLE), x[2]])"
        parts.append(f"round(list_reduce(list_prepend([0.0, 0.0, 0.0], {steps}), lambda a, b: [CASE WHEN b[3] = 1.0 THEN (a[1] * b[2] + b[1]) / (b[2] + 1) ELSE a[1] END, 0.0, 0.0])[1], 6) AS d{d}")
    return f"""
WITH o AS (
  SELECT *, l_discount <= 0.05 AS g, l_partkey % 640 AS u, l_suppkey % 480 AS v FROM lineitem JOIN embeddings ON vec_id = l_orderkey % {_FRAMES}
), x AS (SELECT *, u * (224.0 / 480) - (640 * (224.0 / 480) - 224) / 2 AS xc, v * (224.0 / 480) AS yc FROM o)
SELECT l_partkey AS voxel, count(*) FILTER (g) AS n, {", ".join(parts)} FROM x {where} GROUP BY 1 HAVING count(*) FILTER (g) > 0
"""


def _seen(spark, sf_dir):
    li, n = L.table(spark, sf_dir, "lineitem"), L.table(spark, sf_dir, "embeddings").count()
    return li.select(F.col("l_partkey").alias("voxel"), (F.col("l_orderkey") % n).alias("frame_id"), (F.col("l_partkey") % 640).alias("u"), (F.col("l_suppkey") % 480).alias("v"), (F.col("l_discount") <= 0.05).alias("g"), *ORDER)


def _maps(spark, sf_dir):
    return L.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("map"))


def _folded(obs, dim):
    m = fold.gated_vector(obs, ["voxel"], ORDER, F.col("feat"), dim, F.col("g"), 32)
    return m.select("voxel", "n", *(r6(F.col("feat")[i], f"d{i}") for i in range(dim)))


@query(_gated_sql("1", 4, ""))
def a3_a6_frame_vectors(spark, sf_dir):
    obs = _seen(spark, sf_dir).join(_maps(spark, sf_dir), "frame_id").withColumn("feat", F.slice("map", 1, 4)).drop("map")
    return _folded(obs, 4)


@query(_gated_sql("((v % 4) * 8 + u % 8) * 2 + 1", 2, ""))
def a4_j3_pixel_vectors(spark, sf_dir):
    obs = _seen(spark, sf_dir).withColumns({"u": F.col("u") % 8, "v": F.col("v") % 4})
    return _folded(fusion.pixel_features(obs, _maps(spark, sf_dir), 8, 4, 2), 2)


_PATCH = "(CAST(trunc(least(greatest(yc / 56, 0), 3)) AS INTEGER) * 4 + CAST(trunc(least(greatest(xc / 56, 0), 3)) AS INTEGER)) * 4 + 1"


@query(_gated_sql(_PATCH, 4, "WHERE xc >= 0 AND xc < 224 AND yc >= 0 AND yc < 224"))
def a5_j4_patch_vectors(spark, sf_dir):
    return _folded(fusion.patch_features(_seen(spark, sf_dir), _maps(spark, sf_dir), 640, 480, 224, 56, 4), 4)


@query("""
WITH d AS (SELECT vec_id, unnest(range(64)) AS pixel, unnest(embedding) AS e FROM embeddings),
m AS (SELECT vec_id, pixel, floor(abs(CAST(e AS DOUBLE)) * 10000) / 400 AS meters FROM d)
SELECT vec_id, pixel, round(CASE WHEN meters > 4 THEN 0.0 ELSE meters END, 6) AS depth FROM m""")
def s17_depth_decode(spark, sf_dir):
    raw = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 10000))
    d = L.table(spark, sf_dir, "embeddings").select("vec_id", fusion.decoded(raw, 400.0, 4.0).alias("depth"))
    return d.select("vec_id", F.posexplode("depth").alias("pixel", "depth")).select("vec_id", F.col("pixel").cast("long").alias("pixel"), r6(F.col("depth"), "depth"))


_FOLD = "list_reduce(list_transform(list(sample ORDER BY frame_id), lambda x, i: [x, CAST(least(i - 1, 32) AS DOUBLE)]), lambda a, b: [(a[1] * b[2] + b[1]) / (b[2] + 1), 0.0])[1]"
_GATED = "list_reduce(list_prepend([0.0, 0.0, 0.0], list_transform(list([CAST(embedding[{0}] AS DOUBLE), CAST(abs(sample) <= 0.5 AS DOUBLE)] ORDER BY frame_id), lambda x, i: [x[1], CAST(least(i - 1, 32) AS DOUBLE), x[2]])), lambda a, b: [CASE WHEN b[3] = 1.0 THEN (a[1] * b[2] + b[1]) / (b[2] + 1) ELSE a[1] END, 0.0, 0.0])[1]"


#: Observations of posed frames: the numbers of a vector are its depths, its first four the turn of its pose.
_POSED_SQL = f"""
WITH q AS (
  SELECT vec_id, embedding, CAST(embedding[1] AS DOUBLE) AS qx, CAST(embedding[2] AS DOUBLE) AS qy, CAST(embedding[3] AS DOUBLE) AS qz, CAST(embedding[4] AS DOUBLE) AS qw FROM embeddings
), p AS (SELECT *, 2.0 / (qx * qx + qy * qy + qz * qz + qw * qw) AS s FROM q),
f AS (SELECT vec_id AS frame_id, embedding, vec_id / 640.0 AS tx, 0.4 AS ty, -0.5 AS tz, {_R} FROM p),
b AS (SELECT DISTINCT vec_id // 512 AS bx FROM embeddings),
w AS (SELECT bx * 8 + l1.a AS i, l2.a AS j, l3.a AS k FROM b, range(8) l1(a), range(8) l2(a), range(8) l3(a)),
d AS (SELECT f.*, i, j, k, (i + 0.5) * 0.1 - tx AS dx, (j + 0.5) * 0.1 - ty AS dy, (k + 0.5) * 0.1 - tz AS dz FROM f, w),
c AS (SELECT *, r0 * dx + r3 * dy + r6 * dz AS x, r1 * dx + r4 * dy + r7 * dz AS y, r2 * dx + r5 * dy + r8 * dz AS z FROM d),
u AS (SELECT *, round_even(6.0 * x / (z + 1e-8) + 3.5, 0) AS u, round_even(6.0 * y / (z + 1e-8) + 3.5, 0) AS v FROM c WHERE z > 0),
e AS (SELECT *, floor(abs(CAST(embedding[CAST(v * 8 + u AS INTEGER) + 1] AS DOUBLE)) * 10000) / 400 AS raw FROM u WHERE u BETWEEN 0 AND 7 AND v BETWEEN 0 AND 7),
o AS (SELECT *, greatest(least((raw - z) / 0.4, 1.0), -1.0) AS sample FROM e WHERE raw > 0 AND raw <= 4 AND raw - z >= -0.4)
"""
_FUSED_SQL = f"""{_POSED_SQL}
SELECT i, j, k, round({_FOLD}, 6) AS tsdf, least(count(*), 32) AS weight, count(*) FILTER (abs(sample) <= 0.5) AS features,
  {", ".join(f"CASE WHEN count(*) FILTER (abs(sample) <= 0.5) > 0 THEN round({_GATED.format(5 + c)}, 6) END AS f{c}" for c in range(3))}
FROM o GROUP BY i, j, k"""


def posed(spark, sf_dir):
    """(frames, blocks): posed depth frames with a feature of three numbers, and the blocks of the voxels."""
    e = _quaternions(spark, sf_dir, F.col("embedding").alias("map"))
    raw = F.transform("map", lambda x: F.floor(F.abs(x.cast("double")) * 10000))
    place = {"tx": F.col("frame_id") / 640.0, "ty": F.lit(0.4), "tz": F.lit(-0.5), "depth": fusion.decoded(raw, 400.0, 4.0), "feat": F.slice("map", 5, 3)}
    frames = e.withColumnRenamed("vec_id", "frame_id").withColumns(place)
    return frames, L.voxels(spark, sf_dir).select(F.expr("i div 8").alias("bx"), F.expr("j div 8").alias("by"), F.expr("k div 8").alias("bz"))


def observed(frames, blocks):
    return fusion.observations(frames, blocks, 0.1, 6.0, 8, 8, 0.4, 4.4, ("feat",))


@query(_FUSED_SQL)
def a7_j2_block_fusion(spark, sf_dir):
    """Decoded depths of posed frames, the blocks each sees, their voxels, signed distances, and the folds of distance and gated features."""
    obs, key, names = observed(*posed(spark, sf_dir)), ["i", "j", "k"], [f"f{c}" for c in range(3)]
    both = fold.means_and_gated(obs, key, ["frame_id"], {"mean": F.col("sample")}, {n: F.col("feat")[c].cast("double") for c, n in enumerate(names)}, F.abs("sample") <= 0.5, 32)
    return both.select(*key, r6(F.col("mean"), "tsdf"), F.col("weight").cast("long").alias("weight"), F.col("gated_n").cast("long").alias("features"), *(r6(F.col(n), n) for n in names))


@query(f"""
WITH v AS ({L.VOXEL_SQL})
SELECT vec_id, i // 8 AS bx, j // 8 AS by, k // 8 AS bz, (i % 8) * 64 + (j % 8) * 8 + k % 8 AS local, i, j, k FROM v""")
def j6_g8_local_offsets(spark, sf_dir):
    """Voxels as block and local number, and back again."""
    v = L.voxels(spark, sf_dir).selectExpr("vec_id", "i div 8 AS bx", "j div 8 AS by", "k div 8 AS bz", "(i % 8) * 64 + (j % 8) * 8 + k % 8 AS local")
    return v.selectExpr("*", "bx * 8 + local div 64 AS i", "by * 8 + (local div 8) % 8 AS j", "bz * 8 + local % 8 AS k")


@query("""
WITH s AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 50 AS depth_new, l_discount <= 0.07 AS valid, greatest(least((CAST(l_quantity AS DOUBLE) / 50 - 0.5) / 0.4, 1.0), -1.0) AS sdf FROM lineitem
)
SELECT l_orderkey, l_linenumber, round(sdf, 6) AS sdf FROM s WHERE valid AND abs(sdf) <= 0.5""")
def p7_near_surface(spark, sf_dir):
    """Samples within half the truncation of the surface."""
    li = L.table(spark, sf_dir, "lineitem").where("l_discount <= 0.07")
    s = li.select("l_orderkey", "l_linenumber", geometry.signed_sample(F.col("l_quantity").cast("double") / 50, F.lit(0.5), 0.4).alias("sdf"))
    return s.where(F.abs("sdf") <= 0.5).select("l_orderkey", "l_linenumber", r6(F.col("sdf"), "sdf"))
