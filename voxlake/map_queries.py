"""Queries of saved maps and of features on images over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import geometry as G
from voxlake.plans import lifts as L
from voxlake.queries import query, r6
from voxlake.sources import maps
from voxlake.storage import new_path


@query(f"WITH v AS ({L.VOXEL_SQL}) SELECT vec_id, i, j, k, weight, CAST(round(tsdf, 6) AS DOUBLE) AS tsdf FROM v")
def k1_s11_saved_map(spark, sf_dir):
    path = new_path(spark, "map")
    maps.save(L.voxels(spark, sf_dir), path, "clip", 0.1, slab=4)
    v = maps.load(spark, path, "clip")
    return v.select("vec_id", "i", "j", "k", "weight", F.round(F.col("tsdf").cast("double"), 6).alias("tsdf"))


# lines of an order stand for the masks over a pixel, discounts for their quality, parts for their features
@query("WITH m AS (SELECT l_orderkey, CAST(l_discount AS DOUBLE) AS q, (l_partkey % 17) / 17.0 AS a, (l_partkey % 13) / 13.0 AS b FROM lineitem), s AS (SELECT l_orderkey, sum(q * a) / nullif(sum(q), 0) AS a, sum(q * b) / nullif(sum(q), 0) AS b FROM m GROUP BY 1), c AS (SELECT o_orderkey, coalesce(a, 0.6) AS a, coalesce(b, 0.8) AS b FROM orders LEFT JOIN s ON l_orderkey = o_orderkey) SELECT o_orderkey AS pixel, round(a / greatest(sqrt(a * a + b * b), 1e-8), 5) AS a, round(b / greatest(sqrt(a * a + b * b), 1e-8), 5) AS b FROM c")
def a19_v5_mask_blend(spark, sf_dir):
    q = F.col("l_discount").cast("double")
    m = L.table(spark, sf_dir, "lineitem").select("l_orderkey", q.alias("q"), ((F.col("l_partkey") % 17) / 17.0).alias("a"), ((F.col("l_partkey") % 13) / 13.0).alias("b"))
    blended = G.weighted_mean(m, ["l_orderkey"], "q", ["a", "b"])
    pixels = L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pixel"))
    c = pixels.join(blended, F.col("pixel") == F.col("l_orderkey"), "left").select("pixel", F.coalesce("a", F.lit(0.6)).alias("a"), F.coalesce("b", F.lit(0.8)).alias("b"))
    norm = F.greatest(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), F.lit(1e-8))
    return c.select("pixel", F.round(F.col("a") / norm, 5).alias("a"), F.round(F.col("b") / norm, 5).alias("b"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 640 AS u, l_suppkey % 480 AS v FROM lineitem), x AS (SELECT *, u * (224.0 / 480) - (640 * (224.0 / 480) - 224) / 2 AS xc, v * (224.0 / 480) AS yc FROM p) SELECT l_orderkey, l_linenumber, CAST(trunc(least(greatest(xc / 32, 0), 6)) AS INTEGER) AS pu, CAST(trunc(least(greatest(yc / 32, 0), 6)) AS INTEGER) AS pv FROM x WHERE xc >= 0 AND xc < 224 AND yc >= 0 AND yc < 224")
def p12_patch_of_pixel(spark, sf_dir):
    p = L.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 640).alias("u"), (F.col("l_suppkey") % 480).alias("v"))
    pu, pv = G.patch(F.col("u"), F.col("v"), 640, 480, 224, 32)
    return p.select("l_orderkey", "l_linenumber", pu.alias("pu"), pv.alias("pv")).where("pu is not null and pv is not null")
