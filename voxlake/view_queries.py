"""Queries of heatmaps over scored voxels, inverses, and settings that are made to fit, over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import geometry
from voxlake.operators import grounding
from voxlake.plans import lifts as L
from voxlake.plans import modes
from voxlake.queries import _V, query, r6
from voxlake.scene_queries import _RAMP, STOPS


@query(_V + f""", s AS (SELECT v.*, list_inner_product(emb, q) AS score FROM v, q WHERE vec_id % 11 <> 0 AND weight >= 1 AND abs(tsdf) <= 0.5),
e AS (SELECT quantile_cont(score, 0.5) AS lo, greatest(quantile_cont(score, 0.99), quantile_cont(score, 0.5) + 1e-6) AS hi FROM s),
x AS (SELECT s.*, least(greatest((score - lo) / (hi - lo), 0.0), 1.0) * 4 AS t FROM s, e), y AS (SELECT *, CAST(least(floor(t), 3) AS INTEGER) AS k_ FROM x)
SELECT i, j, k, round((i + 0.5) * 0.1, 6) AS x, round((j + 0.5) * 0.1, 6) AS y, round((k + 0.5) * 0.1, 6) AS z, round(score, 6) AS score, red, green, blue
FROM (SELECT i, j, k, score, {_RAMP.replace('[k + ', '[k_ + ').replace('(t - k)', '(t - k_)')} FROM y)""")
def k3_scored_heatmap(spark, sf_dir):
    """The observed surface voxels with their scores as colors."""
    scored = grounding.score(L.voxels(spark, sf_dir), L.vector_of(spark, sf_dir, 0))
    h = grounding.heatmap(scored, STOPS)
    return h.select("i", "j", "k", *(r6(F.col(c), c) for c in ("x", "y", "z", "score")), "red", "green", "blue")


_A = [[f"({2 if r == c else 0} + CAST(embedding[{3 * r + c + 1}] AS DOUBLE))" for c in range(3)] for r in range(3)]
_T = [f"CAST(embedding[{10 + r}] AS DOUBLE)" for r in range(3)]
#: Cofactors by the rule of expanding along rows, written out for the SQL.
_M = lambda r, c: "(" + " - ".join(f"a{(r + 1) % 3}{(c + x) % 3} * a{(r + 2) % 3}{(c + y) % 3}" for x, y in ((1, 2), (2, 1))) + ")"


@query(
    f"WITH m AS (SELECT vec_id, {', '.join(f'{_A[r][c]} AS a{r}{c}' for r in range(3) for c in range(3))}, {', '.join(f'{t} AS t{r}' for r, t in enumerate(_T))} FROM embeddings), d AS (SELECT *, a00 * {_M(0, 0)} + a01 * {_M(0, 1)} + a02 * {_M(0, 2)} AS det FROM m), "
    f"i AS (SELECT vec_id, t0, t1, t2, {', '.join(f'{_M(c, r)} / det AS b{r}{c}' for r in range(3) for c in range(3))} FROM d) SELECT vec_id, {', '.join(f'round(b{r}{c}, 6) AS m{4 * r + c}' for r in range(3) for c in range(3))}, {', '.join(f'round(-(b{r}0 * t0 + b{r}1 * t1 + b{r}2 * t2), 6) AS m{4 * r + 3}' for r in range(3))} FROM i"
)
def m4_inverse(spark, sf_dir):
    """Inverses of affine maps that are not rigid."""
    e = L.table(spark, sf_dir, "embeddings")
    part = lambda n: F.col("embedding")[n].cast("double")
    m = [part(9 + r) if c == 3 else part(3 * r + c) + (2.0 if r == c else 0.0) for r in range(3) for c in range(4)]
    return e.select("vec_id", *(r6(x, f"m{n}") for n, x in enumerate(geometry.inverse(m))))


@query("""WITH r AS (SELECT p_partkey, ['reference', 'sparse_feature', 'block_hash', 'triton', NULL][p_partkey % 5 + 1] AS layout, ['global', 'patch', 'sam_dense', 'lseg'][p_partkey // 5 % 4 + 1] AS mode, p_size AS dim FROM part),
l AS (SELECT *, CASE WHEN layout IN ('reference', 'sparse_feature', 'block_hash') THEN layout ELSE 'reference' END AS own FROM r),
m AS (SELECT *, CASE WHEN own = 'sparse_feature' AND mode <> 'global' OR own = 'block_hash' AND mode = 'patch' THEN 'global' ELSE mode END AS used FROM l)
SELECT p_partkey, own AS layout, used AS mode, CAST(CASE WHEN own = 'block_hash' AND used = 'lseg' THEN 512 ELSE dim END AS BIGINT) AS dim FROM m""")
def v13_modes(spark, sf_dir):
    """Requested layouts, modes and lengths of features as they will be used."""
    p = L.table(spark, sf_dir, "part")
    layouts = F.array(*map(F.lit, ("reference", "sparse_feature", "block_hash", "triton", None)))
    names = F.array(*map(F.lit, ("global", "patch", "sam_dense", "lseg")))
    layout, mode, dim = modes.fitted(F.get(layouts, (F.col("p_partkey") % 5).cast("int")), F.get(names, F.expr("cast(p_partkey div 5 % 4 as int)")), F.col("p_size"))
    return p.select("p_partkey", layout.alias("layout"), mode.alias("mode"), dim.cast("long").alias("dim"))
