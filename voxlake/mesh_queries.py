"""Queries of meshes, and of colors and features at points, over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import vector
from voxlake.operators import mesh, points
from voxlake.plans import lifts as L
from voxlake.queries import query, r6

COLORS = ("red", "green", "blue")
#: Colors of the voxels, some of them beyond a byte.
_SHADE = {"red": "(vec_id * 3) % 300 - 20", "green": "(vec_id * 5) % 256", "blue": "(vec_id * 11) % 290 - 10"}


def colored(spark, sf_dir):
    v = L.voxels(spark, sf_dir)
    return v.withColumns({c: F.expr(f"cast({_SHADE[c]} as double)") for c in COLORS})


_COLORED = L.VOXEL_SQL.replace(" FROM embeddings", ", " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _SHADE.items()) + " FROM embeddings")
_GRID = "(VALUES (0), (1)) o1(a), (VALUES (0), (1)) o2(b), (VALUES (0), (1)) o3(c)"
_TABLE = ", ".join(f"({p}, {n}, {t[0]}, {t[1]}, {t[2]})" for p, ts in enumerate(mesh.triangle_table()) for n, t in enumerate(ts))
_EDGES = ", ".join(f"({n}, {axis}, {o[0]}, {o[1]}, {o[2]})" for n, (axis, o) in enumerate(mesh.EDGES))
#: Voxels that count, and those around them that may be corners of their cells, +1 where not observed.
_DENSE = f"""v AS ({_COLORED}), w AS (SELECT *, CASE WHEN weight >= 1 THEN tsdf ELSE 1.0 END AS d FROM v),
cell AS (SELECT DISTINCT i - a AS i, j - b AS j, k - c AS k FROM w, {_GRID} WHERE i - a BETWEEN 0 AND {L.DIMS[0] - 2} AND j - b BETWEEN 0 AND {L.DIMS[1] - 2} AND k - c BETWEEN 0 AND {L.DIMS[2] - 2})"""
_NUMBER = "(((q.i + {e}.x) * 8 + q.j + {e}.y) * 8 + q.k + {e}.z) * 3 + {e}.axis"


@query(f"""WITH {_DENSE}, corner AS (SELECT cell.i, cell.j, cell.k, 4 * a + 2 * b + c AS bit, coalesce(w.d, 1.0) < 0 AS neg FROM cell CROSS JOIN {_GRID} LEFT JOIN w ON w.i = cell.i + a AND w.j = cell.j + b AND w.k = cell.k + c),
q AS (SELECT i, j, k, CAST(sum(CASE WHEN neg THEN power(2, bit) ELSE 0 END) AS INTEGER) AS pattern FROM corner GROUP BY i, j, k),
t(pattern, n, p1, p2, p3) AS (VALUES {_TABLE}), e(edge, axis, x, y, z) AS (VALUES {_EDGES})
SELECT q.i, q.j, q.k, CAST(n AS INTEGER) AS n, CAST({_NUMBER.format(e='e1')} AS BIGINT) AS a, CAST({_NUMBER.format(e='e2')} AS BIGINT) AS b, CAST({_NUMBER.format(e='e3')} AS BIGINT) AS c
FROM q JOIN t USING (pattern) JOIN e e1 ON e1.edge = p1 JOIN e e2 ON e2.edge = p2 JOIN e e3 ON e3.edge = p3""")
def g6_faces(spark, sf_dir):
    """The triangles of the surface, by cell, as edge numbers of their vertices."""
    return mesh.faces(L.voxels(spark, sf_dir), L.DIMS).select("i", "j", "k", "n", "a", "b", "c")


def _side_sql(axis: int) -> str:
    at = {c: f"w.{c} + {int(n == axis)}" for n, c in enumerate("ijk")}
    return f"SELECT w.i, w.j, w.k, {axis} AS axis, w.d AS d0, coalesce(u.d, 1.0) AS d1, {', '.join(f'w.{c} AS {c}0, u.{c} AS {c}1' for c in COLORS)} FROM p w LEFT JOIN w u ON u.i = {at['i']} AND u.j = {at['j']} AND u.k = {at['k']} WHERE w.{'ijk'[axis]} < {L.DIMS[axis] - 1}"


@query(f"""WITH {_DENSE}, p AS (SELECT c.i, c.j, c.k, coalesce(w.d, 1.0) AS d, red, green, blue FROM (SELECT i, j, k FROM w UNION SELECT i - 1, j, k FROM w WHERE i > 0 UNION SELECT i, j - 1, k FROM w WHERE j > 0 UNION SELECT i, j, k - 1 FROM w WHERE k > 0) c LEFT JOIN w USING (i, j, k)),
s AS ({' UNION ALL '.join(_side_sql(a) for a in range(3))}), x AS (SELECT *, d0 / (d0 - d1) AS t FROM s WHERE (d0 < 0) <> (d1 < 0))
SELECT CAST(((i * 8 + j) * 8 + k) * 3 + axis AS BIGINT) AS vertex, round((i + 0.5 + CASE WHEN axis = 0 THEN t ELSE 0 END) * 0.1, 6) AS x, round((j + 0.5 + CASE WHEN axis = 1 THEN t ELSE 0 END) * 0.1, 6) AS y, round((k + 0.5 + CASE WHEN axis = 2 THEN t ELSE 0 END) * 0.1, 6) AS z,
{', '.join(f'CAST(trunc(greatest(least(coalesce(CASE WHEN t < 0.5 THEN {c}0 ELSE {c}1 END, 0.0), 255.0), 0.0)) AS INTEGER) AS {c}' for c in COLORS)} FROM x""")
def g6_colored_vertices(spark, sf_dir):
    """The vertices of the surface with the color of the nearer voxel."""
    v = mesh.vertices(colored(spark, sf_dir), L.DIMS, colors=COLORS)
    return v.select("vertex", *(r6(F.col(c), c) for c in "xyz"), *COLORS)


_SHOWN = (0, 31, 63)
_POINTS = "p AS (SELECT event_id AS id, value / 60 / 0.1 AS x, (event_id % 79) / 100.0 / 0.1 AS y, (event_id % 73) / 100.0 / 0.1 AS z FROM events)"


def _at(spark, sf_dir):
    e = L.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("value") / 60).alias("x"), ((F.col("event_id") % 79) / 100.0).alias("y"), ((F.col("event_id") % 73) / 100.0).alias("z"))


def _with_feature(df):
    return df.select("id", *COLORS, r6(vector.norm(F.col("feat")), "feat_norm"), *(r6(F.col("feat")[d], f"feat_{d}") for d in _SHOWN))


_BYTES = ", ".join(f"CAST(trunc(round(greatest(least({{}}({{}}coalesce({c}, 0.0)), 255.0), 0.0), 9)) AS INTEGER) AS {c}" for c in COLORS)
_FEATURES = "round(sqrt(list_inner_product(f, f)), 6) AS feat_norm, " + ", ".join(f"round(f[{d + 1}], 6) AS feat_{d}" for d in _SHOWN)


@query(f"""WITH v AS ({_COLORED}), {_POINTS}, g AS (SELECT id, x - 0.5 AS x, y - 0.5 AS y, z - 0.5 AS z, least(greatest(floor(x - 0.5), 0), 1048575) AS i, least(greatest(floor(y - 0.5), 0), 7) AS j, least(greatest(floor(z - 0.5), 0), 7) AS k FROM p),
h AS (SELECT *, least(greatest(x - i, 0), 1) AS fx, least(greatest(y - j, 0), 1) AS fy, least(greatest(z - k, 0), 1) AS fz FROM g),
n AS (SELECT id, CAST(least(i + a, 1048575) AS BIGINT) AS i, CAST(least(j + b, 7) AS BIGINT) AS j, CAST(least(k + c, 7) AS BIGINT) AS k, (CASE WHEN a = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN b = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN c = 1 THEN fz ELSE 1 - fz END) AS share FROM h, {_GRID}),
m AS (SELECT id, share, red, green, blue, CASE WHEN feat IS NOT NULL THEN emb END AS e FROM n LEFT JOIN v USING (i, j, k)),
s AS (SELECT id, {_BYTES.format(*('sum', 'share * ') * 3)} FROM m GROUP BY id),
d AS (SELECT id, d, sum(share * coalesce(e[d], 0.0)) AS y FROM m, range(1, 65) r(d) GROUP BY id, d), l AS (SELECT id, list(y ORDER BY d) AS f FROM d GROUP BY id)
SELECT id, red, green, blue, {_FEATURES} FROM s JOIN l USING (id)""")
def g3_color_feature(spark, sf_dir):
    """Colors and whole feature vectors interpolated at points."""
    return _with_feature(points.trilinear(_at(spark, sf_dir), colored(spark, sf_dir), L.DIMS, {}, colors=COLORS, vectors={"feat": 64}))


@query(f"""WITH v AS ({_COLORED}), {_POINTS}, n AS (SELECT id, CAST(least(greatest(floor(x), 0), 1048575) AS BIGINT) AS i, CAST(least(greatest(floor(y), 0), 7) AS BIGINT) AS j, CAST(least(greatest(floor(z), 0), 7) AS BIGINT) AS k FROM p),
m AS (SELECT id, {_BYTES.format(*('', '') * 3)}, CASE WHEN feat IS NOT NULL THEN emb ELSE list_transform(range(64), lambda x: 0.0::DOUBLE) END AS f FROM n LEFT JOIN v USING (i, j, k))
SELECT id, red, green, blue, {_FEATURES} FROM m""")
def g4_color_feature(spark, sf_dir):
    """Colors and whole feature vectors of the voxel at each point."""
    return _with_feature(points.nearest(_at(spark, sf_dir), colored(spark, sf_dir), L.DIMS, {}, colors=COLORS, vectors={"feat": 64}))
