"""Queries of the spatial operators over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.functions import geometry as G
from voxlake.functions import vector
from voxlake.operators import fold, grounding, quantile, temporal
from voxlake.plans import lifts as L

QUERIES, ORACLE_SQL = {}, {}
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c, name):
    """Six decimals as SQL rounds a double: by its millionfold, not by the decimal that prints it, which differs for some halves."""
    return (F.round(c * 1e6) / 1e6).alias(name)


_V = f"WITH v AS ({L.VOXEL_SQL}), q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), g AS (SELECT CAST(embedding AS DOUBLE[]) AS g FROM embeddings WHERE vec_id = 1)"


@query(_V + ", s AS (SELECT v.*, CASE WHEN vec_id % 11 <> 0 THEN list_inner_product(emb, q) END AS s, CASE WHEN vec_id % 11 <> 0 THEN list_inner_product(emb, g) END AS n FROM v, q, g) SELECT vec_id, round(s, 6) AS score, round(s - n, 6) AS score_negative, CASE WHEN vec_id % 11 <> 0 THEN round(sqrt(list_inner_product(emb, emb)), 6) END AS norm FROM s")
def v1_v3_scores(spark, sf_dir):
    v, q, n = L.voxels(spark, sf_dir), L.vector_of(spark, sf_dir, 0), L.vector_of(spark, sf_dir, 1)
    both = grounding.score(v, q).withColumn("plain", F.col("score"))
    both = grounding.score(both, q, n)
    return both.select("vec_id", r6(F.col("plain"), "score"), r6(F.col("score"), "score_negative"), r6(vector.norm(F.col("feat")), "norm"))


_SEEN = _V + ", s AS (SELECT v.*, CASE WHEN vec_id % 11 <> 0 THEN list_inner_product(emb, q) END AS score FROM v, q), o AS (SELECT * FROM s WHERE weight >= 1 AND score IS NOT NULL AND abs(tsdf) <= 0.5), c AS (SELECT quantile_cont(score, 0.9) AS cut, avg(score) AS m FROM o), seed AS (SELECT o.* FROM o, c WHERE score >= cut)"


@query(_SEEN + " SELECT vec_id, round(score, 6) AS score, round(score - m, 6) AS centered FROM seed, c")
def p8_a9_a10_seeds(spark, sf_dir):
    s = grounding.score(L.voxels(spark, sf_dir), L.vector_of(spark, sf_dir, 0))
    found, mean = grounding.seeds(s, 0.1, None, 1.0, True, True)
    return found.crossJoin(F.broadcast(mean)).select("vec_id", r6(F.col("score"), "score"), r6(F.col("score") - F.col("mean"), "centered"))


def _ground_sql(missing: str) -> str:
    value = {"ignore": "s.score", "zero": "coalesce(s.score, 0.0)", "sentinel": "coalesce(s.score, -10000.0)"}[missing]
    return (
        _SEEN.replace("WITH v", "WITH RECURSIVE v", 1)
        + f""", e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM seed a, seed b WHERE greatest(abs(a.i - b.i), abs(a.j - b.j), abs(a.k - b.k)) <= 3),
reach AS (SELECT vec_id AS x, vec_id AS y FROM seed UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
lab AS (SELECT x, min(y) AS label FROM reach GROUP BY x),
mem AS (SELECT DISTINCT label, i + a AS i, j + b AS j, k + c2 AS k FROM lab JOIN seed ON vec_id = x, (VALUES (-1), (0), (1)) t1(a), (VALUES (-1), (0), (1)) t2(b), (VALUES (-1), (0), (1)) t3(c2)),
inside AS (SELECT * FROM mem WHERE i >= 0 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND 7),
m2 AS (SELECT inside.*, {value} AS value FROM inside LEFT JOIN s USING (i, j, k)),
agg AS (SELECT label, count(*) AS n, avg((i + 0.5) * 0.1) AS ci, avg((j + 0.5) * 0.1) AS cj, avg((k + 0.5) * 0.1) AS ck, min((i + 0.5) * 0.1) AS li, max((i + 0.5) * 0.1) AS hi, avg(value) AS sc, min((i * 8 + j) * 8 + k) AS f FROM m2 GROUP BY label)
SELECT row_number() OVER (ORDER BY sc * ln(1 + n) DESC, f) AS rank, n AS count, round(ci, 6) AS center_i, round(cj, 6) AS center_j, round(ck, 6) AS center_k, round(li, 6) AS min_i, round(hi, 6) AS max_i, round(sc, 6) AS score FROM agg QUALIFY rank <= 5"""
    )


def _ground(missing):
    def run(spark, sf_dir):
        r = grounding.ground(L.voxels(spark, sf_dir), L.vector_of(spark, sf_dir, 0), L.DIMS, missing=missing)
        return r.select(F.col("rank").cast("long").alias("rank"), "count", *(r6(F.col(c), c) for c in ("center_i", "center_j", "center_k", "min_i", "max_i", "score")))

    run.__name__ = f"ground_{missing}"
    return run


for _m in ("ignore", "zero", "sentinel"):
    query(_ground_sql(_m))(_ground(_m))

_OBS = "WITH o AS (SELECT l_partkey AS voxel, CAST(l_quantity AS DOUBLE) / 50 AS s, l_discount <= 0.05 AS g, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber))"


def _fold_sql(cap: int) -> str:
    # an ordered fold over the list of samples, independent of the closed form
    return f"""WITH o AS (SELECT l_partkey AS voxel, list(CAST(l_quantity AS DOUBLE) / 50 ORDER BY l_shipdate, l_orderkey, l_linenumber) AS xs FROM lineitem GROUP BY 1)
SELECT voxel, round(list_reduce(list_transform(xs, lambda x, i: [x, CAST(least(i - 1, {cap}) AS DOUBLE)]), lambda a, b: [(a[1] * b[2] + b[1]) / (b[2] + 1), 0.0])[1], 6) AS mean, least(len(xs), {cap}) AS weight, CAST(len(xs) AS BIGINT) AS n FROM o"""


@query(_fold_sql(32))
def a1_running_mean(spark, sf_dir):
    m = fold.running_mean(L.observations(spark, sf_dir), ["voxel"], ORDER, F.col("sample"), 32)
    return m.select("voxel", r6(F.col("mean"), "mean"), "weight", "n")


@query(_fold_sql(5))
def a1_running_mean_low_cap(spark, sf_dir):
    m = fold.running_mean(L.observations(spark, sf_dir), ["voxel"], ORDER, F.col("sample"), 5)
    return m.select("voxel", r6(F.col("mean"), "mean"), "weight", "n")


@query("""WITH o AS (SELECT l_partkey AS voxel, list(struct_pack(x := CAST(l_quantity AS DOUBLE) / 50, g := l_discount <= 0.05) ORDER BY l_shipdate, l_orderkey, l_linenumber) AS xs FROM lineitem GROUP BY 1),
p AS (SELECT voxel, list_prepend([0.0, 0.0, 0.0], list_transform(xs, lambda x, i: [x.x, CAST(least(i - 1, 32) AS DOUBLE), CAST(x.g AS DOUBLE)])) AS ys, len(list_filter(xs, lambda x: x.g)) AS n FROM o)
SELECT voxel, round(list_reduce(ys, lambda a, b: [CASE WHEN b[3] = 1.0 THEN (a[1] * b[2] + b[1]) / (b[2] + 1) ELSE a[1] END, 0.0, 0.0])[1], 6) AS mean, CAST(n AS BIGINT) AS n FROM p WHERE n > 0""")
def a3_gated_mean(spark, sf_dir):
    m = fold.gated_mean(L.observations(spark, sf_dir), ["voxel"], ORDER, F.col("sample"), F.col("gate"), 32)
    return m.select("voxel", r6(F.col("mean"), "mean"), "n")


def _segmented(spark, sf_dir):
    """Both folds of each voxel by years of its samples, none of which needs all of a voxel's samples in one task."""
    o = L.observations(spark, sf_dir)
    return fold.means_by_segments(o, ["voxel"], ORDER, F.year("l_shipdate"), {"mean": F.col("sample")}, {"near": F.col("sample")}, F.col("gate"), 32)


@query(ORACLE_SQL["a1_running_mean"])
def a1_by_segments(spark, sf_dir):
    return _segmented(spark, sf_dir).select("voxel", r6(F.col("mean"), "mean"), "weight", "n")


@query(ORACLE_SQL["a3_gated_mean"])
def a3_by_segments(spark, sf_dir):
    return _segmented(spark, sf_dir).where("gated_n > 0").select("voxel", r6(F.col("near"), "mean"), F.col("gated_n").alias("n"))


_EV = "WITH c AS (SELECT event_id AS id, epoch_us(ts::TIMESTAMP) AS t FROM events WHERE event_type = 'click'), w AS (SELECT event_id AS id, epoch_us(ts::TIMESTAMP) AS t FROM events WHERE event_type = 'view')"


@query(_EV + ", lo AS (SELECT c.id, c.t, w.id AS m, w.t AS mt FROM c ASOF LEFT JOIN w ON c.t >= w.t), hi AS (SELECT c.id, w.id AS m, w.t AS mt FROM c ASOF LEFT JOIN w ON c.t <= w.t) SELECT lo.id, lo.t, CASE WHEN hi.mt IS NULL OR lo.t - lo.mt <= hi.mt - lo.t THEN lo.m ELSE hi.m END AS match_id, CASE WHEN hi.mt IS NULL OR lo.t - lo.mt <= hi.mt - lo.t THEN lo.t - lo.mt ELSE hi.mt - lo.t END AS gap FROM lo JOIN hi USING (id)")
def j8_nearest_in_time(spark, sf_dir):
    return temporal.nearest(L.stream(spark, sf_dir, "click"), L.stream(spark, sf_dir, "view"), 3_600_000_000)


@query(_EV + " SELECT c.id AS left_id, w.id AS right_id, w.t - c.t AS gap FROM c JOIN w ON abs(w.t - c.t) <= 60000000")
def j9_interval_sync(spark, sf_dir):
    return temporal.within(L.stream(spark, sf_dir, "click"), L.stream(spark, sf_dir, "view"), 60_000_000)


@query("WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 100) / 10.0 - 5 AS x, (l_suppkey % 60) / 10.0 - 3 AS y, CAST(l_quantity AS DOUBLE) / 10 AS z FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(round_even(60.0 * x / (z + 1e-8) + 39.5, 0) AS INTEGER) AS u, CAST(round_even(60.0 * y / (z + 1e-8) + 29.5, 0) AS INTEGER) AS v, round(greatest(least((3.0 - z) / 0.4, 1.0), -1.0), 6) AS sdf FROM p WHERE z > 0 AND 3.0 - z >= -0.4 AND round_even(60.0 * x / (z + 1e-8) + 39.5, 0) BETWEEN 0 AND 79 AND round_even(60.0 * y / (z + 1e-8) + 29.5, 0) BETWEEN 0 AND 59")
def p3_p5_projection(spark, sf_dir):
    li = L.table(spark, sf_dir, "lineitem")
    p = li.select("l_orderkey", "l_linenumber", ((F.col("l_partkey") % 100) / 10.0 - 5).alias("x"), ((F.col("l_suppkey") % 60) / 10.0 - 3).alias("y"), (F.col("l_quantity").cast("double") / 10).alias("z"))
    p = p.where("z > 0").withColumn("u", G.pixel(F.lit(60.0), F.col("x"), F.col("z"), F.lit(39.5))).withColumn("v", G.pixel(F.lit(60.0), F.col("y"), F.col("z"), F.lit(29.5)))
    p = p.where((F.lit(3.0) - F.col("z") >= -0.4) & F.col("u").between(0, 79) & F.col("v").between(0, 59))
    return p.select("l_orderkey", "l_linenumber", "u", "v", r6(G.signed_sample(F.lit(3.0), F.col("z"), 0.4), "sdf"))


@query("WITH v AS (SELECT p_partkey, p_size AS seg, (p_partkey % 97) / 10.0 AS x, (p_partkey % 89) / 20.0 AS z FROM part) SELECT seg, count(*) AS n, round(min(x) - 0.05, 3) AS min_x, round(max(x) + 0.05, 3) AS max_x, round(quantile_cont(z, 0.02), 6) AS floor_z, round(quantile_cont(z, 0.98), 6) AS ceiling_z FROM v GROUP BY seg HAVING count(*) >= 3")
def a15_a16_boxes(spark, sf_dir):
    v = L.table(spark, sf_dir, "part").select(F.col("p_size").alias("seg"), ((F.col("p_partkey") % 97) / 10.0).alias("x"), ((F.col("p_partkey") % 89) / 20.0).alias("z"))
    per = v.groupBy("seg").agg(F.round(F.min("x") - 0.05, 3).alias("min_x"), F.round(F.max("x") + 0.05, 3).alias("max_x"))
    heights = quantile.quantiles(v, "z", {"floor_z": 0.02, "ceiling_z": 0.98}, ["seg"]).where("n >= 3")
    return per.join(heights, "seg").select("seg", "n", "min_x", "max_x", r6(F.col("floor_z"), "floor_z"), r6(F.col("ceiling_z"), "ceiling_z"))


@query(f"WITH v AS ({L.VOXEL_SQL}) SELECT i // 8 AS bx, j // 8 AS by, k // 8 AS bz, count(*) AS voxels, count(feat) AS features, count(feat) * 64 * 4 AS feature_bytes FROM v GROUP BY 1, 2, 3")
def a20_a22_blocks(spark, sf_dir):
    v = L.voxels(spark, sf_dir)
    b = v.groupBy(F.expr("i div 8").alias("bx"), F.expr("j div 8").alias("by"), F.expr("k div 8").alias("bz")).agg(F.count("*").alias("voxels"), F.count("feat").alias("features"))
    return b.withColumn("feature_bytes", F.col("features") * 64 * 4)


@query(f"WITH v AS ({L.VOXEL_SQL}), p AS (SELECT event_id AS id, value * 3 AS x, (event_id % 79) / 100.0 AS y, (event_id % 73) / 100.0 AS z FROM events), n AS (SELECT id, CAST(least(greatest(floor(x / 0.1), 0), 1000000) AS BIGINT) AS i, CAST(least(greatest(floor(y / 0.1), 0), 7) AS BIGINT) AS j, CAST(least(greatest(floor(z / 0.1), 0), 7) AS BIGINT) AS k FROM p) SELECT id, coalesce(tsdf, 1.0) AS tsdf, coalesce(weight, 0.0) AS weight FROM n LEFT JOIN v USING (i, j, k)")
def g4_g5_nearest_voxel(spark, sf_dir):
    cell = lambda c, n: F.least(F.greatest(F.floor(c / 0.1), F.lit(0)), F.lit(n)).cast("long")
    e = L.table(spark, sf_dir, "events")
    p = e.select(F.col("event_id").alias("id"), cell(F.col("value") * 3, 1_000_000).alias("i"), cell((F.col("event_id") % 79) / 100.0, 7).alias("j"), cell((F.col("event_id") % 73) / 100.0, 7).alias("k"))
    v = L.voxels(spark, sf_dir).select("i", "j", "k", "tsdf", "weight")
    return p.join(v, ["i", "j", "k"], "left").select("id", F.coalesce("tsdf", F.lit(1.0)).alias("tsdf"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query("WITH c AS (SELECT c_custkey, c_nationkey AS kind, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, c_acctbal > 5000 AND c_custkey % 3 = 0 AS hit FROM customer), h AS (SELECT kind, min(CASE WHEN hit THEN rank END) AS rank_of_hit FROM c GROUP BY kind) SELECT kind, rank_of_hit, coalesce(rank_of_hit = 1, false) AS hit1, coalesce(rank_of_hit <= 5, false) AS hit5 FROM h")
def w2_a12_rank_of_hit(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = L.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("kind"), F.row_number().over(w).cast("long").alias("rank"), ((F.col("c_acctbal") > 5000) & (F.col("c_custkey") % 3 == 0)).alias("hit"))
    h = c.groupBy("kind").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank_of_hit"))
    return h.select("kind", "rank_of_hit", F.coalesce(F.col("rank_of_hit") == 1, F.lit(False)).alias("hit1"), F.coalesce(F.col("rank_of_hit") <= 5, F.lit(False)).alias("hit5"))
