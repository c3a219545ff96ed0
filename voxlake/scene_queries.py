"""Queries of points, poses, colors, labels, evaluation and streams over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions import geometry as G
from voxlake.functions import vector
from voxlake.operators import fold, points, quantile, temporal
from voxlake.plans import lifts as L
from voxlake.queries import _EV, ORDER, _fold_sql, query, r6
from voxlake.streaming import live_map, sync

#: The five stops of the score colors.
STOPS = [(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)]


@query(f"""WITH v AS ({L.VOXEL_SQL}), p AS (SELECT event_id AS id, value / 60 / 0.1 - 0.5 AS x, (event_id % 79) / 100.0 / 0.1 - 0.5 AS y, (event_id % 73) / 100.0 / 0.1 - 0.5 AS z FROM events),
g AS (SELECT id, least(greatest(floor(x), 0), 1048575) AS i, least(greatest(floor(y), 0), 7) AS j, least(greatest(floor(z), 0), 7) AS k, x, y, z FROM p),
f AS (SELECT *, least(greatest(x - i, 0), 1) AS fx, least(greatest(y - j, 0), 1) AS fy, least(greatest(z - k, 0), 1) AS fz FROM g),
c AS (SELECT id, CAST(least(i + a, 1048575) AS BIGINT) AS i, CAST(least(j + b, 7) AS BIGINT) AS j, CAST(least(k + d, 7) AS BIGINT) AS k, (CASE WHEN a = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN b = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN d = 1 THEN fz ELSE 1 - fz END) AS share FROM f, (VALUES (0), (1)) t1(a), (VALUES (0), (1)) t2(b), (VALUES (0), (1)) t3(d))
SELECT id, round(sum(share * coalesce(tsdf, 1.0)), 6) AS tsdf, round(sum(share * coalesce(weight, 0.0)), 6) AS weight FROM c LEFT JOIN v USING (i, j, k) GROUP BY id""")
def g3_j16_trilinear(spark, sf_dir):
    e = L.table(spark, sf_dir, "events")
    at = e.select(F.col("event_id").alias("id"), (F.col("value") / 60).alias("x"), ((F.col("event_id") % 79) / 100.0).alias("y"), ((F.col("event_id") % 73) / 100.0).alias("z"))
    r = points.trilinear(at, L.voxels(spark, sf_dir), L.DIMS, {"tsdf": 1.0, "weight": 0.0})
    return r.select("id", r6(F.col("tsdf"), "tsdf"), r6(F.col("weight"), "weight"))


@query(_EV.replace("event_type = 'view'", "event_type = 'purchase'").replace("epoch_us(ts::TIMESTAMP) AS t FROM events WHERE event_type = 'purchase'", "epoch_us(ts::TIMESTAMP) AS t, value AS x FROM events WHERE event_type = 'purchase'") + ", lo AS (SELECT c.id, c.t, w.t AS t0, w.x AS x0 FROM c ASOF JOIN w ON c.t >= w.t), hi AS (SELECT c.id, w.t AS t1, w.x AS x1 FROM c ASOF JOIN w ON c.t <= w.t) SELECT lo.id, t, round(CASE WHEN t1 > t0 THEN x0 + (x1 - x0) * ((t - t0) / (t1 - t0)) ELSE x0 END, 6) AS x FROM lo JOIN hi USING (id)")
def j10_pose_at_time(spark, sf_dir):
    e = L.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    poses = e.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"))
    r = temporal.pose_at(L.stream(spark, sf_dir, "click"), poses, 3_600_000_000)
    return r.select("id", "t", r6(F.col("x"), "x"))


_CHANNEL = "list_reduce(list_transform(list({0} ORDER BY l_shipdate, l_orderkey, l_linenumber), lambda x, i: [x, CAST(least(i - 1, 32) AS DOUBLE)]), lambda a, b: [(a[1] * b[2] + b[1]) / (b[2] + 1), 0.0])[1]"


@query("SELECT l_partkey AS voxel, " + ", ".join(f"round({_CHANNEL.format(c)}, 6) AS {n}" for c, n in (("l_quantity / 50", "red"), ("l_discount * 10", "green"), ("l_tax * 10", "blue"))) + " FROM lineitem GROUP BY 1")
def a2_color_mean(spark, sf_dir):
    o = L.table(spark, sf_dir, "lineitem").withColumn("voxel", F.col("l_partkey"))
    color = {"red": F.col("l_quantity") / 50, "green": F.col("l_discount") * 10, "blue": F.col("l_tax") * 10}
    m = fold.running_means(o, ["voxel"], ORDER, color, 32)
    return m.select("voxel", *(r6(F.col(c), c) for c in color))


@query("WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), b AS (SELECT CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM part, e GROUP BY 1) SELECT bin, round(lo + bin * ((hi - lo) / 50), 6) AS low, n, row_number() OVER (ORDER BY n DESC, bin) <= 4 AS peak FROM b")
def a17_w3_histogram_peaks(spark, sf_dir):
    h = points.histogram(L.table(spark, sf_dir, "part"), F.col("p_retailprice"), 50)
    w = Window.orderBy(F.desc("n"), "bin")  # one row for each bin
    return h.select("bin", r6(F.col("low"), "low"), "n", (F.row_number().over(w) <= 4).alias("peak"))


@query("WITH s AS (SELECT c_nationkey AS scene, count(*) AS n, avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END) AS hit1, avg(abs(c_acctbal)) FILTER (WHERE c_acctbal > 5000) AS l2 FROM customer GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS scenes, CAST(sum(n) AS BIGINT) AS queries, round(avg(hit1), 6) AS hit1, round(avg(l2), 6) AS hit_only_l2 FROM s")
def a13_macro_average(spark, sf_dir):
    hit = F.col("c_acctbal") > 5000
    s = L.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("hit1"), F.avg(F.when(hit, F.abs("c_acctbal"))).alias("l2"))
    return s.agg(F.count("*").alias("scenes"), F.sum("n").alias("queries"), r6(F.avg("hit1"), "hit1"), r6(F.avg("l2"), "hit_only_l2"))


@query("WITH n AS (SELECT p_partkey, lower(trim(p_brand)) AS label, row_number() OVER (PARTITION BY lower(trim(p_brand)) ORDER BY p_partkey) AS k, p_size FROM part) SELECT p_partkey, CASE WHEN k > 1 THEN label || ' (instance ' || k || ')' ELSE label END AS label FROM n WHERE p_size >= 3")
def w4_distinct_labels(spark, sf_dir):
    p = L.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lower(F.trim("p_brand")).alias("name"))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("p_partkey")))  # small instances are numbered too
    return p.where("p_size >= 3").select("p_partkey", F.when(F.col("k") > 1, F.format_string("%s (instance %d)", "name", "k")).otherwise(F.col("name")).alias("label"))


_RAMP = ", ".join(f"CAST(trunc([{', '.join(f'{s[c]}.0' for s in STOPS)}][k + 1] + ([{', '.join(f'{s[c]}.0' for s in STOPS)}][k + 2] - [{', '.join(f'{s[c]}.0' for s in STOPS)}][k + 1]) * (t - k)) AS INTEGER) AS {n}" for c, n in enumerate(("red", "green", "blue")))


@query(f"WITH e AS (SELECT quantile_cont(o_totalprice, 0.5) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders), x AS (SELECT o_orderkey, least(greatest((o_totalprice - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END), 0.0), 1.0) * 4 AS t FROM orders, e), y AS (SELECT o_orderkey, t, CAST(least(floor(t), 3) AS INTEGER) AS k FROM x) SELECT o_orderkey, {_RAMP} FROM y")
def a21_m13_heatmap(spark, sf_dir):
    o = L.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    e = quantile.quantiles(o, "o_totalprice", {"lo": 0.5, "hi": 0.99}).select("lo", "hi")  # one row
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    red, green, blue = G.colormap((F.col("o_totalprice") - F.col("lo")) / span, STOPS)
    return o.join(F.broadcast(e)).select("o_orderkey", red.alias("red"), green.alias("green"), blue.alias("blue"))


@query("WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 5)) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, abs(sqrt(list_inner_product(e, e)) - 1) <= 0.01 AS is_unit, round(e[1] / greatest(sqrt(list_inner_product(e, e)), 1e-8), 6) AS first_normalised FROM v")
def v2_v5_norms(spark, sf_dir):
    e = L.table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> cast(x as double) * (1 + vec_id % 5))").alias("e"))
    n = vector.norm(F.col("e"))
    return e.select("vec_id", r6(n, "norm"), (F.abs(n - 1) <= 0.01).alias("is_unit"), r6(F.col("e")[0] / F.greatest(n, F.lit(1e-8)), "first_normalised"))


@query("SELECT o_orderkey AS frame_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def j11_frames_in_all(spark, sf_dir):
    li = L.table(spark, sf_dir, "lineitem")
    color, depth = (li.where(c).select(F.col("l_orderkey").alias("frame_id")) for c in ("l_returnflag = 'R'", "l_linestatus = 'F'"))
    return L.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id")).join(color, "frame_id", "left_semi").join(depth, "frame_id", "left_semi")


@query(_EV + " SELECT c.id AS left_id, w.id AS right_id, w.t - c.t AS gap FROM c JOIN w ON abs(w.t - c.t) <= 60000000")
def st1_stream_sync(spark, sf_dir):
    e = sync.source(spark, f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return sync.drained(sync.synchronised(e.where("event_type = 'click'"), e.where("event_type = 'view'"), 60), "sync")


@query(_fold_sql(32))
def st4_st5_live_map(spark, sf_dir):
    o = sync.source(spark, f"{sf_dir}/lineitem.parquet").withColumn("voxel", F.col("l_partkey"))
    m = live_map.run(o, ["voxel"], ORDER, F.col("l_quantity") / 50, 32)
    return m.select("voxel", r6(F.col("mean"), "mean"), F.least(F.col("n"), F.lit(32).cast("long")).alias("weight"), "n")
