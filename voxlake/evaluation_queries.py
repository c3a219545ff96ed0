"""Queries of evaluation, labels, sampling and formats over the driver tables, each with SQL for the same rows. Customers stand for results, nations for cases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions import geometry
from voxlake.operators import evaluation, grounding, quantile
from voxlake.plans import lifts as L
from voxlake.queries import _SEEN, query, r6
from voxlake.storage import new_path

_CASES = """
r AS (
  SELECT c_nationkey AS case_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank,
    (c_custkey % 100) / 10.0 AS x, (c_custkey % 70) / 10.0 AS y, (c_custkey % 30) / 10.0 AS z
  FROM customer WHERE c_nationkey % 6 <> 0
), t AS (SELECT * FROM r WHERE rank <= 5),
s AS (SELECT n_nationkey AS case_id, n_regionkey, (n_nationkey % 10) * 0.6 AS m FROM nation),
j AS (
  SELECT s.case_id, rank, x BETWEEN m - 0.25 AND m + 4 + 0.25 AND y BETWEEN m - 0.25 AND m + 4 + 0.25 AND z BETWEEN 0.5 - 0.25 AND 2.5 + 0.25 AS hit,
    sqrt((x - (m + 2)) ** 2 + (y - (m + 2)) ** 2 + (z - 1.5) ** 2) AS l2
  FROM s LEFT JOIN t ON s.case_id = t.case_id
), p AS (
  SELECT case_id, count(rank) AS num_results, min(rank) FILTER (hit) AS rank_of_hit, coalesce(arg_min(l2, rank), 'inf'::DOUBLE) AS l2 FROM j GROUP BY 1
), e AS (SELECT *, coalesce(rank_of_hit = 1, false) AS hit1, rank_of_hit IS NOT NULL AS hit5 FROM p)"""


def _per_case(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = L.table(spark, sf_dir, "customer").where("c_nationkey % 6 <> 0")
    at = {n: (F.col("c_custkey") % m) / 10.0 for n, m in (("x", 100), ("y", 70), ("z", 30))}
    r = c.select(F.col("c_nationkey").alias("case_id"), F.row_number().over(w).cast("long").alias("rank"), *(e.alias(n) for n, e in at.items())).where("rank <= 5")
    m = (F.col("n_nationkey") % 10) * 0.6
    box = {"min_x": m, "max_x": m + 4, "min_y": m, "max_y": m + 4, "min_z": F.lit(0.5), "max_z": F.lit(2.5)}
    cases = L.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case_id"), *(e.alias(n) for n, e in box.items()))
    return evaluation.per_case(r, cases, 0.25)


@query(f"WITH {_CASES} SELECT case_id, num_results, rank_of_hit, hit1, hit5, isinf(l2) AS no_result, round(CASE WHEN isinf(l2) THEN NULL ELSE l2 END, 6) AS l2 FROM e")
def j14_p10_m6_per_case(spark, sf_dir):
    none = F.col("l2") == float("inf")
    return _per_case(spark, sf_dir).withColumn("no_result", none).withColumn("l2", F.when(~none, F.round("l2", 6)))


@query(f"""
WITH {_CASES} SELECT count(*) AS n, round(avg(CAST(hit1 AS DOUBLE)), 6) AS hit1, round(avg(CAST(hit5 AS DOUBLE)), 6) AS hit5, bool_or(isinf(l2)) AS mean_is_infinite,
  round(avg(l2) FILTER (hit5), 6) AS hit_only_l2, round(avg(l2) FILTER (NOT isinf(l2)), 6) AS finite_l2 FROM e""")
def a12_m5_summary(spark, sf_dir):
    """The mean distance is infinite as soon as one case has no result; hits' own and the finite one are kept apart."""
    per = _per_case(spark, sf_dir)
    s = evaluation.summary(per).crossJoin(F.broadcast(evaluation.summary(per.where(F.col("l2") < float("inf"))).select(F.col("mean_l2").alias("finite_l2"))))  # one row each
    return s.select("n", r6(F.col("hit1"), "hit1"), r6(F.col("hit5"), "hit5"), (F.col("mean_l2") == float("inf")).alias("mean_is_infinite"), r6(F.col("hit_only_l2"), "hit_only_l2"), r6(F.col("finite_l2"), "finite_l2"))


@query(f"""
WITH {_CASES}, k AS (SELECT case_id, CASE WHEN case_id % 5 = 4 THEN 'object' ELSE 'kind ' || (case_id % 3) END AS kind FROM e)
SELECT kind, count(*) AS n, CAST(sum(CAST(hit1 AS INTEGER)) AS BIGINT) AS hit1, CAST(sum(CAST(hit5 AS INTEGER)) AS BIGINT) AS hit5 FROM e JOIN k USING (case_id) GROUP BY 1""")
def a14_j13_per_kind(spark, sf_dir):
    """Kinds come from the first case of the same query in a second list, in which each query stands three times and some not at all."""
    n = L.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query")).where("query % 5 <> 4")
    spec = n.withColumn("position", F.explode(F.array(*map(F.lit, (3, 1, 2))))).withColumn("kind", F.when(F.col("position") == 1, F.concat(F.lit("kind "), F.col("query") % 3)).otherwise("later"))
    k = evaluation.with_kind(_per_case(spark, sf_dir).withColumnRenamed("case_id", "query"), spec)
    return k.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("hit1").cast("int")).alias("hit1"), F.sum(F.col("hit5").cast("int")).alias("hit5"))


@query(f"""
WITH {_CASES} SELECT case_id % 5 AS scene, count(*) AS n, '| ' || (case_id % 5) || ' | ' || count(*) || ' | ' || sum(CAST(hit5 AS INTEGER)) || ' |' AS line FROM e GROUP BY 1""")
def k4_k6_s16_results_as_json(spark, sf_dir):
    """Per-case rows written as JSON by scene, read back with the scene from the path, and put in lines of a table."""
    path = new_path(spark, "results")
    per = _per_case(spark, sf_dir).withColumn("scene", F.col("case_id") % 5)
    per.write.partitionBy("scene").option("ignoreNullFields", "false").json(path)
    back = spark.read.schema("case_id int, num_results long, rank_of_hit long, hit1 boolean, hit5 boolean, l2 double, scene int").option("allowNonNumericNumbers", "true").json(path)
    s = back.groupBy("scene").agg(F.count("*").alias("n"), F.sum(F.col("hit5").cast("int")).alias("hits"))
    return s.select("scene", "n", F.format_string("| %d | %d | %d |", "scene", "n", "hits").alias("line"))


@query(_SEEN.replace("score >= cut", "score >= 0.05 + m") + " SELECT vec_id, round(score, 6) AS score, round(score - m, 6) AS centered FROM seed, c")
def p9_threshold_seeds(spark, sf_dir):
    s = grounding.score(L.voxels(spark, sf_dir), L.vector_of(spark, sf_dir, 0))
    found, mean = grounding.seeds(s, None, 0.05, 1.0, True, True)
    return found.crossJoin(F.broadcast(mean)).select("vec_id", r6(F.col("score"), "score"), r6(F.col("score") - F.col("mean"), "centered"))


_LABELS = ("ECONOMY", "STANDARD", "PROMO", "LARGE")


@query(f"""
WITH g AS (SELECT p_partkey, lower(p_type) AS label, p_size % 5 AS first FROM part WHERE p_type IN {_LABELS}),
v AS (SELECT l_partkey, l_linenumber % 7 AS seg, (l_suppkey % 100) / 10.0 AS x, CAST(l_quantity AS DOUBLE) / 20 AS z FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p_partkey) AS k FROM g),
b AS (
  SELECT p_partkey, CASE WHEN k > 1 THEN label || ' (instance ' || k || ')' ELSE label END AS name, count(*) AS vertices,
    round(min(x) - 0.05, 3) AS min_x, round(max(x) + 0.05, 3) AS max_x, round(min(z) - 0.05, 3) AS min_z, round(max(z) + 0.05, 3) AS max_z
  FROM n JOIN v ON l_partkey = p_partkey AND seg IN (first, first + 1, first + 2) GROUP BY 1, 2
)
SELECT * FROM b WHERE vertices >= 3""")
def j12_p14_w4_p11_instances(spark, sf_dir):
    """Groups of segments with a listed label, numbered before small ones go, and the boxes of the vertices of their segments."""
    listed = spark.createDataFrame([(x,) for x in _LABELS], "p_type string")
    g = L.table(spark, sf_dir, "part").join(F.broadcast(listed), "p_type")  # the list of labels
    g = evaluation.numbered_labels(g.select("p_partkey", F.lower("p_type").alias("label"), F.col("p_partkey").alias("position"), (F.col("p_size") % 5).alias("first")))
    segments = g.select("p_partkey", "name", F.explode(F.sequence(F.col("first"), F.col("first") + 2)).alias("seg"))
    v = L.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_linenumber") % 7).alias("seg"), ((F.col("l_suppkey") % 100) / 10.0).alias("x"), (F.col("l_quantity").cast("double") / 20).alias("z"))
    ends = [f(c, s).alias(n) for c in "xz" for f, s, n in ((lambda c, s: F.round(F.min(c) - s, 3), 0.05, f"min_{c}"), (lambda c, s: F.round(F.max(c) + s, 3), 0.05, f"max_{c}"))]
    return segments.join(v, ["p_partkey", "seg"]).groupBy("p_partkey", "name").agg(F.count("*").alias("vertices"), *ends).where("vertices >= 3")


@query("""
WITH v AS (SELECT p_size AS scene, (p_partkey % 97) / 10.0 AS x, (p_partkey % 83) / 10.0 AS y, (p_partkey % 89) / 20.0 AS z FROM part),
h AS (SELECT scene, quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi, min(x) - 0.1 AS min_x, max(x) + 0.1 AS max_x, min(y) - 0.1 AS min_y, max(y) + 0.1 AS max_y FROM v GROUP BY 1)
SELECT scene, kind, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, round(min_y, 6) AS min_y, round(max_y, 6) AS max_y, round(z - 0.15, 6) AS min_z, round(z + 0.15, 6) AS max_z
FROM (SELECT *, 'floor' AS kind, lo AS z FROM h UNION ALL SELECT *, 'ceiling', hi FROM h)""")
def a16_floor_and_ceiling(spark, sf_dir):
    v = L.table(spark, sf_dir, "part").select(F.col("p_size").alias("scene"), ((F.col("p_partkey") % 97) / 10.0).alias("x"), ((F.col("p_partkey") % 83) / 10.0).alias("y"), ((F.col("p_partkey") % 89) / 20.0).alias("z"))
    flat = v.groupBy("scene").agg(*(r6(e, f"{n}_{c}") for c in "xy" for n, e in (("min", F.min(c) - 0.1), ("max", F.max(c) + 0.1))))
    q = quantile.quantiles(v, "z", {"floor": 0.02, "ceiling": 0.98}, ["scene"])
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("z")) for k in ("floor", "ceiling"))))
    return flat.join(q.select("scene", kinds.alias("e")), "scene").select("scene", "e.kind", "min_x", "max_x", "min_y", "max_y", r6(F.col("e.z") - 0.15, "min_z"), r6(F.col("e.z") + 0.15, "max_z"))


@query("""
WITH v AS (SELECT (p_partkey % 97) / 10.0 AS x, (p_partkey % 83) / 10.0 AS y, (p_partkey % 89) / 20.0 AS z, (p_partkey % 21 - 10) / 10.0 AS nz FROM part)
SELECT CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(y / 0.5) AS BIGINT) AS cy, count(*) AS n, count(*) FILTER (abs(nz) > 0.9) AS horizontal,
  count(*) FILTER (z BETWEEN 0.1 AND 4.3 AND x BETWEEN 0.2 AND 9.4 AND y BETWEEN 0.2 AND 8) AS interior FROM v GROUP BY 1, 2""")
def a17_p15_density(spark, sf_dir):
    """Vertices by cell of half a meter: all, horizontal ones, and those inside of the room less its margins."""
    v = L.table(spark, sf_dir, "part").select(((F.col("p_partkey") % 97) / 10.0).alias("x"), ((F.col("p_partkey") % 83) / 10.0).alias("y"), ((F.col("p_partkey") % 89) / 20.0).alias("z"), ((F.col("p_partkey") % 21 - 10) / 10.0).alias("nz"))
    inside = evaluation.in_box([F.col(c) for c in "zxy"], [F.lit(0.1), F.lit(0.2), F.lit(0.2)], [F.lit(4.3), F.lit(9.4), F.lit(8.0)], 0.0)
    return v.groupBy(F.floor(F.col("x") / 0.5).alias("cx"), F.floor(F.col("y") / 0.5).alias("cy")).agg(F.count("*").alias("n"), F.count_if(F.abs("nz") > 0.9).alias("horizontal"), F.count_if(inside).alias("interior"))


@query(f"WITH v AS ({L.VOXEL_SQL}) SELECT vec_id, i, j, k FROM v WHERE weight > 0 AND abs(tsdf) <= 0.5 ORDER BY md5(vec_id || ':7'), vec_id LIMIT 100")
def a18_k8_preview_sample(spark, sf_dir):
    """At most 100 surface voxels for a preview, drawn by a hash, so that each has the same chance and reruns agree."""
    v = L.voxels(spark, sf_dir).where("weight > 0 and abs(tsdf) <= 0.5").select("vec_id", "i", "j", "k")
    return v.orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(":7"))), "vec_id").limit(100)


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, 'frame' || o_orderkey || '.jpg' AS path, o_orderdate FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT)) AS k FROM f)
SELECT o_custkey AS scene, path, CAST((k - 1) // 2 AS BIGINT) AS frame_id FROM n WHERE (k - 1) % 2 = 0 AND (k - 1) // 2 < 4""")
def p13_w6_stride_and_limit(spark, sf_dir):
    """Every second frame of a scene, four at most, in the order of the numbers in their names."""
    f = L.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene"), F.concat(F.lit("frame"), "o_orderkey", F.lit(".jpg")).alias("path"))
    k = F.row_number().over(Window.partitionBy("scene").orderBy(F.regexp_extract("path", "([0-9]+)", 1).cast("long"))) - 1
    return f.withColumn("k", k).where("k % 2 = 0 and k div 2 < 4").select("scene", "path", F.expr("k div 2").alias("frame_id"))


@query("""
WITH f AS (SELECT vec_id, vec_id / 640.0 AS x, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS z FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS frame_id, round(x - 3, 6) AS min_x, round(x + 3, 6) AS max_x, round(y - 3, 6) AS min_y, round(y + 3, 6) AS max_y, round(z - 3, 6) AS min_z, round(z + 3, 6) AS max_z FROM f""")
def p17_auto_bounds(spark, sf_dir):
    """A cube of three meters around the first camera; the first is taken by one aggregate, without a sort."""
    at = {"x": F.col("vec_id") / 640.0, "y": F.col("embedding")[0].cast("double"), "z": F.col("embedding")[1].cast("double")}
    f = L.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), *(e.alias(n) for n, e in at.items())).agg(F.min(F.struct("frame_id", *at)).alias("f"))
    return f.select("f.frame_id", *(r6(F.col(f"f.{c}") + s, f"{n}_{c}") for c in at for n, s in (("min", -3.0), ("max", 3.0))))


@query(r"""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS packed,
  CAST(trunc(value * 2 + 0.5) AS BIGINT) AS half_away, CAST(round_even(value * 2, 0) AS BIGINT) AS half_even,
  coalesce(nullif(trim(regexp_replace(lower(event_type || ' No. ' || event_id || '!'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'query') AS slug,
  TRY_CAST(event_type AS BIGINT) AS stem, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, event_type LIKE 'c%' AS is_c, split_part(event_type || '=' || event_id || '=x', '=', 1) AS name
FROM events""")
def m2_m8_m9_m10_m11_m14_scalars(spark, sf_dir):
    e = L.table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.select(
        "event_id", "k", F.to_json(F.struct(F.col("event_id").alias("id"), "k")).alias("packed"), F.round(F.col("value") * 2).cast("long").alias("half_away"), F.bround(F.col("value") * 2).cast("long").alias("half_even"),
        geometry.slug(F.concat("event_type", F.lit(" No. "), "event_id", F.lit("!"))).alias("slug"), F.expr("try_cast(event_type as bigint)").alias("stem"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"),
        F.startswith("event_type", F.lit("c")).alias("is_c"), F.substring_index(F.concat("event_type", F.lit("="), "event_id", F.lit("=x")), "=", 1).alias("name"),
    )


@query("""
WITH s AS (SELECT o_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS segments FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey AS group_id, unnest(range(len(segments))) AS position, unnest(segments) AS seg FROM s""")
def s15_s13_annotations(spark, sf_dir):
    """Groups with their lists of segments written as JSON documents, and read back to one row for each segment and its place."""
    li = L.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.struct("l_linenumber", "l_suppkey").alias("s"))
    groups = li.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["l_suppkey"]).alias("segments"))
    path = new_path(spark, "annotations")
    groups.write.json(path)
    back = spark.read.schema("group_id long, segments array<long>").json(path)
    return back.select("group_id", F.posexplode("segments").alias("position", "seg")).withColumn("position", F.col("position").cast("long"))
