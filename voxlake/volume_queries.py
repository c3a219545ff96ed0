"""Queries of versioned volumes, and of the whole way from frames to evaluated results, over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.fusion_queries import _FUSED_SQL, observed, posed
from voxlake.operators import camera, evaluation, grounding
from voxlake.plans import lifts as L
from voxlake.plans.chain import Chain
from voxlake.queries import _ground_sql, query, r6
from voxlake.sources.volume import Channels, Volume
from voxlake.storage import new_path

NAMES = ("f0", "f1", "f2")


def fused(spark, sf_dir, path: str) -> Volume:
    """A volume into which the frames are folded in two parts, the earlier ones first; parts that it holds already are passed over."""
    volume = Volume(spark, path, Channels({"tsdf": 1.0}, NAMES), L.DIMS, 0.1)
    frames, blocks = posed(spark, sf_dir)
    middle = F.lit(frames.agg(F.max("frame_id")).first()[0] // 2)
    for tag, part in (("early", F.col("frame_id") <= middle), ("late", F.col("frame_id") > middle)):
        obs, seen = observed(frames.where(part), blocks), camera.visible_blocks(frames.where(part), blocks, 0.8, 6.0, 8, 8, 4.4)
        volume.integrate(obs, ["frame_id"], {"tsdf": F.col("sample")}, {n: F.col("feat")[c].cast("double") for c, n in enumerate(NAMES)}, F.abs("sample") <= 0.5, touched=seen, tag=tag)
    return volume


@query(_FUSED_SQL)
def u1_volume(spark, sf_dir):
    """The volume after two integrations."""
    v = fused(spark, sf_dir, new_path(spark, "volume")).read()
    return v.select("i", "j", "k", r6(F.col("tsdf"), "tsdf"), "weight", F.col("gated_n").alias("features"), *(r6(F.col(n), n) for n in NAMES))


#: Settings of the chain: the queries are features of frames; a case's box is around that frame's place.
_CASES = (0, 7, 30)
_WHOLE = _FUSED_SQL.replace(", 6) AS tsdf", ", 12) AS tsdf").replace(", 6) END AS f", ", 12) END AS f")


def _chain_sql(case: int) -> str:
    sql = _ground_sql("ignore")
    start = sql.index("s AS (SELECT v.*")
    head = f"WITH RECURSIVE fv AS ({_WHOLE}), v AS (SELECT (i * 8 + j) * 8 + k AS vec_id, i, j, k, weight, tsdf, [coalesce(f0, 0.0), coalesce(f1, 0.0), coalesce(f2, 0.0)] AS emb, f0 AS feat FROM fv), q AS (SELECT CAST(embedding[5:7] AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {case}), "
    return head + sql[start:].replace("CASE WHEN vec_id % 11 <> 0 THEN list_inner_product(emb, q) END", "CASE WHEN feat IS NOT NULL THEN list_inner_product(emb, q) END")


_ALL = " UNION ALL ".join(f"(SELECT CAST({c} AS BIGINT) AS case_id, * FROM ({_chain_sql(c)}))" for c in _CASES)
_BOX = {"x": ("case_id / 640.0 - 0.5", "case_id / 640.0 + 0.5"), "y": ("0.2", "0.6"), "z": ("0.0", "0.8")}


@query(f"""WITH r AS ({_ALL}), c AS (SELECT CAST(x AS BIGINT) AS case_id FROM (VALUES {', '.join(f'({c})' for c in _CASES)}) t(x)),
b AS (SELECT c.case_id, {', '.join(f'{lo} AS lo_{a}, {hi} AS hi_{a}' for a, (lo, hi) in _BOX.items())} FROM c),
j AS (SELECT b.*, rank, score, {' AND '.join(f'center_{c} BETWEEN lo_{a} - 0.1 AND hi_{a} + 0.1' for c, a in zip('ijk', 'xyz', strict=True))} AS hit FROM b LEFT JOIN r ON r.case_id = b.case_id)
SELECT case_id, count(rank) AS num_results, min(CASE WHEN hit THEN rank END) AS rank_of_hit, coalesce(min(CASE WHEN hit THEN rank END) = 1, false) AS hit1, count(CASE WHEN hit THEN 1 END) > 0 AS hit5, round(max(score), 5) AS best FROM j GROUP BY case_id""")
def u7_frames_to_ranks(spark, sf_dir):
    """Frames are fused into a volume, its features grounded for three queries, and the results held against boxes; each step has its table."""
    path = new_path(spark, "chain")
    chain = Chain(spark, path)

    def grounded():
        v = fused(spark, sf_dir, f"{path}/volume").read().withColumn("feat", F.when(F.col("f0").isNotNull(), F.array(*NAMES)))
        cases = {str(c): ([float(x) for x in L.vector_of(spark, sf_dir, c)[4:7]], None) for c in _CASES}
        return grounding.ground_grid(v, cases, [grounding.Setting()], L.DIMS)

    ranks = chain.step("ranks", grounded)
    boxes = spark.createDataFrame([(c,) for c in _CASES], "case_id long")
    boxes = boxes.select("case_id", *(F.expr(f"cast({e} as double)").alias(f"{w}_{a}") for a, pair in _BOX.items() for w, e in zip(("min", "max"), pair, strict=True)))
    results = ranks.select(F.col("case").cast("long").alias("case_id"), F.col("rank").cast("long").alias("rank"), F.col("center_i").alias("x"), F.col("center_j").alias("y"), F.col("center_k").alias("z"))
    best = ranks.groupBy(F.col("case").cast("long").alias("case_id")).agg(r6(F.max("score"), "best"))
    per = chain.step("evaluation", lambda: evaluation.per_case(results, boxes, 0.1).drop("l2").join(best, "case_id", "left"))
    return per.withColumn("best", F.round("best", 5))
