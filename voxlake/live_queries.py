"""Queries of live maps and of streams with keyed state over the driver tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import camera, temporal
from voxlake.plans import lifts as L
from voxlake.queries import ORDER, _fold_sql, query, r6
from voxlake.storage import new_path
from voxlake.streaming import block_map, frames, matched, sync

#: Where the samples are parted into appends, each followed by a run of the stream.
_PARTS = ("1997-01-01", "1999-06-01")


def _parts(items: DataFrame) -> list[DataFrame]:
    day = F.col("l_shipdate").cast("date")
    ends = [None, *_PARTS, None]
    return [items.where((F.lit(True) if low is None else day >= low) & (F.lit(True) if high is None else day < high)) for low, high in zip(ends[:-1], ends[1:], strict=True)]


def live(spark: SparkSession, sf_dir: str, listener: bool = False) -> tuple[block_map.BlockMap, str]:
    """A map of quantity and discount by part, fed by three appends; the stream stops after each and goes on from its checkpoint. Also the path of its progress rows."""
    path = new_path(spark, "block-map")
    items = L.table(spark, sf_dir, "lineitem").withColumns({"block": F.expr("l_partkey div 512"), "local": (F.col("l_partkey") % 512).cast("int")})
    samples = {"quantity": F.col("l_quantity").cast("double") / 50, "discount": F.col("l_discount").cast("double")}
    held = block_map.BlockMap(spark, path, ["block"], ORDER, samples, 32)
    progress = block_map.Progress(spark, f"{path}/progress")
    if listener:
        spark.streams.addListener(progress)
    try:
        for part in _parts(items):
            part.write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(items.schema).parquet(f"{path}/in")
            held.start(stream, availableNow=True).awaitTermination()
            if listener:
                spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        if listener:
            spark.streams.removeListener(progress)
    return held, f"{path}/progress"


@query(_fold_sql(32))
def st4_block_state(spark, sf_dir):
    """The live map by blocks of voxels, after two restarts."""
    held, _ = live(spark, sf_dir)
    v = held.snapshot()
    return v.select((F.col("block") * 512 + F.col("local")).cast("long").alias("voxel"), r6(F.col("quantity"), "mean"), F.least("n", F.lit(32).cast("long")).alias("weight"), "n")


_MOST = 300


@query(f"""WITH m AS ({_fold_sql(32)}) SELECT voxel, mean AS quantity FROM m WHERE abs(mean - 0.5) <= 0.1 ORDER BY md5('7:' || (voxel // 512) || ':' || (voxel % 512)), voxel LIMIT {_MOST}""")
def st6_preview(spark, sf_dir):
    """A bounded, uniform sample of the live map's voxels near a level."""
    held, _ = live(spark, sf_dir)
    near = held.snapshot().withColumn("quantity", F.round("quantity", 6)).where("abs(quantity - 0.5) <= 0.1")
    shown = block_map.preview(near, ["block", "local"], _MOST, 7)
    return shown.select((F.col("block") * 512 + F.col("local")).cast("long").alias("voxel"), "quantity")


_SPAN = " WHEN ".join(f"CAST(l_shipdate AS DATE) < '{d}' THEN {n}" for n, d in enumerate(_PARTS))


@query(f"""WITH p AS (SELECT CASE WHEN {_SPAN} ELSE {len(_PARTS)} END AS batch, l_partkey FROM lineitem), b AS (SELECT batch, count(*) AS rows FROM p GROUP BY 1),
k AS (SELECT batch, count(DISTINCT first.l_partkey // 512) AS new FROM (SELECT l_partkey, batch, min(batch) OVER (PARTITION BY l_partkey // 512) AS f FROM p) first WHERE f = batch GROUP BY 1)
SELECT CAST(b.batch AS BIGINT) AS batch, rows, CAST(sum(coalesce(new, 0)) OVER (ORDER BY b.batch) AS BIGINT) AS keys FROM b LEFT JOIN k ON b.batch = k.batch""")
def st8_progress(spark, sf_dir):
    """A row for each batch of the live map's stream: rows read, and blocks in its state."""
    _, path = live(spark, sf_dir, listener=True)
    return spark.read.schema(block_map.Progress.SCHEMA).parquet(path).where("rows > 0").select("batch", "rows", "keys")


_SLOP = 50_000
_TOPICS = {"click": 0, "view": 1, "purchase": 2}


@query(f"""WITH m AS (SELECT user_id % 3 AS source, event_type AS topic, event_id AS id, epoch_us(ts::TIMESTAMP) // 10000 AS t FROM events),
p AS (SELECT c.source, c.id, c.t, m.topic, m.id AS other, abs(m.t - c.t) AS gap FROM m c JOIN m ON m.source = c.source AND c.topic = 'click' AND m.topic IN ('view', 'purchase') AND abs(m.t - c.t) <= {_SLOP}),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source, id, topic ORDER BY gap, other) = 1)
SELECT v.source, v.id, v.t, v.other AS first_id, q.other AS second_id, v.gap + q.gap AS gap FROM b v JOIN b q ON v.source = q.source AND v.id = q.id AND v.topic = 'view' AND q.topic = 'purchase'""")
def st1_j9_in_threes(spark, sf_dir):
    """Three topics of each source matched by time, one match for each leading message."""
    path = new_path(spark, "threes")
    e = L.table(spark, sf_dir, "events")
    topic = F.create_map(*(F.lit(x) for pair in _TOPICS.items() for x in pair))
    at = F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 10000"))
    messages = e.where(F.col("event_type").isin(*_TOPICS)).select((F.col("user_id") % 3).alias("source"), topic[F.col("event_type")].alias("topic"), F.col("event_id").alias("id"), at.alias("ts"))
    beat = messages.agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts"))
    nothing = [F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in ("source", "topic", "id")]
    for part in (messages, beat.select(*nothing, "ts")):
        part.write.mode("append").parquet(f"{path}/in")
        threes = matched.in_threes(spark.readStream.schema(messages.schema).parquet(f"{path}/in"), _SLOP)
        with block_map.rocks(spark):
            threes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(threes.schema).parquet(f"{path}/out")


@query("""WITH u AS (SELECT user_id AS source, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1), b AS (SELECT source, n, ids, unnest(range((n + 3) // 4)) AS number FROM u)
SELECT source, number, least(n - 4 * number, 4) AS size, ids FROM b""")
def st3_count_or_timeout(spark, sf_dir):
    """Batches of four events of each user; what is left over goes after a time-out. ``ids`` adds up the user's events, of which none may be lost."""
    path = new_path(spark, "batches")
    e = sync.source(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("source"), F.col("event_id").alias("id"))
    batches = matched.by_count_or_timeout(e, 4, 250)
    with block_map.rocks(spark):
        stream = batches.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(processingTime="100 milliseconds").start()
    matched.settle(stream, 250)
    out = spark.read.schema(batches.schema).parquet(f"{path}/out")
    per = out.groupBy("source", "number").agg(F.count("*").alias("size"))
    return per.join(out.groupBy("source").agg(F.sum("id").alias("ids")), "source").select("source", "number", "size", "ids")


_PARTS_OF_POSE = {"tx": "value", "ty": "value * 2 - 3", "tz": "CAST(user_id AS DOUBLE)", "qx": "sin(event_id)", "qy": "cos(event_id * 3)", "qz": "sin(event_id * 5 + 1) * 2", "qw": "cos(event_id * 7 + 2)"}
_Q = ("qx", "qy", "qz", "qw")
_DOT = lambda a, b: "(" + " + ".join(f"{a}.{c} * {b}.{c}" for c in _Q) + ")"
_POSE_SQL = f"""WITH c AS (SELECT event_id AS id, epoch_us(ts::TIMESTAMP) AS t FROM events WHERE event_type = 'click'),
w AS (SELECT epoch_us(ts::TIMESTAMP) AS t, {', '.join(f'{e} AS {c}' for c, e in _PARTS_OF_POSE.items())} FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1),
lo AS (SELECT c.id, c.t AS tc, w.* FROM c ASOF JOIN w ON c.t >= w.t), hi AS (SELECT c.id, w.* FROM c ASOF JOIN w ON c.t <= w.t),
b AS (SELECT lo.id, tc, CASE WHEN hi.t > lo.t THEN (tc - lo.t) / (hi.t - lo.t) ELSE 0.0 END AS s, lo, hi, sqrt({_DOT('lo', 'lo')}) AS la, sqrt({_DOT('hi', 'hi')}) AS lb, {_DOT('lo', 'hi')} AS d FROM lo JOIN hi USING (id)),
g AS (SELECT *, acos(least(abs(d / (la * lb)), 1.0)) AS th, CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END AS sg FROM b),
f AS (SELECT *, CASE WHEN th < 1e-6 THEN 1 - s ELSE sin((1 - s) * th) / sin(th) END / la AS wa, CASE WHEN th < 1e-6 THEN s ELSE sin(s * th) / sin(th) END * sg / lb AS wb FROM g)
SELECT id, tc AS t, {', '.join(f'round(lo.{c} + (hi.{c} - lo.{c}) * s, 6) AS {c}' for c in ('tx', 'ty', 'tz'))}, {', '.join(f'round(lo.{c} * wa + hi.{c} * wb, 6) AS {c}' for c in _Q)} FROM f"""


def _poses(spark, sf_dir):
    e = L.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    at = e.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), *(F.expr(x).alias(c) for c, x in _PARTS_OF_POSE.items()))
    return at.select("id", "t", camera.pose().alias("x"))


def _flat(posed):
    return posed.select("id", "t", *(r6(F.col(f"x.{c}"), c) for c in _PARTS_OF_POSE))


@query(_POSE_SQL)
def j10_whole_pose_at_time(spark, sf_dir):
    """Places and turns between two poses, at the times of clicks."""
    return _flat(temporal.pose_at(L.stream(spark, sf_dir, "click"), _poses(spark, sf_dir), 3_600_000_000, camera.pose_between))


@query(_POSE_SQL)
def st2_stream_whole_poses(spark, sf_dir):
    """The same of a stream of clicks."""
    e = sync.source(spark, f"{sf_dir}/events.parquet").where("event_type = 'click'").select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return _flat(sync.drained(frames.with_pose(e, _poses(spark, sf_dir), 3_600_000_000, camera.pose_between), "posed"))
