"""Streams of frames: every n-th of a source, and frames with the pose at their time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from voxlake.operators.temporal import along_line


def every_nth(stream: DataFrame, source: str, ids: str, time: str, n: int) -> DataFrame:
    """(source, id) of every n-th frame of each source, the n-th first; counting goes on over batches.

    Within a batch frames count by time, then id. The state of a source is one number. Frames without a source are a source of their own; repeated frames count each.
    """
    kind = {c: stream.schema[c].dataType.simpleString() for c in (source, ids)}

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # one source's frames of one batch
        rows = pd.concat([*batches]).sort_values([time, ids])
        seen = state.get[0] if state.exists else 0
        state.update((seen + len(rows),))
        yield rows.iloc[(n - 1 - seen) % n :: n][[source, ids]]

    out = f"{source} {kind[source]}, {ids} {kind[ids]}"
    return stream.select(source, ids, time).groupBy(source).applyInPandasWithState(keep, out, "seen long", "append", GroupStateTimeout.NoTimeout)


def with_pose(stream: DataFrame, poses: DataFrame, bucket: int, between: Callable[[Column, Column, Column], Column] = along_line) -> DataFrame:
    """``stream`` (id, t) with ``x`` of the table ``poses`` (id, t, x) at t, from the two poses around it; frames that no two poses enclose are dropped. ``x`` may be
    a number, or a whole pose as a struct with ``between`` = camera.pose_between.

    Between two neighbouring poses lies an interval, listed once for each bucket of time that it touches; frames meet the intervals of their bucket. Of poses at one time the
    smallest id counts. A frame at a pose's time takes that pose. Times are whole numbers; rows with a null time are dropped.
    """
    at = poses.where("t is not null").groupBy("t").agg(F.min_by("x", "id").alias("x")).withColumn("part", F.floor(F.col("t") / bucket))
    # neighbours are found within buckets; what follows a bucket's last pose is the first of the next bucket that has one
    w = Window.partitionBy("part").orderBy("t")
    first = at.groupBy("part").agg(F.min(F.struct("t", "x")).alias("first"))
    following = first.select("part", F.lead("first").over(Window.orderBy("part")).alias("following"))  # one row for each bucket
    held = at.withColumn("next", F.lead(F.struct("t", "x")).over(w)).join(following, "part")
    held = held.select(F.col("t").alias("t0"), F.col("x").alias("x0"), F.coalesce("next", "following").alias("n"))
    last = F.coalesce(F.col("n.t"), F.col("t0"))
    spans = held.select("t0", "x0", F.col("n.t").alias("t1"), F.col("n.x").alias("x1"), F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(last / bucket))).alias("part"))
    near = stream.withColumn("part", F.floor(F.col("t") / bucket)).join(spans, "part").where((F.col("t") == F.col("t0")) | ((F.col("t") > F.col("t0")) & (F.col("t") < F.col("t1"))))
    share = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    moved = between(F.col("x0"), F.coalesce("x1", "x0"), F.when(F.col("t") == F.col("t0"), 0.0).otherwise(share))
    return near.select("id", "t", moved.alias("x"))
