"""Joins by time: nearest, and within a tolerance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bracket(left: DataFrame, right: DataFrame, bucket: int) -> DataFrame:
    """(id, t, lo, hi) for each left (id, t): the right (t, id) at or before t, and that at or after it; of equal times the smallest id. Times are whole numbers.

    Both sides are merged in buckets of time; what a bucket's first and last rows need from other buckets is carried over from
    the buckets' own first and last right rows, so no task sorts all times.
    """
    item = F.struct(F.col("t").alias("t"), F.col("id").alias("id"))
    merged = left.select("id", "t", F.lit(False).alias("right")).union(right.select("id", "t", F.lit(True).alias("right"))).withColumn("b", F.floor(F.col("t") / bucket))
    r = merged.where("right").groupBy("t", "b").agg(F.min("id").alias("id"))  # of equal times the smallest id
    ends = r.groupBy("b").agg(F.min(item).alias("first"), F.max(item).alias("last"))
    every = merged.select("b").distinct().join(ends, "b", "left")
    w = Window.orderBy("b")  # one row for each bucket
    carried = every.select("b", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    rows = merged.where("not right").select("id", "t", "b", F.lit(None).cast("struct<t: bigint, id: bigint>").alias("r")).union(r.select(F.lit(None).cast("long"), "t", "b", item))
    # both look back only: a frame of all following rows is worked out anew for each row
    x = Window.partitionBy("b").orderBy("t", F.col("r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    y = Window.partitionBy("b").orderBy(F.desc("t"), F.col("r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("lo", F.last("r", True).over(x)).withColumn("hi", F.last("r", True).over(y))
    found = found.where("id is not null").join(carried, "b").withColumn("lo", F.coalesce("lo", "before")).withColumn("hi", F.coalesce("hi", "after"))
    return found.select("id", "t", "lo", "hi")


def nearest(left: DataFrame, right: DataFrame, bucket: int) -> DataFrame:
    """For each left (id, t), the right (id, t) nearest in time; the earlier, then the smaller id, wins ties."""
    found = bracket(left, right, bucket)
    low = F.col("hi.t").isNull() | (F.col("t") - F.col("lo.t") <= F.col("hi.t") - F.col("t"))
    best = F.when(low, F.col("lo")).otherwise(F.col("hi"))
    return found.select("id", "t", best["id"].alias("match_id"), F.abs(F.col("t") - best["t"]).alias("gap"))


def along_line(a: Column, b: Column, share: Column) -> Column:
    """The number ``share`` of the way from one to another."""
    return a + (b - a) * share


def pose_at(left: DataFrame, poses: DataFrame, bucket: int, between: Callable[[Column, Column, Column], Column] = along_line) -> DataFrame:
    """(id, t, x): ``x`` of the poses (id, t, x) at each left (id, t), from the two poses around it; rows that no two poses enclose are dropped.

    ``x`` may be a number, or a whole pose as a struct with ``between`` = camera.pose_between. Of poses at one time the smallest id counts; at a pose's time that pose is taken.
    """
    own = bracket(left, poses.select("id", "t"), bucket).where("lo is not null and hi is not null")
    own = own.join(poses.select(F.col("id").alias("p0"), F.col("x").alias("x0")), F.col("lo.id") == F.col("p0")).join(poses.select(F.col("id").alias("p1"), F.col("x").alias("x1")), F.col("hi.id") == F.col("p1"))
    part = F.when(F.col("hi.t") > F.col("lo.t"), (F.col("t") - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t"))).otherwise(0.0)
    return own.select("id", "t", between(F.col("x0"), F.col("x1"), part).alias("x"))


def within(left: DataFrame, right: DataFrame, slop: int) -> DataFrame:
    """Pairs of left and right (id, t) at most ``slop`` apart; joined on buckets of that width."""
    b = F.floor(F.col("t") / slop)
    a = left.select(F.col("id").alias("left_id"), F.col("t").alias("lt"), F.explode(F.array(b - 1, b, b + 1)).alias("b"))
    c = right.select(F.col("id").alias("right_id"), F.col("t").alias("rt"), b.alias("b"))
    return a.join(c, "b").where(F.abs(F.col("lt") - F.col("rt")) <= slop).select("left_id", "right_id", (F.col("rt") - F.col("lt")).alias("gap"))
