"""Ranked results against the boxes where they should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_box(point: list[Column], low: list[Column], high: list[Column], slack: float) -> Column:
    """Whether a point lies in a box made wider by ``slack``, its faces included."""
    inside = [p.between(a - slack, b + slack) for p, a, b in zip(point, low, high, strict=True)]
    return inside[0] & inside[1] & inside[2]


def per_case(results: DataFrame, cases: DataFrame, slack: float) -> DataFrame:
    """Every case with num_results, rank_of_hit (null without one), hit1, hit5 and the distance of the first result to the box's middle, infinite without results.

    ``results``: case_id, rank, x, y, z. ``cases``: case_id, min_x, ... max_z. hit5 looks at all results that are given.
    """
    low, high = ([F.col(f"{e}_{c}") for c in "xyz"] for e in ("min", "max"))
    held = in_box([F.col(c) for c in "xyz"], low, high, slack)
    away = F.sqrt(sum((F.pow(F.col(c) - (a + b) / 2, F.lit(2.0)) for c, a, b in zip("yz", low[1:], high[1:], strict=True)), F.pow(F.col("x") - (low[0] + high[0]) / 2, F.lit(2.0))))
    joined = cases.join(results, "case_id", "left")
    per = joined.groupBy("case_id").agg(F.count("rank").alias("num_results"), F.min(F.when(held, F.col("rank"))).alias("rank_of_hit"), F.min_by(away, "rank").alias("l2"))
    hit = F.col("rank_of_hit")
    return per.select("case_id", "num_results", "rank_of_hit", F.coalesce(hit == 1, F.lit(False)).alias("hit1"), hit.isNotNull().alias("hit5"), F.coalesce("l2", F.lit(float("inf"))).alias("l2"))


def summary(per: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, shares of hits, the mean distance (infinite if any is), and that of hits only (null if none)."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return per.groupBy(*(by or [])).agg(F.count("*").alias("n"), share("hit1"), share("hit5"), F.avg("l2").alias("mean_l2"), F.avg(F.when(F.col("hit5"), F.col("l2"))).alias("hit_only_l2"))


def with_kind(per: DataFrame, spec: DataFrame) -> DataFrame:
    """``per`` (query, ...) with the kind of the first case of ``spec`` (query, position, kind) with that query; ``object`` where there is none."""
    first = spec.groupBy("query").agg(F.min_by("kind", "position").alias("kind"))
    return per.join(first, "query", "left").withColumn("kind", F.coalesce("kind", F.lit("object")))


def numbered_labels(instances: DataFrame) -> DataFrame:
    """``instances`` (label, position, ...) with ``name``: the label, and the instance's number from the second on."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("position"))
    return instances.withColumn("k", k).withColumn("name", F.when(F.col("k") > 1, F.format_string("%s (instance %d)", "label", "k")).otherwise(F.col("label"))).drop("k")
