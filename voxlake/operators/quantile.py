"""Exact quantiles, with linear interpolation, of columns of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranks are first known to one part in ACCURACY; only the values within twice that are then ordered, or all of a group of so many.
ACCURACY = 100_000


def quantiles(df: DataFrame, col: str, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """One row for each group (one in all without ``by``): ``n``, ``mean``, and the quantile of ``col`` at each share of ``at``, by name.

    A sketch brackets each quantile between two values; the values below are counted, and the distinct ones between, a few of ACCURACY parts of
    the group, are counted each and ordered. So no task holds a column's values. Nulls and NaN are left out. Groups without values have no row; without ``by`` an
    empty column gives n = 0 and null. The order of rows does not matter.
    """
    by = by or []
    v = df.select(*by, F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    wide = 2 / ACCURACY
    known = [F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")]
    for k, q in enumerate(at.values()):
        known.append(F.percentile_approx("v", F.array(F.lit(max(q - wide, 0.0)), F.lit(min(q + wide, 1.0))), ACCURACY).alias(f"near{k}"))
    stats = v.groupBy(*by).agg(*known)
    if not at:
        return stats.select(*by, "n", "mean")
    few = F.col("n") <= ACCURACY  # all of such a group's values are ordered
    low = lambda k, q: F.when(few, F.col("least")).otherwise(F.col("least") if q <= wide else F.col(f"near{k}")[0])
    high = lambda k, q: F.when(few, F.col("most")).otherwise(F.col("most") if q >= 1 - wide else F.col(f"near{k}")[1])
    ends = [F.struct(F.lit(k).alias("k"), low(k, q).alias("low"), high(k, q).alias("high")) for k, q in enumerate(at.values())]
    brackets = stats.select(*by, F.array(*ends).alias("ends"))
    held = v.join(brackets, by) if by else v.crossJoin(F.broadcast(brackets))  # one row
    held = held.select(*by, "v", F.explode("ends").alias("e")).where("v <= e.high")
    counts = held.groupBy(*by, F.col("e.k").alias("k"), F.when(F.col("v") >= F.col("e.low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    # what lies below a bracket is one row, the first
    running = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("v"))))
    joined = running.join(stats.select(*by, "n"), by) if by else running.crossJoin(F.broadcast(stats.select("n")))
    place = F.element_at(F.array(*map(F.lit, at.values())), F.col("k") + 1) * (F.col("n") - 1)
    value = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct(F.col("v").isNotNull().alias("found"), "v")))
    picked = joined.groupBy(*by, "k").agg(value(F.floor(place)).alias("a"), value(F.ceil(place)).alias("b"), F.max(place - F.floor(place)).alias("part"))
    sure = F.assert_true(F.col("a.found") & F.col("b.found"), "a quantile lies outside its bracket")
    picked = picked.select(*by, "k", (F.col("a.v") + (F.col("b.v") - F.col("a.v")) * F.col("part")).alias("q"), sure.alias("sure")).where("sure is null")
    wide_rows = picked.groupBy(*by).agg(*(F.max(F.when(F.col("k") == k, F.col("q"))).alias(name) for k, name in enumerate(at)))
    base = stats.select(*by, "n", "mean")
    return base.join(wide_rows, by) if by else base.crossJoin(F.broadcast(wide_rows))
