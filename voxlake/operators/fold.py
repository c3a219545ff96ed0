"""Order-dependent running means as window expressions.

The fold t = (t w + s) / (w + 1), w = min(w + 1, cap) weighs the k-th of n samples by 1 / n while n is within K = cap + 1,
and afterwards by d^(n - max(k, K)) / K, d = cap / K.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_means(obs: DataFrame, by: list[str], order: list[str], samples: dict[str, Column], cap: int) -> DataFrame:
    """One row per group: the mean of each of ``samples``, weight = min(n, cap), n. All come from one sort of the group."""
    w = Window.partitionBy(*by).orderBy(*order)
    everything = Window.partitionBy(*by)
    k, n, top = F.row_number().over(w), F.count("*").over(everything), cap + 1
    rows = obs.select(*by, *(s.alias(f"s_{name}") for name, s in samples.items()), k.alias("rank_"), n.alias("rows_"))
    late = F.pow(F.lit(cap / top), F.col("rows_") - F.greatest("rank_", F.lit(top))) / top
    weight = F.when(F.col("rows_") <= top, 1.0 / F.col("rows_")).otherwise(late)
    return rows.groupBy(*by).agg(*(F.sum(weight * F.col(f"s_{name}")).alias(name) for name in samples), F.least(F.count("*"), F.lit(cap)).alias("weight"), F.count("*").alias("n"))


def running_mean(obs: DataFrame, by: list[str], order: list[str], sample: Column, cap: int) -> DataFrame:
    """One row per group: mean, weight = min(n, cap), n."""
    return running_means(obs, by, order, {"mean": sample}, cap)


def gated_means(obs: DataFrame, by: list[str], order: list[str], samples: dict[str, Column], gate: Column, cap: int) -> DataFrame:
    """One row per group with a gated sample: means of gated samples only, but divided by the weight of all samples so far, f = f + (s - f) / (w + 1), and n."""
    w = Window.partitionBy(*by).orderBy(*order)
    rank = F.row_number().over(w)
    rows = obs.select(*by, *order, *(s.alias(f"s_{name}") for name, s in samples.items()), gate.alias("gate_"), (1.0 / (F.least(rank - 1, F.lit(cap)) + 1)).alias("share_")).where("gate_")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    # the product of what later samples leave; a share of 1 leaves nothing
    left = F.exp(F.coalesce(F.sum(F.coalesce(F.ln(1 - F.col("share_")), F.lit(float("-inf")))).over(after), F.lit(0.0)))
    part = rows.withColumn("part_", F.col("share_") * left)
    return part.groupBy(*by).agg(*(F.sum(F.col(f"s_{name}") * F.col("part_")).alias(name) for name in samples), F.count("*").alias("n"))


def gated_mean(obs: DataFrame, by: list[str], order: list[str], sample: Column, gate: Column, cap: int) -> DataFrame:
    """The same of one sample, as ``mean``."""
    return gated_means(obs, by, order, {"mean": sample}, gate, cap)


def means_and_gated(obs: DataFrame, by: list[str], order: list[str], samples: dict[str, Column], gated: dict[str, Column], gate: Column, cap: int, state: DataFrame | None = None) -> DataFrame:
    """``running_means`` of ``samples`` and ``gated_means`` of ``gated``, null for a group without gated ones, in one pass: one exchange and one sort. ``gated_n``: gated samples.

    With ``state``, an earlier result of other samples, the fold goes on from it; groups without samples stay as they are. A group is read from its last sample to its first, so that what
    later samples leave is a running sum; its state comes as one more row, the last.
    """
    back = Window.partitionBy(*by).orderBy(*([] if state is None else [F.desc("new_")]), *(F.desc(c) for c in order))
    whole = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, d = cap + 1, cap / (cap + 1)
    rows = obs.select(*by, *order, *(s.alias(f"s_{n}") for n, s in samples.items()), *(s.alias(f"g_{n}") for n, s in gated.items()), F.coalesce(gate, F.lit(False)).alias("gate_"), F.lit(1).alias("new_"))
    held = [*samples, *gated, "n", "gated_n"]
    if state is None:
        rows = rows.withColumns({f"b_{c}": F.lit(0.0 if c in samples or c in gated else 0) for c in held})
    else:
        before = state.select(*by, *(F.col(c).alias(f"b_{c}") for c in held), F.lit(False).alias("gate_"), F.lit(0).alias("new_"))
        rows = rows.unionByName(before, allowMissingColumns=True)
    n0 = F.col("n0_")
    rows = rows.withColumns({"after_": F.row_number().over(back) - 1, "rows_": F.sum("new_").over(whole), "n0_": F.coalesce(F.max("b_n").over(whole), F.lit(0))})
    k, n = n0 + F.col("rows_") - F.col("after_"), n0 + F.col("rows_")
    share = 1.0 / (F.least(k - 1, F.lit(cap)) + 1)
    # a share of 1, as that of a group's very first sample, leaves nothing of what came before
    left = F.when(F.col("gate_"), F.coalesce(F.ln(1 - share), F.lit(float("-inf"))))
    later = F.coalesce(F.sum("left_").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = rows.withColumn("left_", left).withColumn("part_", F.when(F.col("gate_"), share * F.exp(later)))
    power = lambda e: F.pow(F.lit(d), F.greatest(e, F.lit(0)))
    weight = F.when(n <= top, 1.0 / n).otherwise(power(n - F.greatest(k, F.lit(top))) / top)
    kept = F.when(n <= top, n0 / n).when(n0 < top, n0 * power(n - top) / top).otherwise(power(n - n0))
    was = lambda c: F.coalesce(F.max(f"b_{c}"), F.lit(0))
    some, rest = was("gated_n") + F.count_if("gate_"), F.exp(F.coalesce(F.sum("left_"), F.lit(0.0)))
    mean = lambda c: F.sum(weight * F.col(f"s_{c}")) + F.first(kept) * was(c)
    sums = [F.when(F.max("rows_") > 0, mean(c)).otherwise(was(c)).alias(c) for c in samples]
    sums += [F.when(some > 0, F.coalesce(F.sum(F.col("part_") * F.col(f"g_{c}")), F.lit(0.0)) + rest * was(c)).alias(c) for c in gated]
    return part.groupBy(*by).agg(*sums, F.least(F.first(n), F.lit(cap)).alias("weight"), F.first(n).alias("n"), some.alias("gated_n"))


def means_by_segments(obs: DataFrame, by: list[str], order: list[str], segment: Column, samples: dict[str, Column], gated: dict[str, Column], gate: Column, cap: int) -> DataFrame:
    """The result of ``means_and_gated`` without bringing a group's samples together: a very frequent group is folded in segments of its order, each by a task of its own.

    ``segment`` must not decrease along ``order`` within a group, and equal places in the order share a segment: a range of time, say. Each segment of a group is counted first, which
    gives every sample's rank; a segment's sums then need only the counts before it and what the gates of later segments leave, a row for each segment.
    """
    top, d = cap + 1, cap / (cap + 1)
    key = [*by, "seg_"]
    rows = obs.select(*by, *order, segment.alias("seg_"), *(s.alias(f"s_{n}") for n, s in samples.items()), *(s.alias(f"g_{n}") for n, s in gated.items()), F.coalesce(gate, F.lit(False)).alias("gate_"))
    counts = obs.select(*by, segment.alias("seg_")).groupBy(*key).agg(F.count("*").alias("rows_"))
    whole, along = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("seg_")
    ends = counts.select(*(F.col(c).alias(f"k_{c}") for c in key), (F.sum("rows_").over(along) - F.col("rows_")).alias("before_"), F.sum("rows_").over(whole).alias("n"))
    inside = Window.partitionBy(*key).orderBy(*order)
    ranked = rows.withColumn("at_", F.row_number().over(inside)).join(ends, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key])
    k, n = F.col("before_") + F.col("at_"), F.col("n")
    share = 1.0 / (F.least(k - 1, F.lit(cap)) + 1)
    left = F.when(F.col("gate_"), F.coalesce(F.ln(1 - share), F.lit(float("-inf"))))
    later = F.coalesce(F.sum("left_").over(inside.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    weight = F.when(n <= top, 1.0 / n).otherwise(F.pow(F.lit(d), n - F.greatest(k, F.lit(top))) / top)
    part = ranked.withColumns({"left_": left, "share_": share, "weight_": weight}).withColumn("part_", F.when(F.col("gate_"), F.col("share_") * F.exp(later)))
    sums = [F.sum(F.col("weight_") * F.col(f"s_{c}")).alias(c) for c in samples] + [F.sum(F.col("part_") * F.col(f"g_{c}")).alias(c) for c in gated]
    per = part.groupBy(*key).agg(*sums, F.first("n").alias("n"), F.count_if("gate_").alias("gated_n"), F.coalesce(F.sum("left_"), F.lit(0.0)).alias("left_"))
    after = F.exp(F.coalesce(F.sum("left_").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    per = per.withColumn("after_", after)
    total = [F.sum(c).alias(c) for c in samples] + [F.sum(F.col(c) * F.col("after_")).alias(c) for c in gated]
    return per.groupBy(*by).agg(*total, F.least(F.first("n"), F.lit(cap)).alias("weight"), F.first("n").alias("n"), F.sum("gated_n").alias("gated_n"))


def gated_vector(obs: DataFrame, by: list[str], order: list[str], vector: Column, dim: int, gate: Column, cap: int) -> DataFrame:
    """The same of vectors of ``dim`` numbers, as the array ``feat``. Vectors are added number by number, so sums combine before the exchange."""
    names = [f"d{i}" for i in range(dim)]
    m = gated_means(obs, by, order, {name: vector[i].cast("double") for i, name in enumerate(names)}, gate, cap)
    return m.select(*by, F.array(*names).alias("feat"), "n")
