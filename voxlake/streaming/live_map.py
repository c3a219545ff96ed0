"""A map folded from a stream, as a versioned table that batch queries read while the stream runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.sources.volume import listed
from voxlake.storage import new_path


def fold_batch(state: DataFrame | None, obs: DataFrame, by: list[str], order: list[str], sample: Column, cap: int) -> DataFrame:
    """(by, mean, n) after a batch of samples: the capped running mean goes on from ``state``, in the given order within the batch.

    With K = cap + 1 and d = cap / K, the mean of n0 samples keeps n0 / n while n is within K; later n0 d^(n - K) / K, and
    d^(n - n0) if it was full already. Groups without samples stay as they are.
    """
    top, d = cap + 1, cap / (cap + 1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = obs.select(*by, sample.alias("s"), rank.alias("k"), F.count("*").over(Window.partitionBy(*by)).alias("m"))
    if state is None:
        state = ranked.select(*by, F.lit(0.0).alias("mean"), F.lit(0).cast("long").alias("n")).limit(0)
    joined = ranked.join(state, by, "left").withColumn("n0", F.coalesce("n", F.lit(0).cast("long"))).withColumn("t0", F.coalesce("mean", F.lit(0.0)))
    n, k = F.col("n0") + F.col("m"), F.col("n0") + F.col("k")
    share = F.when(n <= top, 1.0 / n).otherwise(F.pow(F.lit(d), n - F.greatest(k, F.lit(top))) / top)
    kept = F.when(n <= top, F.col("n0") / n).when(F.col("n0") < top, F.col("n0") * F.pow(F.lit(d), n - top) / top).otherwise(F.pow(F.lit(d), n - F.col("n0")))
    new = joined.groupBy(*by).agg((F.sum(share * F.col("s")) + F.first(kept * F.col("t0"))).alias("mean"), F.first(n).alias("n"))
    return new.unionByName(state.join(ranked.select(*by).distinct(), by, "left_anti").select(*by, "mean", "n"))


def run(stream: DataFrame, by: list[str], order: list[str], sample: Column, cap: int, path: str = "") -> DataFrame | None:
    """Fold all that the stream holds; the last version of the map. A batch that runs again writes its version again, and a stream that starts again on a ``path`` goes on from its last one.

    Every batch writes the whole map, which suits small ones; block_map keeps large ones by blocks.
    """
    spark, path = stream.sparkSession, path or new_path(stream.sparkSession, "map")

    def last(session: SparkSession, before: float) -> DataFrame | None:
        done = [int(name) for name in listed(session, path) if name.isdigit() and int(name) < before]
        return session.read.parquet(f"{path}/{max(done)}") if done else None

    def step(batch: DataFrame, number: int) -> None:
        fold_batch(last(batch.sparkSession, number), batch, by, order, sample, cap).write.mode("overwrite").parquet(f"{path}/{number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return last(spark, float("inf"))
