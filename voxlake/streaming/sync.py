"""Streams of stamped messages joined by approximate time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.storage import new_path


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder of them, as a stream of its files. Only a pattern may name a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def synchronised(left: DataFrame, right: DataFrame, slop_seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of (id, ts) of two streams at most ``slop_seconds`` apart; rows later than ``late`` behind their stream are dropped.

    Both sides meet in buckets of the tolerance's width, so state is dealt by time; watermarks and the bounds on both times let old state go.
    """
    bucket = F.floor(F.unix_micros("ts") / (slop_seconds * 1_000_000))
    a = left.select(F.col("id").alias("left_id"), F.col("ts").alias("lt")).withWatermark("lt", late)
    a = a.withColumn("ab", F.explode(F.array(*(F.floor(F.unix_micros("lt") / (slop_seconds * 1_000_000)) + o for o in (-1, 0, 1)))))
    b = right.select(F.col("id").alias("right_id"), F.col("ts").alias("rt"), bucket.alias("bb")).withWatermark("rt", late)
    near = F.expr(f"ab = bb AND rt >= lt - INTERVAL {slop_seconds} SECONDS AND rt <= lt + INTERVAL {slop_seconds} SECONDS")
    return a.join(b, near).select("left_id", "right_id", (F.unix_micros("rt") - F.unix_micros("lt")).alias("gap"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over all that is there; its rows as a table of the shared folder."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
