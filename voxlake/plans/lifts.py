"""The driver tables as relations of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Voxel numbers decode as 64 = 8 x 8 local places per step of i.
DIMS = (1 << 20, 8, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v, F.expr("vec_id div 64").alias("i"), F.expr("(vec_id div 8) % 8").alias("j"), (v % 8).alias("k"), ((v * 7) % 41).cast("double").alias("weight"),
        (((v * 13) % 21 - 10) / 10.0).alias("tsdf"), F.when(v % 11 != 0, F.col("embedding")).alias("feat"),
    )


VOXEL_SQL = "SELECT vec_id, vec_id // 64 AS i, (vec_id // 8) % 8 AS j, vec_id % 8 AS k, CAST((vec_id * 7) % 41 AS DOUBLE) AS weight, ((vec_id * 13) % 21 - 10) / 10.0 AS tsdf, CAST(embedding AS DOUBLE[]) AS emb, CASE WHEN vec_id % 11 <> 0 THEN 1 END AS feat FROM embeddings"


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row[0]]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("voxel"), "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") / 50).alias("sample"), (F.col("l_discount") <= 0.05).alias("gate")
    )


def stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(id, t): events of one kind, t in microseconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), micros.alias("t"))
