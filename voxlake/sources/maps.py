"""Maps as tables: voxels partitioned by ranges of i, and one row that describes the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(voxels: DataFrame, path: str, model: str, size: float, slab: int = 512) -> None:
    """Write the stored voxels (i, j, k, ...) under ``path``, by slabs of i, and the map's description.

    Only voxels that exist are written; a column named ``slab`` is replaced. Rows are exchanged by slab and block, so a slab's files are few and no
    slab has to fit one task. Voxels with a null i go to a slab of their own.
    """
    dealt = voxels.withColumn("slab", F.floor(F.col("i") / slab)).repartition("slab", F.expr("i div 8"))
    dealt.write.partitionBy("slab").parquet(f"{path}/voxel")
    about = voxels.sparkSession.range(1).select(F.lit(model).alias("model"), F.lit(float(size)).alias("size"), F.lit(slab).alias("slab"))
    about.write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str, model: str = "", first: int | None = None, last: int | None = None) -> DataFrame:
    """The voxels of a saved map, those with ``first`` <= i <= ``last`` where given (only their slabs are read).

    A model that is not the map's is refused; an empty name on either side matches any.
    """
    about = spark.read.parquet(f"{path}/about").first()
    if model and about["model"] and model != about["model"]:
        raise ValueError(f"the map holds features of {about['model']}, not of {model}")
    voxels = spark.read.parquet(f"{path}/voxel")
    if first is not None:
        voxels = voxels.where((F.col("slab") >= first // about["slab"]) & (F.col("i") >= first))
    if last is not None:
        voxels = voxels.where((F.col("slab") <= last // about["slab"]) & (F.col("i") <= last))
    return voxels.drop("slab")
