"""The documents' way to a training corpus: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm.decontaminate import stage_decontaminate
from voxlake.llm.mixing import stage_mix
from voxlake.llm.quality import stage_quality
from voxlake.llm.sharding import stage_shard
from voxlake.llm.simhash import stage_near_dedup
from voxlake.storage import stored

STAGES = [
    ("quality rules", stage_quality),
    ("near-duplicates", stage_near_dedup),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
    ("sharding", stage_shard),
]

#: SQL can express neither the fingerprints nor the random walks; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
