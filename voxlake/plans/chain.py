"""Jobs of several steps with a stored table after each: one that starts again takes the steps that are done from their tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from voxlake.sources.volume import listed


@dataclass(frozen=True)
class Chain:
    """Steps under ``path``. A step is done once Spark has committed its table."""

    spark: SparkSession
    path: str

    def done(self) -> list[str]:
        """The names of the steps that are done."""
        return [name.removeprefix("step-") for name in listed(self.spark, self.path) if name.startswith("step-")]

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step, made if it isn't done yet. ``make`` is not called otherwise."""
        at = f"{self.path}/step-{name}"
        if name not in self.done():
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)
