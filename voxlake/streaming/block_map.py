"""A live map as keyed state: each block of 8 x 8 x 8 voxels is one value of the state store, and a batch works on the blocks it touches only.

The state lies in RocksDB with its changes in the stream's checkpoint, so a stream that starts again goes on from it, and any batch query can read the map
of the last whole batch while the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VOXELS = 512


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, which Spark's keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def folded(mean: np.ndarray, n: np.ndarray, local: np.ndarray, samples: np.ndarray, cap: int) -> None:
    """Fold samples (channels, m), in order within each voxel, into the capped running means (channels, voxels) and counts of a block, in place.

    A voxel's samples weigh as in the fold one by one: of N in all, 1 / N while N is within K = cap + 1, and then d^(N - max(k, K)) / K with d = cap / K.
    """
    top, d = cap + 1, cap / (cap + 1)
    order = np.argsort(local, kind="stable")
    local, samples = local[order], samples[:, order]
    added = np.bincount(local, minlength=len(n))
    first = np.cumsum(added) - added
    before, after = n[local], (n + added)[local]
    k = before + np.arange(len(local)) - first[local] + 1
    power = lambda e: np.power(d, np.maximum(e, 0))
    share = np.where(after <= top, 1 / np.maximum(after, 1), power(after - np.maximum(k, top)) / top)
    total = n + added
    kept = np.where(total <= top, n / np.maximum(total, 1), np.where(n < top, n * power(total - top) / top, power(total - n)))
    touched = added > 0
    for c in range(len(mean)):
        mean[c] = np.where(touched, kept * mean[c] + np.bincount(local, share * samples[c], minlength=len(n)), mean[c])
    n += added


class BlockFold(StatefulProcessor):
    """State of a block: the means of its voxels, channel by channel, and their counts. A batch's samples of a block are ordered and folded together."""

    def __init__(self, by: list[str], order: list[str], names: list[str], cap: int):
        self.by, self.order, self.names, self.cap = by, order, names, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("voxels", "mean array<double>, n array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        obs = pd.concat([*rows], ignore_index=True).sort_values(self.order, kind="stable")
        mean, n = (np.array(x) for x in self.state.get()) if self.state.exists() else (np.zeros(len(self.names) * VOXELS), np.zeros(VOXELS, np.int64))
        mean, n = mean.reshape(len(self.names), VOXELS), n.astype(np.int64)
        local = obs["local"].to_numpy(np.int64)
        folded(mean, n, local, obs[[f"s_{x}" for x in self.names]].to_numpy(float).T, self.cap)
        self.state.update((mean.ravel().tolist(), n.tolist()))
        at = np.unique(local)
        out = {name: [key[p]] * len(at) for p, name in enumerate(self.by)} | {"local": at.astype(np.int32)}
        yield pd.DataFrame(out | {x: mean[c, at] for c, x in enumerate(self.names)} | {"n": n[at]})

    def close(self) -> None:
        pass


class Progress(StreamingQueryListener):
    """A row for each batch of the streams that start while it listens: number, rows read, rows read so far by this run, keys in the state, and milliseconds."""

    SCHEMA = "query string, run string, batch long, rows long, total long, keys long, took_ms long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.total = spark, path, {}

    def onQueryStarted(self, event) -> None:
        self.total[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        self.total[run] = self.total.get(run, 0) + p.numInputRows
        keys = sum(s.numRowsTotal for s in p.stateOperators)
        row = (str(p.id), run, p.batchId, p.numInputRows, self.total[run], keys, int(p.batchDuration))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.total.pop(str(event.runId), None)


class BlockMap:
    """A map by blocks under ``path`` of the shared folder: ``state`` is the stream's checkpoint, ``changes`` has the voxels that each batch touched.

    ``samples`` are the channels, folded as running means of at most ``cap`` earlier samples, in the order of the columns ``order`` within a batch. Samples with a null key, voxel or
    channel are dropped. How many rows a batch has is the source's to bound.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str], order: list[str], samples: dict[str, Column], cap: int):
        self.spark, self.path, self.by, self.order, self.samples, self.cap = spark, path, by, order, samples, cap

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Fold ``stream`` (by, local from 0 to 511, order, ...) into the map, from where the last run ended. A batch that runs again writes its changes again."""
        names = [*self.samples]
        obs = stream.select(*self.by, F.col("local").cast("int").alias("local"), *self.order, *(s.cast("double").alias(f"s_{n}") for n, s in self.samples.items()))
        obs = obs.dropna(subset=[*self.by, "local", *(f"s_{n}" for n in names)])
        kinds = [f"{c} {stream.schema[c].dataType.simpleString()}" for c in self.by]
        schema = ", ".join([*kinds, "local int", *(f"{n} double" for n in names), "n long"])
        folds = obs.groupBy(*self.by).transformWithStateInPandas(BlockFold(self.by, self.order, names, self.cap), schema, "Update", "None")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")

        with rocks(self.spark):
            return folds.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.path}/state").trigger(**trigger).start()

    def snapshot(self) -> DataFrame:
        """(by, local, *samples, n): the voxels with samples after the last whole batch."""
        state = self.spark.read.format("statestore").option("path", f"{self.path}/state").option("stateVarName", "voxels").load()
        local = F.posexplode("value.n").alias("local", "n")
        rows = state.select("key.*", "value.mean", local).where("n > 0")
        return rows.select(*self.by, "local", *(F.get("mean", F.col("local") + c * VOXELS).alias(x) for c, x in enumerate(self.samples)), "n")


def preview(surface: DataFrame, keys: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` of the voxels, each as likely as any other: those with the smallest digests of seed and keys. Tasks keep as many rows, not more."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return surface.withColumn("draw_", digest).orderBy("draw_", *keys).limit(most).drop("draw_")
