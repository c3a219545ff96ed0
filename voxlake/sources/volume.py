"""A volume as a table of versions: each holds the blocks that one integration touched, whole, and the newest of each block counts.

A version counts from the moment its writer has committed it, so that a write that fails, or is still going on, leaves the last one as it is. The latest version
is found in the folder; one writer at a time is assumed, and any number of readers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import fold, mesh, points

BLOCK = ("bx", "by", "bz")


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders under ``path`` that Spark's writers have committed, in order; none if there is no such path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    inside = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(p.getName() for p in inside if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


@dataclass(frozen=True)
class Channels:
    """What a voxel holds: ``samples``, running means of all samples with the value of free space for each, and ``gated``, means of samples within the gate."""

    samples: dict[str, float]
    gated: tuple[str, ...] = ()


@dataclass(frozen=True)
class Volume:
    """Blocks of 8 x 8 x 8 voxels (bx, by, bz, i, j, k, *samples, *gated, weight, n, gated_n) under ``path``. ``dims`` and ``size`` as in queries; ``cap`` bounds a mean's weight.

    After ``full_every`` versions one is written with all blocks, so that a reader opens a bounded number of them.
    """

    spark: SparkSession
    path: str
    channels: Channels
    dims: tuple[int, int, int]
    size: float
    origin: float = 0.0
    cap: int = 32
    full_every: int = 16

    def versions(self) -> list[tuple[int, str]]:
        """Number and folder of the versions that count; a folder of kind full holds all blocks."""
        return [(int(name.split("-")[1]), name) for name in listed(self.spark, self.path)]

    def version(self) -> int:
        """The latest version; 0 before the first."""
        return max((n for n, _ in self.versions()), default=0)

    def _schema(self) -> str:
        values = [f"{c} double" for c in (*self.channels.samples, *self.channels.gated)]
        return ", ".join([*(f"{c} long" for c in (*BLOCK, "i", "j", "k")), *values, "weight long", "n long", "gated_n long"])

    def read(self, version: int | None = None) -> DataFrame:
        """The voxels as of a version, by default the latest. Blocks of later versions take the place of earlier ones."""
        held = [(n, name) for n, name in self.versions() if version is None or n <= version]
        full = max((n for n, name in held if name.endswith("-full")), default=0)
        tables = [(n, self.spark.read.schema(self._schema()).parquet(f"{self.path}/{name}")) for n, name in held if n >= full]
        if not tables:
            return self.spark.createDataFrame([], self._schema())
        if len(tables) == 1:
            return tables[0][1]
        every = reduce(DataFrame.unionByName, (t.withColumn("version", F.lit(n)) for n, t in tables))
        newest = every.groupBy(*BLOCK).agg(F.max("version").alias("version"))
        return every.join(newest, [*BLOCK, "version"]).drop("version")

    def _write(self, voxels: DataFrame, full: bool, tag: str = "") -> int:
        number = self.version() + 1
        rows = voxels.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in self._schema().split(", ")))
        rows.repartition(*BLOCK).write.mode("overwrite").parquet(f"{self.path}/v-{number:09d}-{'full' if full else 'part'}{'-' * bool(tag)}{tag}")
        return number

    def reset(self) -> int:
        """A new version without voxels."""
        return self._write(self.spark.createDataFrame([], self._schema()), full=True)

    def integrate(self, obs: DataFrame, order: list[str], samples: dict[str, Column], gated: dict[str, Column] | None = None, gate: Column | None = None, touched: DataFrame | None = None, tag: str = "") -> int:
        """Fold samples of voxels (i, j, k, ...), in ``order``, into the volume; the number of the new version.

        Only blocks with samples are read and written. ``touched`` may name them (bx, by, bz) where they are known, say from the cameras' views, which saves working out ``obs`` twice; all blocks
        with samples have to be among them. Samples with a null index are dropped. Without samples, and without ``touched``, nothing is written. A ``tag`` (letters and digits) names what is folded: if a version bears it already nothing is done, so that a job that
        starts again goes on where it was.
        """
        if tag and any(name.endswith(f"-{tag}") for _, name in self.versions()):
            return self.version()
        key = ["i", "j", "k"]
        named = obs.where(F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("k").isNotNull())
        block = {b: F.floor(F.col(c) / 8) for b, c in zip(BLOCK, key, strict=True)}
        if touched is None:
            if named.isEmpty():
                return self.version()
            touched = named.select(*(e.alias(b) for b, e in block.items()))
        touched = touched.select(*BLOCK).distinct()
        state = self.read().join(touched, [*BLOCK], "left_semi")
        new = fold.means_and_gated(named, key, order, samples, gated or {}, F.lit(False) if gate is None else gate, self.cap, state).withColumns(block)
        number = self._write(new, full=False, tag=tag)
        held = self.versions()
        full = max((n for n, name in held if name.endswith("-full")), default=0)
        return self._write(self.read(), full=True) if sum(n > full for n, _ in held) >= self.full_every else number

    def query(self, at: DataFrame, version: int | None = None, interpolate: bool = True) -> DataFrame:
        """(id, *samples, weight, feat): the volume at points (id, x, y, z); between voxels, or of the nearest one. ``feat`` has the gated channels."""
        v = self.read(version).withColumn("feat", F.array(*self.channels.gated) if self.channels.gated else F.lit(None).cast("array<double>"))
        values = {**self.channels.samples, "weight": 0.0}
        look = points.trilinear if interpolate else points.nearest
        return look(at, v.withColumn("weight", F.col("weight").cast("double")), self.dims, values, self.origin, self.size, vectors={"feat": len(self.channels.gated)} if self.channels.gated else None)

    def extract_mesh(self, min_weight: float = 1.0, colors: tuple[str, ...] = (), version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(vertices, faces) of the surface of the channel ``tsdf``."""
        return mesh.mesh(self.read(version), self.dims, self.origin, self.size, min_weight, colors)
