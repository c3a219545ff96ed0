"""Posed depth frames and image features brought to voxels, as rows that the folds take."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions import geometry
from voxlake.operators import camera

#: Blocks whose voxels a task projects at once: 512 rows each, of some numbers.
CHUNK = 256


def decoded(raw: Column, scale: float, most: float) -> Column:
    """Depths in meters of an array of raw depths; those beyond ``most`` are 0, which means none, like those that are null or NaN."""
    meters = lambda d: d.cast("double") / scale
    return F.transform(raw, lambda d: F.when(meters(d).isNull() | F.isnan(meters(d)) | (meters(d) > most), 0.0).otherwise(meters(d)))


def pixel_features(obs: DataFrame, frames: DataFrame, width: int, height: int, dim: int) -> DataFrame:
    """``obs`` (frame_id, u, v, ...) with ``feat``: the ``dim`` numbers at pixel (u, v) of the frame's ``map``, an array by rows; pixels outside are dropped."""
    inside = F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)
    first = ((F.col("v") * width + F.col("u")) * dim + 1).cast("int")
    return obs.where(inside).join(frames.select("frame_id", "map"), "frame_id").withColumn("feat", F.slice("map", first, F.lit(dim))).drop("map")


def patch_features(obs: DataFrame, frames: DataFrame, width: int, height: int, side: int, step: int, dim: int) -> DataFrame:
    """The same, of the patch that holds the pixel, after the image's middle is cut out; pixels outside of it are dropped."""
    pu, pv = geometry.patch(F.col("u"), F.col("v"), width, height, side, step)
    first = ((F.col("pv") * (side // step) + F.col("pu")) * dim + 1).cast("int")
    inside = obs.withColumns({"pu": pu, "pv": pv}).where("pu is not null and pv is not null")
    return inside.join(frames.select("frame_id", "map"), "frame_id").withColumn("feat", F.slice("map", first, F.lit(dim))).drop("map", "pu", "pv")


def observations(frames: DataFrame, blocks: DataFrame, size: float, focal: float, width: int, height: int, truncation: float, far: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, i, j, k, z, depth, sample, *carry): each voxel of the given blocks of 8 x 8 x 8 in each frame that sees it in front of, or less than ``truncation`` behind, its depth.

    ``frames``: frame_id, a quaternion qx, qy, qz, qw and place tx, ty, tz (camera to world), ``depth`` in meters by rows, 0 or null for none. Frames meet the blocks of
    their pyramid of view only; the blocks seen meet their frame's depths, and its columns named in ``carry``, and each task lists and projects the voxels of CHUNK of them at a time. No depth may
    be above ``far`` less ``truncation``. A frame without a pose sees nothing.
    """
    # a row becomes up to 512, so few rows are dealt to as many tasks as many would be
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = camera.visible_blocks(frames, blocks, 8 * size, focal, width, height, far, with_pose=True).repartition(tasks, "frame_id")
    held = frames.select("frame_id", F.col("depth").cast("array<double>").alias("depth"), *carry)
    seen = seen.join(held, "frame_id").select("frame_id", *(F.col(c).cast("long").alias(c) for c in ("bx", "by", "bz")), "t_wc", "depth", *carry)
    kinds = {f.name: f.dataType.simpleString() for f in seen.schema.fields}
    names = ["frame_id", "i", "j", "k", "z", "depth", "sample", *carry]
    out = ", ".join(f"`{c}` {'long' if c in 'ijk' else 'double' if c in ('z', 'depth', 'sample') else kinds[c]}" for c in names)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = np.arange(512)
        inside = np.stack([local // 64, local // 8 % 8, local % 8])
        for rows in (batch.slice(n, CHUNK) for batch in batches for n in range(0, batch.num_rows, CHUNK)):
            at = [8 * rows[c].to_numpy()[:, None] + x for c, x in zip(("bx", "by", "bz"), inside, strict=True)]
            pose = rows["t_wc"].flatten().to_numpy().reshape(-1, 12, 1)
            d = [(a + 0.5) * size - pose[:, 4 * r + 3] for r, a in enumerate(at)]
            x, y, z = (pose[:, c] * d[0] + pose[:, 4 + c] * d[1] + pose[:, 8 + c] * d[2] for c in range(3))
            with np.errstate(all="ignore"):
                u, v = (np.rint(focal * p / (z + 1e-8) + (n - 1) / 2) for p, n in ((x, width), (y, height)))
                row, voxel = np.nonzero((z > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height))
            length = np.asarray(pc.fill_null(pc.list_value_length(rows["depth"]), 0))
            depths = np.append(rows["depth"].flatten().to_numpy(zero_copy_only=False), 0.0)
            pixel = (v[row, voxel] * width + u[row, voxel]).astype(np.int64)
            depth = depths[np.where(pixel < length[row], (np.cumsum(length) - length)[row] + pixel, -1)]
            z = z[row, voxel]
            seen = (depth > 0) & (depth - z >= -truncation)
            row, voxel, z, depth = row[seen], voxel[seen], z[seen], depth[seen]
            sample = np.maximum(np.minimum((depth - z) / truncation, 1.0), -1.0)
            found = dict(zip("ijk", (a[row, voxel] for a in at), strict=True)) | {"z": z, "depth": depth, "sample": sample}
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(found[c]) if c in found else rows[c].take(take) for c in names], names)

    return seen.mapInArrow(project, out)
