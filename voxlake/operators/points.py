"""Queries at points of a voxel table, and histograms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.storage import cut

#: Points whose corners a task weighs at once.
CHUNK = 1000


def _byte(c: Column) -> Column:
    """A color channel: cut to 0 to 255, then to a whole number; sums that miss one by rounding errors only count as it."""
    return F.round(F.greatest(F.least(c, F.lit(255.0)), F.lit(0.0)), 9).cast("int")


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """The first ``dim`` numbers of each list, 0 where there are none or a null."""
    length = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    numbers = pc.fill_null(lists.flatten(), 0).to_numpy()
    if (length > dim).any():
        numbers, length = numbers[np.arange(len(numbers)) - np.repeat(np.cumsum(length) - length, length) < dim], np.minimum(length, dim)
    out = np.zeros((len(length), dim))
    out[np.arange(dim) < length[:, None]] = numbers
    return out


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def trilinear(
    points: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], values: dict[str, float], origin: float = 0.0, size: float = 0.1, colors: tuple[str, ...] = (), vectors: dict[str, int] | None = None
) -> DataFrame:
    """(id, *values, *colors, *vectors): values of ``voxels`` (i, j, k, ...) interpolated at ``points`` (id, x, y, z).

    Corners are clamped to the volume and fractions to [0, 1]; voxels that are not stored have the values given, colors of 0, and vectors of zeros, as have those
    with a null there. Interpolated colors are cut to 0 to 255 and to whole numbers. ``vectors`` gives the length of each array column. The eight corners of a cell are brought together once,
    for the cells that hold points, and points meet their cell, so no row of a point and a corner is exchanged. Points without an id, or with a null coordinate, are passed over; those
    of one id are added up.
    """
    vectors = vectors or {}
    at = points.where("id is not null and x is not null and y is not null and z is not null")
    low, part = {}, {}
    for c, axis, n in zip("ijk", "xyz", dims, strict=True):
        g = (F.col(axis) - origin) / size - 0.5
        low[c] = F.least(F.greatest(F.floor(g), F.lit(0)), F.lit(n - 1))
        part[c] = F.least(F.greatest(g - low[c], F.lit(0.0)), F.lit(1.0))
    offsets = [*product((0, 1), repeat=3)]
    located = at.select("id", *(low[c].alias(c) for c in "ijk"), *(part[c].alias(f"part_{c}") for c in "ijk"))
    around = F.array(*(F.struct(F.lit(m).alias("corner"), *(F.least(F.col(c) + o, F.lit(n - 1)).alias(f"at_{c}") for c, o, n in zip("ijk", offset, dims, strict=True))) for m, offset in enumerate(offsets)))
    listed = located.select(*"ijk").distinct().select(*"ijk", F.explode(around).alias("c")).select(*"ijk", "c.*")
    defaults = {**values, **dict.fromkeys(colors, 0.0)}
    numbers = [f"n_{c}" for c in defaults]
    held = voxels.select(*(F.col(c).alias(f"at_{c}") for c in "ijk"), *values, *colors, *(F.col(c).alias(f"v_{c}") for c in vectors))
    entry = F.struct("corner", *(F.coalesce(F.col(c).cast("double"), F.lit(default)).alias(f"n_{c}") for c, default in defaults.items()), *(f"v_{c}" for c in vectors))
    corners = listed.join(held, [f"at_{c}" for c in "ijk"], "left").groupBy(*"ijk").agg(F.collect_list(entry).alias("held"))
    wide = len(numbers) + sum(vectors.values())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's corners one after the other, each with its numbers and then its vectors; repeated voxels are added up."""
        for rows in (batch.slice(n, CHUNK) for batch in batches for n in range(0, batch.num_rows, CHUNK)):
            entries, count = rows["held"].flatten(), rows["held"].value_lengths().to_numpy()
            every = np.concatenate([*(entries.field(c).to_numpy()[:, None] for c in numbers), *(_matrix(entries.field(f"v_{c}"), n) for c, n in vectors.items())], axis=1)
            held = np.zeros((8 * rows.num_rows, wide))
            np.add.at(held, np.repeat(np.arange(rows.num_rows) * 8, count) + entries.field("corner").to_numpy(), every)
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in "ijk"), _lists(held.reshape(rows.num_rows, -1))], [*"ijk", "held"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.array(offsets, bool)
        for rows in (batch.slice(n, CHUNK) for batch in batches for n in range(0, batch.num_rows, CHUNK)):
            place = np.stack([rows[f"part_{c}"].to_numpy() for c in "ijk"], 1)[:, None]
            share = np.where(far, place, 1.0 - place).prod(axis=2)[:, None]
            total = (share @ rows["held"].flatten().to_numpy().reshape(-1, 8, wide))[:, 0]
            ends = np.cumsum([len(numbers), *vectors.values()])
            yield pa.RecordBatch.from_arrays([rows["id"], *(pa.array(total[:, n]) for n in range(len(numbers))), *(_lists(total[:, e - n : e]) for e, n in zip(ends[1:], vectors.values(), strict=True))], names)

    names = ["id", *numbers, *(f"v_{c}" for c in vectors)]
    out = ", ".join([f"id {located.schema['id'].dataType.simpleString()}", *(f"{c} double" for c in numbers), *(f"v_{c} array<double>" for c in vectors)])
    cells = corners.mapInArrow(packed, "i long, j long, k long, held array<double>")

    def interpolated(located: DataFrame) -> DataFrame:
        return located.join(cells, [*"ijk"]).select("id", *(f"part_{c}" for c in "ijk"), "held").mapInArrow(weighed, out)

    repeated = cut(located.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if repeated.isEmpty():
        found = interpolated(located)
    else:
        sums = [F.sum(c).alias(c) for c in numbers] + [F.array(*(F.sum(F.get(f"v_{c}", F.lit(d))) for d in range(n))).alias(f"v_{c}") for c, n in vectors.items()]
        added = interpolated(located.join(repeated, "id", "left_semi")).groupBy("id").agg(*sums)
        found = interpolated(located.join(repeated, "id", "left_anti")).unionByName(added)
    return found.select("id", *(F.col(f"n_{c}").alias(c) for c in values), *(_byte(F.col(f"n_{c}")).alias(c) for c in colors), *(F.col(f"v_{c}").alias(c) for c in vectors))


def nearest(
    points: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], values: dict[str, float], origin: float = 0.0, size: float = 0.1, colors: tuple[str, ...] = (), vectors: dict[str, int] | None = None
) -> DataFrame:
    """The same of the voxel that holds each point, or the nearest in the volume, without interpolation."""
    vectors = vectors or {}
    at = points.where("id is not null and x is not null and y is not null and z is not null")
    cells = [F.least(F.greatest(F.floor((F.col(axis) - origin) / size), F.lit(0)), F.lit(n - 1)).cast("long").alias(c) for c, axis, n in zip("ijk", "xyz", dims, strict=True)]
    found = at.select("id", *cells).join(voxels.select("i", "j", "k", *values, *colors, *vectors), ["i", "j", "k"], "left")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return found.select(
        "id", *(F.coalesce(name, F.lit(default)).alias(name) for name, default in values.items()), *(_byte(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in colors),
        *(F.coalesce(F.transform(name, lambda x: x.cast("double")), zeros(n)).alias(name) for name, n in vectors.items()),
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, low, n): counts in equal bins between the least and the greatest value; the last bin holds its upper end. Nulls are passed over."""
    v = df.select(value.alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return v.join(F.broadcast(ends)).select(place.cast("int").alias("bin"), "lo", width.alias("width")).groupBy("bin", "lo", "width").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), "n")
