"""Where the surface crosses the edges of the voxel grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crossings(voxels: DataFrame, dims: tuple[int, int, int], origin: float = 0.0, size: float = 0.1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, k, axis, x, y, z, *carry): the zero of the distance on each grid edge whose ends differ in sign, linearly interpolated; columns named in ``carry`` are
    those of the nearer end's voxel, null where it isn't stored.

    An edge goes from voxel (i, j, k) to the next one along ``axis`` (0 to 2), within the volume. Voxels not stored, without weight or with a null
    distance count as +1; zero counts as outside. Each voxel is sent to the six edges it ends, so one exchange and no join
    finds both ends. Voxels with a null index are passed over; of repeated voxels the smallest distance counts.
    """
    seen = voxels.where("i is not null and j is not null and k is not null and weight > 0 and tsdf is not null")
    ends = []
    for axis, (c, n) in enumerate(zip("ijk", dims, strict=True)):
        at = [F.col(x).alias(x) for x in "ijk"]
        before = [(F.col(x) - 1 if x == c else F.col(x)).alias(x) for x in "ijk"]
        none = F.lit(None).cast("double")
        held = [F.col(x).alias(x) for x in carry]
        ends.append(F.when(F.col(c) < n - 1, F.struct(*at, F.lit(axis).alias("axis"), F.col("tsdf").alias("a"), none.alias("b"), *held)))
        ends.append(F.when(F.col(c) > 0, F.struct(*before, F.lit(axis).alias("axis"), none.alias("a"), F.col("tsdf").alias("b"), *held)))
    edges = seen.select(F.explode(F.array(*ends)).alias("e")).where("e is not null").select("e.*")
    held = [F.min(F.when(F.col(c).isNotNull(), F.struct(c, *carry))).alias(f"{c}_held") for c in "ab" if carry]
    both = edges.groupBy("i", "j", "k", "axis").agg(*(F.coalesce(F.min(c), F.lit(1.0)).alias(c) for c in "ab"), *held)
    cut = both.where((F.col("a") < 0) != (F.col("b") < 0)).withColumn("t", F.col("a") / (F.col("a") - F.col("b")))
    nearer = [F.when(F.col("t") < 0.5, F.col(f"a_held.{x}")).otherwise(F.col(f"b_held.{x}")).alias(x) for x in carry]
    place = [(F.lit(origin) + (F.col(c) + 0.5 + F.when(F.col("axis") == axis, F.col("t")).otherwise(0.0)) * size).alias(x) for axis, (c, x) in enumerate(zip("ijk", "xyz", strict=True))]
    return cut.select("i", "j", "k", "axis", *place, *nearer)
