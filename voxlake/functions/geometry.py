"""Camera and voxel expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def center(index: Column, origin: float, size: float) -> Column:
    return F.lit(origin) + (index + 0.5) * F.lit(size)


def pixel(focal: Column, x: Column, z: Column, middle: Column) -> Column:
    """Pinhole projection; halves go to the even pixel."""
    return F.rint(focal * x / (z + 1e-8) + middle).cast("int")


def to_camera(t_wc: Column, p: list[Column]) -> list[Column]:
    """World point in the camera frame of a rigid camera-to-world pose (16 values, by rows)."""
    d = [p[r] - t_wc[4 * r + 3] for r in range(3)]
    return [sum((t_wc[4 * r + c] * d[r] for r in range(1, 3)), t_wc[c] * d[0]) for c in range(3)]


def inverse(m: list[Column]) -> list[Column]:
    """The inverse of an affine map, of 12 numbers by rows (three of the matrix and one of the place); of a singular one nulls."""
    a, t = [m[4 * r : 4 * r + 3] for r in range(3)], [m[4 * r + 3] for r in range(3)]
    minor = lambda r, c: a[(r + 1) % 3][(c + 1) % 3] * a[(r + 2) % 3][(c + 2) % 3] - a[(r + 1) % 3][(c + 2) % 3] * a[(r + 2) % 3][(c + 1) % 3]
    det = F.nullif(a[0][0] * minor(0, 0) + a[0][1] * minor(0, 1) + a[0][2] * minor(0, 2), F.lit(0.0))
    turn = [[minor(c, r) / det for c in range(3)] for r in range(3)]
    return [x for r in range(3) for x in (*turn[r], -(turn[r][0] * t[0] + turn[r][1] * t[1] + turn[r][2] * t[2]))]


def signed_sample(depth: Column, z: Column, truncation: float) -> Column:
    return F.greatest(F.least((depth - z) / F.lit(truncation), F.lit(1.0)), F.lit(-1.0))


def colormap(x: Column, stops: list[tuple[int, int, int]]) -> list[Column]:
    """Channels of a piecewise linear map of [0, 1], clipped, truncated to whole numbers."""
    t = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) * (len(stops) - 1)
    k = F.least(F.floor(t), F.lit(len(stops) - 2)).cast("int")
    table = [F.array(*(F.lit(float(s[c])) for s in stops)) for c in range(3)]
    return [(table[c][k] + (table[c][k + 1] - table[c][k]) * (t - k)).cast("int") for c in range(3)]


def slug(text: Column) -> Column:
    """Lower-case letters and digits, joined by single underscores; ``query`` where nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("query"))


def patch(u: Column, v: Column, width: int, height: int, side: int, step: int) -> list[Column]:
    """Column and row of the patch of ``step`` pixels that holds a pixel, after the shorter side is scaled to ``side`` and the middle cut out; null outside."""
    scale, last = side / min(width, height), side // step - 1
    at = [c * scale - (n * scale - side) / 2 for c, n in ((u, width), (v, height))]
    inside = (at[0] >= 0) & (at[0] < side) & (at[1] >= 0) & (at[1] < side)
    return [F.when(inside, F.least(F.greatest(a / step, F.lit(0.0)), F.lit(float(last))).cast("int")) for a in at]


def weighted_mean(df: DataFrame, keys: list[str], weight: str, values: list[str]) -> DataFrame:
    """(keys, values): means by weight within each key; null where the weights add up to zero. Sums combine before the exchange."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(*(F.when(total != 0, F.sum(F.col(weight) * F.col(v)) / total).alias(v) for v in values))
