"""Poses as quaternions, and which blocks a camera can see."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(q: list[Column]) -> list[Column]:
    """Rotation matrix, by rows, of a quaternion (x, y, z, w) of any length but zero; zero gives nulls."""
    n = sum((c * c for c in q[1:]), q[0] * q[0])
    s = F.when(n > 0, F.lit(2.0) / n)
    x, y, z, w = q
    return [
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    ]


def quaternion(m: list[Column]) -> list[Column]:
    """Unit quaternion (x, y, z, w), w not negative, of a rotation matrix by rows.

    Four times the square of each part is one plus a sum of signs times the diagonal; dividing by the largest part keeps precision.
    """
    a, b, c = m[0], m[4], m[8]
    squares = [1 + a - b - c, 1 - a + b - c, 1 - a - b + c, 1 + a + b + c]
    # products of two parts, times four
    xy, xz, yz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    xw, yw, zw = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    rows = [[squares[0], xy, xz, xw], [xy, squares[1], yz, yw], [xz, yz, squares[2], zw], [xw, yw, zw, squares[3]]]
    top = F.greatest(*squares)
    out = []
    for part in range(4):
        by = F.when(squares[3] == top, rows[3][part])
        for r in range(3):
            by = by.when(squares[r] == top, rows[r][part])
        sign = F.when(squares[3] == top, 1.0)
        for r in range(3):
            sign = sign.when(squares[r] == top, F.when(rows[r][3] < 0, -1.0).otherwise(1.0))
        out.append(sign * by / (2 * F.sqrt(top)))
    return out


def pose(*columns: str) -> Column:
    """A pose as a struct: place tx, ty, tz and quaternion qx, qy, qz, qw, of columns of these names or of those given."""
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    return F.struct(*(F.col(c).cast("double").alias(n) for c, n in zip(columns or names, names, strict=True)))


def pose_between(a: Column, b: Column, share: Column) -> Column:
    """The pose ``share`` of the way from ``a`` to ``b`` (structs): the place along a line, the turn along the shorter arc at a constant rate.

    Quaternions of any length but zero are made units; of opposite ones, which are the same turn, the nearer is taken. Where the arc is too small to tell, the quaternion goes along
    the line. The result is a unit, of ``a``'s sign. A zero or null quaternion gives nulls in the turn.
    """
    parts = ("qx", "qy", "qz", "qw")
    inner = lambda p, q: sum((p[c] * q[c] for c in parts[1:]), p[parts[0]] * q[parts[0]])
    length = lambda q: F.nullif(F.sqrt(inner(q, q)), F.lit(0.0))

    def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
        """``body`` of values that are computed once."""
        return F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), body)[0]

    def weighed(r: Column) -> Column:
        near = F.when(r["dot"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        small = r["angle"] < 1e-6
        wa = F.when(small, 1.0 - r["share"]).otherwise(F.sin((1.0 - r["share"]) * r["angle"]) / F.sin(r["angle"])) / r["la"]
        wb = F.when(small, r["share"]).otherwise(F.sin(r["share"] * r["angle"]) / F.sin(r["angle"])) * near / r["lb"]
        return let({"a": r["a"], "b": r["b"], "share": r["share"], "wa": wa, "wb": wb}, moved)

    def moved(r: Column) -> Column:
        place = [(r["a"][c] + (r["b"][c] - r["a"][c]) * r["share"]).alias(c) for c in ("tx", "ty", "tz")]
        return F.struct(*place, *((r["a"][c] * r["wa"] + r["b"][c] * r["wb"]).alias(c) for c in parts))

    start = {"a": a, "b": b, "share": share, "la": length(a), "lb": length(b), "dot": inner(a, b)}
    angle = lambda r: F.acos(F.least(F.abs(r["dot"] / (r["la"] * r["lb"])), F.lit(1.0)))
    return let(start, lambda r: let({**{n: r[n] for n in start}, "angle": angle(r)}, weighed))


def visible_blocks(frames: DataFrame, blocks: DataFrame, side: float, focal: float, width: int, height: int, far: float, with_pose: bool = False) -> DataFrame:
    """(frame_id, bx, by, bz), and the frame's ``t_wc`` (16 numbers less the last row) if asked for: the distinct ``blocks`` whose middle lies in each frame's pyramid of view up to depth ``far``,
    its planes moved out by the radius of a block's ball, so no block with a visible voxel is missed.

    ``frames`` has frame_id, a quaternion qx, qy, qz, qw and a place tx, ty, tz (camera to world); a block's corner is its index times ``side``. Frames meet blocks
    by cells of the size of that wider pyramid, cut off at a radius before and behind (27 a frame or fewer), not all against all. Frames with a null or a zero quaternion see none.
    """
    radius = side * 3**0.5 / 2
    wide, high = width / 2 / focal, height / 2 / focal
    near_end, far_end = -radius, far + radius
    # half the width and half the height of the wider pyramid at both ends; at the corners its planes are farther than a radius from the plain one
    half = {z: [z * slope + radius * (1 + slope * slope) ** 0.5 for slope in (wide, high)] for z in (near_end, far_end)}
    cell = max(far + 2 * radius, *(2 * h for h in half[far_end]), side)
    turn = matrix([F.col(c) for c in ("qx", "qy", "qz", "qw")])
    f = frames.select("frame_id", *(F.col(c).alias(c) for c in ("tx", "ty", "tz")), *(c.alias(f"r{i}") for i, c in enumerate(turn))).where("r0 is not null")
    corners = [(x * half[z][0], y * half[z][1], z) for x, y, z in product((-1, 1), (-1, 1), half)]
    spans = []
    for row, t in enumerate(("tx", "ty", "tz")):
        at = [F.col(t) + sum((F.col(f"r{3 * row + c}") * p[c] for c in (1, 2)), F.col(f"r{3 * row}") * p[0]) for p in corners]
        spans.append(F.sequence(F.floor((F.least(*at) - 1e-6) / cell), F.floor((F.greatest(*at) + 1e-6) / cell)))
    for name, s in zip(("cx", "cy", "cz"), spans, strict=True):
        f = f.withColumn(name, F.explode(s))
    middle = {c: (F.col(b) + 0.5) * side for c, b in zip("xyz", ("bx", "by", "bz"), strict=True)}
    b = blocks.select("bx", "by", "bz").distinct().withColumns(middle).withColumns({f"c{c}": F.floor(F.col(c) / cell) for c in "xyz"})
    both = f.join(b, ["cx", "cy", "cz"])
    d = [F.col(c) - F.col(f"t{c}") for c in "xyz"]
    x, y, z = (sum((F.col(f"r{3 * r + c}") * d[r] for r in (1, 2)), F.col(f"r{c}") * d[0]) for c in range(3))
    pose = F.array(*(F.col(c) for r, t in enumerate(("tx", "ty", "tz")) for c in (f"r{3 * r}", f"r{3 * r + 1}", f"r{3 * r + 2}", t)))
    side_out = lambda p, slope: z * slope - F.abs(p) >= -radius * (1 + slope * slope) ** 0.5
    return both.where((z >= -radius) & (z <= far + radius) & side_out(x, wide) & side_out(y, high)).select("frame_id", "bx", "by", "bz", *([pose.alias("t_wc")] if with_pose else []))
