"""Triangle meshes of the zero surface of a voxel table: colored vertices on grid edges, and faces that name them.

A cell is a cube of eight voxels, numbered by its smallest corner (i, j, k). Which of its corners are inside (negative) is a number from 0 to 255, and a table
made from one rule gives the triangles of each: around every side of the cube, each run of inside corners is cut off by a segment between
the two edges it crosses. Both cells of a side see the same runs, so segments meet, loops of segments close, and a mesh has no cracks.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.surface import crossings

Edge = tuple[int, tuple[int, int, int]]
#: Corners of a cell; corner c is bit c of a pattern.
CORNERS = [*product((0, 1), repeat=3)]
#: Edges of a cell: the axis along which they run, and the corner where they begin.
EDGES: list[Edge] = [(axis, c) for axis in range(3) for c in CORNERS if not c[axis]]


def _sides() -> list[list[tuple[int, int, int]]]:
    """The four corners of each side of a cell, in turn, counter-clockwise as seen from outside."""
    out = []
    for axis, at in product(range(3), (0, 1)):
        b, c = (axis + 1) % 3, (axis + 2) % 3
        around = []
        for x, y in ((0, 0), (1, 0), (1, 1), (0, 1)):
            corner = [0, 0, 0]
            corner[axis], corner[b], corner[c] = at, x, y
            around.append(tuple(corner))
        out.append(around if at else around[::-1])
    return out


def _edge(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    axis = next(i for i in range(3) if a[i] != b[i])
    return EDGES.index((axis, min(a, b)))


def _loops(pattern: int) -> list[list[int]]:
    """Closed ways over the edges that a pattern cuts, in the direction that leaves the inside behind the surface."""
    inside = {c for n, c in enumerate(CORNERS) if pattern >> n & 1}
    following = {}
    for side in _sides():
        turns = [(side[n - 1] in inside, _edge(side[n - 1], side[n])) for n in range(4) if (side[n - 1] in inside) != (side[n] in inside)]
        # a run of inside corners is entered by one edge and left by the next one that is cut
        for n, (leaving, edge) in enumerate(turns):
            if leaving:
                following[turns[n - 1][1]] = edge
    loops, left = [], set(following)
    while left:
        loop = [min(left)]
        while (new := following[loop[-1]]) != loop[0]:
            loop.append(new)
        loops.append(loop)
        left -= set(loop)
    return loops


def _on_one_side(a: int, b: int) -> bool:
    """Whether two edges lie on one side of the cell, where a line between them could meet the next cell's."""
    ends = [{c, tuple(x + (n == axis) for n, x in enumerate(c))} for axis, c in (EDGES[a], EDGES[b])]
    return any(ends[0] | ends[1] <= set(side) for side in _sides())


def _triangles(loop: list[int]) -> list[tuple[int, int, int]] | None:
    """Triangles that fill a loop, with no inner line along a side of the cell; of all ways the first one by position."""
    if len(loop) == 3:
        return [tuple(loop)]
    for n in range(1, len(loop) - 1):  # the triangle on the line from the last to the first
        parts = [loop[: n + 1], loop[n:]]
        if any(len(p) > 2 and _on_one_side(p[0], p[-1]) for p in parts):
            continue
        filled = [[] if len(p) == 2 else _triangles(p) for p in parts]
        if None not in filled:
            return [(loop[0], loop[n], loop[-1]), *filled[0], *filled[1]]
    return None


@lru_cache(1)
def triangle_table() -> list[list[tuple[int, int, int]]]:
    """For each pattern, the triangles as numbers of EDGES, counter-clockwise as seen from outside."""
    out = []
    for pattern in range(256):
        filled = [_triangles(loop) for loop in _loops(pattern)]
        if None in filled:
            raise AssertionError(f"no triangles for pattern {pattern}")
        out.append([t for part in filled for t in part])
    return out


def observed(voxels: DataFrame, min_weight: float) -> DataFrame:
    """The voxels that count: the others are free space, +1, like those that are not stored."""
    return voxels.where("i is not null and j is not null and k is not null and tsdf is not null").where(F.col("weight") >= min_weight)


def edge_number(i: Column, j: Column, k: Column, axis: Column, dims: tuple[int, int, int]) -> Column:
    """One number for each edge of the grid."""
    return (((i * dims[1] + j) * dims[2] + k) * 3 + axis).cast("long")


def faces(voxels: DataFrame, dims: tuple[int, int, int], min_weight: float = 1.0) -> DataFrame:
    """(i, j, k, n, a, b, c): the triangles of each cell, numbered from 0 within it; a, b, c are the edge numbers of their vertices.

    Only inside voxels matter for a cell's pattern, so only they are sent, each to the cells of which it is a corner, as one bit that is combined before the exchange.
    Voxels that are not stored, of less than ``min_weight``, or without a distance, are outside; so is the distance zero. Of repeated voxels one inside is enough.
    Cells are within the volume. An empty table gives no faces.
    """
    cells = []
    for n, offset in enumerate(CORNERS):
        at = [F.col(c) - o for c, o in zip("ijk", offset, strict=True)]
        within = [(a >= 0) & (a < size - 1) for a, size in zip(at, dims, strict=True)]
        cells.append(F.when(within[0] & within[1] & within[2], F.struct(*(a.cast("long").alias(c) for a, c in zip(at, "ijk", strict=True)), F.lit(1 << n).alias("bit"))))
    inside = observed(voxels, min_weight).where("tsdf < 0")
    corners = inside.select(F.explode(F.array(*cells)).alias("e")).where("e is not null").select("e.*")
    patterns = corners.groupBy("i", "j", "k").agg(F.bit_or("bit").alias("pattern")).where("pattern < 255")
    table = F.array(*(F.array(*(F.array(*map(F.lit, t)) for t in triangles)) if triangles else F.expr("cast(array() as array<array<int>>)") for triangles in triangle_table()))
    listed = patterns.select("i", "j", "k", F.posexplode(F.get(table, F.col("pattern"))).alias("n", "t"))
    numbers = F.array(*(edge_number(F.col("i") + o[0], F.col("j") + o[1], F.col("k") + o[2], F.lit(axis), dims) for axis, o in EDGES))
    return listed.select("i", "j", "k", "n", *(F.get(numbers, F.get("t", p)).alias(x) for p, x in enumerate("abc")))


def vertices(voxels: DataFrame, dims: tuple[int, int, int], origin: float = 0.0, size: float = 0.1, min_weight: float = 1.0, colors: tuple[str, ...] = ()) -> DataFrame:
    """(vertex, x, y, z, *colors): a vertex on each edge between an inside and an outside voxel, by its edge number, with the color of the nearer of the two.

    A vertex in the middle takes the color of the end farther along. Colors are cut to 0 to 255 and to whole numbers; where the nearer voxel isn't stored, they are 0. A
    stored voxel gives its color whatever its weight.
    """
    seen = voxels.where("i is not null and j is not null and k is not null")
    counts = (F.col("weight") >= min_weight) & F.col("tsdf").isNotNull()
    held = seen.select("i", "j", "k", F.when(counts, F.col("tsdf")).otherwise(F.lit(1.0)).alias("tsdf"), F.lit(1.0).alias("weight"), *colors)
    cut = crossings(held, dims, origin, size, colors)
    number = edge_number(F.col("i"), F.col("j"), F.col("k"), F.col("axis"), dims)
    byte = lambda c: F.greatest(F.least(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(255.0)), F.lit(0.0)).cast("int")
    return cut.select(number.alias("vertex"), "x", "y", "z", *(byte(F.col(c)).alias(c) for c in colors))


def mesh(voxels: DataFrame, dims: tuple[int, int, int], origin: float = 0.0, size: float = 0.1, min_weight: float = 1.0, colors: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the surface; faces name vertices by their edge numbers."""
    return vertices(voxels, dims, origin, size, min_weight, colors), faces(voxels, dims, min_weight)
