"""Connected components: of an edge table, as repeated joins and aggregations, and within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.skew import join_unique
from voxlake.storage import cut

#: Edges that a single task can join, whatever their keys.
FEW_EDGES = 1_000_000


class Forest:
    """Links among n things of one task: a spanning forest, so a dense group of g gives g - 1 of them. ``label``: the smallest of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link a[i] with b[i], by repeatedly taking over the smaller label of both ends' roots."""
        while len(a):
            x, y = self.label[a], self.label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.label, high, low)
            while (up := self.label[self.label] != self.label).any():
                self.label[up] = self.label[self.label[up]]
            keep = self.label[a] != self.label[b]
            a, b = a[keep], b[keep]


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node it reaches.

    Each round links every node's neighbours, and the node, to the smallest of them, first over all
    neighbours, then over smaller ones only; this keeps the edge count and needs a logarithmic number
    of rounds. Edges that are stars already, as those of blocks which nothing crosses, need none. Self-loops, repeated edges and edges with a null end are ignored (a self-loop still
    yields its node). The edge set is checkpointed in the shared folder every round, and a round that leaves its
    number of edges and the exclusive or of their hashes as they were is the last. Nodes with many neighbours are joined by broadcast.
    An edge set that has not settled after ``max_rounds`` is an error.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    state = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    alone = state.where("a = b").select(F.col("a").alias("node"))
    state = state.where("a <> b")
    if _are_stars(state):
        return _labelled(state, alone)
    mark = _mark(state)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        split = mark[0] > FEW_EDGES
        # every larger neighbour, to the smallest
        near = join_unique(both, low, ["a"], "n", 2 * mark[0]) if split else both.join(low.drop("n"), "a")
        large = near.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # the node and its smaller neighbours, to the smallest
        joined = join_unique(large, low2, ["a"], "n", mark[0]) if split else large.join(low2.drop("n"), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        state = cut(small.where("a <> b").distinct())
        last, mark = mark, _mark(state)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return _labelled(state, alone)


def _labelled(state: DataFrame, alone: DataFrame) -> DataFrame:
    """The nodes of stars, and those of ``alone`` that are in none."""
    found = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    linked = found.union(roots)
    return linked.union(alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))


def _are_stars(state: DataFrame) -> bool:
    """Whether every larger end has one edge, to a node that has none to a smaller one."""
    ends = state.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(state.select(F.col("b"), F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _mark(state: DataFrame) -> tuple[int, int | None]:
    """The number of edges and the exclusive or of their hashes."""
    return tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
