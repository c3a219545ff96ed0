"""Scored voxels to ranked 3D results."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxlake.functions import geometry, vector
from voxlake.operators.components import Forest, connected_components
from voxlake.operators.quantile import quantiles
from voxlake.storage import cut

SENTINEL = -1e4
#: Side of the blocks whose seeds are linked in one task.
BLOCK = 64


def score(voxels: DataFrame, query: list[float], negative: list[float] | None = None) -> DataFrame:
    """``score``: inner product with the query, less that with a negative prompt; null without a feature."""
    q = query if negative is None else [a - b for a, b in zip(query, negative, strict=True)]
    return voxels.withColumn("score", vector.inner(F.col("feat"), vector.literal(q)))


def seeds(scored: DataFrame, top_percentile: float | None, threshold: float | None, min_weight: float, surface_only: bool, subtract_mean: bool) -> tuple[DataFrame, DataFrame]:
    """Observed voxels with a score at or above the cut, and one row with ``mean``, what is subtracted from scores.

    The percentile wins over the threshold, which is of scores less the mean. Voxels equal to the cut pass.
    """
    if top_percentile is None and threshold is None:
        raise ValueError("top_percentile or threshold is needed")
    seen = scored.where((F.col("weight") >= min_weight) & F.col("score").isNotNull())
    if surface_only:
        seen = seen.where(F.abs("tsdf") <= 0.5)
    stats = quantiles(seen, "score", {} if top_percentile is None else {"cut": 1 - top_percentile})
    mean = F.coalesce("mean", F.lit(0.0)) if subtract_mean else F.lit(0.0)
    level = F.lit(threshold) + mean if top_percentile is None else F.col("cut")
    stats = stats.select(mean.alias("mean"), level.alias("level"))
    return seen.crossJoin(F.broadcast(stats.select("level"))).where("score >= level").drop("level"), stats.select("mean")  # one row


def heatmap(
    scored: DataFrame, stops: list[tuple[int, int, int]], low: float = 0.5, high: float = 0.99, min_weight: float = 1.0, band: float = 0.5, origin: float = 0.0, size: float = 0.1
) -> DataFrame:
    """(i, j, k, x, y, z, score, red, green, blue): the observed surface voxels, their centers, and their scores as colors between the quantiles ``low`` and ``high``.

    Scores beyond the quantiles take the end colors; where both are equal, those above are the high end's. Voxels without a score are left out. One row of quantiles is sent to all tasks.
    """
    surface = scored.where((F.col("weight") >= min_weight) & (F.abs("tsdf") <= band) & F.col("score").isNotNull())
    ends = quantiles(surface, "score", {"lo_": low, "hi_": high}).select("lo_", F.greatest(F.col("hi_"), F.col("lo_") + 1e-6).alias("hi_"))
    at = [geometry.center(F.col(c), origin, size).alias(x) for c, x in zip("ijk", "xyz", strict=True)]
    channels = geometry.colormap((F.col("score") - F.col("lo_")) / (F.col("hi_") - F.col("lo_")), stops)
    return surface.crossJoin(F.broadcast(ends)).select("i", "j", "k", *at, "score", *(c.alias(n) for c, n in zip(channels, ("red", "green", "blue"), strict=True)))


def _block_links(at: np.ndarray, r: int) -> np.ndarray:
    """For each of the distinct places (n, 3), the number of the smallest place that a chain of steps of at most ``r`` along each axis reaches."""
    order = np.lexsort(at.T[::-1])
    at = at[order]
    cell = (at - at.min(axis=0)) // r + 1
    size = cell.max(axis=0) + 2
    code = lambda c: (c[:, 0] * size[1] + c[:, 1]) * size[2] + c[:, 2]
    by_cell = np.argsort(code(cell), kind="stable")
    keys = code(cell)[by_cell]
    forest = Forest(len(at))
    for o in product((-1, 0, 1), repeat=3):
        if o < (0, 0, 0):
            continue
        there = code(cell + np.array(o))
        low, high = np.searchsorted(keys, there), np.searchsorted(keys, there, side="right")
        n = high - low
        a = np.repeat(np.arange(len(at)), n)
        b = by_cell[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        near = (np.abs(at[a] - at[b]) <= r).all(axis=1)
        forest.join(a[near], b[near])
    label = np.empty(len(at), np.int64)
    label[order] = order[forest.label]
    return label


def clusters(points: DataFrame, eps: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, i, j, k, label) of seeds linked within Chebyshev distance 2 (eps - 1) + 1, within each group of ``by``; the label is the smallest (i, j, k) linked.

    Seeds are dealt to blocks of BLOCK voxels a side, those near a lower face to the block below as well, so every link lies in some block. A block's
    links become a star, and the stars' components are the clusters. A block that only holds copies from one other block has no links of its own.
    """
    r = 2 * (eps - 1) + 1
    key = [*by, "bi", "bj", "bk"]
    dealt = points.select(*by, "i", "j", "k").distinct()
    for c in "ijk":
        dealt = dealt.withColumn(f"b{c}", F.explode(F.array_distinct(F.array(F.floor((F.col(c) - r) / BLOCK), F.floor(F.col(c) / BLOCK)))))

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["i", "j", "k"]].to_numpy()
        owner = at // BLOCK
        if (owner == owner[0]).all() and tuple(owner[0]) != key[-3:]:
            at = at[:0]
        root = at[_block_links(at, r)] if len(at) else at
        out = {n: np.full(len(at), key[p]) for p, n in enumerate(by)}
        return pd.DataFrame(out | {f"{n}{c}": x[:, m] for n, x in (("a", at), ("b", root)) for m, c in enumerate("ijk")})

    kinds = [f"{n} {points.schema[n].dataType.simpleString()}" for n in by]
    links = dealt.groupBy(*key).applyInPandas(link, ", ".join([*kinds, *(f"{n}{c} long" for n in "ab" for c in "ijk")]))
    end = lambda n: F.struct(*by, *(F.col(f"{n}{c}").alias(c) for c in "ijk")).alias(n)
    found = connected_components(links.select(end("a"), end("b")))
    return found.select("node.*", F.struct(*(F.col(f"component.{c}").alias(c) for c in "ijk")).alias("label"))


def dilated(labelled: DataFrame, eps: int, dims: tuple[int, int, int]) -> DataFrame:
    """Members of each cluster: the cubes of radius eps - 1 around its seeds, clipped to the volume."""
    d = eps - 1
    steps = F.sequence(F.lit(-d), F.lit(d))
    out = labelled
    for c, n in zip("ijk", dims, strict=True):
        out = out.withColumn("o", F.explode(steps)).withColumn(c, F.col(c) + F.col("o")).drop("o").where((F.col(c) >= 0) & (F.col(c) < n))
    return out.distinct()


@dataclass(frozen=True)
class Setting:
    """How seeds are cut and clusters kept: the share of the best observed scores (which wins) or a threshold of scores less the mean, whether the mean is subtracted, the least size."""

    top_percentile: float | None = 0.1
    threshold: float | None = None
    subtract_mean: bool = False
    min_voxels: int = 1


def ground_grid(
    voxels: DataFrame, cases: dict[str, tuple[list[float], list[float] | None]], settings: list[Setting], dims: tuple[int, int, int], min_weight: float = 1.0,
    surface_only: bool = True, eps: int = 2, top_k: int = 5, origin: float = 0.0, size: float = 0.1, missing: str = "ignore",
) -> DataFrame:
    """Ranked clusters of every case (a query and a negative prompt, or none) under every setting, in one job: (case, setting, rank, count, center, box, score).

    Voxels are read and scored once, for all cases. The cuts of all shares come from one set of brackets for each case, and seeds, clusters and members carry their case and the number of their
    setting. Only the table of cuts, a row for each case and setting, is sent to all tasks.

    ``missing``: members without a feature are left out of the mean score (ignore), count as 0 (zero), or as the sentinel
    of a layout that stores it (sentinel). Clusters are ranked by score * log1p(count); ties by the first member.
    """
    if any(s.top_percentile is None and s.threshold is None for s in settings):
        raise ValueError("top_percentile or threshold is needed")
    every = [vector.inner(F.col("feat"), vector.literal(q if n is None else [a - b for a, b in zip(q, n, strict=True)])) for q, n in cases.values()]
    names = F.array(*map(F.lit, cases))
    scored = voxels.select("i", "j", "k", "weight", "tsdf", F.posexplode(F.array(*every)).alias("c", "score")).where("score is not null")
    scored = cut(scored.select(F.get(names, F.col("c")).alias("case"), "i", "j", "k", "weight", "tsdf", "score"))
    seen = scored.where(F.col("weight") >= min_weight)
    if surface_only:
        seen = seen.where(F.abs("tsdf") <= 0.5)
    shares = sorted({s.top_percentile for s in settings if s.top_percentile is not None})
    stats = quantiles(seen, "score", {f"cut{n}": 1 - p for n, p in enumerate(shares)}, ["case"])
    rows = []
    for n, s in enumerate(settings):
        mean = F.col("mean") if s.subtract_mean else F.lit(0.0)
        level = F.lit(s.threshold) + mean if s.top_percentile is None else F.col(f"cut{shares.index(s.top_percentile)}")
        rows.append(F.struct(F.lit(n).alias("setting"), mean.alias("mean"), level.cast("double").alias("level"), F.lit(s.min_voxels).alias("least")))
    levels = F.broadcast(cut(stats.select("case", F.explode(F.array(*rows)).alias("s")).select("case", "s.*")))  # cases times settings
    by = ("case", "setting")
    found = seen.join(levels, "case").where("score >= level").select(*by, "i", "j", "k")
    members = dilated(clusters(found, eps, by), eps, dims)
    members = members.join(scored.select("case", "i", "j", "k", "score"), ["case", "i", "j", "k"], "left").join(levels, [*by])
    value = F.col("score") if missing == "ignore" else F.coalesce("score", F.lit(SENTINEL if missing == "sentinel" else 0.0))
    at = {c: geometry.center(F.col(c), origin, size) for c in "ijk"}
    flat = (F.col("i") * dims[1] + F.col("j")) * dims[2] + F.col("k")
    per = members.groupBy(*by, "label").agg(
        F.count("*").alias("count"), *(F.avg(at[c]).alias(f"center_{c}") for c in "ijk"), *(F.min(at[c]).alias(f"min_{c}") for c in "ijk"), *(F.max(at[c]).alias(f"max_{c}") for c in "ijk"),
        F.avg(value - F.col("mean")).alias("score"), F.min(flat).alias("first"), F.first("least").alias("least"),
    ).where("count >= least")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("score") * F.log1p("count")), "first"))
    return per.withColumn("rank", rank).where(F.col("rank") <= top_k).select(*by, "rank", *(c for c in per.columns if c not in (*by, "label", "first", "least")))


def ground(
    voxels: DataFrame, query: list[float], dims: tuple[int, int, int], negative: list[float] | None = None, top_percentile: float | None = 0.1, threshold: float | None = None, min_weight: float = 1.0,
    surface_only: bool = True, subtract_mean: bool = False, eps: int = 2, min_voxels: int = 1, top_k: int = 5, origin: float = 0.0, size: float = 0.1, missing: str = "ignore",
) -> DataFrame:
    """Ranked clusters of one query under one setting: rank, count, center, box, score."""
    setting = Setting(top_percentile, threshold, subtract_mean, min_voxels)
    return ground_grid(voxels, {"": (query, negative)}, [setting], dims, min_weight, surface_only, eps, top_k, origin, size, missing).drop("case", "setting")
