"""Joins to unique keys of which some may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than a HOT-th of all rows is hot, so there are fewer than HOT of them.
HOT = 1000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], n_col: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which holds every key once, with the number ``n_col`` of its rows among the ``total`` of ``left``.

    Hot keys, fewer than HOT, are joined by broadcast where the rows lie; the others by exchange. Null keys match nothing. ``n_col`` is dropped.
    """
    is_hot = F.col(n_col) * HOT > total
    hot, cold = right.where(is_hot).drop(n_col), right.where(~is_hot).drop(n_col)
    near = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(rest)
