"""Bitmaps of hashed keys: tests that hold for every member of a set and for few others, of a bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest bitmap: 8 MB.
MOST_BITS = 1 << 26


def bitmap(members: DataFrame, col: str) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes, by their lowest bits. Larger sets let more others pass, which costs time only."""
    bits = min(MOST_BITS, 1 << max(15, (8 * members.count()).bit_length()))
    place = F.pmod(F.col(col), F.lit(bits)) + 1
    rows = members.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")).collect()  # at most bits / 2**15
    held = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in rows:
        held[r.k - 1] = np.frombuffer(r.b, np.uint8)
    return held.ravel()


def may_hold(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be a member."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(held) - 1)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def tester(members: DataFrame, col: str) -> Callable[[Column], Column]:
    """The test as a function of columns. The result may be used in filters; it is computed once."""
    sent = members.sparkSession.sparkContext.broadcast(bitmap(members, col))

    @F.pandas_udf("boolean")
    def tested(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(sent.value, h.to_numpy()))

    return lambda c: tested(c)
