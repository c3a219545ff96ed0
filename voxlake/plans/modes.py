"""How a volume's layout and its features go together: settings are made to fit, or refused, before anything is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts that hold features; modes that a layout can't take, which become global; what one mode's vectors measure on the layout of blocks.
LAYOUTS = ("reference", "sparse_feature", "block_hash")
REFUSED = {"sparse_feature": ("patch", "sam_dense", "lseg"), "block_hash": ("patch",)}
WIDE_MODE, WIDE = "lseg", 512


def fitted(layout: Column, mode: Column, dim: Column) -> tuple[Column, Column, Column]:
    """Layout, mode and length of features as they will be used. An unknown or null layout becomes the reference's; a null mode is global."""
    own = F.when(layout.isin(*LAYOUTS), layout).otherwise(F.lit(LAYOUTS[0]))
    given = F.coalesce(mode, F.lit("global"))
    refused = F.lit(False)
    for name, modes in REFUSED.items():
        refused = refused | ((own == name) & given.isin(*modes))
    used = F.when(refused, F.lit("global")).otherwise(given)
    return own, used, F.when((used == WIDE_MODE) & (own == "block_hash"), F.lit(WIDE)).otherwise(dim)


def check(dim: int, encoder_dim: int) -> None:
    """A volume's features have to be as long as the encoder's."""
    if dim != encoder_dim:
        raise ValueError(f"the volume holds features of {dim} numbers, the encoder gives {encoder_dim}")
