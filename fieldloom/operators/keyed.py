"""Random numbers that depend on what they are for alone, not on order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_draw(seed: int, node: str, ident: Column, salt: str = "") -> Column:
    """Uniform in [0, 1) from seed, node and a cell or label: 52 bits of a SHA-256."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(str(len(node))), F.lit(node + salt), ident.cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def noise(seed: int, node: str, ident: Column, scale: float = 1.0) -> Column:
    return (2 * unit_draw(seed, node, ident) - 1) * F.lit(float(scale))


def region_scalar(seed: int, node: str, label: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """One draw per label in ``offset`` plus or minus ``scale``; label 0 is exactly ``offset``."""
    return F.when(label == 0, F.lit(float(offset))).otherwise(F.lit(float(offset)) + F.lit(float(scale)) * (2 * unit_draw(seed, node, label) - 1))


def rank_hash(seed: int, node: str, ident: Column) -> Column:
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(str(len(node))), F.lit(node), ident.cast("string"))
    return F.sha2(key, 256)
