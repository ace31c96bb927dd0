"""Seeded draws that do not depend on partitioning: the same row always gets the same number."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed, *cols) -> Column:
    """Hex digest of the ids and the seed; its order is a seeded shuffle."""
    parts = [F.lit(str(seed))] + [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def draw_unit(key: Column, part: int = 0) -> Column:
    """Uniform number in [0, 1) from the `part`-th group of eight hex digits (0..3) of a digest."""
    digits = F.substring(key, 8 * part + 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def draw_normal(key: Column) -> Column:
    """Standard normal number (Box-Muller) from a digest."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - draw_unit(key, 0)))
    return radius * F.cos(F.lit(6.283185307179586) * draw_unit(key, 1))


def draw_index(key: Column, n, part: int = 0) -> Column:
    """Whole number in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(draw_unit(key, part) * n).cast("int")
