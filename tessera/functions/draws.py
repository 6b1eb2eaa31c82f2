"""Random numbers that depend on a seed and a key alone, not on partitions, and that other engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def draw(seed: int | str, *key: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 out of the MD5 of seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def unit(seed: int | str, *key: Column) -> Column:
    """A number between 0 and 1, neither included."""
    return (draw(seed, *key) + F.lit(0.5)) / F.lit(float(SPAN))


def weighted_key(weight: Column, seed: int | str, *key: Column) -> Column:
    """Ascending order by this is successive sampling without replacement in proportion to `weight`; null if that is 0."""
    return F.when(weight > 0, -F.ln(unit(seed, *key)) / weight)
