"""Coalitions as bit masks: bit i of a bigint says whether item i takes part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(item: Column) -> Column:
    """The mask of one item."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), item.cast("int"))


def full(n: Column) -> Column:
    """The mask of items 0 to n - 1."""
    return bit(n) - F.lit(1).cast("bigint")


def has(mask: Column, item: Column) -> Column:
    return mask.bitwiseAND(bit(item)) != 0


def size(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def without(mask: Column, gone: Column) -> Column:
    return mask.bitwiseAND(F.bitwise_not(gone))


def items(n: Column) -> Column:
    """Array 0, 1 ... n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def members(mask: Column, n: Column) -> Column:
    """Array of the items in a mask, ascending."""
    return F.filter(items(n), lambda i: has(mask, i))


def pairs(n: Column) -> Column:
    """Array of structs (i, j), i < j < n; empty for n < 2."""
    each = F.transform(items(n), lambda i: F.transform(F.filter(items(n), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.flatten(each)


def lexicographic(mask: Column, n: Column) -> Column:
    """Number that orders masks of equal size as their ascending item lists are ordered, the first one greatest."""
    return F.aggregate(items(n), F.lit(0).cast("bigint"), lambda acc, i: acc * 2 + has(mask, i).cast("bigint"))
