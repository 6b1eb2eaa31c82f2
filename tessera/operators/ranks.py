"""Ranks and quantiles within cells of any size, without a cell in one task.

Equal values of a cell are counted before anything is ordered, counts are dealt by ranges of (cell, value), and a range
learns from the sums of the ranges before it how many rows come first. What one task orders is a range of values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import kept


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """`left` with the other columns of `right`; null keys are equal. Without keys each side is one row."""
    if not keys:
        return left.join(right, F.lit(True), how)
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(named, on, how).drop(*(f"__{k}" for k in keys))


def value_counts(rows: DataFrame, keys: list[str], value: str, **also: Column) -> DataFrame:
    """(keys, v, n, before, total, and the sums `also`), a row for each different value of a cell, nulls left out: how many
    rows have it, have a smaller one, and there are. NaN is the greatest value. Keys have none of these names."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(name) for name, c in also.items()))
    ranged = kept(counts.repartitionByRange(*keys, "v").withColumn("place", F.spark_partition_id()), "value-counts")
    sums = ranged.groupBy(*keys, "place").agg(F.sum("n").alias("m"))
    cells = sums.groupBy(*keys).agg(F.sum("m").alias("total"), F.array_sort(F.collect_list(F.struct("place", "m"))).alias("parts"))  # an entry a range
    earlier = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("bigint"), lambda s, x: s + x["m"])
    places = cells.select(*keys, "total", F.explode(F.transform("parts", lambda x, i: F.struct(x["place"].alias("place"), earlier(i).alias("offset")))).alias("p")).select(*keys, "p.place", "p.offset", "total")
    within = Window.partitionBy(*keys, "place").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("run", F.sum("n").over(within) - F.col("n"))
    return joined(run, places, [*keys, "place"], "inner").select(*keys, "v", "n", (F.col("offset") + F.col("run")).alias("before"), "total", *also)


def average_rank() -> Column:
    """The rank from 1 of a row of value_counts(), ties at their mean."""
    return F.col("before") + (F.col("n") + 1) / 2


def quantiles(rows: DataFrame, keys: list[str], value: str, **at: float) -> DataFrame:
    """(keys, a column for each name in `at`): quantiles of a cell's values, between two neighbours by their distance.
    Nulls aren't values; a cell of nulls alone has no row."""
    counts = value_counts(rows, keys, value)
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    wanted = {name: p * (F.col("total") - 1) for name, p in at.items()}
    sides = [F.max(F.when(holds(side(place)), F.col("v"))).alias(f"{name}_{end}") for name, place in wanted.items() for end, side in (("low", F.floor), ("high", F.ceil))]
    found = counts.groupBy(*keys).agg(F.first("total").alias("total"), *sides)
    between = lambda name, place: F.col(f"{name}_low") + (place - F.floor(place)) * (F.col(f"{name}_high") - F.col(f"{name}_low"))
    value_of = lambda name, place: F.when(F.col(f"{name}_low") == F.col(f"{name}_high"), F.col(f"{name}_low")).otherwise(between(name, place))
    return found.select(*keys, *(value_of(name, place).alias(name) for name, place in wanted.items()))
