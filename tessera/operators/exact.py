"""Exact attributions and interactions from all coalitions of each game. `utilities`: game_id, n_items, mask, value.

Every index here is linear in the utilities: a coalition adds its value, times a weight of its size, to each item or
pair. So one explode and one aggregate with partial sums do it, and no self-join. A game whose coalitions aren't all
there, or not all finite, gets nulls: a missing utility never counts as a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import bits, kernels


def finite(value: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def whole(signed: Column, rows: Column) -> Column:
    """A sum, if it has as many finite terms as it should."""
    return F.when(F.count(signed) == rows, F.sum(signed))


def item_index(utilities: DataFrame, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """(game_id, item_idx, phi): sum over coalitions S without i of weight(n, |S|) (v(S + i) - v(S))."""
    rows = utilities.select("game_id", "n_items", "mask", "value", F.explode(bits.items(F.col("n_items"))).alias("item_idx"))
    inside = bits.has(F.col("mask"), F.col("item_idx"))
    s = bits.size(F.col("mask")) - inside.cast("int")
    signed = finite(F.col("value")) * F.when(inside, 1.0).otherwise(-1.0) * weight(F.col("n_items"), s)
    rows = rows.select("game_id", "n_items", "item_idx", signed.alias("signed"))
    return rows.groupBy("game_id", "n_items", "item_idx").agg(whole(F.col("signed"), bits.bit(F.col("n_items"))).alias("phi")).select("game_id", "item_idx", "phi")


def shapley(utilities: DataFrame) -> DataFrame:
    return item_index(utilities, kernels.shapley_weight)


def banzhaf(utilities: DataFrame) -> DataFrame:
    return item_index(utilities, lambda n, s: 1.0 / bits.bit(n - 1))


def pair_index(utilities: DataFrame, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """(game_id, i, j, value): weighted sum of second differences; games of one item have no row."""
    rows = utilities.select("game_id", "n_items", "mask", "value", F.explode(bits.pairs(F.col("n_items"))).alias("p"))
    one, other = bits.has(F.col("mask"), F.col("p.i")).cast("int"), bits.has(F.col("mask"), F.col("p.j")).cast("int")
    signed = finite(F.col("value")) * F.when(one == other, 1.0).otherwise(-1.0) * weight(F.col("n_items"), bits.size(F.col("mask")) - one - other)
    rows = rows.select("game_id", "n_items", "p.i", "p.j", signed.alias("signed"))
    return rows.groupBy("game_id", "n_items", "i", "j").agg(whole(F.col("signed"), bits.bit(F.col("n_items"))).alias("value")).select("game_id", "i", "j", "value")


def shapley_interactions(utilities: DataFrame) -> DataFrame:
    return pair_index(utilities, kernels.pair_weight)


def banzhaf_interactions(utilities: DataFrame) -> DataFrame:
    return pair_index(utilities, lambda n, s: F.when(n > 1, 1.0 / bits.bit(F.greatest(n - 2, F.lit(0)))))


def subset_sums(rows: DataFrame, column: str, alternate: bool = False, most_items: int = 20, step: int = 4) -> DataFrame:
    """(game_id, n_items, mask, `column`): for each mask the sum over its subsets; `alternate`: signed, the inverse.

    Goes over the items `step` at a time: each row adds itself to the masks that have more of these items. So there are
    n / step shuffles of some 2**n rows with partial sums, whatever the number of pairs of a mask and a subset. Masks
    that are absent count as 0. A game of more than `most_items` items fails when it is read: its sums would lack items.
    """
    fits = F.when(F.col("n_items") <= most_items, F.col("n_items")).otherwise(F.raise_error(F.lit(f"subset sums of more than {most_items} items")).cast("int"))
    rows = rows.withColumn("n_items", fits)
    for at in range(0, most_items, step):
        rows = _widened(rows, column, at, step, alternate)
    return rows


def _widened(rows: DataFrame, column: str, at: int, step: int, alternate: bool) -> DataFrame:
    added = F.filter(F.array(*(F.lit(k << at).cast("bigint") for k in range(1 << step))), lambda d: (d.bitwiseAND(F.col("mask")) == 0) & (d <= bits.full(F.col("n_items"))))
    rows = rows.select("game_id", "n_items", "mask", column, F.explode(added).alias("d"))
    sign = F.when(F.bit_count("d") % 2 == 1, -1.0).otherwise(1.0) if alternate else F.lit(1.0)
    rows = rows.select("game_id", "n_items", F.col("mask").bitwiseOR(F.col("d")).alias("mask"), (F.col(column) * sign).alias(column))
    return rows.groupBy("game_id", "n_items", "mask").agg(F.sum(column).alias(column))


def mobius(utilities: DataFrame, most_items: int = 20) -> DataFrame:
    """(game_id, n_items, subset, coef): how much a set has beyond its proper subsets."""
    found = subset_sums(utilities.select("game_id", "n_items", "mask", finite(F.col("value")).alias("coef")), "coef", True, most_items)
    return found.withColumnRenamed("mask", "subset")


def faithful(coefs: DataFrame, index: str = "FSII", order: int = 2) -> DataFrame:
    """(game_id, subset, coef) of all sets of up to `order` items: the best fit of that order to the game.

    FSII weighs coalitions by the Shapley kernel and is exact on the empty and the full one, FBII weighs them alike.
    `coefs` is what mobius() gives; a set hands its part to each of its subsets, so this is one aggregate. Order 1 or 2.
    """
    if index not in ("FSII", "FBII") or order not in (1, 2):
        raise ValueError("index FSII or FBII, order 1 or 2")
    s, subset = bits.size(F.col("subset")), F.col("subset")
    own = bits.members(subset, F.col("n_items"))
    below = [F.array(F.lit(0).cast("bigint")), F.transform(own, lambda i: bits.bit(i))]
    if order == 2:
        below.append(F.transform(F.filter(bits.pairs(F.col("n_items")), lambda p: bits.has(subset, p["i"]) & bits.has(subset, p["j"])), lambda p: bits.bit(p["i"]).bitwiseOR(bits.bit(p["j"]))))
    rows = coefs.select("game_id", "n_items", "subset", "coef", F.explode(F.when(s > order, F.concat(*below)).otherwise(F.array(subset))).alias("t"))
    t = bits.size(F.col("t"))
    sign = F.when((order - t) % 2 == 1, -1.0).otherwise(1.0)
    if index == "FSII":
        share = sign * t / (order + t) * kernels.choose(F.lit(order), t) * kernels.choose(s - 1, F.lit(order)) / kernels.choose(F.greatest(s, t + 1) + (order - 1), order + t)
    else:
        share = sign / bits.bit(F.greatest(s - t, F.lit(0))) * kernels.choose(s - t - 1, order - t)
    part = F.col("coef") * F.when(s > order, share).otherwise(F.lit(1.0))
    return rows.select("game_id", F.col("t").alias("subset"), part.alias("part")).groupBy("game_id", "subset").agg(F.sum("part").alias("coef"))


def coefficient_pairs(coefs: DataFrame, most_items: int = 62) -> DataFrame:
    """(game_id, i, j, value) of the coefficients of pairs."""
    two = coefs.where(bits.size(F.col("subset")) == 2).select("game_id", "coef", bits.members(F.col("subset"), F.lit(most_items)).alias("m"))
    return two.select("game_id", F.col("m")[0].alias("i"), F.col("m")[1].alias("j"), F.col("coef").alias("value"))


def leave_one_out(utilities: DataFrame) -> DataFrame:
    """(game_id, item_idx, phi): v(N) - v(N without i). Reads n + 1 coalitions of each game."""
    rest = bits.full(F.col("n_items")).bitwiseXOR(F.col("mask"))
    rows = utilities.where(F.bit_count(rest) <= 1).select("game_id", F.explode(F.when(rest == 0, bits.items(F.col("n_items"))).otherwise(bits.members(rest, F.col("n_items")))).alias("item_idx"), (finite(F.col("value")) * F.when(rest == 0, 1.0).otherwise(-1.0)).alias("signed"))
    return rows.groupBy("game_id", "item_idx").agg(whole(F.col("signed"), F.lit(2)).alias("phi"))


def worst_removal(utilities: DataFrame, k: int) -> DataFrame:
    """(game_id, removed, value): the k items without which the utility is least; ties by the greater mask left.

    Only finite values compete. Games of fewer than k items have no row.
    """
    rows = utilities.where((bits.size(F.col("mask")) == F.col("n_items") - k) & finite(F.col("value")).isNotNull())
    best = rows.groupBy("game_id", "n_items").agg(F.min(F.struct(F.col("value").alias("value"), (-F.col("mask")).alias("key"))).alias("b"))
    return best.select("game_id", bits.full(F.col("n_items")).bitwiseXOR(-F.col("b.key")).alias("removed"), F.col("b.value").alias("value"))


def jensen_shannon(dists: DataFrame, keys: list[str], p: str = "p", q: str = "q", smooth: float = 1e-10) -> DataFrame:
    """Divergence of two token distributions a group of `keys`; rows are tokens, with null for one that a side lacks.

    `smooth` is added to each probability and both sides are scaled to sum to 1 before.
    """
    a, b = (F.coalesce(F.col(c), F.lit(0.0)) + smooth for c in (p, q))
    rows = dists.select(*keys, a.alias("a"), b.alias("b"))
    total = rows.groupBy(*keys).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    rows = rows.join(total, keys).select(*keys, (F.col("a") / F.col("ta")).alias("a"), (F.col("b") / F.col("tb")).alias("b"))
    m = (F.col("a") + F.col("b")) / 2
    return rows.groupBy(*keys).agg((0.5 * F.sum(F.col("a") * F.ln(F.col("a") / m)) + 0.5 * F.sum(F.col("b") * F.ln(F.col("b") / m))).alias("jsd"))


def divergence_of_sets(dists: DataFrame) -> DataFrame:
    """(game_id, gone, jsd, gain): how far the distribution without a set of items is from the full one.

    `dists` has game_id, gone (mask of the items left out, 0 for none), token, p, the token's probability, and where an
    answer has several, its position; gone = 0 must be there. With a set of one item this is leave-one-out by divergence;
    `gain` is 1 - exp(-jsd), the loss in a utility of exp(-jsd). Each position is a distribution of its own, and the
    divergences of all positions add up.
    """
    dists = dists if "position" in dists.columns else dists.withColumn("position", F.lit(0))
    full = dists.where("gone = 0").select("game_id", "position", "token", F.col("p").alias("q"))
    sets = dists.where("gone <> 0").select("game_id", "gone").distinct()
    left = dists.where("gone <> 0").select("game_id", "gone", "position", "token", "p")
    both = sets.join(full, "game_id").join(left, ["game_id", "gone", "position", "token"], "full_outer").select("game_id", "gone", "position", "p", "q")
    found = jensen_shannon(both, ["game_id", "gone", "position"]).groupBy("game_id", "gone").agg(F.sum("jsd").alias("jsd"))
    return found.select("game_id", "gone", "jsd", (1 - F.exp(-F.col("jsd"))).alias("gain"))


def bundle(utilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shapley values and order-2 faithful interactions, the references that estimates are held against."""
    return shapley(utilities), coefficient_pairs(faithful(mobius(utilities)))
