"""Interactions of games with few of them, from far fewer coalitions than there are: aliased Walsh-Hadamard coefficients,
trees as proxies, and estimates from coalitions drawn by size.

A game is v(S) = sum of F(k) * (-1)**|k and S| over sets k, or sum of m(T) over the subsets T of S. Patterns are rows
(game_id, subset, coef) as everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits, kernels
from tessera.functions.draws import draw, unit
from tessera.operators.coalitions import powerset, sampleable
from tessera.operators.exact import finite
from tessera.operators.surrogates import COEFS, ready, spread

#: Groups of aliased coalitions, bits of a group's bins, and delays that test what a bin has been decoded to.
GROUPS, BIN_BITS, CHECKS = 3, 5, 3
#: Items of a pattern whose subsets are listed.
MOST_PATTERN = 16


# Sparse transform


def columns(group: Column, width: int, seed: int) -> Column:
    """The matrix of a group: a number of `width` bits for each item of a game."""
    return F.transform(bits.items(F.col("n_items")), lambda i: draw(f"{seed}:bins", F.col("game_id"), group, i).bitwiseAND(F.lit((1 << width) - 1)))


def aliased(games: DataFrame, groups: int = GROUPS, width: int = BIN_BITS, checks: int = CHECKS, seed: int = 42) -> DataFrame:
    """(game_id, n_items, group, delay, row, mask): the coalitions that the sparse transform asks for.

    A group's coalitions are the combinations of the rows of a random matrix of bits: 2**width of them. Each comes once
    as it is (delay 0), once with each item turned over (delays 1 to n), and with some random sets turned over, as checks.
    """
    rows = sampleable(games).select("game_id", "n_items", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    rows = rows.withColumn("columns", columns(F.col("group"), width, seed))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << width) - 1).cast("bigint"))).alias("row"))
    base = F.aggregate(bits.items(F.col("n_items")), F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(F.when(F.bit_count(F.col("columns")[i].bitwiseAND(F.col("row"))) % 2 == 1, bits.bit(i)).otherwise(F.lit(0).cast("bigint"))))
    rows = rows.select("game_id", "n_items", "group", "row", base.alias("base"), F.explode(F.sequence(F.lit(0), F.col("n_items") + checks)).alias("delay"))
    return rows.select("game_id", "n_items", "group", "delay", "row", F.col("base").bitwiseXOR(turned(seed)).alias("mask"))


def turned(seed: int) -> Column:
    """The items that a delay turns over."""
    n, d = F.col("n_items"), F.col("delay")
    low, high = (draw(f"{seed}:{part}", F.col("game_id"), F.col("group"), d).bitwiseAND(F.lit((1 << 30) - 1)) for part in ("low", "high"))
    check = low.bitwiseOR(F.call_function("shiftleft", high, F.lit(30))).bitwiseAND(bits.full(n))
    return F.when(d == 0, F.lit(0).cast("bigint")).when(d <= n, bits.bit(F.greatest(d - 1, F.lit(0)))).otherwise(check)


def binned(asked: DataFrame, width: int = BIN_BITS) -> DataFrame:
    """(game_id, n_items, group, delay, bin, value): transforms of the coalitions of each group and delay. A bin has the
    coefficients of all sets that the group's matrix sends to it, signed by what the delay turns over.

    One explode and one aggregate with partial sums: 2**width rows for each coalition asked for.
    """
    rows = asked.select("game_id", "n_items", "group", "delay", "row", finite(F.col("value")).alias("value"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << width) - 1).cast("bigint"))).alias("bin"))
    signed = F.when(F.bit_count(F.col("row").bitwiseAND(F.col("bin"))) % 2 == 1, -F.col("value")).otherwise(F.col("value"))
    mean = F.when(F.count("value") == 1 << width, F.sum("signed") / (1 << width))
    return rows.withColumn("signed", signed).groupBy("game_id", "n_items", "group", "delay", "bin").agg(mean.alias("value"))


def peel(bins: np.ndarray, turned: np.ndarray, matrix: np.ndarray, tolerance: float) -> tuple[dict[int, float], bool]:
    """Decodes bins (group, bin, delay) that hold one coefficient, takes it out of all groups, and goes on until none is
    left or none can be decoded: {set: coefficient}, and whether all is explained.

    `turned`: (group, delay) sets; `matrix`: (group, item) numbers. A bin holds one coefficient if it has one size at all
    delays, if the set that its signs spell belongs to the bin, and if the checks' signs are that set's.
    """
    n, found = matrix.shape[1], {}
    item = np.left_shift(np.int64(1), np.arange(n, dtype=np.int64))
    odd = lambda x: np.bitwise_count(x) & 1
    scale = max(1.0, float(np.abs(bins).max(initial=0.0)))
    for _ in range(64 * bins.shape[1]):
        took = 0
        for g, b in np.argwhere(np.abs(bins[:, :, 0]) > tolerance * scale):
            u = bins[g, b]
            if np.abs(np.abs(u) - abs(u[0])).max() > tolerance * scale or abs(u[0]) <= tolerance * scale:
                continue
            minus = (u < 0) ^ (u[0] < 0)
            k = np.int64(item[minus[1 : n + 1]].sum())
            if np.bitwise_xor.reduce(matrix[g][minus[1 : n + 1]], initial=0) != b or (odd(turned[g] & k) != minus).any():
                continue
            coef = float(np.where(minus, -u, u).mean())
            found[int(k)] = found.get(int(k), 0.0) + coef
            for h in range(len(bins)):
                at = np.bitwise_xor.reduce(matrix[h][minus[1 : n + 1]], initial=0)
                bins[h, at] -= coef * np.where(odd(turned[h] & k), -1.0, 1.0)
            took += 1
        if not took:
            break
    return found, bool(np.abs(bins).max(initial=0.0) <= tolerance * scale * 10)


def sparse_transform(games: DataFrame, provider: Callable[[DataFrame], DataFrame], groups: int = GROUPS, width: int = BIN_BITS, checks: int = CHECKS, seed: int = 42, tolerance: float = 1e-6) -> DataFrame:
    """(game_id, subset, coef, complete): Walsh-Hadamard coefficients of games that have few, up to 60 items.

    `provider` gets (game_id, n_items, mask), each once, and adds `value`; it is asked for groups * 2**width *
    (n + 1 + checks) coalitions at most, however many the game has. `complete` says whether the coefficients explain all
    that was asked for; if not, take more groups or wider bins. A game with a missing or infinite value has no rows. The
    numbers of one game that are decoded together are as many as coalitions were asked for: a budget, not the data.
    """
    asked = aliased(games, groups, width, checks, seed)
    values = provider(asked.select("game_id", "n_items", "mask").distinct()).select("game_id", "mask", "value")
    found = binned(asked.join(values, ["game_id", "mask"], "left"), width)
    whole = found.groupBy("game_id", "n_items", "group").agg(F.sort_array(F.collect_list(F.struct("bin", "delay", "value"))).alias("bins"))
    whole = whole.withColumn("matrix", columns(F.col("group"), width, seed))
    sets = F.transform(F.sequence(F.lit(0), F.col("n_items") + checks), lambda d: F.struct(d.alias("delay")))
    delays = whole.select("game_id", "n_items", "group", F.explode(sets).alias("d")).select("game_id", "n_items", "group", F.col("d.delay").alias("delay"))
    delays = delays.select("game_id", "group", "delay", turned(seed).alias("turned")).groupBy("game_id", "group").agg(F.sort_array(F.collect_list(F.struct("delay", "turned"))).alias("turned"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("group")
        n = int(frame["n_items"].iloc[0])
        values = np.array([[np.nan if x["value"] is None else x["value"] for x in own] for own in frame["bins"]], float).reshape(groups, 1 << width, n + 1 + checks)
        if not np.isfinite(values).all():
            return pd.DataFrame({"game_id": [], "subset": [], "coef": [], "complete": []})
        sets = np.array([[x["turned"] for x in own] for own in frame["turned"]], np.int64)
        coefs, complete = peel(values, sets, np.array(frame["matrix"].tolist(), np.int64), tolerance)
        return pd.DataFrame({"game_id": int(frame["game_id"].iloc[0]), "subset": list(coefs), "coef": list(coefs.values()), "complete": complete})

    return whole.join(delays, ["game_id", "group"]).groupBy("game_id").applyInPandas(run, f"{COEFS}, complete boolean")


def listed_subsets(mask: Column, most: int = MOST_PATTERN) -> Column:
    """All subsets of a mask of `most` items at most; larger ones are an error."""
    fits = F.when(bits.size(mask) <= most, mask).otherwise(F.raise_error(F.lit(f"a pattern of more than {most} items")).cast("bigint"))
    return F.aggregate(bits.members(fits, F.lit(62)), F.array(F.lit(0).cast("bigint")), lambda sets, i: F.concat(sets, F.transform(sets, lambda s: s.bitwiseOR(bits.bit(i)))))


def to_mobius(coefs: DataFrame) -> DataFrame:
    """(game_id, subset, coef) of the Moebius transform from Walsh-Hadamard coefficients: a set k hands F(k) * (-2)**|T| to
    each of its subsets T."""
    rows = coefs.select("game_id", "coef", F.explode(listed_subsets(F.col("subset"))).alias("subset"))
    return rows.select("game_id", "subset", (F.col("coef") * F.pow(F.lit(-2.0), bits.size(F.col("subset")))).alias("part")).groupBy("game_id", "subset").agg(F.sum("part").alias("coef"))


# Trees as proxies


def grown(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> list[tuple[int, int, float]]:
    """A regression tree on items that are in or out, as leaves (items in, items out, mean): splits by the greatest fall in
    squares, read off sums by item and side, ties to the first item."""
    leaves, open_ = [], [(np.ones(len(y), bool), 0, 0, 0)]
    while open_:
        rows, inside, outside, level = open_.pop()
        m, total = int(rows.sum()), float(y[rows].sum())
        n1, s1 = x[rows].sum(0), x[rows].T @ y[rows]
        n0, s0 = m - n1, total - s1
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n1 >= least) & (n0 >= least), s1 * s1 / n1 + s0 * s0 / n0 - total * total / m, -np.inf)
        best = int(np.argmax(np.round(gain, 9))) if len(gain) else 0
        if level == depth or not len(gain) or not gain[best] > 1e-12 * max(1.0, total * total / m):
            leaves.append((inside, outside, total / m))
            continue
        side = x[:, best] > 0
        open_ += [(rows & side, inside | 1 << best, outside, level + 1), (rows & ~side, inside, outside | 1 << best, level + 1)]
    return leaves


def boosted_leaves(train: DataFrame, trees: int = 100, depth: int = 3, rate: float = 0.1, least: int = 1) -> DataFrame:
    """(game_id, tree, inside, outside, value): leaves of boosted trees, each with the items that must be in and those that
    must be out; their values add up to the prediction. Tree 0 is the mean. One group is the training coalitions of a
    game, as in all fits here: a budget. Games without finite values have no rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = ready(frame)
        if frame.empty:
            return pd.DataFrame({"game_id": [], "tree": [], "inside": [], "outside": [], "value": []})
        n, masks, y = int(frame["n_items"].iloc[0]), frame["mask"].to_numpy("int64"), frame["value"].to_numpy(float)
        x = ((masks[:, None] >> np.arange(n)) & 1).astype(float)
        rows, left = [(0, 0, 0, float(y.mean()))], y - y.mean()
        for t in range(1, trees + 1):
            for inside, outside, value in grown(x, left, depth, least):
                rows.append((t, inside, outside, rate * value))
                left = left - np.where((masks & inside == inside) & (masks & outside == 0), rate * value, 0.0)
        return pd.DataFrame(rows, columns=["tree", "inside", "outside", "value"]).assign(game_id=int(frame["game_id"].iloc[0]))

    return spread(train).groupBy("game_id").applyInPandas(run, "game_id bigint, tree int, inside bigint, outside bigint, value double")


def tree_coefficients(leaves: DataFrame) -> DataFrame:
    """(game_id, subset, coef): exact Moebius coefficients of what trees predict. A leaf is a product of x for the items in
    and 1 - x for those out, so it hands its value, signed, to its items in with each subset of those out."""
    rows = leaves.select("game_id", "inside", "value", F.explode(listed_subsets(F.col("outside"))).alias("t"))
    sign = F.when(bits.size(F.col("t")) % 2 == 1, -1.0).otherwise(1.0)
    return rows.select("game_id", F.col("inside").bitwiseOR(F.col("t")).alias("subset"), (F.col("value") * sign).alias("part")).groupBy("game_id", "subset").agg(F.sum("part").alias("coef"))


def strongest(coefs: DataFrame, k: int) -> DataFrame:
    """The k coefficients of each game that are largest by size, ties to the lesser set: what a proxy says is worth asking."""
    by = Window.partitionBy("game_id").orderBy(F.abs("coef").desc(), "subset")
    return coefs.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k).drop("at")


# Interactions from coalitions drawn by size


def by_size(games: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """(game_id, n_items, mask, stratum, drawn): coalitions by size for interactions(): sizes are taken whole from both ends
    inwards as long as the budget allows, and what is left of it is dealt evenly to the sizes between, drawn without
    replacement. `stratum` and `drawn`: how many coalitions there are of that size, and how many of them are here.
    """
    rows = powerset(games).withColumn("size", bits.size(F.col("mask")))
    n, z = F.col("n_items"), F.col("size")
    level = F.least(z, n - z)
    # coalitions of sizes up to k from both ends, for each k
    ends = lambda k: F.aggregate(bits.items(k + 1), F.lit(0.0), lambda s, j: s + kernels.choose(n, j) * F.when(2 * j == n, 1.0).otherwise(2.0))
    whole = F.size(F.filter(bits.items(F.floor(n / 2).cast("int") + 1), lambda k: ends(k) <= budget))  # levels 0 to whole - 1
    rows = rows.withColumn("whole", whole).withColumn("stratum", kernels.choose(n, z))
    between = F.greatest(n + 1 - 2 * F.col("whole"), F.lit(1))
    rest = F.floor((budget - F.when(F.col("whole") > 0, ends(F.col("whole") - 1)).otherwise(0.0)) / between)
    rows = rows.withColumn("drawn", F.when(level < F.col("whole"), F.col("stratum")).otherwise(F.least(F.col("stratum"), F.greatest(rest, F.lit(2)))).cast("bigint"))
    order = Window.partitionBy("game_id", "size").orderBy(unit(f"{seed}:stratum", F.col("game_id"), F.col("mask")), "mask")
    rows = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("drawn"))
    return rows.select("game_id", "n_items", "mask", F.col("stratum").cast("bigint").alias("stratum"), "drawn")


def interactions(utilities: DataFrame, order: int = 2) -> DataFrame:
    """(game_id, subset, value, variance): Shapley interactions of all sets of 1 to `order` items, without bias.

    `utilities` is by_size() with values. An interaction is a sum over all coalitions, whose weight depends on their size
    and on how many of the set are in; each size is a stratum, whose mean is estimated from what was drawn of it. With
    sizes drawn whole nothing is left to chance: the variance is 0 and the values are the exact ones; a stratum with one
    coalition drawn of several has no variance. Games with a null or non-finite value get nulls.
    """
    n = F.col("n_items")
    sets = F.flatten(F.transform(bits.items(F.lit(order)), lambda k: ordered_sets(n, k + 1)))
    rows = utilities.select("game_id", "n_items", "mask", finite(F.col("value")).alias("value"), "stratum", "drawn", F.explode(sets).alias("subset"))
    k, inside = bits.size(F.col("subset")), bits.size(F.col("subset").bitwiseAND(F.col("mask")))
    s = bits.size(F.col("mask")) - inside
    weight = 1.0 / ((n - k + 1) * kernels.choose(n - k, s))
    term = F.col("value") * F.when((k - inside) % 2 == 1, -1.0).otherwise(1.0) * weight
    own = rows.select("game_id", "subset", bits.size(F.col("mask")).alias("size"), "stratum", "drawn", term.alias("term"))
    per = own.groupBy("game_id", "subset", "size", "stratum", "drawn").agg(F.count("term").alias("n"), F.avg("term").alias("mean"), F.var_samp("term").alias("var"))
    total = F.when(F.col("n") == F.col("drawn"), F.col("stratum") * F.col("mean"))
    noise = F.when(F.col("drawn") == F.col("stratum"), 0.0).otherwise(F.col("stratum") * (F.col("stratum") - F.col("drawn")) * F.col("var") / F.col("drawn"))
    return per.groupBy("game_id", "subset").agg(F.when(F.count(total) == F.count(F.lit(1)), F.sum(total)).alias("value"), F.when(F.count(noise) == F.count(F.lit(1)), F.sum(noise)).alias("variance"))


def ordered_sets(n: Column, k: Column) -> Column:
    """Masks of all sets of k items of n, smaller sets first extended by greater items."""
    grow = lambda sets, _: F.flatten(F.transform(sets, lambda s: F.transform(F.filter(bits.items(n), lambda i: bits.bit(i) > s), lambda i: s.bitwiseOR(bits.bit(i)))))
    return F.aggregate(bits.items(k), F.array(F.lit(0).cast("bigint")), grow)


# Predictions of patterns of any order


def predict_patterns(coefs: DataFrame, coalitions: DataFrame) -> DataFrame:
    """(game_id, n_items, mask, predicted): for each coalition the sum of the coefficients of patterns that it contains.

    Containment as an equi-join: a pattern waits at its member that the fewest coalitions have, a coalition comes by all
    of its items, and what meets is tested. The empty pattern is added to all. Coalitions without a pattern get 0.
    """
    own = coalitions.select("game_id", "n_items", "mask").distinct()
    at = own.select("game_id", "mask", F.explode(bits.members(F.col("mask"), F.col("n_items"))).alias("item"))
    common = at.groupBy("game_id", "item").agg(F.count(F.lit(1)).alias("n"))
    by_item = coefs.where("subset <> 0").select("game_id", "subset", "coef", F.explode(bits.members(F.col("subset"), F.lit(62))).alias("item"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item"))
    waiting = by_item.join(common, ["game_id", "item"], "left").groupBy("game_id", "subset", "coef").agg(rare.alias("rare")).select("game_id", F.col("rare.item").alias("item"), "subset", "coef")
    met = at.join(waiting, ["game_id", "item"]).where(F.col("mask").bitwiseAND(F.col("subset")) == F.col("subset"))
    parts = met.groupBy("game_id", "mask").agg(F.sum("coef").alias("part"))
    none = coefs.where("subset = 0").groupBy("game_id").agg(F.sum("coef").alias("always"))
    out = own.join(parts, ["game_id", "mask"], "left").join(none, "game_id", "left")
    return out.select("game_id", "n_items", "mask", (F.coalesce("part", F.lit(0.0)) + F.coalesce("always", F.lit(0.0))).alias("predicted"))
