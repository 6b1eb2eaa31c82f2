"""Which coalitions of each game to evaluate. `games` has columns game_id and n_items; results have game_id, mask, ord.

Draws depend on the seed, the game and the mask alone. A weighted draw without replacement is an order by
-ln(u) / weight, so a sampler is a top-k by game and no draw is rejected or repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits, kernels
from tessera.functions.draws import draw, unit, weighted_key

#: Items up to which all coalitions of a game are listed, and up to which it can be sampled at all.
MOST_ITEMS, MOST_SAMPLED = 20, 60
#: Draws for each coalition wanted of a game too large to be listed; repeated ones count once.
DRAWS = 8


def powerset(games: DataFrame) -> DataFrame:
    """Every coalition: 2**n rows a game; a game with more than MOST_ITEMS items fails when it is read."""
    fits = F.when(F.col("n_items") <= MOST_ITEMS, bits.full(F.col("n_items"))).otherwise(F.raise_error(F.lit(f"all coalitions of more than {MOST_ITEMS} items")).cast("bigint"))
    return games.select("game_id", "n_items", F.explode(F.sequence(F.lit(0).cast("bigint"), fits)).alias("mask"))


def first(rows: DataFrame, budget: int, *order: Column) -> DataFrame:
    """The first `budget` coalitions of each game in this order."""
    by = Window.partitionBy("game_id").orderBy(*order, "mask")
    return rows.withColumn("ord", F.row_number().over(by)).where(F.col("ord") <= budget).select("game_id", "n_items", "mask", "ord")


def ends_rank() -> Column:
    """0 for the empty coalition, 1 for the full one, 2 for the rest."""
    return F.when(F.col("mask") == 0, 0).when(F.col("mask") == bits.full(F.col("n_items")), 1).otherwise(2)


def neighbour_rank() -> Column:
    """Singletons and leave-one-outs, interleaved: 2i for {i}, 2i + 1 for all but i; null for others."""
    z, alone = bits.size(F.col("mask")), lambda m: F.expr(f"cast(round(log2({m})) as int)")
    single = F.when(z == 1, 2 * alone("mask"))
    return F.coalesce(single, F.when(z == F.col("n_items") - 1, 2 * alone("(shiftleft(1L, n_items) - 1 - mask)") + 1))


def fill_weight(fill: str) -> Column:
    """Weight of a coalition under a law: sizes by the kernel or evenly, then evenly within a size; or evenly over all."""
    z = bits.size(F.col("mask"))
    inner = (z > 0) & (z < F.col("n_items"))
    count = kernels.choose(F.col("n_items"), F.when(inner, z).otherwise(F.lit(0)))
    if fill == "uniform":
        return F.lit(1.0)
    if fill == "kernelshap":
        return kernels.size_law(F.col("n_items"), z) / count
    if fill == "size_uniform":
        return F.when(inner, 1.0 / count).otherwise(F.lit(0.0))
    if fill == "pool":
        return kernels.size_law(F.col("n_items"), z)
    raise ValueError(f"unknown fill {fill!r}")


def is_wide() -> Column:
    return F.col("n_items") > MOST_ITEMS


def breadth_rank() -> tuple[Column, Column, Column]:
    """Order of the coalitions from the empty and the full one outwards, by turns."""
    z = bits.size(F.col("mask"))
    side = F.when(ends_rank() < 2, ends_rank()).otherwise((z > F.col("n_items") - z).cast("int"))
    lists = F.when(z <= F.col("n_items") - z, -bits.lexicographic(F.col("mask"), F.col("n_items"))).otherwise(bits.lexicographic(F.col("mask"), F.col("n_items")))
    return F.least(z, F.col("n_items") - z), side, lists


def outwards(games: DataFrame, budget: int) -> DataFrame:
    """Coalitions of up to k items and their complements, with k no greater than the budget needs."""
    level = games.select("game_id", "n_items", F.lit(0).cast("bigint").alias("mask"), F.lit(2.0).alias("had"), F.lit(0).alias("k"))
    found = level
    for k in range(1, MOST_SAMPLED // 2 + 1):
        level = level.where((F.col("had") < budget) & (2 * k <= F.col("n_items")))
        later = F.filter(bits.items(F.col("n_items")), lambda i: bits.bit(i) > F.col("mask"))
        level = level.select("game_id", "n_items", "mask", "had", F.explode(later).alias("i")).select("game_id", "n_items", F.col("mask").bitwiseOR(bits.bit(F.col("i"))).alias("mask"), (F.col("had") + 2 * kernels.wide_choose(F.col("n_items"), k)).alias("had"), F.lit(k).alias("k"))
        found = found.unionByName(level)
        if 2 * math.comb(MOST_ITEMS + 1, k) > budget:  # the smallest game here has enough by now
            break
    both = F.explode(F.array(F.col("mask"), bits.full(F.col("n_items")).bitwiseXOR(F.col("mask"))))
    return found.select("game_id", "n_items", both.alias("mask")).distinct()


def drawn(games: DataFrame, count: int, fill: str, seed: int) -> DataFrame:
    """(game_id, n_items, mask, draw) of `count` draws a game, the first of each mask: by the law that `fill` names."""
    rows = games.select("game_id", "n_items", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("draw"))
    key = (F.col("game_id"), F.col("draw"))
    n = F.col("n_items")
    if fill == "uniform":
        half = F.lit((1 << 30) - 1).cast("bigint")
        low, high = (draw(f"{seed}:{part}", *key).bitwiseAND(half) for part in ("low", "high"))
        mask = low.bitwiseOR(F.call_function("shiftleft", high, F.lit(30))).bitwiseAND(bits.full(n))
    else:
        sizes = F.filter(bits.items(n), lambda z: z > 0)
        law = (lambda z: (n - 1).cast("double") / (z * (n - z))) if fill == "kernelshap" else (lambda z: F.lit(1.0))
        rows = rows.withColumn("at", unit(f"{seed}:size", *key) * F.aggregate(sizes, F.lit(0.0), lambda s, z: s + law(z)))
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("z"))
        step = lambda s, z: F.struct((s["seen"] + law(z)).alias("seen"), (s["z"] + (s["seen"] < F.col("at")).cast("int")).alias("z"))
        rows = rows.withColumn("z", F.aggregate(sizes, start, step, lambda s: s["z"]))
        ranked = F.array_sort(F.transform(bits.items(n), lambda i: F.struct(draw(f"{seed}:member", *key, i).alias("h"), i.alias("i"))))
        mask = F.aggregate(F.slice(ranked, F.lit(1), F.col("z")), F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(bits.bit(x["i"])))
    return rows.select("game_id", "n_items", mask.alias("mask"), "draw").groupBy("game_id", "n_items", "mask").agg(F.min("draw").alias("draw"))


def wide_sample(games: DataFrame, budget: int, core: bool, neighbours: bool, fill: str, seed: int) -> DataFrame:
    """structured_sample() of games too large to be listed: core and neighbours by name, the fill from DRAWS draws for
    each coalition of the budget, of which those that repeat one count once; so there may be fewer than `budget`."""
    fixed = []
    if core:
        fixed += [(F.lit(0), F.array(F.lit(0).cast("bigint"))), (F.lit(1), F.array(bits.full(F.col("n_items"))))]
    rows = None
    for rank, masks in fixed:
        one = games.select("game_id", "n_items", F.explode(masks).alias("mask")).withColumn("rank", rank).withColumn("key", F.lit(None).cast("double"))
        rows = one if rows is None else rows.unionByName(one)
    if neighbours:
        alone = games.select("game_id", "n_items", F.explode(bits.items(F.col("n_items"))).alias("i"))
        for side, mask in ((0, bits.bit(F.col("i"))), (1, bits.full(F.col("n_items")).bitwiseXOR(bits.bit(F.col("i"))))):
            one = alone.select("game_id", "n_items", mask.alias("mask"), (2 * F.col("i") + 2 + side).alias("rank"), F.lit(None).cast("double").alias("key"))
            rows = one if rows is None else rows.unionByName(one)
    if fill != "none":
        one = drawn(games, DRAWS * budget, fill, seed).select("game_id", "n_items", "mask", F.lit(None).cast("int").alias("rank"), F.col("draw").cast("double").alias("key"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("game_id", "n_items", "mask").agg(F.min("rank").alias("rank"), F.min("key").alias("key"))
    return first(best, budget, F.col("rank").asc_nulls_last(), F.col("key"))


def sampleable(games: DataFrame) -> DataFrame:
    """Games with more than MOST_SAMPLED items fail when they are read."""
    fits = F.when(F.col("n_items") <= MOST_SAMPLED, F.col("n_items")).otherwise(F.raise_error(F.lit(f"coalitions of more than {MOST_SAMPLED} items")).cast("int"))
    return games.select("game_id", fits.cast("int").alias("n_items"))


def sample(games: DataFrame, budget: int, method: str = "uniform", seed: int = 42) -> DataFrame:
    """`budget` distinct coalitions a game, or all if there are fewer; the empty and the full one come first.

    Methods: uniform, kernelshap (by size, then evenly), bf (nearest to the empty and the full coalition, by turns),
    bf_uniform and bf_kernelshap (all at distance one, then one of the other two laws). Budgets hold throughout. Games
    of more than MOST_ITEMS items are not listed but drawn from, see wide_sample().
    """
    if method == "bf":
        listed = powerset(games.where(~is_wide())).unionByName(outwards(sampleable(games.where(is_wide())), budget))
        return first(listed, budget, *breadth_rank())
    if method not in ("uniform", "kernelshap", "bf_uniform", "bf_kernelshap"):
        raise ValueError(f"unknown method {method!r}")
    return structured_sample(games, budget, core=True, neighbours=method.startswith("bf_"), fill=method.removeprefix("bf_"), seed=seed)


def structured_sample(games: DataFrame, budget: int, core: bool = True, neighbours: bool = True, fill: str = "kernelshap", seed: int = 42) -> DataFrame:
    """Coalitions in the order core, neighbours, fill, each of which can be left out; fill "none" adds nothing.

    What is left out as a part of its own can still be drawn by the fill. Fills: kernelshap, uniform, size_uniform, none.
    """
    if fill not in ("kernelshap", "uniform", "size_uniform", "none"):
        raise ValueError(f"unknown fill {fill!r}")
    rank = F.lit(None).cast("int")
    if neighbours:
        rank = neighbour_rank() + 2
    if core:
        rank = F.when(ends_rank() < 2, ends_rank()).otherwise(rank)
    rows = powerset(games.where(~is_wide())).withColumn("rank", rank.cast("int"))
    key = F.lit(None).cast("double") if fill == "none" else weighted_key(fill_weight(fill), seed, F.col("game_id"), F.col("mask"))
    rows = rows.withColumn("key", F.when(F.col("rank").isNull(), key)).where(F.col("rank").isNotNull() | F.col("key").isNotNull())
    listed = first(rows, budget, F.col("rank").asc_nulls_last(), F.col("key"))
    if not core and not neighbours and fill == "none":
        return listed
    return listed.unionByName(wide_sample(sampleable(games.where(is_wide())), budget, core, neighbours, fill, seed))


def least_budget(n: int) -> int:
    """Evaluations that the core and the neighbours take."""
    return 2 * n + 2


def pool_sample(pool: DataFrame, budget: int, weighted: bool = False, seed: int = 42) -> DataFrame:
    """`budget` of the coalitions in `pool` (game_id, n_items, mask), evenly or by the kernel's weight of each one."""
    key = weighted_key(fill_weight("pool" if weighted else "uniform"), seed, F.col("game_id"), F.col("mask"))
    return first(pool.withColumn("key", key).where(F.col("key").isNotNull()), budget, F.col("key"))


def paired_coalitions(games: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """`count` pairs a game of a coalition with an item and the same without it: draw, item_idx, mask_with, mask_without.

    The item is drawn evenly, the size of the smaller coalition by the kernel's law, its members evenly. Games of one
    item have the pair ({0}, {}) alone.
    """
    drawn = games.select("game_id", "n_items", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("draw"))
    drawn = drawn.withColumn("item_idx", (draw(f"{seed}:item", F.col("game_id"), F.col("draw")) % F.col("n_items")).cast("int"))
    sizes = F.filter(bits.items(F.col("n_items")), lambda z: z > 0)
    law = lambda z: (F.col("n_items") - 1).cast("double") / (z * (F.col("n_items") - z))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, z: s + law(z))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("z"))
    at = F.col("u") * F.col("total")
    step = lambda s, z: F.struct((s["seen"] + law(z)).alias("seen"), (s["z"] + (s["seen"] < at).cast("int")).alias("z"))
    drawn = drawn.withColumn("u", unit(f"{seed}:size", F.col("game_id"), F.col("draw"))).withColumn("total", total)
    drawn = drawn.withColumn("z", F.aggregate(sizes, start, step, lambda s: s["z"]))
    others = F.filter(bits.items(F.col("n_items")), lambda i: i != F.col("item_idx"))
    ranked = F.array_sort(F.transform(others, lambda i: F.struct(draw(f"{seed}:member", F.col("game_id"), F.col("draw"), i).alias("h"), i.alias("i"))))
    mask = F.aggregate(F.slice(ranked, F.lit(1), F.col("z")), F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(bits.bit(x["i"])))
    drawn = drawn.withColumn("mask_without", F.when(F.col("n_items") > 1, mask).otherwise(F.lit(0).cast("bigint")))
    return drawn.select("game_id", "draw", "item_idx", F.col("mask_without").bitwiseOR(bits.bit(F.col("item_idx"))).alias("mask_with"), "mask_without")


def flip_expand(coalitions: DataFrame, seed: int = 42) -> DataFrame:
    """Every coalition and its copy with one item, drawn evenly, put in or out; each mask once a game."""
    item = (draw(f"{seed}:flip", F.col("game_id"), F.col("mask")) % F.col("n_items")).cast("int")
    both = F.array(F.col("mask"), F.col("mask").bitwiseXOR(bits.bit(item)))
    return coalitions.select("game_id", "n_items", F.explode(both).alias("mask")).distinct()


def orders(games: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(game_id, n_items, iteration, order): `count` orders of the items a game, each an array."""
    drawn = games.select("game_id", "n_items", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("iteration"))
    ranked = F.array_sort(F.transform(bits.items(F.col("n_items")), lambda i: F.struct(draw(f"{seed}:order", F.col("game_id"), F.col("iteration"), i).alias("h"), i.alias("i"))))
    return drawn.select("game_id", "n_items", "iteration", F.transform(ranked, lambda x: x["i"]).alias("order"))


def permutations(games: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """`count` orders of the items a game, and the coalition before each item: iteration, position, item_idx, mask_before."""
    rows = orders(games, count, seed).select("*", F.posexplode("order").alias("position", "item_idx"))
    before = F.aggregate(F.slice(F.col("order"), F.lit(1), F.col("position")), F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(bits.bit(i)))
    return rows.select("game_id", "n_items", "iteration", "position", "item_idx", before.alias("mask_before"))


def hamming1_pairs(coalitions: DataFrame) -> DataFrame:
    """Pairs of listed coalitions that differ in one item: game_id, item_idx, mask_without, mask_with. An equi-join."""
    own = coalitions.select("game_id", "n_items", "mask").distinct()
    up = own.select("game_id", F.col("mask").alias("mask_without"), F.explode(F.filter(bits.items(F.col("n_items")), lambda i: ~bits.has(F.col("mask"), i))).alias("item_idx"))
    up = up.withColumn("mask_with", F.col("mask_without").bitwiseOR(bits.bit(F.col("item_idx"))))
    return up.join(own.select("game_id", F.col("mask").alias("mask_with")), ["game_id", "mask_with"]).select("game_id", "item_idx", "mask_without", "mask_with")
