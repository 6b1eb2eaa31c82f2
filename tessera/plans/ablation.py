"""The grid of variants: samplers, rank rules and pruning of the surrogate, by budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import metrics, surrogates
from tessera.operators.coalitions import structured_sample
from tessera.operators.exact import bundle, coefficient_pairs
from tessera.operators.exact import shapley as exact_shapley
from tessera.operators.surrogates import attributions, fit_fm, main_effects, prune_interactions, pruned_attributions

from tessera.sources.scratch import kept


@dataclass(frozen=True)
class Variant:
    name: str
    group: str
    core: bool = True
    neighbours: bool = True
    fill: str = "kernelshap"
    rank: int | None = None
    criterion: str = "r2_delta"
    prune: str = "none"


#: The variants compared.
VARIANTS = (
    Variant("full", "all"), Variant("no core", "sampling", core=False), Variant("no neighbours", "sampling", neighbours=False), Variant("uniform fill", "sampling", fill="uniform"),
    Variant("uniform only", "sampling", core=False, neighbours=False, fill="uniform"), Variant("size-uniform fill", "sampling", fill="size_uniform"), Variant("rank by utility", "rank", criterion="r2_util"),
    Variant("rank by gold", "rank", criterion="gold"), *(Variant(f"rank {r}", "rank", rank=r) for r in (1, 2, 4, 8)), Variant("pruned by share", "pruning", prune="topq"), Variant("pruned by deviation", "pruning", prune="thresh"),
)


def variants(groups: Sequence[str] = ("sampling", "rank", "pruning")) -> list[Variant]:
    """The full system and the variants of the groups, each once."""
    return [v for v in VARIANTS if v.group == "all" or v.group in groups]


def evaluations(utilities: DataFrame, chosen: Sequence[Variant], budget: int, seed: int = 42) -> DataFrame:
    """(game_id, place, name, n): how many coalitions each variant evaluates of each game."""
    games, rows = utilities.select("game_id", "n_items").distinct(), None
    for place, v in enumerate(chosen):
        drawn = structured_sample(games, budget, v.core, v.neighbours, v.fill, seed)
        one = drawn.groupBy("game_id").agg(F.lit(place).alias("place"), F.lit(v.name).alias("name"), F.count(F.lit(1)).alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def numbered(utilities: DataFrame) -> DataFrame:
    """(game_id, place): a number from 0 for each game, whatever its id is. With parts of a game as games of their own,
    place * parts + part is the id of one. Numbers have gaps and stay under 2**53, so some hundred parts fit."""
    return kept(utilities.select("game_id").distinct().withColumn("place", F.monotonically_increasing_id()), "grid-games")


def chosen_rank(scores: DataFrame, criterion: str) -> DataFrame:
    """(game_id, rank) from what select_rank() tells of each rank: its own choice, or the best by another criterion."""
    if criterion == "r2_delta":
        return scores.where("chosen").select("game_id", "rank")
    good = F.col(criterion) * (-1 if criterion == "mse_util" else 1)
    best = scores.groupBy("game_id").agg(F.max(F.struct(F.coalesce(good, F.lit(float("-inf"))).alias("good"), (-F.col("rank")).alias("low"))).alias("b"))
    return best.select("game_id", (-F.col("b.low")).cast("int").alias("rank"))


def grid(utilities: DataFrame, budgets: Sequence[int], chosen: Sequence[Variant] = VARIANTS, seed: int = 42, k: int = 5, ranks: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Metric rows (qid, metric, method, budget, k, value) of all variants at all budgets against the exact indices.

    A game in a cell is a game of its own, so each step below is one job for the whole grid: coalitions drawn for each
    different sampler, ranks chosen for each different sampler and criterion ("gold": by the exact values, the ceiling),
    machines fitted for each rank that any cell uses, and the metrics. Games may have any ids. What is fitted twice in the grid is fitted once: variants that only prune share their fit.
    """
    cells = [(v, budget) for v in chosen for budget in budgets]
    parts = len(cells)  # a sampler's number is less than this as well
    cell_id = lambda game, cell: game * parts + cell
    of_game, own_part = F.expr(f"game_id div {parts}"), F.col("game_id") % parts
    places = numbered(utilities)
    utilities = utilities.join(places, "game_id").drop("game_id").withColumnRenamed("place", "game_id")
    games = utilities.select("game_id", "n_items").distinct()
    sampler = lambda v, budget: (budget, v.core, v.neighbours, v.fill)
    rule = lambda v, budget: (*sampler(v, budget), v.rank or v.criterion)
    samplers, rules = sorted({sampler(*c) for c in cells}, key=repr), sorted({rule(*c) for c in cells}, key=repr)
    drawn = [structured_sample(games, s[0], *s[1:], seed=seed).select("game_id", "mask", F.lit(n).alias("sampler")) for n, s in enumerate(samplers)]
    drawn = reduce(DataFrame.unionByName, drawn).join(utilities, ["game_id", "mask"])
    train = kept(drawn.select(cell_id(F.col("game_id"), F.col("sampler")).alias("game_id"), "n_items", "mask", "value"), "grid-train")
    number = {s: n for n, s in enumerate(samplers)}
    ruled = {r[-1]: [] for r in rules if isinstance(r[-1], str)}
    for r in rules:
        if r[-1] in ruled:
            ruled[r[-1]].append(number[r[:-1]])
    log = None
    if ruled:
        every = sorted({n for own in ruled.values() for n in own})
        scores = kept(surrogates.select_rank(train.where(own_part.isin(every)), ranks, seed=seed), "grid-scores") if set(ruled) - {"gold"} else None
        for criterion, own in ruled.items():
            if criterion == "gold":
                truth = exact_shapley(utilities).withColumnRenamed("phi", "truth").withColumn("part", F.explode(F.array(*(F.lit(n).cast("bigint") for n in own))))
                truth = truth.withColumn("game_id", cell_id(F.col("game_id"), F.col("part"))).drop("part")
                one = rank_by_gold(train.where(own_part.isin(own)), truth, ranks, k, seed).select("game_id", "rank", F.lit(criterion).alias("by"))
                log = one if log is None else log.unionByName(one)
                continue
            one = chosen_rank(scores.where(own_part.isin(own)), criterion).withColumn("by", F.lit(criterion))
            log = one if log is None else log.unionByName(one)
    for r in rules:
        if not isinstance(r[-1], str):
            one = train.where(own_part == number[r[:-1]]).select("game_id", F.lit(r[-1]).alias("rank"), F.lit(str(r[-1])).alias("by")).distinct()
            log = one if log is None else log.unionByName(one)
    log = kept(log, "grid-ranks")
    used = sorted({*ranks, *(r[-1] for r in rules if not isinstance(r[-1], str))})
    fits = [fit_fm(train.join(log.where(F.col("rank") == n).select("game_id").distinct(), "game_id", "left_semi"), n, seed=seed).withColumn("rank", F.lit(n)) for n in used]
    models = kept(reduce(DataFrame.unionByName, fits).join(log, ["game_id", "rank"]), "grid-models")
    table = utilities.sparkSession.createDataFrame([(n, number[sampler(*c)], str(rule(*c)[-1]), c[0].name, c[1], c[0].prune) for n, c in enumerate(cells)], "cell int, sampler bigint, by string, method string, budget int, prune string")
    table = F.broadcast(table)  # a row a cell
    of_cell = models.withColumn("sampler", own_part).join(table, ["sampler", "by"])
    coefs = kept(of_cell.select(cell_id(of_game, F.col("cell")).alias("game_id"), "subset", "coef", "prune"), "grid-coefs")
    pairs, effects = coefficient_pairs(coefs), main_effects(coefs)
    prune = coefs.select("game_id", "prune").distinct()
    judged = None
    for mode in sorted({v.prune for v in chosen}):
        one = prune_interactions(pairs.join(prune.where(F.col("prune") == mode).select("game_id"), "game_id", "left_semi"), mode)
        judged = one if judged is None else judged.unionByName(one)
    judged = kept(judged, "grid-pairs")
    phi = pruned_attributions(effects, judged)
    exact_phi, exact_pairs = (kept(x, "grid-truth") for x in bundle(utilities))
    game = of_game
    key = (F.col("i") * 64 + F.col("j")).alias("item_idx")
    items = phi.select("game_id", game.alias("game"), "item_idx", F.col("phi").alias("pred")).join(exact_phi.select(F.col("game_id").alias("game"), "item_idx", F.col("phi").alias("truth")), ["game", "item_idx"])
    value = F.when(F.col("kept"), F.col("value")).otherwise(0.0)
    crossed = judged.select("game_id", game.alias("game"), key, value.alias("pred")).join(exact_pairs.select(F.col("game_id").alias("game"), key, F.col("value").alias("truth")), ["game", "item_idx"])
    absolute = crossed.select("game_id", "item_idx", F.abs("pred").alias("pred"), F.abs("truth").alias("truth"))
    got = [(metrics.ndcg(items, ["game_id"], k), "ndcg_items", k), (metrics.ndcg(absolute, ["game_id"], k, shift=False), "ndcg_pairs", k), (metrics.spearman(crossed, ["game_id"]), "spearman_pairs", None)]
    rows = reduce(DataFrame.unionByName, [frame.where("value is not null").select("game_id", F.lit(name).alias("metric"), F.lit(at).cast("int").alias("k"), "value") for frame, name, at in got])
    named = rows.withColumn("cell", own_part.cast("int")).join(table, "cell")
    named = named.withColumn("place", game).join(places.withColumnRenamed("game_id", "qid"), "place")
    return named.select("qid", "metric", "method", "budget", "k", "value")


def rank_by_gold(train: DataFrame, truth: DataFrame, ranks: tuple[int, ...] = (1, 2, 4, 8), k: int = 5, seed: int = 42) -> DataFrame:
    """(game_id, rank, ndcg): of each game the rank with the greatest NDCG of its attributions against `truth`, ties to the
    lower rank. It looks at what it is judged by, so it is no rule but a ceiling for rules."""
    rows = None
    for rank in ranks:
        items = attributions(fit_fm(train, rank, seed=seed)).withColumnRenamed("phi", "pred").join(truth, ["game_id", "item_idx"])
        one = metrics.ndcg(items, ["game_id"], k).select("game_id", F.lit(rank).alias("rank"), F.col("value").alias("ndcg"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("game_id").agg(F.max(F.struct(F.round("ndcg", 9).alias("ndcg"), (-F.col("rank")).alias("low"))).alias("b"))
    return best.select("game_id", (-F.col("b.low")).alias("rank"), F.col("b.ndcg").alias("ndcg"))


def rank_oracle(utilities: DataFrame, budget: int, ranks: tuple[int, ...] = (1, 2, 4, 8), k: int = 5, seed: int = 42) -> DataFrame:
    """rank_by_gold() against the exact values, of machines fitted to `budget` coalitions."""
    games = utilities.select("game_id", "n_items").distinct()
    train = structured_sample(games, budget, seed=seed).select("game_id", "mask").join(utilities, ["game_id", "mask"])
    return rank_by_gold(train, exact_shapley(utilities).withColumnRenamed("phi", "truth"), ranks, k, seed)


def rank_log(utilities: DataFrame, budgets: Sequence[int], seed: int = 42) -> DataFrame:
    """(budget, rank): mean rank that the full system chooses."""
    games, rows = utilities.select("game_id", "n_items").distinct(), None
    for budget in budgets:
        train = structured_sample(games, budget, seed=seed).select("game_id", "mask").join(utilities, ["game_id", "mask"])
        one = surrogates.select_rank(train, seed=seed).where("chosen").agg(F.lit(budget).alias("budget"), F.avg("rank").alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
