"""Where utilities come from: named scorers, run for the coalitions that aren't in the table yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.functions.draws import unit
from tessera.functions.utilities import utility
from tessera.operators.surrogates import predict

#: A scorer gets coalitions (game_id, n_items, mask) and returns them with `value`.
Provider = Callable[[DataFrame], DataFrame]
KEY = ["game_id", "provider", "mode", "mask"]


def from_expression(value: Column) -> Provider:
    """A scorer that is an expression of n_items and mask."""
    return lambda coalitions: coalitions.withColumn("value", value.cast("double"))


def from_batches(score: Callable[[pd.DataFrame], pd.Series]) -> Provider:
    """A scorer in Python that gets a batch of coalitions and returns their values."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(value=score(frame).astype(float))

    return lambda coalitions: coalitions.select("game_id", "n_items", "mask").mapInPandas(run, "game_id bigint, n_items int, mask bigint, value double")


def from_log_probs(log_probs: DataFrame, mode: str) -> Provider:
    """Utilities of a mode from (game_id, mask, lp, tokens). The empty coalition's lp is looked up once a game."""
    empty = log_probs.where("mask = 0").select("game_id", F.col("lp").alias("lp_empty"))
    known = log_probs.join(empty, "game_id").select("game_id", "mask", utility(mode, F.col("lp"), F.col("lp_empty"), F.col("tokens")).alias("value"))
    return lambda coalitions: coalitions.join(known, ["game_id", "mask"])


def degree_two(effects: DataFrame, pairs: DataFrame, noise: float = 0.0, seed: int = 42) -> Provider:
    """A game known in closed form: effects (game_id, item_idx, w) and pairs (game_id, i, j, value), plus noise that
    depends on seed, game and mask."""
    two = pairs.select("game_id", bits.bit(F.col("i")).bitwiseOR(bits.bit(F.col("j"))).alias("subset"), F.col("value").alias("coef"))
    one = effects.select("game_id", bits.bit(F.col("item_idx")).alias("subset"), F.col("w").alias("coef"))
    zero = effects.select("game_id").distinct().select("game_id", F.lit(0).cast("bigint").alias("subset"), F.lit(0.0).alias("coef"))
    coefs = zero.unionByName(one).unionByName(two)

    def score(coalitions: DataFrame) -> DataFrame:
        key = (F.col("game_id"), F.col("mask"))
        normal = F.sqrt(-2 * F.ln(unit(f"{seed}:r", *key))) * F.cos(F.lit(6.283185307179586) * unit(f"{seed}:t", *key))
        got = predict(coefs, coalitions)
        return got.select("game_id", "n_items", "mask", (F.col("predicted") + noise * normal if noise else F.col("predicted")).alias("value"))

    return score


def missing(coalitions: DataFrame, known: DataFrame, provider: str, mode: str) -> DataFrame:
    """Coalitions without a utility under this provider and mode."""
    have = known.where((F.col("provider") == provider) & (F.col("mode") == mode)).select("game_id", "mask")
    return coalitions.select("game_id", "n_items", "mask").distinct().join(have, ["game_id", "mask"], "left_anti")


def evaluate(coalitions: DataFrame, known: DataFrame, provider: str, mode: str, score: Provider) -> DataFrame:
    """New rows for the utilities table; the key names game, provider, mode and mask, so nothing is mixed up."""
    new = score(missing(coalitions, known, provider, mode))
    return new.select("game_id", F.lit(provider).alias("provider"), F.lit(mode).alias("mode"), "n_items", "mask", "value")


def calls(coalitions: DataFrame) -> DataFrame:
    """(game_id, n): distinct coalitions to evaluate."""
    return coalitions.groupBy("game_id").agg(F.count_distinct("mask").alias("n"))


def within_budget(lookups: DataFrame, utilities: DataFrame, budget: int, known: DataFrame | None = None) -> DataFrame:
    """`lookups` (game_id, step, mask; step orders them) with value and evaluations, the number spent so far.

    The first lookup of a mask is an evaluation, later ones are free, and so are masks in `known` (game_id, mask).
    A lookup that would be one evaluation too many is refused: its value is minus infinity. Windows go over the
    lookups of one game, which its budget and number of orders bound.
    """
    game = Window.partitionBy("game_id").orderBy("step")
    first = (F.row_number().over(Window.partitionBy("game_id", "mask").orderBy("step")) == 1).cast("int")
    rows = lookups.select("game_id", "step", "mask").withColumn("new", first)
    if known is not None:
        have = known.select("game_id", "mask").distinct().withColumn("free", F.lit(True))
        rows = rows.join(have, ["game_id", "mask"], "left").withColumn("new", F.when(F.col("free"), 0).otherwise(F.col("new"))).drop("free")
    order = F.sum("new").over(game)
    rows = rows.withColumn("order", F.when(F.col("new") == 1, order))
    spent = F.max("order").over(Window.partitionBy("game_id", "mask"))
    rows = rows.withColumn("refused", F.coalesce(spent > budget, F.lit(False))).withColumn("evaluations", F.least(order, F.lit(budget)))
    value = F.when(F.col("refused"), F.lit(float("-inf"))).otherwise(F.col("value"))
    return rows.join(utilities.select("game_id", "mask", "value"), ["game_id", "mask"]).select("game_id", "step", "mask", value.alias("value"), "evaluations")
