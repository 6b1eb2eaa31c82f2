"""Attributions from marginal contributions along random orders of the items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import bits, kernels
from tessera.operators.coalitions import orders, permutations
from tessera.operators.exact import finite


def marginals(games: DataFrame, utilities: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(game_id, n_items, iteration, position, item_idx, delta) along `count` orders a game; steps at unknown or
    infinite utilities are left out."""
    steps = permutations(games, count, seed).withColumn("mask_after", F.col("mask_before").bitwiseOR(bits.bit(F.col("item_idx"))))
    known = utilities.select("game_id", "mask", finite(F.col("value")).alias("value")).where("value is not null")
    before, after = (known.select("game_id", F.col("mask").alias(f"mask_{s}"), F.col("value").alias(s)) for s in ("before", "after"))
    return steps.join(before, ["game_id", "mask_before"]).join(after, ["game_id", "mask_after"]).select("game_id", "n_items", "iteration", "position", "item_idx", (F.col("after") - F.col("before")).alias("delta"))


def beta_shapley(games: DataFrame, utilities: DataFrame, count: int, alpha: float = 16.0, beta: float = 1.0, seed: int = 42) -> DataFrame:
    """(game_id, item_idx, phi): mean of marginals weighted by the Beta density of the position; 0 without weight."""
    rows = marginals(games, utilities, count, seed).withColumn("w", kernels.beta_weight(F.col("n_items"), F.col("position"), alpha, beta))
    total = F.sum("w")
    return rows.groupBy("game_id", "item_idx").agg(F.when(total > 1e-9, F.sum(F.col("w") * F.col("delta")) / total).otherwise(F.lit(0.0)).alias("phi"))


def truncated_shapley(games: DataFrame, utilities: DataFrame, count: int, tolerance: float = 0.01, budget: int | None = None, seed: int = 42) -> DataFrame:
    """(game_id, item_idx, phi, evaluations): running mean of marginals along `count` orders.

    From the second order on, once the utility so far is within `tolerance` of the full one, the order's other items
    get 0, which counts in the mean. With `budget`, orders end before a coalition that would be one evaluation too many;
    coalitions seen before are free. Each step depends on those before it, so a game is one group: at most 2**n
    utilities. A missing or infinite utility ends its order.
    """
    walks = orders(games, count, seed).groupBy("game_id", "n_items").agg(F.transform(F.array_sort(F.collect_list(F.struct("iteration", "order"))), lambda x: x["order"]).alias("orders"))
    known = utilities.where(finite(F.col("value")).isNotNull()).groupBy("game_id").agg(F.collect_list("mask").alias("masks"), F.collect_list("value").alias("values"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield walk(row.game_id, int(row.n_items), row.orders, dict(zip(row.masks, row.values, strict=True)), tolerance, budget)

    return walks.join(known, "game_id").mapInPandas(run, "game_id bigint, item_idx int, phi double, evaluations bigint")


def walk(game: int, n: int, orders, value: dict[int, float], tolerance: float, budget: int | None) -> pd.DataFrame:
    total, steps, seen, stop = np.zeros(n), np.zeros(n), {0, (1 << n) - 1}, False
    top = value.get((1 << n) - 1)
    for t, order in enumerate(orders):
        mask, last, cut = 0, value.get(0), False
        for item in order:
            if last is None or stop:
                break
            cut = cut or (t > 0 and top is not None and abs(top - last) < tolerance)
            if cut:
                steps[item] += 1
                continue
            mask |= 1 << int(item)
            if budget is not None and mask not in seen and len(seen) >= budget:
                stop = True
                break
            seen.add(mask)
            now = value.get(mask)
            if now is None:
                break
            total[item] += now - last
            steps[item] += 1
            last = now
        if stop:
            break
    return pd.DataFrame({"game_id": game, "item_idx": np.arange(n, dtype="int32"), "phi": total / np.maximum(steps, 1), "evaluations": len(seen)})
