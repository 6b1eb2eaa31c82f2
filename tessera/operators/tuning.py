"""Rank and blend of a factorisation machine chosen together, on folds of coalitions and their flipped copies.

Pairs are rows (game_id, n_items, pair, side, mask, value): side 0 is a coalition, side 1 its copy with one item put in or out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.functions.draws import draw
from tessera.operators.exact import finite
from tessera.operators.surrogates import COEFS, as_coefs, design, fm_predict

SCORES = "game_id bigint, fold int, rank int, beta double, util_mse double, delta_mse double, util_z double, delta_z double"


def flipped_pairs(coalitions: DataFrame, seed: int = 42) -> DataFrame:
    """Each coalition of (game_id, n_items, mask), once, and its copy with one drawn item flipped; `pair` is its mask."""
    own = coalitions.select("game_id", "n_items", F.col("mask").alias("pair")).distinct()
    item = (draw(f"{seed}:flip", F.col("game_id"), F.col("pair")) % F.col("n_items")).cast("int")
    both = F.array(F.col("pair"), F.col("pair").bitwiseXOR(bits.bit(item)))
    return own.select("game_id", "n_items", "pair", F.posexplode(both).alias("side", "mask"))


def complete(pairs: DataFrame) -> DataFrame:
    """Pairs of which both sides have a finite value, as (game_id, n_items, pair, mask, value, mask2, value2)."""
    rows = pairs.withColumn("value", finite(F.col("value").cast("double"))).where("value is not null")
    a, b = (rows.where(F.col("side") == s) for s in (0, 1))
    return a.select("game_id", "n_items", "pair", "mask", "value").join(b.select("game_id", "pair", F.col("mask").alias("mask2"), F.col("value").alias("value2")), ["game_id", "pair"])


def blended_fit(x: np.ndarray, y: np.ndarray, rank: int, beta: float, l2_w: float, l2_v: float, rounds: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Least beta * mean squared error of the pairs' differences + (1 - beta) * mean squared error of utilities + penalties.

    Rows 2k and 2k + 1 are a pair. A prediction is linear in each parameter by itself, so coordinates take turns at their exact
    minima. Rank 0 is the linear model. With beta 1 the intercept is that of least squares, as differences don't settle it.
    """
    n, m = x.shape[1], len(y)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(n), rng.normal(0, 0.1, (n, rank))
    w0 = float(y.mean())
    across = lambda z: (1 - beta) / m * z + (beta / (m / 2)) * np.repeat(z[1::2] - z[::2], 2) * np.tile([-1.0, 1.0], m // 2)
    error = y - fm_predict(x, w0, w, v)
    least = 1e-13 * max(1.0, float(np.abs(y).max()))
    for _ in range(rounds):
        moved = 0.0
        if beta < 1:
            shift = error.mean()
            w0, error = w0 + shift, error - shift
        for i in range(n):
            h = across(x[:, i])
            hh = h @ x[:, i]
            move = (h @ error + hh * w[i]) / (hh + l2_w) - w[i] if hh + l2_w > 0 else 0.0
            w[i], error, moved = w[i] + move, error - move * x[:, i], max(moved, abs(move))
        for f in range(rank):
            for i in range(n):
                along = x[:, i] * (x @ v[:, f] - v[i, f] * x[:, i])
                h = across(along)
                hh = h @ along
                move = (h @ error + hh * v[i, f]) / (hh + l2_v) - v[i, f] if hh + l2_v > 0 else 0.0
                v[i, f], error, moved = v[i, f] + move, error - move * along, max(moved, abs(move))
        if moved <= least:
            break
    return (w0 + float(error.mean()) if beta == 1 else w0), w, v


def rows_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Design and values of a game's complete pairs in order, the two sides of each one after the other."""
    frame = frame.sort_values("pair")
    masks = frame[["mask", "mask2"]].to_numpy("int64").ravel()
    return design(masks, int(frame["n_items"].iloc[0])), frame[["value", "value2"]].to_numpy(float).ravel()


def standard(z: np.ndarray) -> np.ndarray:
    """Less the mean, over the deviation; zeros where all are equal."""
    spread = z.std()
    return (z - z.mean()) / spread if spread > 1e-12 else np.zeros_like(z)


def tuning_scores(pairs: DataFrame, ranks: tuple[int, ...] = (1, 2, 4, 8), betas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), splits: int = 4, l2_w: float = 0.001, l2_v: float = 0.001, rounds: int = 200, seed: int = 42) -> DataFrame:
    """A row for each game, fold, rank and beta: held-out errors of utilities and differences, plain and z-scored.

    Pairs stay whole: those of a game are dealt to folds by turns in the order of `pair`. Each fold of a game is one task that
    fits the whole grid on its pairs, a budget and not the data: rows go through one shuffle, once a fold. Pairs with a
    missing or infinite value are left out; a game of one pair has no rows, as no fold has anything to learn from.
    """
    game = Window.partitionBy("game_id").orderBy("pair")
    dealt = complete(pairs).withColumn("own", ((F.row_number().over(game) - 1) % splits).cast("int"))
    tasks = dealt.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = frame["own"] == key[1]
        if held.all() or not held.any():
            return pd.DataFrame(columns=["game_id", "fold", "rank", "beta", "util_mse", "delta_mse", "util_z", "delta_z"])
        (x, y), (xv, yv) = rows_of(frame[~held]), rows_of(frame[held])
        out = []
        for rank in ranks:
            for beta in betas:
                p = fm_predict(xv, *blended_fit(x, y, rank, beta, l2_w, l2_v, rounds, seed))
                d, dv = p[1::2] - p[::2], yv[1::2] - yv[::2]
                errors = [((a - b) ** 2).mean() for a, b in ((yv, p), (dv, d), (standard(yv), standard(p)), (standard(dv), standard(d)))]
                out.append((key[0], key[1], rank, beta, *errors))
        return pd.DataFrame(out, columns=["game_id", "fold", "rank", "beta", "util_mse", "delta_mse", "util_z", "delta_z"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts, "game_id", "fold").groupBy("game_id", "fold").applyInPandas(run, SCORES)


def choose(scores: DataFrame, zscored: bool = False) -> DataFrame:
    """(game_id, rank, beta, loss): the least mean over folds of the blended error; ties go to the lower rank, then beta."""
    delta, util = ("delta_z", "util_z") if zscored else ("delta_mse", "util_mse")
    mean = scores.groupBy("game_id", "rank", "beta").agg(F.avg(F.col("beta") * F.col(delta) + (1 - F.col("beta")) * F.col(util)).alias("loss"))
    best = mean.groupBy("game_id").agg(F.min(F.struct("loss", "rank", "beta")).alias("b"))
    return best.select("game_id", "b.rank", "b.beta", "b.loss")


def fit_tuned(pairs: DataFrame, chosen: DataFrame, l2_w: float = 0.001, l2_v: float = 0.001, rounds: int = 400, seed: int = 42) -> DataFrame:
    """Coefficients (game_id, subset, coef) of each game's chosen model, fitted to all of its pairs; games that have no choice
    have no rows."""
    rows = complete(pairs).join(chosen.select("game_id", "rank", "beta"), "game_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rank, beta = int(frame["rank"].iloc[0]), float(frame["beta"].iloc[0])
        return as_coefs(int(frame["game_id"].iloc[0]), *blended_fit(*rows_of(frame), rank, beta, l2_w, l2_v, rounds, seed))

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "game_id").groupBy("game_id").applyInPandas(run, COEFS)
