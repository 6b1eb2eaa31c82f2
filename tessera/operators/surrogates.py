"""Models fitted to some coalitions of each game, and what attributions they give.

`train`: game_id, n_items, mask, value and, if weighted, weight. A fitted model is rows (game_id, subset, coef) with
subset 0 for the intercept, so all models predict, prune and explain by the same queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.operators.exact import finite, shapley

COEFS = "game_id bigint, subset bigint, coef double"


def subsets(mask: Column, n: Column, order: int) -> Column:
    """Masks of the subsets of up to `order` items, 1 to 4."""
    own = bits.members(mask, n)
    lists = [F.array(F.lit(0).cast("bigint"))]
    for _ in range(order):  # sets get items greater than those they have
        last = lists[-1]
        lists.append(F.flatten(F.transform(last, lambda s: F.transform(F.filter(own, lambda i: bits.bit(i) > s), lambda i: s.bitwiseOR(bits.bit(i))))))
    return F.concat(*lists)


# Linear and polynomial fits


def sufficient(train: DataFrame, order: int) -> DataFrame:
    """Per game the sums a least-squares fit of this order needs.

    Products of indicators are indicators of unions, so the sums of weights and of weighted values over the coalitions
    that hold a set, for sets of up to 2 * order items, are all there is. They are partial aggregates: the number of
    coalitions doesn't matter to the task that fits.
    """
    weight = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    rows = train.select("game_id", "n_items", "mask", finite(F.col("value")).alias("value"), weight.cast("double").alias("w")).where("value is not null and w > 0")
    rows = rows.select("game_id", "n_items", "value", "w", F.explode(subsets(F.col("mask"), F.col("n_items"), 2 * order)).alias("u"))
    sums = rows.groupBy("game_id", "n_items", "u").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("value")).alias("wy"), F.sum(F.col("w") * F.col("value") * F.col("value")).alias("wyy"))
    return sums.groupBy("game_id", "n_items").agg(F.sort_array(F.collect_list(F.struct("u", "w", "wy", "wyy"))).alias("sums"))


def features(n: int, order: int) -> list[int]:
    single = [1 << i for i in range(n)]
    return single + ([1 << i | 1 << j for i in range(n) for j in range(i + 1, n)] if order == 2 else [])


def fit_least_squares(train: DataFrame, order: int = 1, ridge: float = 0.0, lasso: float = 0.0) -> DataFrame:
    """Coefficients of the linear (order 1) or pairwise (order 2) model.

    Minimises sum w (y - f)^2 + ridge |b|^2, or with `lasso` sum w (y - f)^2 / (2 sum w) + lasso |b|_1; the intercept
    isn't penalised. Without a penalty a game that doesn't settle all coefficients gets those of least norm.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield solve(int(row.game_id), int(row.n_items), row.sums, order, ridge, lasso)

    return sufficient(train, order).mapInPandas(run, COEFS)


def solve(game: int, n: int, sums, order: int, ridge: float, lasso: float) -> pd.DataFrame:
    held = {int(s["u"]): s for s in sums}
    names = features(n, order)
    get = lambda u, c: held[u][c] if u in held else 0.0
    total = get(0, "w")
    gram = np.array([[get(a | b, "w") for b in names] for a in names])
    mean, target = np.array([get(a, "w") for a in names]) / total, np.array([get(a, "wy") for a in names])
    centred = gram - total * np.outer(mean, mean)
    ybar = get(0, "wy") / total
    right = target - total * mean * ybar
    if lasso:
        coef = descend(centred / total, right / total, lasso)
    elif ridge:
        coef = np.linalg.solve(centred + ridge * np.eye(len(names)), right)
    else:
        coef = np.linalg.lstsq(centred, right, rcond=1e-10)[0]
    return pd.DataFrame({"game_id": game, "subset": [0, *names], "coef": [ybar - mean @ coef, *coef]})


def soft_threshold(x: Column, by: float) -> Column:
    """`x` nearer to 0 by `by`, and 0 if it is nearer than that."""
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def pairwise_logistic(difference: Column, sign: Column) -> Column:
    """ln(1 + exp(-sign * difference)): the loss of a predicted difference of two neighbours by the sign of the true one."""
    margin = -F.signum(sign) * difference
    return F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def soft(x: float, by: float) -> float:
    return float(np.sign(x) * max(abs(x) - by, 0.0))


def descend(gram: np.ndarray, right: np.ndarray, penalty: float, most: int = 5000, least: float = 1e-12) -> np.ndarray:
    """Coordinate descent for the lasso on a Gram matrix."""
    b = np.zeros(len(right))
    for _ in range(most):
        moved = 0.0
        for k in range(len(b)):
            if gram[k, k] <= 1e-15:
                continue
            now = soft(right[k] - gram[k] @ b + gram[k, k] * b[k], penalty) / gram[k, k]
            moved = max(moved, abs(now - b[k]))
            b[k] = now
        if moved < least:
            break
    return b


# Factorisation machines


def design(masks: np.ndarray, n: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(n)) & 1).astype(float)


def fm_predict(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    q = x @ v
    return w0 + x @ w + 0.5 * (q**2 - (x**2) @ (v**2)).sum(1)


def als(x: np.ndarray, y: np.ndarray, rank: int, rounds: int = 200, l2_w: float = 0.01, l2_v: float = 0.1, seed: int = 42, stop: float = 1e-7) -> tuple[float, np.ndarray, np.ndarray]:
    """Coordinate-wise least squares for intercept, weights and factors."""
    m, n = x.shape
    rng = np.random.default_rng(seed)
    w0, w, v = float(y.mean()), np.zeros(n), rng.normal(0, 0.1, (n, rank))
    error = y - fm_predict(x, w0, w, v)
    q = x @ v
    sizes = (x**2).sum(0)
    before = np.inf
    for _ in range(rounds):
        shift = error.mean()
        w0, error = w0 + shift, error - shift
        for i in range(n):
            now = (x[:, i] @ error + w[i] * sizes[i]) / (sizes[i] + l2_w)
            error -= (now - w[i]) * x[:, i]
            w[i] = now
        for f in range(rank):
            for i in range(n):
                h = x[:, i] * (q[:, f] - v[i, f] * x[:, i])
                hh = h @ h
                now = (h @ error + v[i, f] * hh) / (hh + l2_v)
                error -= (now - v[i, f]) * h
                q[:, f] += (now - v[i, f]) * x[:, i]
                v[i, f] = now
        loss = error @ error + l2_w * w @ w + l2_v * (v**2).sum()
        if abs(before - loss) <= stop * max(1.0, abs(loss)):
            break
        before = loss
    return w0, w, v


def neighbours(masks: np.ndarray) -> np.ndarray:
    """Row pairs whose masks differ in one bit, the smaller mask first."""
    place = {int(m): k for k, m in enumerate(masks)}
    found = [(k, place[m | 1 << i]) for m, k in place.items() for i in range(62) if not m >> i & 1 and (m | 1 << i) in place]
    return np.array(found, int).reshape(-1, 2)


def r2(y: np.ndarray, p: np.ndarray) -> float:
    spread = ((y - y.mean()) ** 2).sum() if len(y) else 0.0
    return float(1 - ((y - p) ** 2).sum() / spread) if spread > 0 else float("nan")


def gradient_fit(x: np.ndarray, y: np.ndarray, masks: np.ndarray, weight: np.ndarray, rank: int, loss: str, steps: int = 1500, rate: float = 0.02, l2: float = 1e-4, l1: float = 0.0, batch: int | None = None, seed: int = 42) -> tuple[float, np.ndarray, np.ndarray]:
    """The same model by Adam, from the linear fit on. Losses: "utility" (weighted squares), "delta" (squares of the differences of
    neighbours, weighted by their size and weight), "mixed" (delta weighted by size over its 70th percentile, plus
    utility), "r2" (what the differences leave unexplained, plus utility), "logistic" (order of neighbours, plus utility).
    `l1` and `l2` penalise all but the intercept; with `batch` a step sees so many coalitions for its utility part, in
    shuffled turns."""
    if loss not in ("utility", "delta", "mixed", "r2", "logistic"):
        raise ValueError(f"unknown loss {loss!r}")
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    theta = np.concatenate([np.linalg.lstsq(np.c_[np.ones(len(y)), x], y, rcond=None)[0], rng.normal(0, 0.1, n * rank)])
    pairs = neighbours(masks)
    weight = weight / weight.mean() if weight.sum() > 0 else np.ones(len(y))
    delta = y[pairs[:, 1]] - y[pairs[:, 0]]
    size = np.abs(delta) * weight[pairs[:, 0]] if loss == "delta" else 1 + np.abs(delta) / (np.quantile(np.abs(delta), 0.7) + 1e-12) if len(delta) else delta
    size = size / size.mean() if len(size) and size.mean() > 0 else np.ones(len(delta))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    spread = ((delta - delta.mean()) ** 2).sum() if len(delta) else 0.0
    turn = np.zeros(0, int)
    for t in range(1, steps + 1):
        w0, w, v = theta[0], theta[1 : n + 1], theta[n + 1 :].reshape(n, rank)
        p = fm_predict(x, w0, w, v)
        g = np.zeros(len(y))
        if loss != "delta" or not len(pairs):
            own = slice(None)
            if batch is not None and batch < len(y):
                turn = turn if len(turn) >= batch else np.r_[turn, rng.permutation(len(y))]
                own, turn = turn[:batch], turn[batch:]
            np.add.at(g, own, (2 * weight * (p - y))[own] / len(y[own]))
        if loss != "utility" and len(pairs):
            d = p[pairs[:, 1]] - p[pairs[:, 0]]
            if loss == "logistic":
                s = np.sign(delta)
                gd = -s / (1 + np.exp(np.clip(s * d, -40, 40))) / len(d)
            elif loss == "r2":
                gd = 2 * (d - delta) / max(spread, 1e-12)
            else:
                gd = 2 * size * (d - delta) / len(d)
            np.add.at(g, pairs[:, 1], gd)
            np.add.at(g, pairs[:, 0], -gd)
        q = x @ v
        grad = np.concatenate([[g.sum()], x.T @ g, ((x * g[:, None]).T @ q - ((x**2).T @ g)[:, None] * v).ravel()]) + 2 * l2 * np.r_[0.0, theta[1:]] + l1 * np.r_[0.0, np.sign(theta[1:])]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta - rate * (1 - t / (steps + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    if loss == "delta" and len(pairs):  # differences don't settle the intercept
        theta[0] += (y - fm_predict(x, theta[0], theta[1 : n + 1], theta[n + 1 :].reshape(n, rank))).mean()
    return theta[0], theta[1 : n + 1], theta[n + 1 :].reshape(n, rank)


def as_coefs(game: int, w0: float, w: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    n, cross = len(w), v @ v.T
    names = features(n, 2)
    pair = [cross[i, j] for i in range(n) for j in range(i + 1, n)]
    return pd.DataFrame({"game_id": game, "subset": [0, *names], "coef": [w0, *w, *pair]})


def ready(frame: pd.DataFrame) -> pd.DataFrame:
    """Finite rows, each mask once, in the order of the masks."""
    return frame[np.isfinite(frame["value"].astype(float))].drop_duplicates("mask").sort_values("mask")


def spread(train: DataFrame) -> DataFrame:
    """`train` dealt by game to as many tasks as shuffles have: fits are long for the few rows they take, so small games
    must not be put together in one task."""
    return train.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), "game_id")


def fit_fm(train: DataFrame, rank: int = 4, loss: str = "als", seed: int = 42, **how) -> DataFrame:
    """Factorisation machines by alternating least squares or, with another `loss`, by gradients. One group is the
    training coalitions of one game: a budget, not the data. Games without finite values have no rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = ready(frame)
        if frame.empty:
            return pd.DataFrame({"game_id": [], "subset": [], "coef": []})
        game, n, masks = int(frame["game_id"].iloc[0]), int(frame["n_items"].iloc[0]), frame["mask"].to_numpy("int64")
        x, y = design(masks, n), frame["value"].to_numpy(float)
        if loss == "als":
            return as_coefs(game, *als(x, y, rank, seed=seed, **how))
        weight = frame["weight"].to_numpy(float) if "weight" in frame else np.ones(len(y))
        return as_coefs(game, *gradient_fit(x, y, masks, weight, rank, loss, seed=seed, **how))

    return spread(train).groupBy("game_id").applyInPandas(run, COEFS)


def fold_of(masks: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """Even folds by a hash of the masks."""
    mixed = (masks.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return np.argsort(np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable"), kind="stable") % folds


def select_rank(train: DataFrame, ranks: tuple[int, ...] = (1, 2, 4, 8), criterion: str = "r2_delta", splits: int = 4, seed: int = 42, rounds: int = 100) -> DataFrame:
    """(game_id, rank, r2_util, r2_delta, mse_util, fallback, chosen) of each candidate rank.

    Folds are dealt by a hash. A fold counts for r2_delta if it has two neighbouring pairs or more; if no rank has a
    finite score, r2_util decides and `fallback` says so. Ties go to the lower rank.
    """
    if criterion not in ("r2_delta", "r2_util", "mse_util"):
        raise ValueError(f"unknown criterion {criterion!r}")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = ready(frame)
        game, n, masks = int(frame["game_id"].iloc[0]), int(frame["n_items"].iloc[0]), frame["mask"].to_numpy("int64")
        x, y = design(masks, n), frame["value"].to_numpy(float)
        fold = fold_of(masks, min(splits, max(2, len(y) // 4)), seed)
        rows = []
        for rank in ranks:
            util, delta, mse = [], [], []
            for k in range(fold.max() + 1 if len(y) > 1 else 0):
                a, b = fold != k, fold == k
                p = fm_predict(x[b], *als(x[a], y[a], rank, rounds, seed=seed))
                util.append(r2(y[b], p))
                mse.append(float(((y[b] - p) ** 2).mean()))
                if len(pair := neighbours(masks[b])) >= 2:
                    delta.append(r2(y[b][pair[:, 1]] - y[b][pair[:, 0]], p[pair[:, 1]] - p[pair[:, 0]]))
            mean = lambda xs: float(np.mean(ok)) if (ok := [v for v in xs if np.isfinite(v)]) else None
            rows.append({"game_id": game, "rank": rank, "r2_util": mean(util), "r2_delta": mean(delta), "mse_util": mean(mse)})
        score = lambda r, c: (-r[c] if c == "mse_util" else r[c]) if r[c] is not None else None
        by = criterion if any(score(r, criterion) is not None for r in rows) else "r2_util"
        best = max(rows, key=lambda r: (score(r, by) if score(r, by) is not None else -np.inf, -r["rank"]))
        for r in rows:
            r |= {"fallback": by != criterion, "chosen": r is best}
        return pd.DataFrame(rows)

    return spread(train).groupBy("game_id").applyInPandas(run, "game_id bigint, rank int, r2_util double, r2_delta double, mse_util double, fallback boolean, chosen boolean")


# What models give


def main_effects(coefs: DataFrame) -> DataFrame:
    one = coefs.where(F.bit_count("subset") == 1)
    return one.select("game_id", F.expr("cast(round(log2(subset)) as int)").alias("item_idx"), F.col("coef").alias("w"))


def attributions(coefs: DataFrame) -> DataFrame:
    """(game_id, item_idx, phi): main effect and half of each interaction; a model's Shapley values, up to order 2."""
    rows = coefs.where(F.bit_count("subset").isin(1, 2)).select("game_id", F.explode(bits.members(F.col("subset"), F.lit(62))).alias("item_idx"), (F.col("coef") / F.bit_count("subset")).alias("part"))
    return rows.groupBy("game_id", "item_idx").agg(F.sum("part").alias("phi"))


def predict(coefs: DataFrame, coalitions: DataFrame, order: int = 2) -> DataFrame:
    """(game_id, n_items, mask, predicted): sum of the coefficients of a mask's subsets. An equi-join on (game, subset)."""
    own = coalitions.select("game_id", "n_items", "mask").distinct()
    rows = own.select("*", F.explode(subsets(F.col("mask"), F.col("n_items"), order)).alias("subset"))
    return rows.join(coefs, ["game_id", "subset"]).groupBy("game_id", "n_items", "mask").agg(F.sum("coef").alias("predicted"))


def hybrid_shapley(coefs: DataFrame, known: DataFrame, games: DataFrame, power: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exact Shapley values of the game that has the true utility where it is known and the predicted one elsewhere."""
    guessed = predict(coefs, power(games))
    true = known.select("game_id", "mask", finite(F.col("value")).alias("value"))
    return shapley(guessed.join(true, ["game_id", "mask"], "left").select("game_id", "n_items", "mask", F.coalesce("value", "predicted").alias("value")))


def prune_interactions(pairs: DataFrame, mode: str = "topq", q: float = 0.2, tau: float | None = None) -> DataFrame:
    """`pairs` (game_id, i, j, value) and whether each is kept.

    none: all; topq: the ceil(q * pairs) largest by size, with those that tie with the last; thresh: of at least `tau`, by
    default the median size and 1.4826 times the median deviation from it.
    """
    size, game = F.abs("value"), Window.partitionBy("game_id")
    if mode == "none":
        return pairs.withColumn("kept", F.lit(True))
    if mode == "topq":
        least = F.greatest(F.lit(1), F.ceil(q * F.count(F.lit(1)).over(game)))
        return pairs.withColumn("kept", F.rank().over(game.orderBy(size.desc())) <= least)
    if mode != "thresh":
        raise ValueError(f"unknown mode {mode!r}")
    if tau is not None:
        return pairs.withColumn("kept", size >= tau)
    middle = pairs.groupBy("game_id").agg(F.percentile(size, F.lit(0.5)).alias("med"))
    off = pairs.join(middle, "game_id").groupBy("game_id", "med").agg(F.percentile(F.abs(size - F.col("med")), F.lit(0.5)).alias("mad"))
    return pairs.join(off, "game_id").select("game_id", "i", "j", "value", (size >= F.col("med") + 1.4826 * F.col("mad")).alias("kept"))


def pruned_attributions(effects: DataFrame, pruned: DataFrame) -> DataFrame:
    """(game_id, item_idx, phi): main effects and half of each interaction kept."""
    halves = pruned.where("kept").select("game_id", F.explode(F.array("i", "j")).alias("item_idx"), (F.col("value") / 2).alias("part"))
    return effects.select("game_id", "item_idx", F.col("w").alias("part")).unionByName(halves).groupBy("game_id", "item_idx").agg(F.sum("part").alias("phi"))
