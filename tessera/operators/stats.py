"""Statistics over many questions. `metrics`: qid, metric, method, budget (null for methods without one), value.

Frames handed to numpy are rows of a task or sums of a cell, never all rows of one; everything else is aggregates and
windows. Values that are null, NaN or infinite never count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import ranks
from tessera.operators.exact import finite
from tessera.operators.metrics import correlation
from tessera.sources.scratch import kept

CELL = ["metric", "method", "budget"]


def method_family(key: Column) -> Column:
    """The part of "family_budget" before the last number; the key itself if there is none."""
    got = F.regexp_extract(key, r"^(.+?)_(\d+)$", 1)
    return F.when(got != "", got).otherwise(key)


def method_budget(key: Column) -> Column:
    """The number at the end of "family_budget", null if there is none."""
    got = F.regexp_extract(key, r"^(.+?)_(\d+)$", 2)
    return F.when(got != "", got.cast("int"))


def long_metrics(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Columns as rows (metric, value), the finite ones."""
    rows = wide.unpivot(keys, names, "metric", "value")
    return rows.where(finite(F.col("value").cast("double")).isNotNull())


def by_k(lists: DataFrame, keys: list[str], values: str, ks: list[int]) -> DataFrame:
    """An array with a value for each k as rows (k, value)."""
    rows = lists.select(*keys, F.posexplode(values).alias("at", "value")).where(F.col("at") < len(ks))
    return rows.select(*keys, F.element_at(F.array(*map(F.lit, ks)), F.col("at") + 1).alias("k"), "value")


def budget_is(budget: int | None) -> Column:
    return F.col("budget").eqNullSafe(F.lit(budget).cast("int"))


def aligned(metrics: DataFrame, left: str, right: str) -> DataFrame:
    """(metric, budget, qid, x, y): values of two methods on the questions that both have."""
    one, two = (metrics.where(F.col("method") == m).select("metric", "budget", "qid", finite(F.col("value")).alias(c)) for m, c in ((left, "x"), (right, "y")))
    two = two.withColumnsRenamed({c: f"r_{c}" for c in ("metric", "budget", "qid")})
    on = F.col("metric").eqNullSafe(F.col("r_metric")) & F.col("budget").eqNullSafe(F.col("r_budget")) & F.col("qid").eqNullSafe(F.col("r_qid"))
    return one.join(two, on).where("x is not null and y is not null").select("metric", "budget", "qid", "x", "y")


def against(metrics: DataFrame, base: str) -> DataFrame:
    """(metric, budget, method, qid, x, y): `base` beside every other method, question by question."""
    own = metrics.where(F.col("method") == base).select(F.col("metric").alias("m"), F.col("budget").alias("b"), F.col("qid").alias("q"), finite(F.col("value")).alias("x"))
    rest = metrics.where(F.col("method") != base).select("metric", "budget", "method", "qid", finite(F.col("value")).alias("y"))
    on = F.col("metric").eqNullSafe(F.col("m")) & F.col("budget").eqNullSafe(F.col("b")) & F.col("qid").eqNullSafe(F.col("q"))
    return rest.join(own, on).where("x is not null and y is not null").select("metric", "budget", "method", "qid", "x", "y")


def summary(metrics: DataFrame) -> DataFrame:
    """n, mean and population deviation of each (metric, method, budget), budgets that are null first."""
    v = finite(F.col("value"))
    return metrics.groupBy(*CELL).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd")).orderBy("metric", "method", F.col("budget").asc_nulls_first())


def interval_summary(metrics: DataFrame, **how) -> DataFrame:
    """summary() with the interval of each mean: metric, method, budget, n, mean, sd, low, high; null budgets first."""
    base, found = summary(metrics), bootstrap_ci(metrics, CELL, **how).select(*(F.col(c).alias(f"i_{c}") for c in CELL), "low", "high")
    on = F.lit(True)
    for c in CELL:
        on = on & F.col(c).eqNullSafe(F.col(f"i_{c}"))
    return base.join(found, on, "left").select(*base.columns, "low", "high").orderBy("metric", "method", F.col("budget").asc_nulls_first())


def series(metrics: DataFrame, metric: str, method: str, budget: int | None = None, any_budget: bool = False) -> DataFrame:
    """(qid, value): a method's finite values in the order of the questions, at a budget (None: rows without one) or, with
    `any_budget`, at all of them."""
    rows = metrics.where((F.col("metric") == metric) & (F.col("method") == method))
    rows = rows if any_budget else rows.where(budget_is(budget))
    return rows.select("qid", finite(F.col("value")).alias("value")).where("value is not null").orderBy("qid", "value")


def deviations(metrics: DataFrame) -> DataFrame:
    """n, mean, sample deviation and standard error of each cell."""
    v = finite(F.col("value"))
    return metrics.groupBy(*CELL).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))


def variance_report(metrics: DataFrame) -> DataFrame:
    """deviations() and the interquartile range."""
    ends = ranks.quantiles(metrics.withColumn("value", finite(F.col("value"))), CELL, "value", low=0.25, high=0.75)
    return ranks.joined(deviations(metrics), ends.select(*CELL, (F.col("high") - F.col("low")).alias("iqr")), CELL)


def win_tie_loss(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, x, y): wins of x, ties, losses, the share of wins without ties, mean and median of x - y."""
    rows = pairs.select(*keys, (F.col("x") - F.col("y")).alias("d"))
    d = F.col("d")
    wins, losses = F.count_if(d > 0), F.count_if(d < 0)
    base = rows.groupBy(*keys).agg(wins.alias("wins"), F.count_if(d == 0).alias("ties"), losses.alias("losses"), F.when(wins + losses > 0, wins / (wins + losses)).alias("win_excl_ties"), F.avg(d).alias("mean_diff"))
    return ranks.joined(base, ranks.quantiles(rows, keys, "d", median_diff=0.5), keys)


def rank_sums(pairs: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """The signed-rank sums of x - y: n (all pairs), nonzero, r_pos, r_neg, effect, win_rate, and tied, the sum of t**3 - t
    over equal sizes; null under `least` non-zero pairs."""
    rows = pairs.select(*keys, (F.col("x") - F.col("y")).alias("d"))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("d") > 0).cast("double")).alias("win_rate"))
    sizes = ranks.value_counts(rows.where("d <> 0").withColumn("size", F.abs("d")), keys, "size", above=(F.col("d") > 0).cast("bigint"))
    t, r = F.col("n").cast("double"), ranks.average_rank()
    sums = sizes.groupBy(*keys).agg(F.sum("n").alias("nonzero"), F.sum(r * F.col("above")).alias("r_pos"), F.sum(r * (F.col("n") - F.col("above"))).alias("r_neg"), F.sum(t * t * t - t).alias("tied"))
    both = ranks.joined(base, sums, keys).withColumn("nonzero", F.coalesce("nonzero", F.lit(0).cast("bigint")))
    enough = F.col("nonzero") >= least
    effect = (F.col("r_pos") - F.col("r_neg")) / (F.col("r_pos") + F.col("r_neg"))
    return both.select(*keys, "n", "nonzero", *(F.when(enough, F.col(c)).alias(c) for c in ("r_pos", "r_neg")), F.when(enough, effect).alias("effect"), "win_rate", F.when(enough, F.col("tied")).alias("tied"))


def signed_rank(pairs: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """rank_sums() without the term of ties."""
    return rank_sums(pairs, keys, least).drop("tied")


def signed_rank_p(n: int, low: float, tied: float, exact_up_to: int = 50) -> float:
    """Two-sided p from the number of non-zero pairs, the smaller rank sum, and the sum of t**3 - t over ties: exact
    without ties up to so many pairs, else the normal approximation with the tie correction."""
    if n < 6:
        return float("nan")
    if n <= exact_up_to and not tied:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48)
    return float(math.erfc(abs(low - n * (n + 1) / 4) / spread / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def p_values(n: pd.Series, low: pd.Series, tied: pd.Series) -> pd.Series:
    found = [signed_rank_p(int(a), float(b), float(c)) if b is not None and not math.isnan(b) else None for a, b, c in zip(n, low, tied, strict=True)]
    return pd.Series([None if x is None or math.isnan(x) else x for x in found], dtype="float64")


def wilcoxon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """signed_rank() and its p, which takes a row a cell: the rank sums and the tie term are aggregates."""
    return rank_sums(pairs, keys).withColumn("p", p_values("nonzero", F.least("r_pos", "r_neg"), F.coalesce("tied", F.lit(0.0)))).drop("tied")


def holm(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """`tests` with p_holm, corrected within each `family`; null p values aren't tests."""
    real, none = tests.where(F.col(p).isNotNull()), tests.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double"))
    game = Window.partitionBy(*family)
    order = game.orderBy(p, F.xxhash64(*tests.columns))
    step = (F.count(F.lit(1)).over(game) - F.row_number().over(order) + 1) * F.col(p)
    rows = real.withColumn("step", step)
    rows = rows.withColumn("p_holm", F.least(F.lit(1.0), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")
    return rows.unionByName(none)


#: Statistics of a resample: the first three from weighted sums of 1, x and x * x, the last from weighted ranks.
STATS = ("mean", "sum", "std", "median")
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Equal values that get one weight together, cells whose sums a task holds before it hands them on, and tasks whose sums
#: are merged at once.
LOT, HELD_CELLS, MERGED = 4096, 256, 64


@lru_cache(maxsize=LOT)
def poisson_steps(mean: int) -> np.ndarray:
    """The distribution function of a Poisson number up to where it is 1 in doubles."""
    k = np.arange(1, mean + 12 * math.isqrt(mean) + 24)
    return np.cumsum(np.exp(np.concatenate([[-mean], np.cumsum(math.log(mean) - np.log(k)) - mean])))


def poisson_weights(rows: np.ndarray, copies: np.ndarray, start: int, stop: int, seed: int) -> np.ndarray:
    """How often the copies of each row (a 64-bit hash) occur together in each of the resamples `start` to `stop`: a Poisson
    number whose mean is their number, of row and resample alone."""
    with np.errstate(over="ignore"):
        x = rows.view(np.uint64)[:, None] + (np.arange(start, stop, dtype=np.uint64) + np.uint64(1) + np.uint64(seed << 32))[None] * GOLDEN
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    out = np.empty(u.shape)
    for m in np.unique(copies):
        out[copies == m] = np.searchsorted(poisson_steps(int(m)), u[copies == m], side="right")
    return out


def of_sums(stat: str, w: np.ndarray, wx: np.ndarray, wxx: np.ndarray, n: int) -> np.ndarray:
    """A statistic of resamples from their weighted sums; NaN for one without rows."""
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = wx / w
        return mean if stat == "mean" else mean * n if stat == "sum" else np.sqrt(np.maximum(wxx / w - mean * mean, 0))


def cells_of(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The cells of a frame by a key that null is part of, once."""
    for _, cell in frame.groupby(keys, dropna=False, sort=False):
        yield tuple(None if pd.isna(v) else v for v in cell[keys].iloc[0]), cell


def added(frame: pd.DataFrame, shape: tuple[int, ...], column: str = "sums") -> np.ndarray:
    return np.sum([np.frombuffer(b).reshape(shape) for b in frame[column]], axis=0)


def lots(metrics: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, x, copies, row): the different values of each cell, with how often they occur, LOT at most a row."""
    alike = metrics.select(*keys, finite(F.col(value).cast("double")).alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("all"))
    rows = alike.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("all") - 1) / LOT))).alias("lot"))
    copies = F.when(F.col("x").isNull(), 0).otherwise(F.least(F.lit(LOT), F.col("all") - F.col("lot") * LOT))
    return rows.select(*keys, "x", copies.cast("bigint").alias("copies"), F.xxhash64(*keys, "x", "lot").alias("row"))


def bootstrap_ci(metrics: DataFrame, keys: list[str], value: str = "value", stat: str = "mean", times: int = 10_000, alpha: float = 0.05, seed: int = 42, block: int = 1 << 21) -> DataFrame:
    """(keys, n, point, low, high): percentile intervals of mean, sum, (population) std or median.

    A resample gives equal values together a Poisson weight whose mean is their number, which depends on the seed, the
    cell, the value and the resample alone. So tasks add up weighted sums of whatever rows they have; each hands on three
    sums a resample and cell, once, and these are merged some at a time: no cell is one task's. Medians take two passes,
    see medians(). One value is its own interval, none gives nulls.
    """
    if stat not in STATS:
        raise ValueError(f"unknown statistic {stat!r}; known: {STATS}")
    kinds = dict(metrics.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    rows = lots(metrics, keys, value)
    if stat == "median":
        return medians(rows, keys, schema, times, alpha, seed, block)
    facts = ["n", "s", "ss", "only"]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held = TaskContext.get().partitionId() // MERGED, {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame([(*k, task, *own[0], own[1].tobytes()) for k, own in held.items()], columns=[*keys, "task", *facts, "sums"])
            held.clear()
            return out

        for frame in frames:
            for key, cell in cells_of(frame, keys):
                good = cell[cell["copies"] > 0]
                x, row, copies = good["x"].to_numpy(float), good["row"].to_numpy("int64"), good["copies"].to_numpy("int64")
                own = held.setdefault(key, [np.array([0.0, 0.0, 0.0, np.nan]), np.zeros((3, times))])
                own[0][:3] += [copies.sum(), copies @ x, copies @ (x * x)]
                own[0][3] = x[0] if len(x) else own[0][3]
                step = max(1, block // max(1, len(x)))
                for at in range(0, times if len(x) else 0, step):
                    w = poisson_weights(row, copies, at, min(times, at + step), seed)
                    own[1][:, at : at + step] += np.stack([w.sum(0), x @ w, (x * x) @ w])
            if len(held) >= HELD_CELLS:
                yield hand_on()
        yield hand_on()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        only = frame["only"].dropna()
        out = frame[keys].iloc[:1].reset_index(drop=True)
        return out.assign(**{c: float(frame[c].sum()) for c in facts[:3]}, only=float(only.iloc[0]) if len(only) else np.nan, sums=[added(frame, (3, times)).tobytes()])

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        own = merged(frame).iloc[0]
        n, out = int(own["n"]), frame[keys].iloc[:1].reset_index(drop=True)
        if n < 2:
            one = (0.0 if stat == "std" else float(own["only"])) if n else None
            return out.assign(n=n, point=one, low=one, high=one)
        low, high = np.nanpercentile(of_sums(stat, *np.frombuffer(own["sums"]).reshape(3, times), n), [50 * alpha, 100 - 50 * alpha])
        point = of_sums(stat, np.array([float(n)]), np.array([own["s"]]), np.array([own["ss"]]), n)[0]
        return out.assign(n=n, point=float(point), low=float(low), high=float(high))

    held = "n double, s double, ss double, only double, sums binary"
    partial = rows.mapInPandas(sums, f"{schema}, task int, {held}").groupBy(*keys, "task").applyInPandas(merged, f"{schema}, {held}")
    return partial.groupBy(*keys).applyInPandas(interval, f"{schema}, n bigint, point double, low double, high double")


def medians(rows: DataFrame, keys: list[str], schema: str, times: int, alpha: float, seed: int, block: int) -> DataFrame:
    """bootstrap_ci() of medians, from lots() of values: weighted order statistics of all resamples at once.

    Values are dealt by ranges of (cell, value). A first pass adds up each range's weights by resample, their sums up to a
    range say which resamples have their middle in it, and a second pass looks for the middle there. The cell itself, each
    value as often as it occurs, is one resample more, whose median is the point. An even number of values has two in the
    middle, whose mean counts. What one task gets of a cell is a range of it, or a row of sums for each of its ranges.
    """
    wide = times + 1
    ranged = kept(rows.repartitionByRange(*keys, F.col("x").asc_nulls_first(), "row").withColumn("place", F.spark_partition_id()), "value-ranges")
    group = [*keys, "place"]

    def weights(good: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        row, copies = good["row"].to_numpy("int64"), good["copies"].to_numpy("int64")
        step = max(1, block // max(1, len(row)))
        yield 0, copies[:, None].astype(float)
        for at in range(0, times, step):
            yield at + 1, poisson_weights(row, copies, at, min(times, at + step), seed)

    def range_sums(frame: pd.DataFrame) -> pd.DataFrame:
        total, good = np.zeros(wide), frame[frame["copies"] > 0]
        for at, w in weights(good) if len(good) else ():
            total[at : at + w.shape[1]] = w.sum(0)
        return frame[group].iloc[:1].reset_index(drop=True).assign(sums=[total.tobytes()])

    def offsets(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place").reset_index(drop=True)
        own = np.array([np.frombuffer(b) for b in frame["sums"]])
        before = np.cumsum(own, axis=0) - own
        return frame[group].assign(before=[b.tobytes() for b in before], total=own.sum(0).tobytes())

    def found(here: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        good = here[here["copies"] > 0].sort_values(["x", "row"])
        before, total = np.frombuffer(sums["before"].iloc[0]), np.frombuffer(sums["total"].iloc[0])
        middle, x = np.zeros((2, wide)), good["x"].to_numpy(float)
        for at, w in weights(good) if len(good) else ():
            ends, cut = np.cumsum(w, axis=0), slice(at, at + w.shape[1])
            for side, wanted in enumerate((np.floor((total[cut] - 1) / 2), np.floor(total[cut] / 2))):
                local = wanted - before[cut]
                inside = (local >= 0) & (local < ends[-1]) & (total[cut] > 0)
                middle[side, cut] = np.where(inside, x[np.minimum((ends <= local).sum(0), len(x) - 1)], 0.0)
        return here[keys].iloc[:1].reset_index(drop=True).assign(total=[total.tobytes()], sums=[middle.tobytes()])

    def interval(frame: pd.DataFrame) -> pd.DataFrame:
        total, middle = np.frombuffer(frame["total"].iloc[0]), added(frame, (2, wide)).mean(axis=0)
        n, out = int(total[0]), frame[keys].iloc[:1].reset_index(drop=True)
        low, high = np.percentile(middle[1:][total[1:] > 0], [50 * alpha, 100 - 50 * alpha]) if n > 1 else (middle[0], middle[0])
        return out.assign(n=n, **{c: float(v) if n else None for c, v in (("point", middle[0]), ("low", low), ("high", high))})

    sums = ranged.groupBy(*group).applyInPandas(range_sums, f"{schema}, place int, sums binary")
    before = sums.groupBy(*keys).applyInPandas(offsets, f"{schema}, place int, before binary, total binary")
    middles = ranged.groupBy(*group).cogroup(before.groupBy(*group)).applyInPandas(found, f"{schema}, total binary, sums binary")
    return middles.groupBy(*keys).applyInPandas(interval, f"{schema}, n bigint, point double, low double, high double")


def paired_bootstrap_ci(pairs: DataFrame, keys: list[str], **how) -> DataFrame:
    """Interval of the mean of x - y."""
    own = [c for c in pairs.columns if c not in (*keys, "x", "y")]
    return bootstrap_ci(pairs.select(*keys, *own, (F.col("x") - F.col("y")).alias("value")), keys, **how)


def contributions(metrics: DataFrame, full: str, **how) -> DataFrame:
    """What each part adds: interval of the full system minus a variant without it; `starred` if that excludes 0."""
    got = paired_bootstrap_ci(against(metrics, full), ["metric", "budget", "method"], **how)
    return got.withColumn("starred", (F.col("low") > 0) | (F.col("high") < 0))


def paired_report(metrics: DataFrame, base: str, family: tuple[str, ...] = ("metric", "budget"), **how) -> DataFrame:
    """`base` against every other method: interval, wins, signed ranks, p and its Holm correction within `family`."""
    keys, pairs = ["metric", "budget", "method"], against(metrics, base)
    out = holm(wilcoxon(pairs, keys), list(family))
    for more in (paired_bootstrap_ci(pairs, keys, **how).drop("n"), win_tie_loss(pairs, keys)):
        named = more.withColumnsRenamed({k: f"k_{k}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
        out = out.join(named, on).drop(*(f"k_{k}" for k in keys))
    return out


def power_factor(power: float, alpha: float) -> float:
    """The normal quantiles of a two-sided test and of its power, together."""
    z = NormalDist().inv_cdf
    return z(1 - alpha / 2) + z(power)


def effect_of(sd: Column, n: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """detectable_effect() as a column; null without pairs."""
    return F.when(n > 0, power_factor(power, alpha) * sd / F.sqrt(n))


def pairs_for(sd: Column, effect: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """required_pairs() as a column; null for no effect."""
    return F.when(effect != 0, F.ceil(F.pow(power_factor(power, alpha) * sd / effect, 2)))


def detectable_effect(sd: float, n: int, power: float = 0.8, alpha: float = 0.05) -> float:
    """Least mean difference that n pairs show with this power."""
    return power_factor(power, alpha) * sd / math.sqrt(n)


def required_pairs(sd: float, effect: float, power: float = 0.8, alpha: float = 0.05) -> int:
    return math.ceil((power_factor(power, alpha) * sd / effect) ** 2)


def paired_correlation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(correlation("x", "y").alias("value"))


def budget_table(metrics: DataFrame, budgets: list[int]) -> DataFrame:
    """(metric, method, a column for each budget): means."""
    return metrics.groupBy("metric", "method").pivot("budget", budgets).agg(F.avg(finite(F.col("value"))))


def by_k_table(metrics: DataFrame, budget: int, ks: list[int]) -> DataFrame:
    """(metric, method, a column for each k): means at one budget and of methods without one."""
    return at_budget(metrics, budget).groupBy("metric", "method").pivot("k", ks).agg(F.avg(finite(F.col("value"))))


def detectable_effects(metrics: DataFrame, power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """(metric, method, budget, n, effect): the least mean difference that each cell's number of questions shows, by its own deviation."""
    rows = deviations(metrics)
    return rows.select(*CELL, "n", (power_factor(power, alpha) * F.col("sem")).alias("effect"))


def at_budget(metrics: DataFrame, budget: int) -> DataFrame:
    """Rows of one budget and of methods without one."""
    return metrics.where((F.col("budget") == budget) | F.col("budget").isNull())
