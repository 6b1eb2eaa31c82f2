"""Axioms and closed forms on small random games, and edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import coalitions, exact, metrics, permutations, stats, surrogates

SCHEMA = "game_id bigint, n_items int, mask bigint, value double"


def game(spark, n, f, game_id=0):
    return spark.createDataFrame([(game_id, n, m, float(f(m))) for m in range(1 << n)], SCHEMA)


def random_game(spark, n, seed=1):
    rng = random.Random(seed)
    values = [rng.gauss(0, 1) for _ in range(1 << n)]
    return game(spark, n, values.__getitem__), values


def phi(df):
    return {r["item_idx"]: r["phi"] for r in df.collect()}


def pairs(df):
    return {(r["i"], r["j"]): r["value"] for r in df.collect()}


def test_shapley_is_efficient(spark):
    u, v = random_game(spark, 6)
    assert sum(phi(exact.shapley(u)).values()) == pytest.approx(v[63] - v[0])


def test_shapley_from_mobius(spark):
    u, _ = random_game(spark, 5)
    coefs = exact.mobius(u, 5)
    direct = phi(exact.shapley(u))
    part = {}
    for r in coefs.collect():
        for i in range(5):
            if r["subset"] >> i & 1:
                part[i] = part.get(i, 0) + r["coef"] / bin(r["subset"]).count("1")
    assert part == pytest.approx(direct)


def test_additive_game(spark):
    w = [1.0, -2.0, 0.0, 4.0]
    u = game(spark, 4, lambda m: sum(x for i, x in enumerate(w) if m >> i & 1))
    for f in (exact.shapley, exact.banzhaf, exact.leave_one_out):
        assert phi(f(u)) == pytest.approx(dict(enumerate(w)))
    assert all(abs(x) < 1e-12 for x in pairs(exact.shapley_interactions(u)).values())


@pytest.mark.parametrize("index", ["FSII", "FBII"])
def test_faithful_is_the_best_fit(spark, index):
    n = 5
    u, v = random_game(spark, n, 3)
    got = {r["subset"]: r["coef"] for r in exact.faithful(exact.mobius(u, n), index).collect()}
    subsets = [s for s in range(1 << n) if bin(s).count("1") <= 2]
    x = np.array([[float(s & m == s) for s in subsets] for m in range(1 << n)])
    size = np.array([bin(m).count("1") for m in range(1 << n)])
    w = np.ones(1 << n) if index == "FBII" else np.array([1e9 if z in (0, n) else (n - 1) / (math.comb(n, z) * z * (n - z)) for z in size])
    root = np.sqrt(w)[:, None]
    want = np.linalg.lstsq(root * x, root[:, 0] * np.array(v), rcond=None)[0]
    assert [got[s] for s in subsets] == pytest.approx(list(want), abs=1e-4)


def test_one_and_two_items(spark):
    one = game(spark, 1, lambda m: 3.0 * m + 1)
    assert phi(exact.shapley(one)) == {0: 3.0}
    assert exact.shapley_interactions(one).count() == 0
    two = game(spark, 2, lambda m: [0, 1, 2, 10][m])
    assert pairs(exact.shapley_interactions(two)) == {(0, 1): 7.0}


def test_missing_or_infinite_utilities_give_null(spark):
    u, _ = random_game(spark, 3)
    assert set(phi(exact.shapley(u.where("mask <> 5"))).values()) == {None}
    bad = u.withColumn("value", F.when(F.col("mask") == 7, F.lit(float("-inf"))).otherwise(F.col("value")))
    assert set(phi(exact.leave_one_out(bad)).values()) == {None}
    assert exact.worst_removal(u.withColumn("value", F.when(F.col("mask") == 1, F.lit(float("-inf"))).otherwise(F.col("value"))), 2).first()["removed"] != 6
    assert exact.shapley(u.limit(0)).count() == 0


def test_twins_and_null_players(spark):
    u = game(spark, 3, lambda m: float(m & 3 != 0))  # items 0 and 1 are copies, 2 does nothing
    got = phi(exact.shapley(u))
    assert got[0] == pytest.approx(got[1]) and got[2] == pytest.approx(0)
    assert pairs(exact.shapley_interactions(u))[0, 1] < 0


@pytest.mark.parametrize("method", ["uniform", "kernelshap", "bf", "bf_uniform", "bf_kernelshap"])
@pytest.mark.parametrize("budget", [1, 2, 7, 16, 99])
def test_samplers_keep_budgets(spark, method, budget):
    games = spark.createDataFrame([(0, 4), (1, 1)], "game_id bigint, n_items int")
    rows = coalitions.sample(games, budget, method).collect()
    for g, n in ((0, 4), (1, 1)):
        own = [r for r in rows if r["game_id"] == g]
        masks = [r["mask"] for r in sorted(own, key=lambda r: r["ord"])]
        assert len(masks) == len(set(masks)) == min(budget, 1 << n)
        assert masks[0] == 0 and (budget < 2 or masks[1] == (1 << n) - 1)


def test_too_many_items(spark):
    with pytest.raises(Exception, match="more than 20"):
        coalitions.powerset(spark.createDataFrame([(0, 21)], "game_id bigint, n_items int")).count()


def test_truncated_shapley(spark):
    u, v = random_game(spark, 4)
    games = u.select("game_id", "n_items").distinct()
    full = phi(permutations.truncated_shapley(games, u, 400, 0.0))
    assert full == pytest.approx(phi(exact.shapley(u)), abs=0.3)
    assert sum(full.values()) == pytest.approx(v[15] - v[0])
    few = permutations.truncated_shapley(games, u, 50, 0.0, budget=6).collect()
    assert {r["evaluations"] for r in few} == {6}
    flat = permutations.truncated_shapley(games, u, 10, 1e9).collect()  # only the first order counts, over ten
    assert max(abs(r["phi"]) for r in flat) < 2


def test_least_squares_against_numpy(spark):
    u, v = random_game(spark, 4, 5)
    x = np.array([[m >> i & 1 for i in range(4)] for m in range(16)], float)
    want = np.linalg.lstsq(np.c_[np.ones(16), x], np.array(v), rcond=None)[0]
    got = {r["subset"]: r["coef"] for r in surrogates.fit_least_squares(u).collect()}
    assert [got[0], *(got[1 << i] for i in range(4))] == pytest.approx(list(want))
    shrunk = surrogates.fit_least_squares(u, lasso=1e6).collect()
    assert all(r["coef"] == 0 for r in shrunk if r["subset"])
    some = u.where("mask in (0, 15)")
    assert surrogates.fit_least_squares(some).count() == 5


def test_pruning(spark):
    rows = spark.createDataFrame([(0, 0, 1, 3.0), (0, 0, 2, -3.0), (0, 1, 2, 0.5)], "game_id bigint, i int, j int, value double")
    kept = lambda *how: {(r["i"], r["j"]) for r in surrogates.prune_interactions(rows, *how).where("kept").collect()}
    assert kept("topq", 0.2) == {(0, 1), (0, 2)}  # ties with the last one stay
    assert kept("none") == {(0, 1), (0, 2), (1, 2)}
    with pytest.raises(ValueError):
        kept("hard")


def scores(spark, pred, truth):
    return spark.createDataFrame([(0, k, float(p), float(t)) for k, (p, t) in enumerate(zip(pred, truth, strict=True))], "q bigint, item_idx int, pred double, truth double")


def one(df):
    return df.first()["value"]


def test_ties_in_ranking_metrics(spark):
    tied = scores(spark, [1, 1, 0], [2, 0, 1])
    assert one(metrics.ndcg(tied, ["q"], 3, shift=False)) == pytest.approx((1 + 1 / math.log2(3) + 0.5) / (2 + 1 / math.log2(3)))
    assert one(metrics.average_precision(scores(spark, [1, 1, 0], [1, 0, 1]), ["q"])) == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert one(metrics.kendall(scores(spark, [1, 2, 2], [1, 2, 3]), ["q"])) == pytest.approx(2 / math.sqrt(2 * 3))
    assert one(metrics.spearman(scores(spark, [1, 2, 2], [1, 2, 3]), ["q"])) == pytest.approx(np.corrcoef([1, 2.5, 2.5], [1, 2, 3])[0, 1])


def test_undefined_metrics_are_null(spark):
    flat = scores(spark, [1, 1, 1], [2, 2, 2])
    for f in (metrics.pearson, metrics.spearman, metrics.kendall, metrics.r2, metrics.ndcg):
        assert one(f(flat, ["q"])) is None
    assert one(metrics.average_precision(scores(spark, [1, 2], [1, 1]), ["q"])) is None
    assert one(metrics.recall_at(scores(spark, [1, 2], [0, 0]), ["q"], 1)) is None
    assert one(metrics.recall_at(scores(spark, [3, 2, 1], [1, 1, 1]), ["q"], 1)) == pytest.approx(1 / 3)


def plain_p(d, exact_up_to=50):
    """p of differences by listing all signs, or by the normal approximation."""
    d = d[d != 0]
    size = np.abs(d)
    ranks = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
    low = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    ties = sum(float((size == x).sum()) ** 3 - (size == x).sum() for x in np.unique(size))
    return stats.signed_rank_p(len(d), low, ties, exact_up_to), low, ranks


def test_signed_rank_p():
    assert math.isnan(plain_p(np.array([1.0, 2, 3, 4, 5]))[0])
    assert plain_p(np.arange(1.0, 7))[0] == pytest.approx(2 / 64)
    d = np.array([1.0, -2, 3, 4, -5, 6, 7.5])
    p, low, ranks = plain_p(d)
    sums = [min(sum(r for r, s in zip(ranks, signs, strict=True) if s), sum(r for r, s in zip(ranks, signs, strict=True) if not s)) for signs in itertools.product([0, 1], repeat=len(d))]
    assert p == pytest.approx(np.mean([s <= low for s in sums]))
    x = np.random.default_rng(0).normal(0.3, 1, 60)
    assert plain_p(x, 60)[0] == pytest.approx(plain_p(x, 0)[0], abs=0.01)


def cells(spark, values, parts):
    rows = [(k, "m", name, None, v) for name, vs in values.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "qid bigint, metric string, method string, budget int, value double").repartition(parts)


def test_bootstrap(spark):
    x = np.random.default_rng(1).normal(0, 1, 300)
    values = {"none": [float("nan")], "one": [2.0, float("inf")], "many": x.tolist(), "same": [3.0] * 20}
    got = {r["method"]: r for r in stats.bootstrap_ci(cells(spark, values, 3), stats.CELL, times=4000).collect()}
    assert got["none"]["n"] == 0 and got["none"]["point"] is None and (got["one"]["low"], got["one"]["high"], got["one"]["n"]) == (2.0, 2.0, 1)
    assert got["same"]["low"] == pytest.approx(3) and got["same"]["high"] == pytest.approx(3)
    many = got["many"]
    assert many["point"] == pytest.approx(x.mean()) and many["low"] < many["point"] < many["high"]
    draws = np.array([np.random.default_rng(k).choice(x, 300).mean() for k in range(4000)])
    assert (many["low"], many["high"]) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])), abs=0.02)
    again = {r["method"]: r for r in stats.bootstrap_ci(cells(spark, values, 11), stats.CELL, times=4000).collect()}
    assert again["many"]["low"] == pytest.approx(many["low"]) and again["many"]["high"] == pytest.approx(many["high"])
    deviation = {r["method"]: r for r in stats.bootstrap_ci(cells(spark, values, 2), stats.CELL, stat="std", times=500).collect()}["many"]
    assert deviation["point"] == pytest.approx(x.std()) and deviation["low"] < x.std() < deviation["high"]


def test_utilities_in_conflict(spark, tmp_path):
    from tessera.sources import tables

    rows = [(1, "p", 2, 0, 1.5, "raw"), (1, "p", 2, 0, float("-inf"), "raw"), (1, "p", 2, 1, 1.0, "raw")]
    spark.createDataFrame(rows, tables.UTILITIES).write.parquet(str(tmp_path / "a"))
    assert {r["mask"]: r["value"] for r in tables.load_utilities(spark, str(tmp_path / "a")).collect()} == {0: 1.5, 1: 1.0}
    spark.createDataFrame([*rows, (1, "p", 2, 1, 7.0, "raw")], tables.UTILITIES).write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="two finite values"):
        tables.load_utilities(spark, str(tmp_path / "b")).collect()


def test_neighbours_in_blocks(spark):
    from tessera.operators.retrieval import nearest

    v = spark.createDataFrame([(k, k % 3, [float(k % 7), float(k * k % 11)]) for k in range(60)], "vec_id bigint, label int, embedding array<double>")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, nearest(v, q, 4).select("query_id", "vec_id", "place").collect()))
    assert whole == sorted(map(tuple, nearest(v, q, 4, block=2).select("query_id", "vec_id", "place").collect())) and len(whole) == 24


def test_wide_games_are_not_listed(spark):
    sizes = spark.createDataFrame([(1, 60), (2, 21), (3, 4)], "game_id bigint, n_items int")
    for method in ("uniform", "kernelshap", "bf", "bf_uniform", "bf_kernelshap"):
        rows = coalitions.sample(sizes, 50, method).collect()
        for game, n in ((1, 60), (2, 21), (3, 4)):
            masks = [r["mask"] for r in rows if r["game_id"] == game]
            assert len(masks) == len(set(masks)) == min(50, 2**n) and all(0 <= m < 2**n for m in masks)
    with pytest.raises(Exception, match="more than 60 items"):
        coalitions.sample(spark.createDataFrame([(1, 61)], "game_id bigint, n_items int"), 5).collect()


def test_detectable_effect():
    assert stats.detectable_effect(0.15, 100) == pytest.approx(0.042, abs=5e-4)
    assert stats.required_pairs(0.15, 0.042) == pytest.approx(100, abs=1)


def test_holm_and_pairs(spark):
    tests = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", None)], "f string, p double")
    assert sorted((r["p_holm"] for r in stats.holm(tests, ["f"]).where("p is not null").collect())) == pytest.approx([0.03, 0.06, 0.06])
    rows = [(q, "m", "x", None, float(q)) for q in range(8)] + [(q, "m", "y", None, 0.5) for q in range(3, 11)]
    metric = spark.createDataFrame(rows, "qid bigint, metric string, method string, budget int, value double")
    assert {r["qid"] for r in stats.aligned(metric, "x", "y").collect()} == {3, 4, 5, 6, 7}
    report = stats.paired_report(metric, "x", times=200).first()
    assert report["p"] is None and report["wins"] == 5 and report["low"] <= report["point"] <= report["high"]


def test_method_keys(spark):
    rows = spark.createDataFrame([("full_128",), ("Exact-FSII",), ("full_r2_delta_64",)], "k string")
    got = {r["k"]: (r["m"], r["b"]) for r in rows.select("k", stats.method_family(F.col("k")).alias("m"), stats.method_budget(F.col("k")).alias("b")).collect()}
    assert got == {"full_128": ("full", 128), "Exact-FSII": ("Exact-FSII", None), "full_r2_delta_64": ("full_r2_delta", 64)}
