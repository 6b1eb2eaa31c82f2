"""Sparse transforms, proxies, sampled interactions, patterns of any order, and games that must not lose parts in silence."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import exact, metrics, sparse
from tessera.operators.surrogates import neighbours
from tessera.plans import ablation

GAME = "game_id bigint, n_items int, mask bigint, value double"


def powers(spark, values, game=0):
    return [(game, int(math.log2(len(values))), m, float(v)) for m, v in enumerate(values)]


def test_sparse_games_of_sixty_items_are_found_from_few_coalitions(spark):
    rng = random.Random(2)
    planted = [(g, sum(1 << i for i in rng.sample(range(n), rng.randrange(1, 4))), float(rng.randrange(1, 99))) for g, n in ((1, 60), (-7, 45)) for _ in range(4)]
    planted += [(1, 0, 2.5)]
    coefs = spark.createDataFrame(planted, "game_id bigint, subset bigint, coef double").groupBy("game_id", "subset").agg(F.sum("coef").alias("coef"))
    games = spark.createDataFrame([(1, 60), (-7, 45)], "game_id bigint, n_items int")
    asked = []

    def provider(coalitions):
        asked.append(coalitions.count())
        return sparse.predict_patterns(coefs, coalitions).withColumnRenamed("predicted", "value")

    found = sparse.sparse_transform(games, provider, width=5)
    assert [r[0] for r in found.select("complete").distinct().collect()] == [True]
    assert asked[0] <= 2 * 3 * 32 * 64
    got = {(r["game_id"], r["subset"]): r["coef"] for r in sparse.to_mobius(found).where(F.abs("coef") > 1e-6).collect()}
    assert got == pytest.approx({(r["game_id"], r["subset"]): r["coef"] for r in coefs.collect()}, abs=1e-6)


def test_a_dense_game_is_said_to_be_incomplete_and_a_broken_one_has_no_rows(spark):
    games = spark.createDataFrame([(1, 30), (2, 30)], "game_id bigint, n_items int")
    noise = lambda rows: rows.withColumn("value", F.when((F.col("game_id") == 2) & (F.col("mask") % 3 == 0), F.lit(float("nan"))).otherwise(F.pmod(F.xxhash64("mask"), F.lit(1000)).cast("double")))
    found = sparse.sparse_transform(games, noise, width=3).collect()
    assert all(r["game_id"] == 1 and not r["complete"] for r in found)


def test_tree_coefficients_predict_what_the_trees_do(spark):
    rng = np.random.default_rng(4)
    train = spark.createDataFrame([(3, 6, int(m), float(v)) for m, v in zip(rng.permutation(64)[:40], rng.normal(size=40), strict=True)] + [(4, 6, 1, None)], GAME)
    leaves = sparse.boosted_leaves(train, trees=20, depth=3, rate=0.5)
    rows, coefs = leaves.collect(), {r["subset"]: r["coef"] for r in sparse.tree_coefficients(leaves).collect()}
    assert {r["game_id"] for r in rows} == {3}
    assert max(bin(s).count("1") for s in coefs) <= 3 * 1
    for m in range(64):
        trees = sum(r["value"] for r in rows if m & r["inside"] == r["inside"] and not m & r["outside"])
        assert trees == pytest.approx(sum(c for s, c in coefs.items() if s & m == s), abs=1e-9)
    got = sparse.strongest(sparse.tree_coefficients(leaves), 5).collect()
    assert len(got) == 5 and min(abs(r["coef"]) for r in got) >= sorted(map(abs, coefs.values()))[-5] - 1e-12
    errors = [sum((v - sum(r["value"] for r in rows if r["tree"] <= t and m & r["inside"] == r["inside"] and not m & r["outside"])) ** 2 for _, _, m, v in [tuple(x) for x in train.where("game_id = 3").collect()]) for t in (0, 5, 20)]
    assert errors[0] > errors[1] > errors[2]


def brute_interaction(values, n, k):
    own = [i for i in range(n) if k >> i & 1]
    rest, total = [i for i in range(n) if not k >> i & 1], 0.0
    for size in range(len(rest) + 1):
        for s in itertools.combinations(rest, size):
            m = sum(1 << i for i in s)
            delta = sum((-1) ** (len(own) - len(t)) * values[m | sum(1 << i for i in t)] for q in range(len(own) + 1) for t in itertools.combinations(own, q))
            total += delta * math.factorial(size) * math.factorial(n - size - len(own)) / math.factorial(n - len(own) + 1)
    return total


def test_interactions_of_order_three_are_exact_with_all_coalitions_and_near_with_few(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(size=256).tolist()
    u = spark.createDataFrame(powers(spark, values), GAME)
    games = u.select("game_id", "n_items").distinct()
    off = []
    for budget in (256, 180, 80):
        errors = []
        for seed in range(1 if budget == 256 else 6):
            drawn = sparse.by_size(games, budget, seed).join(u.select("game_id", "mask", "value"), ["game_id", "mask"])
            assert drawn.count() <= budget + 18
            rows = sparse.interactions(drawn, 3).collect()
            assert len(rows) == 8 + 28 + 56
            errors += [(r["value"] - brute_interaction(values, 8, r["subset"])) ** 2 for r in rows[::5]]
            assert budget < 256 or all(r["variance"] == 0 for r in rows)
        off.append(float(np.mean(errors)))
    assert off[0] < 1e-18 < off[1] < off[2]


def test_a_missing_utility_makes_interactions_null(spark):
    u = spark.createDataFrame([(0, 2, m, float("inf") if m == 1 else 1.0) for m in range(4)], GAME)
    drawn = sparse.by_size(u.select("game_id", "n_items").distinct(), 4).join(u.select("game_id", "mask", "value"), ["game_id", "mask"])
    assert all(r["value"] is None for r in sparse.interactions(drawn).collect())


def test_patterns_of_any_order_against_all_pairs(spark):
    rng = random.Random(9)
    coefs = [(g, rng.randrange(1 << 12), float(k)) for k, g in enumerate([1, 1, 1, 2, 2] * 8)] + [(1, 0, 7.0), (1, (1 << 12) - 1, 3.0), (3, 1 << 40, 1.0)]
    masks = [(g, 12, rng.randrange(1 << 12)) for g in (1, 2, 3, 4) for _ in range(60)] + [(1, 12, 0), (1, 12, (1 << 12) - 1)]
    got = sparse.predict_patterns(spark.createDataFrame(coefs, "game_id bigint, subset bigint, coef double"), spark.createDataFrame(masks, "game_id bigint, n_items int, mask bigint"))
    want = {(g, m): sum(c for h, s, c in coefs if h == g and s & m == s) for g, _, m in masks}
    assert {(r["game_id"], r["mask"]): r["predicted"] for r in got.collect()} == pytest.approx(want)


def test_divergences_of_positions_add_up(spark):
    one = [(1, 0, "a", 0.5), (1, 0, "b", 0.5), (1, 2, "a", 0.9), (1, 2, "c", 0.1)]
    alone = exact.divergence_of_sets(spark.createDataFrame(one, "game_id bigint, gone bigint, token string, p double")).first()["jsd"]
    both = spark.createDataFrame([(*r, at) for r in one for at in (0, 1)], "game_id bigint, gone bigint, token string, p double, position int")
    assert exact.divergence_of_sets(both).first()["jsd"] == pytest.approx(2 * alone)


def test_subset_sums_refuse_what_they_would_cut(spark):
    wide = spark.createDataFrame([(0, 22, 0, 1.0), (0, 22, 1, 2.0)], GAME)
    with pytest.raises(PySparkException, match="more than 20 items"):
        exact.mobius(wide).collect()
    assert {r["subset"]: r["coef"] for r in exact.mobius(wide.where("mask < 2"), most_items=24).where("subset < 2").collect()} == {0: 1.0, 1: 1.0}


def test_grid_keeps_games_of_any_id_and_has_all_variants(spark):
    rng = np.random.default_rng(1)
    ids = (-3, 10**15, 7)
    rows = [r for g in ids for r in powers(spark, np.cumsum(rng.random(32)).tolist(), g)]
    chosen = [v for v in ablation.VARIANTS if v.name in ("full", "rank 2", "rank by gold", "pruned by share")]
    got = ablation.grid(spark.createDataFrame(rows, GAME), [20], chosen).where("metric = 'ndcg_items'").collect()
    assert {(r["qid"], r["method"]) for r in got} == {(g, v.name) for g in ids for v in chosen}
    best = {r["qid"]: r["value"] for r in got if r["method"] == "rank by gold"}
    assert all(r["value"] <= best[r["qid"]] + 1e-9 for r in got if r["method"] in ("full", "rank 2"))


def test_gradient_fits_stand_still_where_they_end(spark):
    """The fit by utilities, again from numpy alone: no direction lowers its loss by much."""
    from tessera.operators import surrogates

    rng = np.random.default_rng(3)
    masks = np.arange(32)
    x = surrogates.design(masks, 5)
    y = x @ rng.normal(size=5) + 0.3 * x[:, 0] * x[:, 3]
    w0, w, v = surrogates.gradient_fit(x, y, masks, np.ones(32), 2, "utility", steps=4000, l2=0.0)
    p = surrogates.fm_predict(x, w0, w, v)
    assert np.abs(x.T @ (p - y) / 32).max() < 1e-3 and np.abs(p - y).max() < 0.05
    w0, w, v = surrogates.gradient_fit(x, y, masks, np.ones(32), 2, "delta", steps=4000, l2=0.0)
    pair = neighbours(masks)
    p = surrogates.fm_predict(x, w0, w, v)
    assert np.abs((p[pair[:, 1]] - p[pair[:, 0]]) - (y[pair[:, 1]] - y[pair[:, 0]])).max() < 0.05


def test_signs_are_compared_where_both_are_strong(spark):
    values = {"a": [4.0, -3.0, 0.1, None], "b": [2.0, 1.5, -2.0, 1.0]}
    rows = [(9, p, 0, j + 1, v) for p, vs in values.items() for j, v in enumerate(vs)] + [(8, p, 0, 1, 0.0) for p in values]
    got = metrics.interaction_agreement_matrix(spark.createDataFrame(rows, "game_id bigint, provider string, i int, j int, value double"), k=2).collect()
    assert len(got) == 1 and (got[0]["left"], got[0]["right"]) == ("a", "b")
    assert (got[0]["n_strong"], got[0]["sign_agree"]) == (1.0, 0.5) and got[0]["weak_frac"] == pytest.approx((1 + 1 / 3) / 2)
    assert metrics.interaction_agreement_matrix(spark.createDataFrame([], "game_id bigint, provider string, i int, j int, value double")).count() == 0
