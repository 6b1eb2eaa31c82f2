"""Joint choice of rank and blend."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import tuning
from tessera.operators.surrogates import design

PAIRS = "game_id bigint, n_items int, pair bigint, side int, mask bigint, value double"


def rows(game, n, value):
    return [(game, n, m, side, m ^ (side << m % n), float(value(m ^ (side << m % n)))) for m in range(1 << n) for side in (0, 1)]


@pytest.mark.parametrize("beta", [0.0, 0.5, 1.0])
def test_linear_fits_solve_the_normal_equations(beta):
    rng = np.random.default_rng(3)
    masks = np.array([m ^ (s << m % 4) for m in range(16) for s in (0, 1)])
    x, y = design(masks, 4), rng.random(32)
    w0, w, _ = tuning.blended_fit(x, y, 0, beta, 0.0, 0.0, 5000, 1)
    a = np.c_[np.ones(32), x]
    stack = np.vstack([a * np.sqrt((1 - beta) / 32), (a[1::2] - a[::2]) * np.sqrt(beta / 16)])
    want = np.linalg.lstsq(stack, np.r_[y * np.sqrt((1 - beta) / 32), (y[1::2] - y[::2]) * np.sqrt(beta / 16)], rcond=None)[0]
    assert w == pytest.approx(want[1:], abs=1e-6)
    assert w0 == pytest.approx((y - x @ w).mean() if beta == 1 else want[0], abs=1e-6)


def test_choice_and_fit(spark):
    product = lambda m: 2 * (m & 1) + 3.0 * ((m & 3) == 3) + 1.5 * ((m & 12) == 12)
    data = rows(1, 4, lambda m: bin(m).count("1")) + rows(-2, 4, product) + rows(3, 1, lambda m: m)[:2] + [(4, 2, 0, 0, 0, float("nan")), (4, 2, 0, 1, 1, 1.0)]
    pairs = spark.createDataFrame(data, PAIRS).withColumn("rank", F.lit("clash"))
    scores = tuning.tuning_scores(pairs.drop("rank"), (0, 2), (0.0, 0.5), l2_w=1e-9, l2_v=1e-9, rounds=2000)
    assert scores.count() == 2 * 4 * 4
    assert tuning.tuning_scores(pairs, (0,), (0.5,), rounds=5).count() == 2 * 4
    for zscored in (False, True):
        got = {r["game_id"]: r for r in tuning.choose(scores, zscored).collect()}
        assert set(got) == {1, -2} and got[-2]["rank"] == 2 and got[1]["loss"] < 1e-6
    coefs = {(r[0], r[1]): r[2] for r in tuning.fit_tuned(pairs, tuning.choose(scores), 1e-9, 1e-9, 4000).collect()}
    assert coefs[(-2, 3)] == pytest.approx(3, abs=0.1) and coefs[(-2, 12)] == pytest.approx(1.5, abs=0.1)
    assert coefs[(1, 1)] == pytest.approx(1, abs=0.05)


def test_flipped_pairs_and_no_rows(spark):
    own = spark.createDataFrame([(1, 5, 9), (1, 5, 9), (2, 60, 1 << 58)], "game_id bigint, n_items int, mask bigint")
    got = tuning.flipped_pairs(own).groupBy("game_id", "pair").agg(F.bit_xor("mask").alias("x"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 2 and all(bin(r["x"]).count("1") == 1 and r["n"] == 2 for r in got)
    none = spark.createDataFrame([], PAIRS)
    assert tuning.tuning_scores(none).count() == 0 and tuning.fit_tuned(none, tuning.choose(tuning.tuning_scores(none))).count() == 0
