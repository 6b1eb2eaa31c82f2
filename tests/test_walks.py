"""Walks that go on a step a round, beside walks in turn over a table."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import permutations, walks

GAME = "game_id bigint, n_items int, mask bigint, value double"


def look_up(known, asked):
    def score(coalitions):
        asked.append(sorted((r["game_id"], r["mask"]) for r in coalitions.collect()))
        return coalitions.join(known.select("game_id", "mask", "value"), ["game_id", "mask"])

    return score


@pytest.mark.parametrize("tolerance,budget", [(0.3, 9), (0.0, None), (0.5, 2)])
def test_equal_to_walks_in_turn(spark, tolerance, budget):
    rng = random.Random(5)
    rows = [(g, n, m, min(1.0, bin(m).count("1") / n + rng.random() / 3)) for g, n in ((-1, 3), (2, 4), (1 << 50, 1)) for m in range(1 << n)]
    rows = [(g, n, m, float("inf") if (g, m) == (2, 5) else v) for g, n, m, v in rows if (g, m) != (2, 6)]
    known = spark.createDataFrame(rows, GAME)
    games = known.select("game_id", "n_items").distinct()
    want = {(r[0], r[1]): (pytest.approx(r[2]), r[3]) for r in permutations.truncated_shapley(games, known, 4, tolerance, budget).collect()}
    asked = []
    got = {(r[0], r[1]): (r[2], r[3]) for r in walks.step_walks(games.withColumn("value", F.lit("x")), look_up(known, asked), 4, tolerance, budget).collect()}
    assert got == want
    flat = [x for part in asked for x in part]
    assert len(flat) == len(set(flat))
    if budget:
        assert all(sum(g == game for g, _ in flat) <= max(budget, 2) for game in (-1, 2, 1 << 50))


def test_forty_items_ask_for_what_the_walks_meet_alone(spark):
    games = spark.createDataFrame([(7, 40)], "game_id bigint, n_items int")
    asked = []

    def score(coalitions):
        asked.append(coalitions.count())
        return coalitions.withColumn("value", F.least(F.bit_count("mask") / 5, F.lit(1.0)))

    got = walks.step_walks(games, score, 3, 0.01).collect()
    assert len(got) == 40 and sum(r["phi"] > 0 for r in got) >= 5
    assert sum(asked) <= 2 + 39 + 2 * 5


def test_no_games_and_no_values(spark):
    none = spark.createDataFrame([], "game_id bigint, n_items int")
    silent = lambda asked: asked.where("false").withColumn("value", F.lit(1.0))
    assert walks.step_walks(none, silent, 2).count() == 0
    got = walks.step_walks(spark.createDataFrame([(1, 2)], "game_id bigint, n_items int"), silent, 2).collect()
    assert [(r["phi"], r["evaluations"]) for r in got] == [(0.0, 2)] * 2
