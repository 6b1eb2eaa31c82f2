"""Ranks and quantiles of large cells: against plain versions, and that no cell is ordered in one task."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ranks, stats


def plain_ranks(values):
    return [sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    hot = [("hot", None, float(v)) for v in rng.integers(-400, 400, 3000)]  # one cell has nearly all rows, and ties
    more = [("some", "a", float(v)) for v in rng.normal(size=41)] + [("one", None, 7.0), ("none", "a", None), (None, None, 1.0), (None, None, 2.0)]
    return spark.createDataFrame(hot + more, "cell string, part string, value double")


def by_cell(rows):
    found = {}
    for r in rows.collect():
        if r.value is not None:
            found.setdefault((r.cell, r.part), []).append(r.value)
    return found


def test_ranks_equal_plain_ones(rows):
    want = {}
    for key, values in by_cell(rows).items():
        want |= {(*key, v): rank for v, rank in zip(values, plain_ranks(values), strict=True)}
    got = ranks.value_counts(rows, ["cell", "part"], "value").select("cell", "part", "v", ranks.average_rank().alias("r"))
    assert {(r.cell, r.part, r.v): r.r for r in got.collect()} == want


def test_quantiles_equal_numpy(rows):
    got = ranks.quantiles(rows, ["cell", "part"], "value", low=0.25, mid=0.5, high=0.9).collect()
    cells = by_cell(rows)
    assert len(got) == len(cells)
    for r in got:
        assert [r.low, r.mid, r.high] == pytest.approx(list(np.quantile(cells[r.cell, r.part], [0.25, 0.5, 0.9])))


def test_quantiles_without_keys_and_without_rows(rows):
    values = [v for own in by_cell(rows).values() for v in own]
    assert ranks.quantiles(rows, [], "value", mid=0.5).collect()[0].mid == pytest.approx(np.median(values))
    assert ranks.quantiles(rows.where("false"), ["cell"], "value", mid=0.5).count() == 0
    assert stats.wilcoxon(rows.where("false").select("cell", F.col("value").alias("x"), F.col("value").alias("y")), ["cell"]).count() == 0


def test_infinite_values_are_values(spark):
    rows = spark.createDataFrame([(1, math.inf), (1, math.inf), (1, 0.0), (2, -math.inf)], "g int, value double")
    assert {r.g: r.mid for r in ranks.quantiles(rows, ["g"], "value", mid=0.5).collect()} == {1: math.inf, 2: -math.inf}


def test_signed_ranks_of_a_large_cell(spark):
    rng = np.random.default_rng(9)
    d = rng.integers(-30, 40, 2500).astype(float)
    pairs = spark.createDataFrame([("c", float(v), 0.0) for v in d] + [("few", 1.0, 0.0), ("still", 0.0, 0.0)], "cell string, x double, y double")
    got = {r.cell: r for r in stats.wilcoxon(pairs, ["cell"]).collect()}
    real = d[d != 0]
    order = np.array(plain_ranks(list(np.abs(real))))
    assert got["c"].nonzero == len(real) and got["c"].n == len(d)
    assert got["c"].r_pos == pytest.approx(order[real > 0].sum()) and got["c"].r_neg == pytest.approx(order[real < 0].sum())
    _, t = np.unique(np.abs(real), return_counts=True)
    assert got["c"].p == pytest.approx(stats.signed_rank_p(len(real), min(got["c"].r_pos, got["c"].r_neg), float((t.astype(float) ** 3 - t).sum())))
    assert (got["few"].nonzero, got["few"].r_pos, got["few"].p) == (1, None, None)
    assert (got["still"].n, got["still"].nonzero, got["still"].win_rate) == (1, 0, 0.0)


def test_no_window_goes_over_a_cell(spark, rows):
    pairs = rows.select("cell", F.col("value").alias("x"), F.lit(0.0).alias("y"))
    for frame in (stats.wilcoxon(pairs, ["cell"]), stats.win_tie_loss(pairs, ["cell"])):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*?\], \[(.*?)\]", plan)
        assert windows and all("place" in w for w in windows), plan
        assert "percentile(" not in plan
