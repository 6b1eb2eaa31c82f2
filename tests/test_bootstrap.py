"""Intervals against the same weights in numpy, for every statistic, however the rows are dealt."""

import numpy as np
import pytest

from tessera.operators import stats

KEYS, TIMES = ["metric", "budget"], 200


def rows():
    rng = np.random.default_rng(2)
    out = [("even", None, float(v)) for v in rng.integers(0, 9, 400)] + [("odd", 4, float(v)) for v in rng.normal(size=151)]
    out += [("same", 1, 2.5)] * 9000 + [("one", None, 7.0), ("one", None, float("nan")), ("none", 3, None), ("two", 1, 1.0), ("two", 1, 4.0)]
    return out


def weighted(stat, x, w, n):
    if w.sum() == 0:
        return np.nan
    if stat == "median":
        return float(np.median(np.repeat(x, w.astype(int))))
    mean = w @ x / w.sum()
    return {"mean": mean, "sum": mean * n, "std": np.sqrt(max(w @ (x * x) / w.sum() - mean * mean, 0))}[stat]


@pytest.mark.parametrize("stat", stats.STATS)
def test_intervals_equal_those_of_numpy(spark, monkeypatch, stat):
    monkeypatch.setattr(stats, "HELD_CELLS", 2)
    frame = spark.createDataFrame(rows(), "metric string, budget int, value double")
    cells = {}
    for r in stats.lots(frame, KEYS, "value").where("copies > 0").collect():
        cells.setdefault((r["metric"], r["budget"]), []).append((r["x"], r["copies"], r["row"]))
    for parts in (1, 7):
        got = {(r["metric"], r["budget"]): r for r in stats.bootstrap_ci(frame.repartition(parts), KEYS, stat=stat, times=TIMES, block=500).collect()}
        assert len(got) == 6 and got["none", 3]["n"] == 0 and got["none", 3]["point"] is None and got["none", 3]["low"] is None
        assert got["one", None]["n"] == 1 and got["one", None]["low"] == got["one", None]["point"] == (0.0 if stat == "std" else 7.0)
        for key, own in cells.items():
            x, copies, row = (np.array(c) for c in zip(*own, strict=True))
            n = int(copies.sum())
            if n < 2:
                continue
            w = stats.poisson_weights(row, copies, 0, TIMES, 42)
            each = np.array([weighted(stat, x, w[:, t], n) for t in range(TIMES)])
            want = [weighted(stat, x, copies.astype(float), n), *np.nanpercentile(each, [2.5, 97.5])]
            assert [got[key]["n"], *(got[key][c] for c in ("point", "low", "high"))] == pytest.approx([n, *want], rel=1e-7, abs=1e-7)


def test_weights_of_many_copies_are_poisson_numbers():
    for m in (1, 7, 900, 4096):
        w = stats.poisson_weights(np.arange(50, dtype=np.int64) * 7919, np.full(50, m), 0, 400, 1)
        assert w.mean() == pytest.approx(m, rel=0.03) and w.var() == pytest.approx(m, rel=0.06)
