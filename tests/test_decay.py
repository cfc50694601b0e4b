"""Decays of many series at once, beside the parameters that made them and a dense fit."""

import numpy as np
import pytest

from quakespark.operators import fits


def shape(u, kind):
    return -np.expm1(-u) if kind == "exp" else np.log1p(u)


def dense(t, v, kind):
    """The best of a fine grid of tau, then refined: for each tau the offset and amplitude are linear."""

    def cost(s):
        f = shape(np.maximum(t, 0) / np.exp(s), kind)
        g = np.stack([np.ones_like(f), f], 1)
        m, *_ = np.linalg.lstsq(g, v, rcond=None)
        return ((v - g @ m) ** 2).sum(), m

    low, high = -4.0, 8.0
    for _ in range(12):
        grid = np.linspace(low, high, 61)
        k = int(np.argmin([cost(s)[0] for s in grid]))
        low, high = grid[max(k - 2, 0)], grid[min(k + 2, 60)]
    s = (low + high) / 2
    return np.append(cost(s)[1], np.exp(s)), cost(s)[0]


@pytest.mark.parametrize("kind", ["exp", "log"])
def test_decays_beside_dense_fits(spark, kind):
    rng = np.random.default_rng(2)
    rows, want, made = [], {}, {}
    for k in range(8):
        t = np.sort(rng.uniform(-20, 100, 200 + 20 * k))
        truth = (rng.normal(), rng.choice([-1, 1]) * rng.uniform(2, 5), rng.uniform(5, 25))
        v = truth[0] + truth[1] * shape(np.maximum(t, 0) / truth[2], kind) + 0.05 * rng.normal(size=len(t))
        rows += [(k, float(a), float(b), "c") for a, b in zip(t, v, strict=True)]
        want[k], made[k] = dense(t, v, kind), truth
    rows += [(100, 1.0, 2.0, "c"), (100, 2.0, 2.0, "c"), (101, -1.0, 1.0, "c"), (101, -2.0, 1.5, "c"), (101, -3.0, 1.5, "c"), (None, 1.0, 1.0, "c"), (0, None, 1.0, "c"), (0, 1.0, float("nan"), "c")]
    got = {r.g: r for r in fits.decay(spark.createDataFrame(rows, "g long, t double, v double, best string").repartition(3), ["g"], "t", "v", kind).collect()}
    assert set(got) == {*range(8), 100, 101, None} and not any(got[k].settled for k in (100, 101, None))
    for k in range(8):
        (offset, amplitude, tau), cost = want[k]
        assert got[k].settled and got[k].n == 200 + 20 * k
        assert got[k].rms == pytest.approx(np.sqrt(cost / got[k].n), rel=1e-6)
        assert (got[k].offset, got[k].amplitude, got[k].tau) == (pytest.approx(offset, abs=1e-3), pytest.approx(amplitude, rel=1e-3), pytest.approx(tau, rel=1e-3))
        assert got[k].tau == pytest.approx(made[k][2], rel=0.2)
    assert fits.decay(spark.createDataFrame([], "g long, t double, v double"), ["g"], "t", "v", kind).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_middle_slopes_beside_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 60))
    x, y = rng.integers(0, 10 if seed % 2 else 1000, n).astype(float), rng.normal(size=n).round(1 if seed % 3 else 9)
    slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(n) if x[i] < x[j]]
    got = fits._middle_slope(x, y)
    assert (np.isnan(got) and not slopes) or got == pytest.approx(np.median(slopes), rel=1e-9, abs=1e-9)


def test_theil_sen_of_odd_series(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 100.0), ("one", 1.0, 2.0), ("same", 1.0, 2.0), ("same", 1.0, 3.0), ("gap", None, 1.0), ("gap", float("nan"), 1.0)]
    got = {r.g: r for r in fits.theil_sen(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["a"].slope == pytest.approx(49.5) and got["one"].slope is None and got["same"].slope is None and "gap" not in got
