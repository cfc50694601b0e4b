"""Inversion: constraints beside all active sets, variance components and row passes beside dense matrices."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.operators import inversion


def tables(spark, g, d, w, part=None):
    rows = [(int(i), int(j), float(g[i, j])) for i in range(len(g)) for j in range(g.shape[1]) if g[i, j]]
    data = [(i, float(d[i]), float(w[i]), int(part[i]) if part is not None else 0) for i in range(len(d))]
    return spark.createDataFrame(rows, "row long, col int, value double").repartition(3), spark.createDataFrame(data, "row long, d double, weight double, part int")


def system(seed=0, n=60, p=5):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(n, p)) * (rng.random((n, p)) < 0.7)
    return g, g @ rng.normal(size=p) + 0.1 * rng.normal(size=n), rng.uniform(0.5, 2, n)


def all_active_sets(g, d, c, limit, e, to):
    best = None
    for size in range(len(c) + 1):
        for which in itertools.combinations(range(len(c)), size):
            a = np.concatenate([e, c[list(which)]])
            try:
                x = np.linalg.solve(np.block([[g, a.T], [a, np.zeros((len(a), len(a)))]]), np.concatenate([d, to, limit[list(which)]]))[: len(d)]
            except np.linalg.LinAlgError:
                continue
            if not len(c) or (c @ x - limit).max() < 1e-9:
                cost = x @ g @ x / 2 - d @ x
                best = (cost, x) if best is None or cost < best[0] else best
    return best


@pytest.mark.parametrize("seed", range(40))
def test_constraints_beside_all_active_sets(seed):
    rng = np.random.default_rng(seed)
    n, k, ne = rng.integers(2, 5), rng.integers(1, 7), rng.integers(0, 2)
    a = rng.normal(size=(8, n)) * 10 ** rng.uniform(-2, 2, n)
    g, d, c, limit, e = a.T @ a, a.T @ rng.normal(size=8), rng.normal(size=(k, n)), rng.uniform(0, 1, k), rng.normal(size=(ne, n))
    cost, _ = all_active_sets(g, d, c, limit, e, np.zeros(ne))
    x = inversion.constrained(g, d, c, limit, e if ne else None, np.zeros(ne) if ne else None)
    assert (c @ x - limit).max() < 1e-7 and np.abs(e @ x).max(initial=0) < 1e-7
    assert x @ g @ x / 2 - d @ x == pytest.approx(cost, rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("seed", range(5))
def test_answers_are_never_outside_their_bounds(seed):
    g = np.random.default_rng(seed).normal(size=(40, 4))
    square, side = g.T @ g, g.T @ (g @ [1, -2, 0, 3])
    for low, high in (([0] * 4, [np.inf] * 4), ([-0.1] * 4, [0.7] * 4), ([np.nan, -np.inf, 0.1, -np.inf], [0.7, np.nan, np.inf, 0.3])):
        m = inversion.bounded(square, side, low, high)
        assert np.isfinite(m).all() and not (m < low).any() and not (m > high).any()


def test_constraints_that_exclude_each_other_raise():
    with pytest.raises(inversion.NotSettled):
        inversion.constrained(np.eye(2), np.zeros(2), np.array([[1.0, 0.0], [-1.0, 0.0]]), np.array([-1.0, -1.0]))
    with pytest.raises(inversion.NotSettled):
        inversion.constrained(np.eye(2), np.zeros(2), equal=np.array([[1.0, 0.0], [1.0, 0.0]]), to=np.array([0.0, 1.0]))


def test_bounds_rakes_and_edges(spark):
    assert inversion.bounded(np.eye(3), np.array([5.0, -5.0, 0.5]), [0, 0, 0], [1, 1, 1]).tolist() == pytest.approx([1, 0, 0.5])
    g, d, w = system(1, p=6)
    a, b = inversion.rake_limits([30, 80, 170], [100, 100, 190])
    m, _ = inversion.solve(*tables(spark, g, d, w), 6, a=a, b=b, equal=np.eye(6)[4:5], to=np.zeros(1))
    rake = np.degrees(np.arctan2(m[1::2], m[::2])) % 360
    size = np.hypot(m[::2], m[1::2])
    for k, (low, high) in enumerate([(30, 100), (80, 100), (170, 190)]):
        assert size[k] < 1e-6 or low - 1e-4 <= rake[k] <= high + 1e-4
    assert abs(m[4]) < 1e-9


def test_products_in_small_blocks(spark, monkeypatch):
    g, d, w = system(2)
    part = np.arange(len(d)) % 3
    greens, data = tables(spark, g, d, w, part)
    greens = greens.unionByName(spark.createDataFrame([(900, 0, 5.0), (0, None, 1.0), (1, 2, None)], greens.schema))
    data = data.unionByName(spark.createDataFrame([(901, 2.0, 1.0, 0), (2, None, 1.0, 0), (3, 1.0, None, 1)], data.schema))
    for cells in (7, inversion.CELLS):
        monkeypatch.setattr(inversion, "CELLS", cells)
        sums = inversion.parts(greens, data, 5)
        for k in range(3):
            at = part == k
            assert np.allclose(sums[k][0], (g[at].T * w[at]) @ g[at]) and np.allclose(sums[k][1], (g[at].T * w[at]) @ d[at])
            assert sums[k][2] == pytest.approx((w[at] * d[at] ** 2).sum() + (4.0 if k == 0 else 0.0)) and sums[k][3] == at.sum() + (k == 0)
    assert inversion.parts(greens.limit(0), data.limit(0), 5) == {}


def dense_components(g, d, w, part, rounds=500):
    s = dict.fromkeys(np.unique(part), 1.0)
    for _ in range(rounds):
        p = w / np.array([s[k] for k in part])
        inverse = np.linalg.inv((g.T * p) @ g)
        v = d - g @ (inverse @ ((g.T * p) @ d))
        n = {k: (g[part == k].T * p[part == k]) @ g[part == k] for k in s}
        keys = list(s)
        a = np.array([[np.trace(inverse @ n[i] @ inverse @ n[j]) + (i == j) * ((part == i).sum() - 2 * np.trace(inverse @ n[i])) for j in keys] for i in keys])
        q = np.array([(p[part == k] * v[part == k] ** 2).sum() for k in keys])
        s = {k: s[k] * f for k, f in zip(keys, np.linalg.solve(a, q), strict=True)}
    return s


def test_variance_components_beside_dense_equations(spark):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(400, 6))
    part = np.repeat([0, 1, 2], [250, 100, 50])
    d = g @ rng.normal(size=6) + rng.normal(size=400) * np.array([0.1, 1.0, 3.0])[part]
    w = rng.uniform(0.9, 1.1, 400)
    want = dense_components(g, d, w, part)
    for rigorous in (True, False):
        m, got = inversion.variance_components(*tables(spark, g, d, w, part), 6, rigorous=rigorous)
        assert [np.sqrt(got[k]) for k in range(3)] == pytest.approx([0.1, 1.0, 3.0], rel=0.25)
        if rigorous:
            assert got == pytest.approx(want, rel=1e-6)
    smooth = np.diff(np.eye(6), axis=0)
    _, got = inversion.variance_components(*tables(spark, g, d, w, part), 6, smoothing=smooth, rigorous=True)
    assert set(got) == {0, 1, 2, -1} and all(v > 0 for v in got.values())


def test_row_passes_beside_dense_solution(spark):
    g, d, w = system(7, 80, 12)
    greens, data = tables(spark, g, d, w)
    want = np.linalg.solve((g.T * w) @ g + 0.01 * np.eye(12), (g.T * w) @ d)
    assert inversion.iterated(greens, data, 12, damping=0.01) == pytest.approx(want, abs=1e-6)
    n = (g.T * w) @ g
    m = inversion.iterated(greens, data, 12, nonnegative=True)
    assert m == pytest.approx(inversion.bounded(n, (g.T * w) @ d, np.zeros(12), np.full(12, np.inf)), abs=1e-6) and (m == 0).any()
    with pytest.raises(inversion.NotSettled):
        inversion.iterated(greens, data, 12, rounds=2)
    assert inversion.iterated(greens.limit(0), data, 3).tolist() == [0, 0, 0]
    assert inversion.iterated(greens.withColumn("col", F.lit(1)).dropDuplicates(["row"]), data, 3)[0] == 0
