"""Published values of dislocations, and operators that SQL can't say, beside plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.functions import angles, okada
from quakespark.operators import inversion, network, traces

# Displacements of the half-space paper's check-list at x = 2, y = 3 with depth 4, length 3 and width 2.
CHECK = {
    (70.0, "strike"): (-8.689e-3, -4.298e-3, -2.747e-3),
    (70.0, "dip"): (-4.682e-3, -3.527e-2, -3.564e-2),
    (70.0, "opening"): (-2.660e-4, 1.056e-2, 3.214e-3),
}


@pytest.mark.parametrize("case", CHECK)
def test_rectangle_has_the_published_values(spark, case):
    row = spark.range(1).select(*okada.rectangle(F.lit(2.0), F.lit(3.0), 4.0, case[0], 3.0, 2.0, {case[1]: 1.0})).first()
    assert list(row) == pytest.approx(CHECK[case], abs=6e-6)


def test_vertical_rectangle_is_the_limit_of_steep_ones(spark):
    for kind in ("strike", "dip", "opening"):
        at = [list(spark.range(1).select(*okada.rectangle(F.lit(1.3), F.lit(-2.0), 4.0, dip, 3.0, 2.0, {kind: 1.0})).first()) for dip in (90.0, 89.999)]
        assert at[0] == pytest.approx(at[1], abs=1e-5)


def test_simplified_traces(spark):
    rng = random.Random(1)
    rows = [(c, k, float(k), rng.choice([0.0, 0.02, 3.0 * (k % 7 == 3)])) for c in range(3) for k in range(30)]
    got = traces.simplified(spark.createDataFrame(rows, "c long, seq long, x double, y double"), ["c"], "seq", "x", "y", 0.1).collect()
    for c in range(3):
        own = [r[1:] for r in rows if r[0] == c]

        def keep(a, b, own=own):
            (_, xa, ya), (_, xb, yb) = own[a], own[b]
            far = [(abs((xb - xa) * (y - ya) - (yb - ya) * (x - xa)) / math.hypot(xb - xa, yb - ya), -k) for k, x, y in own[a + 1 : b]]
            if not far or max(far)[0] <= 0.1:
                return set()
            k = -max(far)[1]
            return keep(a, k) | {k} | keep(k, b)

        assert sorted(r.seq for r in got if r.c == c) == sorted({0, 29} | keep(0, 29))


def test_dips_out_of_range_are_errors(spark):
    assert spark.range(1).select(angles.check_dip(F.lit(90.0))).first()[0] == 90
    with pytest.raises(Exception, match="dip is outside"):
        spark.range(1).select(angles.check_dip(F.lit(91.0))).collect()


def test_rotation_pole_and_datum(spark):
    assert network.pole([0.0, 0.0, 2.0]) == (0.0, 90.0, 2.0)
    assert angles.datum("wgs-84")[0] == 6378137.0


def test_variance_components_find_the_parts_noise(spark):
    rng = np.random.default_rng(1)
    g = rng.normal(size=(4000, 3))
    part = np.arange(4000) % 2
    d = g @ [1.0, -2.0, 3.0] + rng.normal(size=4000) * np.where(part, 0.1, 2.0)
    greens = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(4000) for j in range(3)], "row long, col int, value double")
    data = spark.createDataFrame([(i, float(d[i]), 1.0, int(part[i])) for i in range(4000)], "row long, d double, weight double, part int")
    m, variance = inversion.variance_components(greens, data, 3)
    assert variance[0] == pytest.approx(4.0, rel=0.1) and variance[1] == pytest.approx(0.01, rel=0.1)
    assert list(m) == pytest.approx([1.0, -2.0, 3.0], abs=0.02)


def test_bounded_least_squares_and_checkerboard():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=30)
    m = inversion.bounded(a.T @ a, a.T @ b, [-0.1] * 4, [0.1] * 4)
    slope = a.T @ (a @ m - b)
    assert np.abs(m).max() <= 0.1
    assert all(abs(s) < 1e-9 if abs(x) < 0.1 - 1e-12 else s * x < 1e-9 for s, x in zip(slope, m, strict=True))
    assert inversion.checkerboard(4, 2, 2, 1.0).tolist() == [1, 1, 0, 0, 1, 1, 0, 0]
