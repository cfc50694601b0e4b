"""Operators against values known in advance or computed plainly."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.functions import geo, seismo
from quakespark.operators import downsample, fits, graph, joins
from quakespark.plans import forward
from quakespark.sources import text


def value(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


lit = lambda *xs: [F.lit(float(x)) for x in xs]


@pytest.mark.parametrize(("dx", "dy", "want"), [(1, 0, 90), (-1, 0, 270), (0, -1, 180)])
def test_strike(spark, dx, dy, want):
    assert value(spark, geo.strike(*lit(dx, dy)))[0] == pytest.approx(want)


def test_angles_and_planes(spark):
    assert value(spark, geo.rake(*lit(-1.0, 0.5)))[0] == pytest.approx(26.5650511770779)
    assert list(value(spark, *geo.plane_normal(*lit(0, 0)))) == pytest.approx([0, 0, 1])
    assert list(value(spark, *geo.plane_normal(*lit(90, 89.99)))) == pytest.approx([0, -1, 0.0001745329], abs=1e-6)
    assert list(value(spark, *geo.auxiliary_plane(*lit(38, 51, 44)))) == pytest.approx([276.71179351444425, 57.32650724684216, 131.61502732561564], abs=1e-6)
    assert list(value(spark, *geo.look_angles(*geo.look_vector(*lit(190, 30))))) == pytest.approx([190, 30])


def test_coordinates(spark):
    got = value(spark, *geo.xyz_to_llh(*lit(-2571637.61354, -1586307.97196, 5599086.71297)))
    assert list(got) == pytest.approx([211.6682527307 - 360, 61.8070788863, 790.83844], abs=1e-3)
    back = value(spark, *geo.xyz_to_llh(*geo.llh_to_xyz(*lit(-121.98765, 37.12345), 0.0)))
    assert list(back) == pytest.approx([-121.98765, 37.12345, 0], abs=1e-6)
    x, y = geo.lonlat_to_xy(*lit(121.5, 24.2), 51)
    assert list(value(spark, *geo.xy_to_lonlat(x, y, 51))) == pytest.approx([121.5, 24.2], abs=1e-8)


def test_scaling(spark):
    assert value(spark, seismo.scaling("rupture_length", F.lit(6.8), "N"), seismo.scaling("rupture_width", F.lit(6.8), "N"))[:] == pytest.approx((33.11311214825911, 17.378008287493753))


def test_dbscan(spark):
    rng = random.Random(3)
    points = [(i, rng.choice([0, 5, 9]) + rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for i in range(120)] + [(500, 50.0, 50.0)]
    got = {r.k: (r.cluster, r.core) for r in graph.dbscan(spark.createDataFrame(points, "k long, x double, y double"), "k", "x", "y", 0.5, 5).collect()}
    near = {i: {j for j, u, v in points if math.hypot(x - u, y - v) <= 0.5} for i, x, y in points}
    core = {i for i in near if len(near[i]) >= 5}
    root = {}
    for i in sorted(core):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j in core and j not in root:
                    root[j] = i
                    todo += near[j]
    want = {i: (root[i], True) if i in core else (min((root[j] for j in near[i] & core), default=None), False) for i in near}
    assert got == want


def test_fits_and_inversion(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 200))
    v = 3 - 2 * x + 0.5 * y
    v[:10] += 100
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, v, strict=True)], "x double, y double, v double")
    design = fits.ramp(F.col("x"), F.col("y"))
    assert fits.huber(df, design, "v") == pytest.approx([3, -2, 0.5], abs=0.05)
    plain = np.linalg.lstsq(np.column_stack([np.ones(200), x, y]), v, rcond=None)[0]
    assert fits.solve(df, design, "v") == pytest.approx(plain)
    g = rng.normal(size=(40, 4))
    greens = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(40) for j in range(4)], "row long, col int, value double")
    data = spark.createDataFrame([(i, float(g[i] @ [1, -2, 0, 3]), 1.0) for i in range(40)], "row long, d double, weight double")
    assert forward.least_squares(greens, data, 4) == pytest.approx([1, -2, 0, 3], abs=1e-8)
    m = forward.least_squares(greens, data, 4, nonnegative=True)
    slope = g.T @ (g @ m - g @ [1, -2, 0, 3])
    assert (m >= 0).all() and (slope >= -1e-6).all() and np.abs(slope * m).max() < 1e-6


def test_readers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Sta Lon Lat de dn du sde sdn sdu\n****\nAAA -120.5 30 1 2 3 0 0.1 0.2\nBBB 10 20 nan 1 1 1 1 1\n")
    row = text.stations(spark, str(tmp_path / "s.txt"), factor=10.0, least_error=0.5).collect()
    assert [(r.station, r.lon, r.ve, r.se, r.su) for r in row] == [("AAA", 239.5, 10.0, 5.0, 2.0)]
    (tmp_path / "c.txt").write_text("1 2 3 4.5 2020-01-02T03:04:05.000006\n")
    assert text.catalog(spark, str(tmp_path / "c.txt")).first().mag == 4.5
    (tmp_path / "g.txt").write_text("> one\n1 2\n3 4\n> two\n5 6 7\n")
    assert [(r.segment, r.seq, r.x, r.z) for r in text.segments(spark, str(tmp_path / "g.txt")).orderBy("segment", "seq").collect()] == [(1, 1, 1.0, None), (1, 2, 3.0, None), (2, 1, 5.0, 7.0)]


def test_salted_cells_lose_nothing(spark):
    points = spark.createDataFrame([(k, (k * 7 % 10) / 10, (k * 3 % 10) / 10) for k in range(200)], "k int, x double, y double")
    cells = spark.createDataFrame([(1, 0.0, 0.5, 0.0, 1.0), (2, 0.5, 2.5, 0.0, 0.5), (3, 5.0, 6.0, 5.0, 6.0)], "c int, x0 double, x1 double, y0 double, y1 double")
    plain, salted = (sorted(map(tuple, joins.in_cells(points, cells, "x", "y", 1.0, s).select("k", "c").collect())) for s in (1, 5))
    assert plain == salted and len(plain) > 100


def test_quadtree_of_large_mean(spark):
    rows = spark.createDataFrame([(float(x), float(y), 1e9 + (x < 8) * 0.01) for x in range(16) for y in range(16)], "x double, y double, v double")
    got = downsample.quadtree(rows, "x", "y", "v", (0.0, 0.0), 16.0, 0.004, 3)
    assert sorted((r.level, r.n) for r in got.collect()) == [(1, 64)] * 4
