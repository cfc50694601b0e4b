"""Dislocations: published values, one method beside another, balance of forces, and blocks of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.functions import dislocations as kernels
from quakespark.operators import greens

# Published check of the surface formulas: lower edge at depth 4, dip 70, length 3, width 2, at x = 2, y = 3.
CHECK = {"strike": (-8.689e-3, -4.298e-3, -2.747e-3), "dip": (-4.682e-3, -3.527e-2, -3.564e-2), "opening": (-2.660e-4, 1.056e-2, 3.214e-3)}
PLANES = [(30, 70), (200, 5), (10, 90), (0, 45), (330, 0), (75, 90), (255, 90), (123, 89)]


def corners(patch):
    return kernels.rectangle_corners(*np.array([patch], float).T)


def slips(patch):
    return kernels.rectangle_slips(np.array([patch[3]], float), np.array([patch[4]], float))


def places(n=400):
    rng = np.random.default_rng(0)
    return rng.uniform(-10, 10, n), rng.uniform(-10, 10, n)


def test_published_values():
    d = np.radians(70)
    patch = (1.5, 2 * np.cos(d), 4 - 2 * np.sin(d), 90, 70, 3, 2)
    x, y = np.array([2.0]), np.array([3.0])
    for u in (kernels.polygon_surface(x, y, corners(patch))[0, 0], kernels.rectangle_inside(x, y, 0 * x, np.array(patch))[0][0]):
        for k, kind in enumerate(kernels.SLIPS):
            assert u[k] == pytest.approx(CHECK[kind], rel=5e-4)


@pytest.mark.parametrize(("strike", "dip"), PLANES)
def test_polygons_rectangles_and_triangles_agree(strike, dip):
    patch, (x, y) = (1.0, 2.0, 0.5, strike, dip, 6.0, 4.0), places()
    whole = kernels.polygon_surface(x, y, corners(patch), 0.25, slips(patch))[:, 0]
    deep = kernels.rectangle_inside(x, y, 0 * x, np.array(patch))[0]
    assert np.abs(whole - deep).max() < 1e-7
    halves = sum(kernels.polygon_surface(x, y, corners(patch)[:, c], 0.25, slips(patch))[:, 0] for c in ([0, 1, 2], [0, 2, 3]))
    assert np.abs(whole - halves).max() < 1e-12
    turned = kernels.polygon_surface(x, y, corners(patch)[:, [2, 1, 0, 3]], 0.25, slips(patch))[:, 0]
    assert np.abs(whole - turned).max() < 1e-12
    if dip and dip < 90:
        assert np.abs(whole - kernels.polygon_surface(x, y, corners(patch))[:, 0]).max() < 1e-12


def test_points_near_edges_and_above_them():
    patch = (0.0, 0.0, 0.0, 0.0, 90.0, 10.0, 5.0)
    y = np.array([0.0, 1.0, 4.999, 6.0, 50.0])
    right, left = (kernels.polygon_surface(0 * y + e, y, corners(patch), 0.25, slips(patch))[:, 0, 0, 1] for e in (1e-9, -1e-9))
    # across a surface break the slip is the whole jump, and beyond its end there is none
    assert np.abs(np.abs(right - left)[:3] - 1).max() < 1e-6 and np.abs(right - left)[3:].max() < 1e-6
    assert np.isnan(kernels.polygon_surface(np.array([0.0]), np.array([5.0]), corners(patch))[0]).any()
    extended = kernels.polygon_surface(np.array([0.0]), np.array([7.0]), corners(patch), 0.25, slips(patch))
    assert np.isfinite(extended).all()


def stress(x, y, z, patch):
    g = kernels.rectangle_inside(x, y, z, patch)[1]
    e = (g + np.swapaxes(g, 2, 3)) / 2
    return 2 * e + np.trace(e, axis1=2, axis2=3)[..., None, None] * np.eye(3)


@pytest.mark.parametrize(("strike", "dip"), PLANES)
def test_surface_is_free_and_forces_balance(strike, dip):
    patch, (x, y) = np.array([1.0, 2.0, 0.5, strike, dip, 6.0, 4.0]), places(150)
    top = stress(x, y, 0 * x, patch)
    assert np.abs(top[:, :, :, 2]).max() < 1e-6 < np.abs(top).max()
    z = np.random.default_rng(1).uniform(5, 9, 150)
    h, steps = 1e-4, ((1, 0, 0), (0, 1, 0), (0, 0, -1))
    moved = lambda f, s, k: f(x + k * h * s[0], y + k * h * s[1], z + k * h * s[2], patch)
    out = sum((moved(stress, s, 1) - moved(stress, s, -1))[:, :, :, k] / (2 * h) for k, s in enumerate(steps))
    assert np.abs(out).max() < 1e-5
    own = kernels.rectangle_inside(x, y, z, patch)[1]
    for k, s in enumerate(steps):
        slope = (moved(kernels.rectangle_inside, s, 1)[0] - moved(kernels.rectangle_inside, s, -1)[0]) / (2 * h)
        assert np.abs(slope - own[:, :, :, k]).max() < 1e-6


def tables(spark):
    rng = np.random.default_rng(4)
    obs = [(k, float(x), float(y), float(z), "o") for k, (x, y, z) in enumerate(rng.uniform(0, 9, (60, 3)))] + [(100, None, 1.0, 1.0, "o"), (101, 1.0, 1.0, -2.0, "o")]
    shapes = [(k, *map(float, rng.uniform(1, 5, 3)), float(rng.uniform(0, 360)), float(rng.uniform(5, 85)), 2.0, 1.0, 1.0, 0.5, None if k == 3 else 0.25, "p") for k in range(9)]
    shapes += [(20, 1.0, 1.0, 1.0, 30.0, 40.0, 0.0, 1.0, 1.0, 1.0, 1.0, "p"), (21, None, 1.0, 1.0, 30.0, 40.0, 1.0, 1.0, 1.0, 1.0, 1.0, "p")]
    one = spark.createDataFrame(obs, "row long, x double, y double, depth double, cell string").repartition(3)
    return one, spark.createDataFrame(shapes, "col long, x double, y double, depth double, strike double, dip double, length double, width double, strike_slip double, dip_slip double, opening double, cell string")


def test_blocks_of_any_size_agree(spark, monkeypatch):
    obs, patches = tables(spark)
    monkeypatch.setattr(greens, "BLOCK", 4)
    near, far = ({r.row: r for r in greens.displacement(obs, patches, near=n).collect()} for n in (100, 0))
    assert len(near) == len(far) == 62 and near[100].east is None and far[100].east is None
    assert all(near[k].up == pytest.approx(far[k].up) for k in near if k != 100)
    g = greens.surface(obs, patches)
    assert g.count() == 62 * 11 == greens.surface(obs, patches, near=0).count()
    assert {r.col for r in g.where("strike_up is null and row = 1").collect()} == {20, 21}
    slip = patches.na.fill(0.0, ["opening"]).select("col", "strike_slip", "dip_slip", "opening")
    total = g.join(slip, "col").groupBy("row").agg(F.sum(F.col("strike_up") * F.col("strike_slip") + F.col("dip_up") * F.col("dip_slip") + F.col("opening_up") * F.col("opening")).alias("up"))
    assert all(r.up == pytest.approx(near[r.row].up) for r in total.collect() if r.row != 100)
    inner = {r.row: r for r in greens.inside(obs.withColumn("depth", F.when(F.col("depth") < 0, F.col("depth")).otherwise(0.0)), patches, shear_modulus=2.0).collect()}
    assert all(inner[k].up == pytest.approx(near[k].up) and abs(inner[k].s_uu) < 1e-9 for k in near if k < 100)
    assert inner[100].up is None and inner[101].up is None


def test_empty_tables(spark):
    obs, patches = tables(spark)
    for near in (100, 0):
        assert {r.up for r in greens.displacement(obs, patches.limit(0), near=near).collect()} <= {0.0, None}
        assert greens.displacement(obs.limit(0), patches, near=near).count() == 0
        assert greens.surface(obs, patches.limit(0), near=near).count() == 0


def test_compound_sources(spark):
    x, y = places(200)
    # three rectangles by their own angles, turned by 30 degrees about the vertical: strikes are clockwise
    corners = kernels.compound_corners(np.array([1.0]), np.array([2.0]), np.array([6.0]), np.array([[0.0, 0.0, 30.0]]), np.array([[1.0, 2.0, 1.5]]))
    whole = kernels.polygon_surface(x, y, corners[0])[:, :, 2].sum(1)
    across = np.radians(30)
    sill = kernels.rectangle_inside(x, y, 0 * x, np.array([1 + 2 * -np.sin(across) * 1, 2 + 2 * np.cos(across) * 1, 6.0, 60.0, 0.0, 2.0, 4.0]))[0][:, 2]
    walls = [kernels.rectangle_inside(x, y, 0 * x, np.array([1.0, 2.0, 4.5, strike, 90.0, length, 3.0]))[0][:, 2] for strike, length in ((60.0, 2.0), (330.0, 4.0))]
    assert np.abs(whole - sill - sum(walls)).max() < 1e-9
    # a small cube far away is a sphere of pressure: its volume is (1 + nu) / (3 (1 - nu)) of what opens
    obs = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "row long, x double, y double")
    source = spark.createDataFrame([(0, 1.0, 2.0, 8.0, 10.0, 20.0, 30.0, 0.05, 0.05, 0.05, 2.0), (1, None, 2.0, 8.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], ", ".join(["col long", *(f"{c} double" for c in greens.COMPOUND)]))
    got = np.array([[r.east, r.north, r.up] for r in greens.compound(obs, source).orderBy("row").collect()])
    sphere = greens.volume(2.0, 0.05, 0.05, 0.05) * 1.25 / (3 * 0.75) * 0.75 / np.pi / ((x - 1) ** 2 + (y - 2) ** 2 + 64) ** 1.5
    assert np.abs(got - np.stack([x - 1, y - 2, 8 + 0 * x], 1) * sphere[:, None]).max() < 1e-3 * np.abs(got).max()
    assert greens.compound(obs, source.limit(0)).where("up = 0").count() == 200
    assert greens.compound(obs, source.withColumn("depth", F.lit(0.0))).where("up is null").count() == 200
