"""Degenerate rows and unreadable lines: a defined value each, and no error."""

import math

import pytest
from pyspark.sql import functions as F

from quakespark.functions import angles, geo, okada, seismo
from quakespark.operators import aggregates, matrices, meshes, network, traces
from quakespark.plans import forward
from quakespark.sources import formats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_strain_of_few_or_collinear_stations(spark):
    rows = [("one", 0.0, 0.0, 1.0, 1.0)] + [("line", float(k), 2.0 * k, 1.0 * k, 0.0) for k in range(5)] + [("net", float(k % 3), float(k // 3), 0.5 * (k % 3), 0.25 * (k // 3)) for k in range(9)]
    got = {r.g: r for r in network.strain(frame(spark, rows, "g string, x double, y double, e double, n double"), "x", "y", "e", "n", ["g"]).collect()}
    assert got["one"].dedx is None and got["line"].dedx is None and got["line"].n == 5
    assert got["net"].dedx == pytest.approx(0.5) and got["net"].dndy == pytest.approx(0.25)


def test_profile_crossing_with_repeated_vertices_and_parallel_legs(spark):
    rows = [("a", k, x, y) for k, (x, y) in enumerate([(5.0, -1.0), (5.0, -1.0), (5.0, 3.0)])] + [("b", k, float(k), 2.0) for k in range(3)]
    got = {r.t: r.distance for r in meshes.profile_crossing(frame(spark, rows, "t string, k int, x double, y double"), ["t"], "k", "x", "y", (0.0, 0.0), (10.0, 0.0)).collect()}
    assert got == {"a": pytest.approx(0.0), "b": None}


def test_sums_over_nothing(spark):
    rows = frame(spark, [("z", 0.0, 1.0, 3.0), ("z", 0.0, 2.0, 3.0), ("a", 2.0, 1.0, 5.0), ("a", 2.0, 3.0, 5.0)], "g string, w double, x double, m double")
    assert {r.g: r.x for r in aggregates.centroid(rows, "w", "x", by=["g"]).collect()} == {"z": None, "a": 2.0}
    assert {r.g: r.b for r in aggregates.b_value_likelihood(rows, "m", 0.0, ["g"]).collect()} == {"z": None, "a": None}
    drop = {r.g: r.stress_drop for r in aggregates.stress_drop(rows, "w", "x", 3e10, ["g"]).collect()}
    assert drop["z"] is None and drop["a"] > 0
    patches = frame(spark, [(1, 0.0), (2, 4.0)], "p int, area double")
    got = aggregates.counts_by_patch(frame(spark, [(2,), (2,)], "p int"), patches, "p", "area").collect()
    assert {r.p: (r.n, r.rate) for r in got} == {1: (0, None), 2: (2, 0.5)}


def test_flat_and_empty_geometry(spark):
    corners = [(f"x{k}", f"y{k}", f"z{k}") for k in range(3)]
    rows = frame(spark, [(0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 4.0, 0.0, 1.0, 0.0, 4.0, 1.0)], ", ".join(f"{c} double" for p in corners for c in p))
    got = [(r.area, r.dip) for r in network.triangles(rows, corners).collect()]
    assert got == [(0.0, None), (8.0, pytest.approx(0.0))]
    one = spark.range(1)
    zero = F.lit(0.0)
    values = one.select(
        geo.los_to_vertical(F.lit(1.0), zero).alias("los"), angles.downdip_width(zero, F.lit(2.0), zero).alias("width"), angles.normalized(zero, zero, zero)[0].alias("unit"),
        seismo.elastic_from_lame(zero, zero)["poisson"].alias("poisson"), forward.mogi(zero, zero, 0.0, 0.0, 0.0, 1.0)[2].alias("mogi"),
    ).first()
    assert all(v is None for v in values)
    surface = one.select(*okada.rectangle(zero, zero, 0.0, 30.0, 1.0, 0.0, {"dip": 1.0})).first()
    assert len(surface) == 3


@pytest.mark.parametrize("strike", [0.0, 100.0, 250.0])
def test_auxiliary_plane_of_a_vertical_dip_slip(spark, strike):
    # the other plane is flat, and its own other plane is the first
    s, d, r = spark.range(1).select(*geo.auxiliary_plane(F.lit(strike), F.lit(90.0), F.lit(90.0))).first()
    assert d == pytest.approx(0.0, abs=1e-6)
    s2, d2, r2 = spark.range(1).select(*geo.auxiliary_plane(F.lit(s), F.lit(d), F.lit(r))).first()
    assert d2 == pytest.approx(90.0) and (s2 - strike) % 180 == pytest.approx(0.0, abs=1e-5) or (s2 - strike) % 180 == pytest.approx(180.0, abs=1e-5)


def test_crossings_of_repeated_vertices(spark):
    rows = frame(spark, [(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 2.0)], "k int, x double, y double").withColumn("t", F.lit("t"))
    assert [r.y for r in traces.crossings(rows, ["t"], "k", "x", "y", 0.5).collect()] == [0.5]


def test_rotated_slip_by_vectors(spark):
    rng = [(s, d, a) for s in (0, 89, 91, 180, 269, 271, 359) for d in (10, 60, 90) for a in (0, 30, 100, 210, 300)]
    for s, d, a in rng:
        along, across = spark.range(1).select(*matrices.rotated(F.lit(float(s)), F.lit(float(d)), F.lit(1.0), F.lit(0.0), a)).first()
        up, _ = spark.range(1).select(*matrices.rotated(F.lit(float(s)), F.lit(float(d)), F.lit(0.0), F.lit(1.0), a)).first()
        rs, rd, ra = (math.radians(v) for v in (s, d, a))
        east = along * math.sin(rs) - up * math.cos(rd) * math.cos(rs)
        north = along * math.cos(rs) + up * math.cos(rd) * math.sin(rs)
        if d < 90 or abs(math.cos(rs - ra)) > 1e-9:
            assert east * math.cos(ra) - north * math.sin(ra) == pytest.approx(0.0, abs=1e-9)
            assert east * math.sin(ra) + north * math.cos(ra) >= -1e-9
        assert along**2 + up**2 == pytest.approx(1.0) and across == pytest.approx(up)


def test_unreadable_lines_go(spark, tmp_path):
    layout = formats.CATALOGS["lat_first"]
    good = "2020 2 28 1 2 3.5 36.1 -118 5 4.2"
    bad = ["2020 13 1 1 2 3 36.1 -118 5 4.2", "2020 2 30 1 2 3 36.1 -118 5 4.2", "1e12 2 3 1 2 3 36.1 -118 5 4.2", "2020 2 3 25 2 3 36 -118 5 4", "2020 2 3 2 2 61 36 -118 5 4"]
    short = ["time of day", "2020 2"]
    (tmp_path / "c.txt").write_text("\n".join(["# header", good, *bad, *short, ""]))
    rows = formats.catalog(spark, str(tmp_path / "c.txt"), "lat_first").collect()
    assert [(str(r.ts), r.lat, r.mag) for r in rows] == [("2020-02-28 01:02:03", 36.1, 4.2)]
    assert sorted(r.value for r in formats.rejected(spark, str(tmp_path / "c.txt"), layout).collect()) == sorted(short)
    (tmp_path / "d.txt").write_text("1 2020 13 1 1 2 3 36N 30 118W 15 5 4.2\n2 2020 12 1 1 2 3 36N 30 118W 15 5 4.2\n")
    assert [r.lon for r in formats.degree_minute_catalog(spark, str(tmp_path / "d.txt")).collect()] == [-118.25]
    (tmp_path / "k.kml").write_text("<kml><coordinates></coordinates><coordinates> 1,2,3 4,5 x </coordinates></kml>")
    assert [(r.lon, r.lat, r.height) for r in formats.kml_coordinates(spark, str(tmp_path / "k.kml")).collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, None)]
    tensor = "PDEW{y} 13  3 11 39 37.0  1.0 2.0 10.0 0.0 6.0 PLACE\nevent name:     {n}\nlatitude:     1.0\nlongitude:    2.0\ndepth:       10.0\n" + "".join(f"M{c}:  1.0e+24\n" for c in ("rr", "tt", "pp", "rt", "rp", "tp"))
    (tmp_path / "t.txt").write_text(tensor.format(y=" 2020", n="bad") + tensor.replace(" 13 ", " 12 ").format(y=" 2020", n="good"))
    assert {r.event: r.ts is None for r in formats.moment_tensors(spark, str(tmp_path / "t.txt")).collect()} == {"bad": True, "good": False}
    (tmp_path / "st.day").write_text("2020 10 1.5\n99999999999 3 1\n2020 x 2\n")
    assert [(r.station, str(r.date), r.offset) for r in formats.creep(spark, str(tmp_path / "st.day")).where("date is not null").collect()] == [("st", "2020-01-11", 1.5)]
