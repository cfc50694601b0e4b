"""Queries on coordinates, angles, moments, dislocations, networks and traces, each beside its DuckDB SQL.

Roles: ``part`` gives points, planes and slips (the columns of ``points``), ``supplier`` a network, ``orders`` positions in
time; the dislocations are fixed values of the queries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles, geo, okada, seismo
from ..operators import joins, network, ordered, traces
from .queries import query, r, table

P = """p AS (SELECT p_partkey AS k, p_brand AS brand, (p_partkey * 7.3e0) % 360 - 180 AS lon, p_size * 1.5e0 - 40 AS lat, p_size AS size,
  (p_partkey * 13) % 360 + 0.5e0 AS strike, p_size * 1.7e0 AS dip, (p_partkey * 29) % 360 - 179.5e0 AS rake, p_retailprice / 1000 AS slip FROM part)"""
NETWORK = "s AS (SELECT s_suppkey AS k, s_nationkey AS nation, (s_suppkey * 37) % 101 / 10e0 AS x, (s_suppkey * 53) % 89 / 10e0 AS y, s_acctbal / 1000 AS v FROM supplier)"


def points(spark, d) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("k"), F.col("p_brand").alias("brand"), ((k * 7.3) % 360 - 180).alias("lon"), (size * 1.5 - 40).alias("lat"), size.alias("size"), ((k * 13) % 360 + 0.5).alias("strike"), (size * 1.7).alias("dip"), ((k * 29) % 360 - 179.5).alias("rake"), (F.col("p_retailprice") / 1000).alias("slip"))


def stations(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("k"), F.col("s_nationkey").alias("nation"), ((k * 37) % 101 / 10.0).alias("x"), ((k * 53) % 89 / 10.0).alias("y"), (F.col("s_acctbal") / 1000).alias("v"))


def solved3(table: str, sums: str) -> str:
    """SQL for m1, m2, m3 of three normal equations whose sums are g11 .. g33 and d1 .. d3."""
    return f"""{table}_s AS ({sums}), {table}_c AS (SELECT *, g22 * g33 - g23 * g23 AS c11, g13 * g23 - g12 * g33 AS c12, g12 * g23 - g13 * g22 AS c13, g11 * g33 - g13 * g13 AS c22, g12 * g13 - g11 * g23 AS c23, g11 * g22 - g12 * g12 AS c33 FROM {table}_s),
{table} AS (SELECT (c11 * d1 + c12 * d2 + c13 * d3) / (g11 * c11 + g12 * c12 + g13 * c13) AS m1, (c12 * d1 + c22 * d2 + c23 * d3) / (g11 * c11 + g12 * c12 + g13 * c13) AS m2, (c13 * d1 + c23 * d2 + c33 * d3) / (g11 * c11 + g12 * c12 + g13 * c13) AS m3 FROM {table}_c)"""


def sums3(a: str, b: str, c: str, v: str, source: str) -> str:
    """SQL for the sums of products of three columns and the data."""
    names = {"1": a, "2": b, "3": c}
    pairs = ", ".join(f"sum({names[i]} * {names[j]}) AS g{i}{j}" for i, j in ("11", "12", "13", "22", "23", "33"))
    return f"SELECT {pairs}, " + ", ".join(f"sum({names[i]} * {v}) AS d{i}" for i in "123") + f" FROM {source}"



def c(*names):
    return tuple(F.col(n) for n in names)


def named(df, values: dict, digits: int = 6, keys=("k",)):
    return df.select(*keys, *((F.round(v, digits) + 0.0).alias(n) for n, v in values.items()))


# Coordinates


@query(f"WITH {P} SELECT k, round(((lon + 360) % 360) + 0.0, 6) AS positive, round((2 * lon + 180 + 720) % 360 - 180, 6) AS wrapped, round(170 + (lon - 170 + 180 + 720) % 360 - 180, 6) AS aligned FROM p")
def geo_longitudes(spark, d):
    (lon,) = c("lon")
    return named(points(spark, d), {"positive": geo.positive_longitude(lon), "wrapped": geo.wrap_longitude(lon * 2), "aligned": geo.align_longitude(lon, 170.0)})


@query(f"""WITH {P}, a AS (SELECT k, lon, lat, strike, radians(lat) AS f, radians(10 - lon) AS dl, radians(20e0) AS g, 100 / 6371e0 AS h FROM p),
b AS (SELECT *, asin(sin(f) * cos(h) + cos(f) * sin(h) * cos(radians(strike))) AS f2 FROM a)
SELECT k, round((degrees(atan2(sin(dl) * cos(g), cos(f) * sin(g) - sin(f) * cos(g) * cos(dl))) + 360) % 360, 6) AS bearing, round(degrees(f2), 6) AS end_lat,
  round(lon + degrees(atan2(sin(radians(strike)) * sin(h) * cos(f), cos(h) - sin(f) * sin(f2))), 6) AS end_lon FROM b""")
def geo_bearing_endpoint(spark, d):
    lon, lat, strike = c("lon", "lat", "strike")
    end = geo.endpoint(lon, lat, 100.0, strike)
    return named(points(spark, d), {"bearing": geo.bearing(lon, lat, F.lit(10.0), F.lit(20.0)), "end_lat": end[1], "end_lon": end[0]})


@query(f"""WITH {P}, a AS (SELECT k, lon, lat, slip * 1000 AS h, radians(lat) AS f, radians(lon) AS o, 6378137 / sqrt(1 - 0.0066943799901413165e0 * pow(sin(radians(lat)), 2)) AS n FROM p)
SELECT k, round((n + h) * cos(f) * cos(o), 3) AS x, round((n + h) * cos(f) * sin(o), 3) AS y, round((n * (1 - 0.0066943799901413165e0) + h) * sin(f), 3) AS z, round(lon, 6) AS lon, round(lat, 6) AS lat, round(h, 3) AS height FROM a""")
def geo_ecef(spark, d):
    lon, lat, slip = c("lon", "lat", "slip")
    x, y, z = geo.llh_to_xyz(lon, lat, slip * 1000)
    rows = points(spark, d).select("k", x.alias("x"), y.alias("y"), z.alias("z"))
    lon, lat, h = geo.xyz_to_llh(*c("x", "y", "z"))
    both = named(rows, {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "height": h}, 3)
    return both.join(named(rows, {"lon": lon, "lat": lat}), "k")


@query(f"""WITH {P}, a AS (SELECT k, slip AS e, dip / 10 AS n, rake / 100 AS u, radians(lon) AS o, radians(lat) AS f FROM p)
SELECT k, round(-sin(o) * e - sin(f) * cos(o) * n + cos(f) * cos(o) * u, 6) AS x, round(cos(o) * e - sin(f) * sin(o) * n + cos(f) * sin(o) * u, 6) AS y, round(cos(f) * n + sin(f) * u, 6) AS z,
  round(e, 6) AS e, round(n, 6) AS n, round(u + 0.0, 6) AS u FROM a""")
def geo_enu_vectors(spark, d):
    lon, lat = c("lon", "lat")
    rows = points(spark, d).select("k", "lon", "lat", F.col("slip").alias("e"), (F.col("dip") / 10).alias("n"), (F.col("rake") / 100).alias("u"))
    x, y, z = geo.enu_to_xyz(*c("e", "n", "u"), lon, lat)
    rows = rows.select("k", "lon", "lat", x.alias("x"), y.alias("y"), z.alias("z"))
    return named(rows, dict(zip("enu", geo.xyz_to_enu(*c("x", "y", "z"), lon, lat), strict=True)) | {v: F.col(v) for v in "xyz"})


@query(f"WITH {P} SELECT k, round(k % 6 - 0.25e0, 6) AS lon, round(lat + 0.0, 6) AS lat, round(111 * (10 - lon) * cos(radians(lat)), 6) AS east, round(111 * (20 - lat), 6) AS north FROM p")
def geo_utm_round_trip(spark, d):
    rows = points(spark, d)
    lon = F.col("k") % 6 - 0.25
    x, y = geo.lonlat_to_xy(lon, F.col("lat"), geo.utm_zone(3.0))
    lon, lat = geo.xy_to_lonlat(x, y, geo.utm_zone(3.0))
    east, north = geo.flat_distance(*c("lon", "lat"), F.lit(10.0), F.lit(20.0))
    return named(rows, {"lon": lon, "lat": lat, "east": east, "north": north})


@query(f"""WITH {P}, a AS (SELECT k, radians(dip) AS i, radians(strike) AS h, strike, dip, slip FROM p)
SELECT k, round(-sin(i) * cos(h), 6) + 0e0 AS e, round(sin(i) * sin(h), 6) + 0e0 AS n, round(cos(i), 6) AS u, round(sin(i) * sin(h), 6) + 0e0 AS ae, round(sin(i) * cos(h), 6) + 0e0 AS an, round(strike, 6) AS heading, round(dip, 6) AS incidence, round(slip / cos(i), 6) AS vertical FROM a""")
def geo_look_vectors(spark, d):
    strike, dip, slip = c("strike", "dip", "slip")
    e, n, u = geo.look_vector(strike, dip)
    ae, an, _ = geo.los_from_azimuth(dip, strike)
    heading, incidence = geo.look_angles(e, n, u)
    return named(points(spark, d), {"e": e, "n": n, "u": u, "ae": ae, "an": an, "heading": heading, "incidence": incidence, "vertical": geo.los_to_vertical(slip, u)})


@query(f"""WITH {P} SELECT k, round((90 - degrees(atan2(lat + 0.3e0, lon + 0.1e0)) + 360) % 360, 6) AS strike, round(degrees(atan2(lat, -slip)), 6) AS rake, round(slip * cos(radians(rake)), 6) + 0e0 AS lateral, round(slip * sin(radians(rake)), 6) + 0e0 AS reverse FROM p""")
def geo_strike_and_slip(spark, d):
    lon, lat, slip, rake = c("lon", "lat", "slip", "rake")
    lateral, reverse = geo.slip_components(slip, rake)
    return named(points(spark, d), {"strike": geo.strike(lon + 0.1, lat + 0.3), "rake": geo.rake(slip, lat), "lateral": lateral, "reverse": reverse})


@query(f"""WITH {P}, a AS (SELECT k, strike, rake, dip, 2 * dip - 10 AS d2 FROM p)
SELECT k, round(sin(radians(dip)) * cos(radians(strike)), 6) + 0e0 AS ne, round(-sin(radians(dip)) * sin(radians(strike)), 6) + 0e0 AS nn, round(cos(radians(dip)), 6) AS nu,
  round(CASE WHEN d2 > 90 OR d2 < 0 THEN (strike + 180) % 360 ELSE strike END, 6) AS strike, round(CASE WHEN d2 > 90 THEN 180 - d2 WHEN d2 < 0 THEN -d2 ELSE d2 END, 6) AS dip,
  round(degrees(acos(least(1, abs(sin(radians(rake)) * sin(radians(dip)))))), 5) AS dip2, 0e0 AS across FROM a""")
def geo_planes(spark, d):
    strike, dip, rake = c("strike", "dip", "rake")
    n = geo.plane_normal(strike, dip)
    folded = geo.fold_dip(strike, dip * 2 - 10)
    s2, d2, _ = geo.auxiliary_plane(strike, dip, rake)
    n2 = geo.plane_normal(s2, d2)
    across = F.round(n[0] * n2[0] + n[1] * n2[1] + n[2] * n2[2], 6)
    rows = named(points(spark, d), {"ne": n[0], "nn": n[1], "nu": n[2], "strike": folded[0], "dip": folded[1]}, 6)
    return rows.join(named(points(spark, d), {"dip2": d2, "across": across}, 5), "k")


_KM = "6371 * pi() / 180"


@query(f"""WITH {P}, w AS (SELECT radians(0.5e0) * 6371 * cos(radians(60e0)) * cos(radians(-100e0)) AS x, radians(0.5e0) * 6371 * cos(radians(60e0)) * sin(radians(-100e0)) AS y, radians(0.5e0) * 6371 * sin(radians(60e0)) AS z),
a AS (SELECT k, radians(lon) AS o, radians(lat) AS f, slip, rake FROM p),
v AS (SELECT k, -sin(f) * cos(o) * x - sin(f) * sin(o) * y + cos(f) * z AS e, sin(o) * x - cos(o) * y AS n, o, f, slip, rake FROM a, w),
b AS (SELECT -sin(f) * cos(o) * {_KM} AS a1, -sin(f) * sin(o) * {_KM} AS a2, cos(f) * {_KM} AS a3, e + slip AS v FROM v UNION ALL SELECT sin(o) * {_KM}, -cos(o) * {_KM}, 0e0, n - rake / 50 FROM v),
{solved3('m', sums3('a1', 'a2', 'a3', 'v', 'b'))}
SELECT k, round(e, 6) + 0e0 AS east, round(n, 6) + 0e0 AS north, round(e + slip - {_KM} * (-sin(f) * cos(o) * m1 - sin(f) * sin(o) * m2 + cos(f) * m3), 6) + 0e0 AS east_left, round(n - rake / 50 - {_KM} * (sin(o) * m1 - cos(o) * m2), 6) + 0e0 AS north_left FROM v, m""")
def network_euler_rotation(spark, d):
    """Velocities about a pole, and what the best rotation leaves of them with other motion added."""
    lon, lat = c("lon", "lat")
    east, north = geo.euler_velocity(lon, lat, -100.0, 60.0, 0.5)
    rows = points(spark, d).withColumns({"east": east, "north": north})
    moved = rows.withColumns({"east": F.col("east") + F.col("slip"), "north": F.col("north") - F.col("rake") / 50})
    left = network.remove_rotation(moved, "lon", "lat", "east", "north").select("k", F.col("east").alias("east_left"), F.col("north").alias("north_left"))
    return named(rows.join(left, "k"), {n: F.col(n) for n in ("east", "north", "east_left", "north_left")})


@query(f"""WITH {P}, a AS (SELECT radians(lon) AS o, radians(lat) AS f, slip, rake FROM p),
b AS (SELECT -sin(f) * cos(o) * {_KM} AS a1, -sin(f) * sin(o) * {_KM} AS a2, cos(f) * {_KM} AS a3, slip * 20 AS v FROM a UNION ALL SELECT sin(o) * {_KM}, -cos(o) * {_KM}, 0e0, rake / 50 FROM a),
{solved3('m', sums3('a1', 'a2', 'a3', 'v', 'b'))},
l AS (SELECT sum(pow(v - a1 * m1 - a2 * m2 - a3 * m3, 2)) / (count(*) - 3) AS variance, count(*) AS n FROM b, m),
q AS (SELECT *, variance / (g11 * c11 + g12 * c12 + g13 * c13) AS f, sqrt(m1 * m1 + m2 * m2) AS flat, sqrt(m1 * m1 + m2 * m2 + m3 * m3) AS size FROM m, m_c, l)
SELECT round(degrees(atan2(m2, m1)), 4) AS lon, round(degrees(atan2(m3, flat)), 4) AS lat, round(size, 8) AS rate, round(variance, 5) AS variance, n,
  round(sqrt(f * (m1 * m1 * c11 + m2 * m2 * c22 + m3 * m3 * c33 + 2 * (m1 * m2 * c12 + m1 * m3 * c13 + m2 * m3 * c23))) / size, 8) AS sd_rate,
  round(degrees(sqrt(f * (m2 * m2 * c11 + m1 * m1 * c22 - 2 * m1 * m2 * c12)) / pow(flat, 2)), 4) AS sd_lon FROM q""")
def network_pole_uncertainty(spark, d):
    """The pole that fits velocities with other motion best, with standard deviations."""
    rows = points(spark, d).withColumns({"east": F.col("slip") * 20, "north": F.col("rake") / 50})
    got = network.rotation_fit(rows, "lon", "lat", "east", "north")
    digits = {"lon": 4, "lat": 4, "rate": 8, "variance": 5, "sd_rate": 8, "sd_lon": 4}
    return spark.createDataFrame([(*(round(float(got[k]), n) for k, n in digits.items()), got["n"])], ", ".join(f"{k} double" for k in digits) + ", n long")


@query(f"WITH {NETWORK}, m AS (SELECT avg(x) AS x0, avg(v) AS v0 FROM s WHERE k IN (3, 5)) SELECT k, round(x - x0, 6) + 0e0 AS x, round(v - v0, 6) + 0e0 AS v FROM s, m")
def network_referenced(spark, d):
    rows = network.referenced(stations(spark, d), "k", [3, 5], ["x", "v"])
    return named(rows, {"x": F.col("x"), "v": F.col("v")})


@query(f"""WITH {NETWORK}, q AS (SELECT a.nation, (b.v - a.v) / (b.x - a.x) AS slope FROM s a JOIN s b ON a.nation = b.nation AND a.x < b.x), m AS (SELECT nation, median(slope) AS slope FROM q GROUP BY 1)
SELECT nation, round(any_value(slope), 5) + 0e0 AS slope, round(median(v - slope * x), 5) + 0e0 AS intercept, count(*) AS n FROM s LEFT JOIN m USING (nation) GROUP BY nation""")
def network_theil_sen(spark, d):
    """Median slopes by nation; the SQL lists all pairs, the operator counts them."""
    from ..operators import fits

    return fits.theil_sen(stations(spark, d), ["nation"], "x", "v").select("nation", r("slope", 5), r("intercept", 5), "n")


@query(f"WITH {P} SELECT brand, round((degrees(atan2(sum(sin(radians(strike))), sum(cos(radians(strike))))) + 360) % 360, 4) AS direction FROM p GROUP BY 1")
def geo_circular_mean(spark, d):
    return points(spark, d).groupBy("brand").agg(F.round(geo.circular_mean(F.col("strike")), 4).alias("direction"))


@query("SELECT event_id, round(year(ts) + (epoch_us(ts) - epoch_us(date_trunc('year', ts))) / (epoch_us(date_trunc('year', ts) + INTERVAL 1 YEAR) - epoch_us(date_trunc('year', ts))), 9) AS t FROM events")
def geo_decimal_year(spark, d):
    return table(spark, d, "events").select("event_id", F.round(geo.decimal_year(F.col("ts")), 9).alias("t"))


@query(f"WITH {P} SELECT k, round(-slip * 0.0555e0 / (4 * pi()), 9) AS los, round(slip * 0.01e0, 9) AS metres FROM p")
def geo_units_and_phase(spark, d):
    (slip,) = c("slip")
    return named(points(spark, d), {"los": geo.phase_to_los(slip, 0.0555), "metres": slip * geo.unit_factor("cm/yr")}, 9)


@query(f"""WITH {P} SELECT k, round(90 - strike, 6) AS cartesian, round(strike - 90, 6) AS north, round(cos(radians(90 - strike)), 6) + 0e0 AS e, round(sin(radians(90 - strike)), 6) + 0e0 AS n,
  round(slip * cos(radians(30e0)) - dip * sin(radians(30e0)), 6) + 0e0 AS x, round(slip * sin(radians(30e0)) + dip * cos(radians(30e0)), 6) AS y, round(slip / sqrt(slip * slip + dip * dip + 1), 6) AS unit FROM p""")
def angle_conventions(spark, d):
    strike, dip, slip = c("strike", "dip", "slip")
    e, n = angles.unit_from_heading(strike)
    x, y = angles.rotate(slip, dip, 30.0)
    return named(points(spark, d), {"cartesian": angles.heading_to_cartesian(strike), "north": angles.cartesian_to_north(strike), "e": e, "n": n, "x": x, "y": y, "unit": angles.normalized(slip, dip, F.lit(1.0))[0]})


@query(f"""WITH {P} SELECT k, round(slip / sin(radians(dip)), 6) AS width, round(sqrt(pow(lon - lat, 2) + pow(lat - 1, 2)), 6) AS length, round(size - slip / 2 * sin(radians(dip)), 6) AS top, round(size + slip / 2 * sin(radians(dip)), 6) AS bottom,
  round(size + slip * sin(radians(dip)), 6) AS lower, round(lon + slip * sin(radians(strike)), 6) AS x, round(lat + slip * cos(radians(strike)), 6) AS y FROM p""")
def fault_dimensions(spark, d):
    lon, lat, strike, dip, slip, size = c("lon", "lat", "strike", "dip", "slip", "size")
    top, bottom = angles.edges_of_center(size, slip, dip)
    x, y = angles.ahead(lon, lat, slip, strike)
    return named(points(spark, d), {"width": angles.downdip_width(size, size + slip, angles.check_dip(dip)), "length": angles.strike_length(lat, F.lit(1.0), lon, lat), "top": top, "bottom": bottom, "lower": angles.edges_of_top(size, slip, dip)[1], "x": x, "y": y})


@query(f"""WITH {P}, a AS (SELECT k, abs(size - 25) / 10e0 AS u, (size - 25) / 10e0 AS t FROM p)
SELECT k, round(CASE WHEN u < 1 THEN 2 / 3e0 - u * u + u * u * u / 2 WHEN u < 2 THEN pow(2 - u, 3) / 6 ELSE 0 END, 8) AS cubic, round(CASE WHEN u < 1 THEN 1 - u ELSE 0 END, 8) AS hat,
  round(10 * (CASE WHEN t <= -1 THEN 0 WHEN t < 0 THEN pow(1 + t, 2) / 2 WHEN t < 1 THEN 1 - pow(1 - t, 2) / 2 ELSE 1 END), 8) AS rise FROM a""")
def spline_basis(spark, d):
    t = F.col("size") - 25.0
    return named(points(spark, d), {"cubic": angles.b_spline(3, 10.0, t), "hat": angles.b_spline(1, 10.0, t), "rise": angles.i_spline(1, 10.0, t)}, 8)


# Moments, elasticity, stress


@query(f"WITH {P} SELECT k, round(2 / 3e0 * log10(slip * 1e18 * 1e7) - 10.7, 6) AS magnitude, round(log10(pow(10, 1.5 * (size / 10e0 + 10.7)) * 1e-7), 6) AS log_moment FROM p")
def seismo_dyne_moments(spark, d):
    return named(points(spark, d), {"magnitude": seismo.magnitude_dyne(F.col("slip") * 1e18), "log_moment": F.log10(seismo.moment_dyne(F.col("size") / 10.0))})


@query(f"""WITH {P}, a AS (SELECT k, slip * 80 AS e, size / 110e0 AS v FROM p), b AS (SELECT *, e / (2 * (1 + v)) AS g, e * v / ((1 + v) * (1 - 2 * v)) AS l FROM a)
SELECT k, round(g, 6) AS shear, round(l, 6) AS lame, round(l + 2 * g / 3, 6) AS bulk, round(l + 2 * g, 6) AS p_modulus, round(e, 6) AS young1, round(v, 6) AS poisson1, round(e, 6) AS young2, round(v, 6) AS poisson2 FROM b""")
def elastic_constants(spark, d):
    m = seismo.elastic(F.col("slip") * 80, F.col("size") / 110.0)
    one, two = seismo.elastic_from_lame(m["lame"], m["shear"]), seismo.elastic_from_bulk(m["bulk"], m["shear"])
    return named(points(spark, d), m | {"young1": one["young"], "poisson1": one["poisson"], "young2": two["young"], "poisson2": two["poisson"]})


@query(f"""WITH {P} SELECT k, round(sqrt((slip * slip + dip * dip + lat * lat + 2 * (rake * rake + lon * lon + size * size)) / 2), 5) AS moment, round((slip + dip + lat) / 3, 6) + 0e0 AS isotropic FROM p""")
def moment_tensors(spark, d):
    m = dict(zip(("rr", "tt", "pp", "rt", "rp", "tp"), c("slip", "dip", "lat", "rake", "lon", "size"), strict=True))
    return named(points(spark, d), {"moment": F.round(seismo.scalar_moment(m), 5), "isotropic": seismo.isotropic(m)})


@query(f"""WITH {P}, a AS (SELECT k, slip AS ee, lat / 10 AS en, rake / 50 AS eu, dip / 9 AS nn, lon / 60 AS nu, size / 7e0 AS uu, radians(strike) AS s, radians(dip) AS d FROM p),
n AS (SELECT *, sin(d) * cos(s) AS n1, -sin(d) * sin(s) AS n2, cos(d) AS n3 FROM a),
t AS (SELECT *, ee * n1 + en * n2 + eu * n3 AS t1, en * n1 + nn * n2 + nu * n3 AS t2, eu * n1 + nu * n2 + uu * n3 AS t3, (ee + nn + uu) / 3 AS m FROM n),
q AS (SELECT *, t1 * n1 + t2 * n2 + t3 * n3 AS normal, t1 * sin(s) + t2 * cos(s) AS along, -t1 * cos(s) * cos(d) + t2 * sin(s) * cos(d) + t3 * sin(d) AS up FROM t)
SELECT k, round(normal, 6) + 0e0 AS normal, round(along, 6) + 0e0 AS along, round(up, 6) + 0e0 AS up, round(3 * m, 6) + 0e0 AS trace, round((pow(ee - m, 2) + pow(nn - m, 2) + pow(uu - m, 2)) / 2 + en * en + eu * eu + nu * nu, 6) AS j2,
  round(abs(along) - 0.4e0 * normal - 0.1e0, 6) + 0e0 AS coulomb FROM q""")
def stress_on_planes(spark, d):
    slip, lat, rake, dip, lon, size, strike = c("slip", "lat", "rake", "dip", "lon", "size", "strike")
    s = {"ee": slip, "en": lat / 10, "eu": rake / 50, "nn": dip / 9, "nu": lon / 60, "uu": size / 7.0}
    normal, along, up = seismo.tractions(s, strike, dip)
    return named(points(spark, d), {"normal": normal, "along": along, "up": up, "trace": seismo.stress_trace(s), "j2": seismo.second_invariant(s), "coulomb": seismo.coulomb(along, normal, 0.4, 0.1)})


@query(f"WITH {P} SELECT k, round((lat + rake) / 2, 6) + 0e0 AS en, round(slip + dip, 6) AS dilatation, round((rake - lat) / 2, 6) + 0e0 AS rotation, round(sqrt(pow((slip - dip) / 2, 2) + pow((lat + rake) / 2, 2)), 6) AS max_shear FROM p")
def strain_rates(spark, d):
    m = seismo.strain_rate(dict(zip(("ee", "en", "ne", "nn"), c("slip", "lat", "rake", "dip"), strict=True)))
    return named(points(spark, d), {k: m[k] for k in ("en", "dilatation", "rotation", "max_shear")})


@query(f"""WITH {P} SELECT k, round(20 / pi() * atan((size - 25) / 15e0), 6) + 0e0 AS backslip, round(20 / pi() * atan((size - 25) / 15e0) + 3 * ((CASE WHEN size >= 25 THEN 0.5e0 ELSE -0.5e0 END) - atan((size - 25) / 4e0) / pi()), 6) AS creep, round(1 + 0.1e0 * (size - 25) + (CASE WHEN size >= 25 THEN 5 ELSE 0 END), 6) + 0e0 AS step FROM p""")
def profile_models(spark, d):
    x = F.col("size").cast("double")
    p = {"center": 25.0, "rate": 20.0, "depth": 15.0, "creep": 3.0, "creep_depth": 4.0, "a": 1.0, "b": 0.1, "step": 5.0}
    return named(points(spark, d), {"backslip": seismo.profile_model("backslip", x, p), "creep": seismo.profile_model("creep", x, p), "step": seismo.profile_model("step_linear", x, p)})


# Dislocations

FAULT = {"depth": 30.0, "dip": 70.0, "length": 40.0, "width": 20.0}
OKADA = """WITH g AS (SELECT p_partkey AS k, (p_partkey % 97) - 40.5e0 AS x, p_size * 2 - 47.3e0 AS y, radians(70e0) AS a, 1 - 2 * 0.25e0 AS al FROM part),
h AS (SELECT *, sin(a) AS s, cos(a) AS c, y * cos(a) + 30 * sin(a) AS p, y * sin(a) - 30 * cos(a) AS q FROM g),
e AS (SELECT h.*, sign, x - dx AS xi, p - dp AS eta FROM h, (VALUES (1, 0, 0), (-1, 0, 20), (-1, 40, 0), (1, 40, 20)) v(sign, dx, dp)),
f AS (SELECT *, sqrt(xi * xi + eta * eta + q * q) AS r, eta * c + q * s AS yt, eta * s - q * c AS dt, sqrt(xi * xi + q * q) AS xx FROM e),
i AS (SELECT *, al * 2 / c * atan((eta * (xx + q * c) + xx * (r + xx) * s) / (xi * (r + xx) * c)) AS i5, al / c * (ln(r + dt) - s * ln(r + eta)) AS i4, ln(r + eta) AS lg, atan(xi * eta / (q * r)) AS turn, 1 / (r * (r + eta)) AS ea, 1 / (r * (r + xi)) AS fa FROM f),
j AS (SELECT *, al * (yt / (c * (r + dt)) - lg) + s / c * i4 AS i3, -al / c * xi / (r + dt) - s / c * i5 AS i1 FROM i),
l AS (SELECT *, -al * lg - i3 AS i2 FROM j),
u AS (SELECT k,
  sum(sign * (-1.5e0 * (xi * q * ea + turn + i1 * s) - 0.7e0 * (q / r - i3 * s * c) + 0.2e0 * (q * q * ea - i3 * s * s))) / (2 * pi()) AS ux,
  sum(sign * (-1.5e0 * (yt * q * ea + q * c * r * ea + i2 * s) - 0.7e0 * (yt * q * fa + c * turn - i1 * s * c) + 0.2e0 * (-dt * q * fa - s * (xi * q * ea - turn) - i1 * s * s))) / (2 * pi()) AS uy,
  sum(sign * (-1.5e0 * (dt * q * ea + q * s * r * ea + i4 * s) - 0.7e0 * (dt * q * fa + s * turn - i5 * s * c) + 0.2e0 * (yt * q * fa + c * (xi * q * ea - turn) - i5 * s * s))) / (2 * pi()) AS uz FROM l GROUP BY k)
SELECT k, round(ux, 6) + 0e0 AS ux, round(uy, 6) + 0e0 AS uy, round(uz, 6) + 0e0 AS uz FROM u"""


@query(OKADA)
def forward_rectangle(spark, d):
    x, y = F.col("k") % 97 - 40.5, F.col("size") * 2 - 47.3
    u = okada.rectangle(x, y, **FAULT, slips={"strike": 1.5, "dip": 0.7, "opening": 0.2})
    return named(points(spark, d), dict(zip(("ux", "uy", "uz"), u, strict=True)))


@query(OKADA.replace("SELECT k, round(ux, 6) + 0e0 AS ux, round(uy, 6) + 0e0 AS uy, round(uz, 6) + 0e0 AS uz FROM u", """SELECT k, round(2 * (ux * sin(radians(30e0)) - uy * cos(radians(30e0))), 6) + 0e0 AS ue, round(2 * (ux * cos(radians(30e0)) + uy * sin(radians(30e0))), 6) + 0e0 AS un, round(2 * uz, 6) + 0e0 AS uu FROM u"""))
def forward_faults(spark, d):
    """Two faults in one place, given by their upper edges, at points placed along and across their strike of 30 degrees."""
    s, w, deep = math.radians(30), 20 * math.cos(math.radians(70)), 20 * math.sin(math.radians(70))
    x, y = F.col("k") % 97 - 40.5 - 20, F.col("size") * 2 - 47.3 - w
    rows = points(spark, d).withColumns({"e": x * math.sin(s) - y * math.cos(s), "n": x * math.cos(s) + y * math.sin(s)})
    one = {"center": (0.0, 0.0), "depth": 30.0 - deep, "strike": 30.0, "dip": 70.0, "length": 40.0, "width": 20.0, "slips": {"strike": 1.5, "dip": 0.7, "opening": 0.2}}
    return named(okada.faults(rows, "e", "n", [one, one]), {n: F.col(n) for n in ("ue", "un", "uu")})


# Networks


@query(f"WITH {NETWORK} SELECT k, round(v * 2.5e0, 6) AS v, round((v * 0.3e0 + x * 0.1e0 + y * 0.9e0) * 10, 6) + 0e0 AS value FROM s")
def network_scaled_los(spark, d):
    rows = stations(spark, d).withColumns({"le": F.lit(0.3), "ln": F.lit(0.1), "lu": F.lit(0.9)})
    rows = network.scale(network.los_velocity(rows, ("v", "x", "y"), ("le", "ln", "lu"), 10.0), 2.5, "v")
    return named(rows, {"v": F.col("v"), "value": F.col("value")})


@query(f"""WITH {P} SELECT k, side, round(lon + w * cos(radians(strike)), 6) + 0e0 AS px, round(lat - w * sin(radians(strike)), 6) + 0e0 AS py FROM p, (VALUES (1, 2e0), (2, -3e0)) v(side, w)""")
def cross_fault_pairs(spark, d):
    rows = network.point_pairs(points(spark, d), "lon", "lat", "strike", 2.0, 3.0)
    return named(rows, {"px": F.col("px"), "py": F.col("py")}, keys=("k", "side"))


@query(f"WITH {NETWORK} SELECT k, component, place, round(CASE component WHEN 'x' THEN x WHEN 'y' THEN y ELSE v END, 6) AS value FROM s, (VALUES ('x', 0), ('y', 1), ('v', 2)) c(component, place)")
def data_vector(spark, d):
    return network.stacked(stations(spark, d), ["k"], ["x", "y", "v"]).select("k", "component", "place", F.round("value", 6).alias("value"))


@query(f"WITH {NETWORK}, m AS (SELECT avg(x) AS x0, avg(y) AS y0 FROM s) SELECT round(x0, 6) AS x0, round(y0, 6) AS y0, round(max(greatest(abs(x - x0), abs(y - y0))), 6) AS norm FROM s, m GROUP BY 1, 2")
def normalizing_factor(spark, d):
    return network.normalizing(stations(spark, d), "x", "y").select(*(F.round(n, 6).alias(n) for n in ("x0", "y0", "norm")))


@query(f"""WITH {NETWORK}, w AS (SELECT *, v + 0.3e0 * x - 0.2e0 * y AS e, 0.5e0 * y - v * x / 9 AS n FROM s),
m AS (SELECT count(*) AS n, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, e) AS xe, covar_pop(y, e) AS ye, covar_pop(x, n) AS xn, covar_pop(y, n) AS yn FROM w),
g AS (SELECT n, (xe * yy - ye * xy) / (xx * yy - xy * xy) AS ex, (xn * yy - yn * xy) / (xx * yy - xy * xy) AS nx, (ye * xx - xe * xy) / (xx * yy - xy * xy) AS ey, (yn * xx - xn * xy) / (xx * yy - xy * xy) AS ny FROM m)
SELECT n, round(ex, 6) AS dedx, round(nx, 6) AS dndx, round(ey, 6) AS dedy, round(ny, 6) AS dndy, round(ex + ny, 6) AS dilatation, round((ey + nx) / 2, 6) AS shear, round((nx - ey) / 2, 6) AS rotation FROM g""")
def network_strain(spark, d):
    x, y, v = c("x", "y", "v")
    rows = stations(spark, d).withColumns({"e": v + 0.3 * x - 0.2 * y, "n": 0.5 * y - v * x / 9})
    return network.strain(rows, "x", "y", "e", "n").select("n", *(F.round(k, 6).alias(k) for k in ("dedx", "dndx", "dedy", "dndy", "dilatation", "shear", "rotation")))


@query(f"""WITH {NETWORK}, g AS (SELECT k, x - (SELECT avg(x) FROM s) AS dx, y - (SELECT avg(y) FROM s) AS dy, 1 + 0.3e0 * x - 0.2e0 * y + v AS e, 2 + 0.2e0 * x + 0.3e0 * y - v * y / 9 AS n FROM s),
m AS (SELECT avg(e) AS e0, avg(n) AS n0, sum(dx * e + dy * n) / sum(dx * dx + dy * dy) AS scale, sum(dx * n - dy * e) / sum(dx * dx + dy * dy) AS turn FROM g)
SELECT k, round(e - e0 - scale * dx + turn * dy, 6) + 0e0 AS e, round(n - n0 - scale * dy - turn * dx, 6) + 0e0 AS n FROM g, m""")
def network_helmert_removed(spark, d):
    x, y, v = c("x", "y", "v")
    rows = stations(spark, d).withColumns({"e": 1 + 0.3 * x - 0.2 * y + v, "n": 2 + 0.2 * x + 0.3 * y - v * y / 9})
    rows = network.remove_helmert(rows, "x", "y", "e", "n")
    return named(rows, {"e": F.col("e"), "n": F.col("n")})


@query(f"""WITH b AS (SELECT event_id, value, cos(2 * pi() * 24 / 12.42e0 * t) AS c, sin(2 * pi() * 24 / 12.42e0 * t) AS s, 1e0 AS o FROM (SELECT event_id, value, epoch_us(ts) / 86400e6 - 19723 AS t FROM events)),
{solved3('m', sums3('o', 'c', 's', 'value', 'b'))}
SELECT event_id, round(value - m1 - m2 * c - m3 * s, 5) + 0e0 AS left_over FROM b, m""")
def series_tides_removed(spark, d):
    """The events' values without their mean and the part that follows the main tide."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6) - 19723
    rows = table(spark, d, "events").select("event_id", "value", t.alias("t"))
    waves = network.tidal_design(F.col("t"), (12.42,))
    rows, _ = network.remove_fit(rows, [waves[0], *waves[2:]], "value", "left_over")
    return rows.select("event_id", (F.round("left_over", 5) + 0.0).alias("left_over"))


@query(f"""WITH {NETWORK} SELECT a.k AS a, b.k AS b, round(CASE WHEN a.k = b.k THEN a.v * a.v ELSE 2 * exp(-sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 0.5e0) END, 6) AS value
FROM s a, s b WHERE a.k = b.k OR sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1""")
def data_covariance(spark, d):
    return network.covariances(stations(spark, d), "k", "x", "y", "v", 2.0, 0.5, 1.0).select("a", "b", F.round("value", 6).alias("value"))


@query("""WITH b AS (SELECT p_size * 1e0 AS h, ln(avg(p_retailprice) / 300 * exp(-p_size / 12.5e0)) AS v, count(*) * 1e0 AS w FROM part WHERE p_size > 0 GROUP BY p_size),
s AS (SELECT sum(w) AS s, sum(w * h) AS sh, sum(w * h * h) AS shh, sum(w * v) AS sv, sum(w * h * v) AS shv FROM b)
SELECT round(exp((sv * shh - shv * sh) / (s * shh - sh * sh)), 6) AS sill, round(-(s * shh - sh * sh) / (s * shv - sh * sv), 6) AS length FROM s""")
def covariogram_fit(spark, d):
    bins = table(spark, d, "part").where("p_size > 0").groupBy("p_size").agg(F.count("*").alias("count"), F.avg("p_retailprice").alias("price")).withColumn("value", F.col("price") / 300 * F.exp(-F.col("p_size") / 12.5))
    sill, length = network.fit_exponential(bins, "p_size", "value", "count")
    return spark.createDataFrame([(round(sill, 6), round(length, 6))], "sill double, length double")


@query(f"""WITH {NETWORK}, t AS (SELECT k, x AS x1, y AS y1, 1 + v / 10 AS z1, x + 2 AS x2, y + 0.5e0 AS y2, 2e0 AS z2, x + 0.3e0 AS x3, y + 3 AS y3, 5e0 AS z3 FROM s),
n AS (SELECT *, (y2 - y1) * (z1 - z3) - (z1 - z2) * (y3 - y1) AS nx, (z1 - z2) * (x3 - x1) - (x2 - x1) * (z1 - z3) AS ny, (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) AS nz FROM t)
SELECT k, round((z1 + z2 + z3) / 3, 6) AS cz, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) AS area, round(degrees(acos(abs(nz) / sqrt(nx * nx + ny * ny + nz * nz))), 5) AS dip, round((degrees(atan2(-ny * sign(nz), nx * sign(nz))) + 360) % 360, 5) AS strike FROM n""")
def triangle_geometry(spark, d):
    x, y, v = c("x", "y", "v")
    rows = stations(spark, d).select("k", x.alias("x1"), y.alias("y1"), (1 + v / 10).alias("z1"), (x + 2).alias("x2"), (y + 0.5).alias("y2"), F.lit(2.0).alias("z2"), (x + 0.3).alias("x3"), (y + 3).alias("y3"), F.lit(5.0).alias("z3"))
    rows = network.triangles(rows, [("x1", "y1", "z1"), ("x2", "y2", "z2"), ("x3", "y3", "z3")])
    return rows.select("k", *(F.round(n, digits).alias(n) for n, digits in (("cz", 6), ("area", 6), ("dip", 5), ("strike", 5))))


@query(f"""WITH {P} SELECT k, place, round(lon + a * 2 * sin(radians(strike)) + b * slip * cos(radians(dip)) * cos(radians(strike)), 6) + 0e0 AS x, round(lat + a * 2 * cos(radians(strike)) - b * slip * cos(radians(dip)) * sin(radians(strike)), 6) + 0e0 AS y, round(size + b * slip * sin(radians(dip)), 6) AS z
FROM p, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) c(place, a, b)""")
def rectangle_corners(spark, d):
    rows = points(spark, d).withColumns({"length": F.lit(4.0), "width": F.col("slip") * 2})
    rows = network.rectangle_corners(rows, "lon", "lat", "size", "strike", "dip", "length", "width").select("k", F.posexplode("corners").alias("place", "q")).select("k", "place", "q.*")
    return named(rows, {n: F.col(n) for n in "xyz"}, keys=("k", "place"))


@query(f"""WITH {P}, b AS (SELECT i AS bin, i * 5 AS low, i * 5 + 5 AS high FROM range(8) t(i)), t AS (SELECT bin, sum(slip * 10) AS q FROM p JOIN b ON size BETWEEN low AND high GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, round(q, 4) AS potency, round(sum(q) OVER (ORDER BY bin), 4) AS running FROM t""")
def potency_with_depth(spark, d):
    rows = network.potency_by_depth(points(spark, d).withColumn("potency", F.col("slip") * 10), "size", "potency", 0.0, 40.0, 8)
    return rows.select("bin", r("potency"), r("running"))


@query(f"WITH {P}, m AS (SELECT size, avg(slip) AS mean FROM p GROUP BY 1) SELECT round(sqrt(avg(pow(slip - mean, 2))), 6) AS rms, count(*) AS n FROM p JOIN m USING (size)")
def downsample_reconstruction(spark, d):
    rows = points(spark, d)
    return network.reconstruction(rows, rows.groupBy("size").agg(F.avg("slip").alias("mean")), ["size"], "slip", "mean").select(F.round("rms", 6).alias("rms"), "n")


@query(f"WITH {P} SELECT brand, k FROM (SELECT brand, k, row_number() OVER (PARTITION BY brand ORDER BY pow(lon - 3, 2) + pow(lat - 4, 2), k) AS i FROM p) WHERE i = 1")
def cell_center_nearest(spark, d):
    far = F.pow(F.col("lon") - 3, 2) + F.pow(F.col("lat") - 4, 2)
    return points(spark, d).groupBy("brand").agg(F.min_by("k", F.struct(far, F.col("k"))).alias("k"))


# Traces: the orders of a customer, in time order.

TRACE = "t AS (SELECT o_custkey AS c, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, (o_orderkey * 31) % 97 / 10e0 AS x, o_totalprice / 10000 AS y FROM orders)"


def _traces(spark, d) -> DataFrame:
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("c"), key.alias("id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("seq"), (key * 31 % 97 / 10.0).alias("x"), (F.col("o_totalprice") / 10000).alias("y"))


@query(f"WITH {TRACE}, e AS (SELECT *, first_value(x) OVER w AS a, last_value(x) OVER w AS b FROM t WINDOW w AS (PARTITION BY c ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT c, id, CAST(row_number() OVER (PARTITION BY c ORDER BY CASE WHEN a > b THEN -seq ELSE seq END) - 1 AS INTEGER) AS seq FROM e")
def trace_oriented(spark, d):
    return traces.oriented(_traces(spark, d), ["c"], "seq", "x").select("c", "id", "seq")


@query(f"WITH {TRACE} SELECT c, id, CAST(row_number() OVER (PARTITION BY c ORDER BY seq DESC) - 1 AS INTEGER) AS seq FROM t")
def trace_reversed(spark, d):
    return traces.reversed_trace(_traces(spark, d), ["c"], "seq").select("c", "id", "seq")


@query(f"WITH {TRACE.replace('o_totalprice / 10000', 'sqrt(o_totalprice / 10000)')}, n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY c ORDER BY seq)) SELECT c, 4.55e0 AS x, round(y + (4.55e0 - x) / (x2 - x) * (y2 - y), 6) AS y FROM n WHERE (x < 4.55e0 AND x2 > 4.55e0) OR (x > 4.55e0 AND x2 < 4.55e0)")
def trace_crossings(spark, d):
    return traces.crossings(_traces(spark, d).withColumn("y", F.sqrt("y")), ["c"], "seq", "x", "y", 4.55).select("c", "x", F.round("y", 6).alias("y"))


@query(f"""WITH {TRACE}, n AS (SELECT *, lag(y, 2) OVER w AS a, lag(y) OVER w AS b, lead(y) OVER w AS e, lead(y, 2) OVER w AS f FROM t WINDOW w AS (PARTITION BY c ORDER BY seq))
SELECT c, id, round(CASE WHEN a IS NULL OR f IS NULL THEN y ELSE (-3 * a + 12 * b + 17 * y + 12 * e - 3 * f) / 35 END, 6) AS y FROM n""")
def trace_smoothed(spark, d):
    return traces.polynomial_smooth(_traces(spark, d), ["c"], "seq", ["y"]).select("c", "id", F.round("y", 6).alias("y"))


@query(f"""WITH {TRACE}, n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM t WINDOW w AS (PARTITION BY c ORDER BY seq)),
l AS (SELECT *, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS lp, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS ln FROM n)
SELECT c, id, round(CASE WHEN lp IS NULL AND ln > 0 THEN x + (x - nx) / ln WHEN ln IS NULL AND lp > 0 THEN x + (x - px) / lp ELSE x END, 6) AS x, round(CASE WHEN lp IS NULL AND ln > 0 THEN y + (y - ny) / ln WHEN ln IS NULL AND lp > 0 THEN y + (y - py) / lp ELSE y END, 6) AS y FROM l""")
def trace_extended(spark, d):
    rows = traces.extended(_traces(spark, d), ["c"], "seq", "x", "y", 1.0)
    return named(rows, {"x": F.col("x"), "y": F.col("y")}, keys=("c", "id"))


@query(f"""WITH {TRACE}, n AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM t WINDOW w AS (PARTITION BY c ORDER BY seq)), a AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY c ORDER BY seq) AS arc FROM n)
SELECT c, id FROM a WHERE arc BETWEEN 5.0005e0 AND 60.0005e0""")
def trace_trimmed(spark, d):
    rows = ordered.arc_length(_traces(spark, d), ["c"], "seq", "x", "y")
    arc = next(n for n in rows.columns if n not in ("c", "id", "seq", "x", "y"))
    return traces.trimmed(rows, ["c"], arc, 5.0005, 60.0005).select("c", "id")


@query(f"WITH {P} SELECT brand, k, CAST(row_number() OVER (PARTITION BY brand ORDER BY k) - 1 AS INTEGER) AS seq FROM (SELECT *, min(size) OVER (PARTITION BY brand) AS top FROM p) WHERE size <= top + 2")
def trace_of_shallow_patches(spark, d):
    return traces.shallow_edge(points(spark, d), ["brand"], "size", "k", 2.0).select("brand", "k", "seq")


@query(f"WITH {P}, g AS (SELECT *, lon * cos(radians(30e0)) AS unused FROM p) SELECT k, round(lat, 6) + 0e0 AS side FROM g")
def signed_side(spark, d):
    return named(joins.signed_distance(points(spark, d), "lon", "lat", (0.0, 0.0), (10.0, 0.0), "side"), {"side": F.col("side")})
