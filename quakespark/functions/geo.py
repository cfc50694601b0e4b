"""Coordinates, angles and look vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from .safe import ratio

# Mean earth radius (km), and WGS84 semi-major axis (m) and flattening.
EARTH_KM, WGS84_A, WGS84_F = 6371.0, 6378137.0, 1 / 298.257223563
_E2 = WGS84_F * (2 - WGS84_F)


def _c(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite(c: Column) -> Column:
    """The value where it is finite, else null, so that aggregates leave it out."""
    return F.when(is_finite(c), c)


def positive_longitude(lon: Column) -> Column:
    """Longitudes below 0 moved up by 360."""
    return F.when(lon < 0, lon + 360).otherwise(lon)


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def align_longitude(lon: Column, reference: Column | float) -> Column:
    """The branch of the longitude nearest to the reference."""
    ref = _c(reference)
    return ref + F.pmod(lon - ref + 180, F.lit(360.0)) - 180


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial compass bearing from the first point to the second, in [0, 360)."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def endpoint(lon: Column, lat: Column, km: Column | float, azimuth: Column | float) -> tuple[Column, Column]:
    """Longitude and latitude reached from a point along a bearing."""
    d, az, a = _c(km) / EARTH_KM, F.radians(_c(azimuth)), F.radians(lat)
    b = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(az))
    return lon + F.degrees(F.atan2(F.sin(az) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(b))), F.degrees(b)


def utm_zone(lon: float) -> int:
    return int(math.floor((lon + 180) / 6)) % 60 + 1


def _series() -> tuple[float, list[float], list[float]]:
    """Rectifying radius (km) and the forward and inverse coefficients of the transverse Mercator series, to n^4."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) / 1000
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, forward, inverse


def lonlat_to_xy(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """UTM easting and northing in km."""
    radius, forward, _ = _series()
    e = math.sqrt(_E2)
    d, phi = F.radians(lon - (6 * zone - 183)), F.radians(lat)
    s = F.sin(phi)
    tau = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(tau, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(tau * tau + F.cos(d) * F.cos(d)))
    x, y = eta, xi
    for k, a in enumerate(forward, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500 + 0.9996 * radius * x, 0.9996 * radius * y + (10000 if south else 0)


def xy_to_lonlat(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM point in km."""
    radius, _, inverse = _series()
    xi, eta = (y - (10000 if south else 0)) / (0.9996 * radius), (x - 500) / (0.9996 * radius)
    a, b = xi, eta
    for k, c in enumerate(inverse, 1):
        a = a - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        b = b - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    e2 = _E2
    # conformal to geodetic latitude
    phi = chi + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) * F.sin(2 * chi) + (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) * F.sin(4 * chi) + (7 * e2**3 / 120 + 81 * e2**4 / 1120) * F.sin(6 * chi) + 4279 * e2**4 / 161280 * F.sin(8 * chi)
    return (6 * zone - 183) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(phi)


def llh_to_xyz(lon: Column, lat: Column, height: Column | float) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in m of geodetic coordinates."""
    a, o, h = F.radians(lat), F.radians(lon), _c(height)
    n = WGS84_A / F.sqrt(1 - _E2 * F.sin(a) * F.sin(a))
    return (n + h) * F.cos(a) * F.cos(o), (n + h) * F.cos(a) * F.sin(o), (n * (1 - _E2) + h) * F.sin(a)


def xyz_to_llh(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height of earth-centred coordinates, to below a millimetre."""
    p = F.sqrt(x * x + y * y)
    lat = F.atan2(z, p * (1 - _E2))
    for _ in range(4):
        n = WGS84_A / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
        lat = F.atan2(z + n * _E2 * F.sin(lat), p)
    n = WGS84_A / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(F.atan2(y, x)), F.degrees(lat), F.when(p > F.abs(z), p / F.cos(lat) - n).otherwise(z / F.sin(lat) - n * (1 - _E2))


def xyz_to_enu(x: Column, y: Column, z: Column, lon: Column | float, lat: Column | float) -> tuple[Column, Column, Column]:
    """An earth-centred vector in east, north and up at a place."""
    o, a = F.radians(_c(lon)), F.radians(_c(lat))
    return -F.sin(o) * x + F.cos(o) * y, -F.sin(a) * F.cos(o) * x - F.sin(a) * F.sin(o) * y + F.cos(a) * z, F.cos(a) * F.cos(o) * x + F.cos(a) * F.sin(o) * y + F.sin(a) * z


def enu_to_xyz(e: Column, n: Column, u: Column, lon: Column | float, lat: Column | float) -> tuple[Column, Column, Column]:
    o, a = F.radians(_c(lon)), F.radians(_c(lat))
    return -F.sin(o) * e - F.sin(a) * F.cos(o) * n + F.cos(a) * F.cos(o) * u, F.cos(o) * e - F.sin(a) * F.sin(o) * n + F.cos(a) * F.sin(o) * u, F.cos(a) * n + F.sin(a) * u


def flat_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """East and north offsets in km on a local plane (111 km a degree)."""
    return 111.0 * (lon2 - lon1) * F.cos(F.radians(lat1)), 111.0 * (lat2 - lat1)


def los_from_heading(incidence: Column, heading: Column, right: bool = True) -> tuple[Column, Column, Column]:
    """Unit vector from ground to satellite (east, north, up) for an incidence angle and flight heading in degrees."""
    i, h = F.radians(incidence), F.radians(heading)
    side = 1.0 if right else -1.0
    return -side * F.sin(i) * F.cos(h), side * F.sin(i) * F.sin(h), F.cos(i)


def los_from_azimuth(incidence: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """Unit vector from ground to satellite for an incidence angle and the azimuth it points to."""
    i, a = F.radians(incidence), F.radians(azimuth)
    return F.sin(i) * F.sin(a), F.sin(i) * F.cos(a), F.cos(i)


def look_vector(heading: Column, incidence: Column) -> tuple[Column, Column, Column]:
    """Ground-to-satellite vector of a right-looking satellite."""
    return los_from_heading(incidence, heading)


def look_angles(e: Column, n: Column, u: Column) -> tuple[Column, Column]:
    """Flight heading (0 to 360) and incidence of a right-looking satellite's ground-to-satellite vector."""
    return F.pmod(F.degrees(F.atan2(n, -e)), F.lit(360.0)), F.degrees(F.atan2(F.sqrt(e * e + n * n), u))


def project(e: Column, n: Column, u: Column, le: Column, ln: Column, lu: Column) -> Column:
    """Displacement along a look vector; null where the vector is zero."""
    return F.when((le != 0) | (ln != 0) | (lu != 0), e * le + n * ln + u * lu)


def los_to_vertical(los: Column, lu: Column) -> Column:
    """Vertical displacement that would give the line-of-sight value without horizontal motion; null for a horizontal look vector."""
    return ratio(los, lu)


def strike(dx: Column, dy: Column) -> Column:
    """Compass direction of a vector, in [0, 360)."""
    return F.pmod(90 - F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def rake(right_lateral: Column, dip_slip: Column) -> Column:
    return F.degrees(F.atan2(dip_slip, -right_lateral))


def slip_components(slip: Column, rake_deg: Column) -> tuple[Column, Column]:
    """Left-lateral and reverse parts of a slip with a rake."""
    return slip * F.cos(F.radians(rake_deg)), slip * F.sin(F.radians(rake_deg))


def plane_normal(strike_deg: Column, dip_deg: Column) -> tuple[Column, Column, Column]:
    """Upward unit normal (east, north, up) of a plane that dips to the right of its strike."""
    s, d = F.radians(strike_deg), F.radians(dip_deg)
    return F.sin(d) * F.cos(s), -F.sin(d) * F.sin(s), F.cos(d)


def fold_dip(strike_deg: Column, dip_deg: Column) -> tuple[Column, Column]:
    """Strike and dip with the dip in [0, 90]: beyond, the plane is turned round."""
    turn = (dip_deg > 90) | (dip_deg < 0)
    return F.when(turn, F.pmod(strike_deg + 180, F.lit(360.0))).otherwise(strike_deg), F.when(dip_deg > 90, 180 - dip_deg).when(dip_deg < 0, -dip_deg).otherwise(dip_deg)


def auxiliary_plane(strike_deg: Column, dip_deg: Column, rake_deg: Column) -> tuple[Column, Column, Column]:
    """Strike, dip and rake of a focal mechanism's other nodal plane."""
    s, d, r = (F.radians(x) for x in (strike_deg, dip_deg, rake_deg))
    # slip vector (north, east, down); the other plane's normal
    sn = F.cos(r) * F.cos(s) + F.sin(r) * F.cos(d) * F.sin(s)
    se = F.cos(r) * F.sin(s) - F.sin(r) * F.cos(d) * F.cos(s)
    sd = -F.sin(r) * F.sin(d)
    nn, ne, nd = -F.sin(d) * F.sin(s), F.sin(d) * F.cos(s), -F.cos(d)
    flip = F.when(sd > 0, -1.0).otherwise(1.0)
    an, ae, ad = flip * sn, flip * se, flip * sd
    bn, be, bd = flip * nn, flip * ne, flip * nd
    dip2 = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -ad)))
    strike2 = F.atan2(-an, ae)
    along = bn * F.cos(strike2) + be * F.sin(strike2)
    # along the plane's steepest way up, which has a direction on a flat plane too
    up = F.cos(dip2) * (bn * F.sin(strike2) - be * F.cos(strike2)) - bd * F.sin(dip2)
    return F.pmod(F.degrees(strike2), F.lit(360.0)), F.degrees(dip2), F.degrees(F.atan2(up, along))


def euler_velocity(lon: Column, lat: Column, pole_lon: float, pole_lat: float, degrees_per_my: float) -> tuple[Column, Column]:
    """East and north velocity in mm/yr of a point that turns about a pole."""
    w = math.radians(degrees_per_my) * EARTH_KM  # km/My = mm/yr
    po, pa = math.radians(pole_lon), math.radians(pole_lat)
    wx, wy, wz = w * math.cos(pa) * math.cos(po), w * math.cos(pa) * math.sin(po), w * math.sin(pa)
    o, a = F.radians(lon), F.radians(lat)
    return -F.sin(a) * F.cos(o) * wx - F.sin(a) * F.sin(o) * wy + F.cos(a) * wz, F.sin(o) * wx - F.cos(o) * wy


def circular_mean(angle_deg: Column) -> Column:
    """Aggregate: the mean direction in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians(angle_deg))), F.sum(F.cos(F.radians(angle_deg))))), F.lit(360.0))


def decimal_year(ts: Column) -> Column:
    """Year and the part of it that has passed."""
    start = F.make_timestamp(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    after = F.make_timestamp(F.year(ts) + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.year(ts) + (micros(ts) - micros(start)) / (micros(after) - micros(start))


def unit_factor(unit: str) -> float:
    """Metres in a unit of length, with or without a rate by year."""
    # Metres in each unit.
    metres = {"m": 1.0, "cm": 0.01, "mm": 0.001, "km": 1000.0}
    name = unit.strip().lower().removesuffix("/yr").removesuffix("/year")
    if name not in metres:
        raise ValueError(f"unknown unit {unit!r}")
    return metres[name]


def phase_to_los(phase: Column, wavelength: float) -> Column:
    """Line-of-sight displacement towards the satellite of unwrapped phase."""
    return -phase * (wavelength / (4 * math.pi))
