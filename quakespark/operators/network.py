"""Networks of stations and pairs of points: scaling, paired points, strain, rotation and time-function fits, patches."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import fits
from ..functions.safe import ratio


def scale(df: DataFrame, factor: float, *columns: str) -> DataFrame:
    """Velocities or errors times a factor."""
    return df.withColumns({c: F.col(c) * factor for c in columns})


def los_velocity(df: DataFrame, enu: Sequence[str], look: Sequence[str], factor: float = 1.0, name: str = "value") -> DataFrame:
    """Line-of-sight value of a displacement, times a factor."""
    return df.withColumn(name, geo.project(*(F.col(c) for c in (*enu, *look))) * factor)


def point_pairs(df: DataFrame, x: str, y: str, strike: str, width: float, other: float | None = None) -> DataFrame:
    """Two rows for each fault point, ``side`` 1 and 2: ``width`` and ``other`` (as far, if not given) away across the strike."""
    s = F.radians(strike)
    at = lambda side, by: F.struct(F.lit(side).alias("side"), (F.col(x) + by * F.cos(s)).alias("px"), (F.col(y) - by * F.sin(s)).alias("py"))
    return df.withColumn("p", F.explode(F.array(at(1, float(width)), at(2, -float(width if other is None else other))))).select("*", "p.*").drop("p")


def stacked(df: DataFrame, keys: Sequence[str], components: Sequence[str]) -> DataFrame:
    """(keys, component, place, value): the components one after another, as one data vector."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for k, c in enumerate(components))))
    return df.select(*keys, each.alias("x")).select(*keys, "x.*")


def normalizing(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: mean position, and the largest distance from it along either axis."""
    mid = df.agg(F.avg(x).alias("x0"), F.avg(y).alias("y0"))
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"))
    both = mid.crossJoin(F.broadcast(ends))  # one row with one row
    return both.select("x0", "y0", F.greatest(F.col("x0") - F.col("a"), F.col("b") - F.col("x0"), F.col("y0") - F.col("c"), F.col("d") - F.col("y0")).alias("norm"))


def strain(df: DataFrame, x: str, y: str, east: str, north: str, by: Sequence[str] = ()) -> DataFrame:
    """Horizontal velocity gradient of a network, by least squares in one aggregate: its strain, dilatation and rotation.

    All are null for fewer than three stations, or stations on one line.
    """
    rows = df.groupBy(*by) if by else df
    cov = lambda a, b: F.covar_pop(a, b)
    sums = rows.agg(F.count("*").alias("n"), cov(x, x).alias("xx"), cov(y, y).alias("yy"), cov(x, y).alias("xy"), *(cov(a, v).alias(f"{k}{w}") for k, a in (("x", x), ("y", y)) for w, v in (("e", east), ("n", north))))
    whole = F.col("xx") * F.col("yy")
    det = F.when(whole - F.col("xy") * F.col("xy") > 1e-12 * whole, whole - F.col("xy") * F.col("xy"))
    slope = {f"d{w}dx": ratio(F.col(f"x{w}") * F.col("yy") - F.col(f"y{w}") * F.col("xy"), det) for w in "en"} | {f"d{w}dy": ratio(F.col(f"y{w}") * F.col("xx") - F.col(f"x{w}") * F.col("xy"), det) for w in "en"}
    out = sums.select(*by, "n", *(v.alias(k) for k, v in slope.items()))
    return out.withColumns({"dilatation": F.col("dedx") + F.col("dndy"), "shear": (F.col("dedy") + F.col("dndx")) / 2, "rotation": (F.col("dndx") - F.col("dedy")) / 2})



def principal_strain(df: DataFrame) -> DataFrame:
    """Add the largest and smallest principal strain, the largest shear and the first's azimuth (degrees from north) to rows of ``strain``."""
    e, n, s = F.col("dedx"), F.col("dndy"), F.col("shear")
    most = F.sqrt(((e - n) / 2) ** 2 + s * s)
    return df.withColumns({"first": (e + n) / 2 + most, "second": (e + n) / 2 - most, "max_shear": most, "azimuth": F.pmod(90 - F.degrees(F.atan2(2 * s, e - n)) / 2, F.lit(180.0))})


def _rotation_rows(df: DataFrame, lon: str, lat: str, east: str, north: str) -> tuple[DataFrame, list[Column]]:
    km = geo.EARTH_KM * math.pi / 180
    o, a = F.radians(lon), F.radians(lat)
    e = [-F.sin(a) * F.cos(o) * km, -F.sin(a) * F.sin(o) * km, F.cos(a) * km]
    n = [F.sin(o) * km, -F.cos(o) * km, F.lit(0.0)]
    both = df.select(F.explode(F.array(*(F.struct(*(c.alias(f"g{k}") for k, c in enumerate(g)), F.col(v).alias("v")) for g, v in ((e, east), (n, north))))).alias("r")).select("r.*")
    return both, [F.col(f"g{k}") for k in range(3)]


def rotation_vector(df: DataFrame, lon: str, lat: str, east: str, north: str) -> np.ndarray:
    """Rotation vector (x, y, z, degrees a million years) that fits velocities in mm/yr; only 3 x 3 sums reach the driver."""
    both, design = _rotation_rows(df, lon, lat, east, north)
    return fits.solve(both, design, "v")


def rotation_fit(df: DataFrame, lon: str, lat: str, east: str, north: str) -> dict[str, float]:
    """Pole, rate and their standard deviations, and the variance of the velocities left over, of the rotation that fits best."""
    both, design = _rotation_rows(df, lon, lat, east, north)
    vector, covariance, variance, n = fits.with_covariance(both, design, "v")
    x, y, z = vector
    flat, size = math.hypot(x, y), float(np.linalg.norm(vector))
    if not flat:
        return {"lon": float("nan"), "lat": math.copysign(90.0, z), "rate": size, "sd_lon": float("nan"), "sd_lat": float("nan"), "sd_rate": float("nan"), "variance": variance, "n": n}
    slopes = np.array([[-y / flat**2, x / flat**2, 0.0], [-x * z / (flat * size**2), -y * z / (flat * size**2), flat / size**2], vector / size])
    slopes[:2] = np.degrees(slopes[:2])
    spread = np.sqrt(np.maximum(np.diag(slopes @ covariance @ slopes.T), 0.0))
    at = pole(vector)
    return dict(zip(("lon", "lat", "rate"), at, strict=True)) | dict(zip(("sd_lon", "sd_lat", "sd_rate"), map(float, spread), strict=True)) | {"variance": variance, "n": n}


def referenced(df: DataFrame, station: str, names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Velocities less the mean ones of the named stations; raises where none of them is in the network."""
    at = df.where(F.col(station).isin(list(names))).agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values)).first()
    if not at["n"]:
        raise ValueError(f"no station of {', '.join(map(str, names))} is in the network")
    return df.withColumns({v: F.col(v) - float(at[v]) for v in values if at[v] is not None})


def pole(vector: np.ndarray) -> tuple[float, float, float]:
    """Longitude, latitude and rate of a rotation vector."""
    x, y, z = vector
    return math.degrees(math.atan2(y, x)), math.degrees(math.atan2(z, math.hypot(x, y))), float(np.linalg.norm(vector))


def remove_rotation(df: DataFrame, lon: str, lat: str, east: str, north: str) -> DataFrame:
    """Velocities less those of the rotation that fits them best."""
    e, n = geo.euler_velocity(F.col(lon), F.col(lat), *pole(rotation_vector(df, lon, lat, east, north)))
    return df.withColumns({east: F.col(east) - e, north: F.col(north) - n})


def remove_helmert(df: DataFrame, x: str, y: str, east: str, north: str) -> DataFrame:
    """Velocities less the shift, turn and scale that fit them best, the positions taken from their mean."""
    mid = df.agg(F.avg(x), F.avg(y)).first()
    dx, dy = F.col(x) - F.lit(float(mid[0] or 0)), F.col(y) - F.lit(float(mid[1] or 0))
    one, no = F.lit(1.0), F.lit(0.0)
    e, n = [one, no, dx, -dy], [no, one, dy, dx]
    both = df.select(F.explode(F.array(*(F.struct(*(c.alias(f"g{k}") for k, c in enumerate(g)), F.col(v).alias("v")) for g, v in ((e, east), (n, north))))).alias("r")).select("r.*")
    m = fits.solve(both, [F.col(f"g{k}") for k in range(4)], "v")
    return df.withColumns({east: F.col(east) - fits.evaluate(e, m), north: F.col(north) - fits.evaluate(n, m)})


def tidal_design(t_days: Column, periods_hours: Sequence[float]) -> list[Column]:
    """Offset, rate, and cosine and sine of each constituent."""
    waves = [f(2 * math.pi * 24 / p * t_days) for p in periods_hours for f in (F.cos, F.sin)]
    return [F.lit(1.0), t_days, *waves]


def remove_fit(df: DataFrame, design: Sequence[Column], value: str, name: str) -> tuple[DataFrame, np.ndarray]:
    """``value`` less the time functions that fit it, as column ``name``, and their weights."""
    m = fits.solve(df, design, value)
    return df.withColumn(name, F.col(value) - fits.evaluate(design, m)), m


def covariances(df: DataFrame, key: str, x: str, y: str, error: str, sill: float, length: float, reach: float) -> DataFrame:
    """(a, b, value): the data covariance, error squared on the diagonal and sill * exp(-distance / length) beside it up to ``reach``.

    Values are worked out for pairs of places, dealt over all cores, and given to all rows there.
    """
    from .joins import range_join
    from .shared import same, settled

    rows = df.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    places = settled(rows.select("x", "y").distinct().withColumn("p", F.monotonically_increasing_id()))
    members = settled(rows.join(places, same(rows, places, ("x", "y"))).select("k", "p"))
    one, two = (places.select(F.col("p").alias(f"p{k}"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "ab")
    apart = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    near = range_join(one, two, ("ax", "ay"), ("bx", "by"), reach).select("pa", "pb", (sill * F.exp(-apart / length)).alias("value"))
    dealt = near.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, "pa", "pb")
    beside = dealt.join(members.toDF("a", "pa"), "pa").join(members.toDF("b", "pb"), "pb").where("a <> b")
    return beside.select("a", "b", "value").unionByName(df.select(F.col(key).alias("a"), F.col(key).alias("b"), (F.col(error) * F.col(error)).alias("value")))


def fit_exponential(bins: DataFrame, distance: str, value: str, count: str) -> tuple[float, float]:
    """Sill and length of sill * exp(-distance / length) over positive bins, by a weighted line through the logarithms."""
    rows = bins.where(F.col(value) > 0).select(F.col(distance).alias("h"), F.log(value).alias("v"), F.col(count).cast("double").alias("w"))
    a, b = fits.solve(rows, [F.lit(1.0), F.col("h")], "v", F.col("w"))
    return math.exp(a), float(-1 / b)


def triangles(df: DataFrame, corners: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add centre (cx, cy, cz), area, strike and dip of triangles with corners (x, y, depth); the dip of an area of 0 is null."""
    (x1, y1, z1), (x2, y2, z2), (x3, y3, z3) = (tuple(F.col(c) for c in p) for p in corners)
    ax, ay, az, bx, by, bz = x2 - x1, y2 - y1, z1 - z2, x3 - x1, y3 - y1, z1 - z3
    nx, ny, nz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    up = F.when(nz < 0, -1.0).otherwise(1.0)
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    return df.withColumns({"cx": (x1 + x2 + x3) / 3, "cy": (y1 + y2 + y3) / 3, "cz": (z1 + z2 + z3) / 3, "area": size / 2, "strike": F.pmod(F.degrees(F.atan2(-up * ny, up * nx)), F.lit(360.0)), "dip": F.when(size > 0, F.degrees(F.acos(F.least(F.lit(1.0), ratio(F.abs(nz), size)))))})


def rectangle_corners(df: DataFrame, x: str, y: str, depth: str, strike: str, dip: str, length: str, width: str) -> DataFrame:
    """Add ``corners``: (x, y, depth) of the four corners of patches given by their centres, from the upper edge's start clockwise."""
    s, d = F.radians(strike), F.radians(dip)
    half, down = F.col(length) / 2, F.col(width) / 2
    at = lambda a, b: F.struct((F.col(x) + a * half * F.sin(s) + b * down * F.cos(d) * F.cos(s)).alias("x"), (F.col(y) + a * half * F.cos(s) - b * down * F.cos(d) * F.sin(s)).alias("y"), (F.col(depth) + b * down * F.sin(d)).alias("z"))
    return df.withColumn("corners", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)))


def potency_by_depth(df: DataFrame, depth: str, potency: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, potency, running): sums over bins closed at both ends, so a patch on an edge counts in both, and the running sum of them."""
    from pyspark.sql import Window

    step = (high - low) / bins
    at = (F.col(depth) - low) / step
    first, last = F.greatest(F.ceil(at - 1).cast("int"), F.lit(0)), F.least(F.floor(at).cast("int"), F.lit(bins - 1))
    rows = df.where(F.col(depth).between(low, high)).withColumn("bin", F.explode(F.sequence(first, last)))
    out = rows.groupBy("bin").agg(F.sum(potency).alias("potency"))
    return out.withColumn("running", F.sum("potency").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))  # as many rows as bins


def reconstruction(pixels: DataFrame, cells: DataFrame, keys: Sequence[str], value: str, mean: str) -> DataFrame:
    """One row: RMS of pixels about their cells' values, and how many are finite."""
    rows = pixels.join(cells, list(keys)).where(geo.is_finite(F.col(value)) & geo.is_finite(F.col(mean)))
    return rows.agg(F.sqrt(F.avg(F.pow(F.col(value) - F.col(mean), 2))).alias("rms"), F.count("*").alias("n"))
