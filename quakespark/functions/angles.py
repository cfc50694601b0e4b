"""Angle conventions, unit vectors, fault dimensions and spline bases."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from .safe import ratio

# Semi-major axis (m) and inverse flattening of reference ellipsoids.
DATUMS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "CLARKE1866": (6378206.4, 294.9786982), "INTERNATIONAL": (6378388.0, 297.0)}


def datum(name: str) -> tuple[float, float]:
    """Semi-major axis and flattening."""
    a, inverse = DATUMS[name.upper().replace(" ", "").replace("-", "")]
    return a, 1 / inverse


def heading_to_cartesian(heading: Column) -> Column:
    """Degrees counterclockwise from east of degrees clockwise from north; its own inverse."""
    return 90 - heading


def complement(angle: Column) -> Column:
    return 90 - angle


def cartesian_to_north(angle: Column) -> Column:
    """Degrees counterclockwise from north of degrees counterclockwise from east."""
    return angle - 90


def rotate(x: Column, y: Column, degrees: Column | float) -> tuple[Column, Column]:
    """A vector turned counterclockwise."""
    t = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    return x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t)


def normalized(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The unit vector; null for a vector of length 0."""
    size = F.sqrt(x * x + y * y + z * z)
    return ratio(x, size), ratio(y, size), ratio(z, size)


def unit_from_cartesian(angle: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(angle)), F.sin(F.radians(angle))


def unit_from_heading(heading: Column) -> tuple[Column, Column]:
    return unit_from_cartesian(heading_to_cartesian(heading))


def ahead(x: Column, y: Column, length: Column, heading: Column) -> tuple[Column, Column]:
    """The point that lies ``length`` along a heading."""
    e, n = unit_from_heading(heading)
    return x + length * e, y + length * n


def downdip_width(top: Column, bottom: Column, dip: Column) -> Column:
    """Width of a fault between two depths; null where it is flat."""
    return ratio(bottom - top, F.sin(F.radians(dip)))


def strike_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def edges_of_center(center: Column, width: Column, dip: Column) -> tuple[Column, Column]:
    """Depths of a fault's top and bottom from the depth of its centre."""
    half = width / 2 * F.sin(F.radians(dip))
    return center - half, center + half


def edges_of_top(top: Column, width: Column, dip: Column) -> tuple[Column, Column]:
    return top, top + width * F.sin(F.radians(dip))


def check_dip(dip: Column) -> Column:
    """The dip where it is in [0, 90], else an error."""
    return F.when(dip.between(0, 90), dip).otherwise(F.raise_error(F.lit("dip is outside 0 to 90 degrees")).cast("double"))


def b_spline(order: int, spacing: float, t: Column) -> Column:
    """The central B-spline of the order on knots ``spacing`` apart: a sum of truncated powers."""
    u = t / spacing + (order + 1) / 2
    terms = (((-1) ** k * math.comb(order + 1, k) / math.factorial(order)) * F.pow(F.greatest(u - k, F.lit(0.0)), F.lit(float(order))) for k in range(order + 2))
    inside = F.abs(t) < spacing * (order + 1) / 2
    return F.when(inside, sum(terms, F.lit(0.0))).otherwise(0.0)


def i_spline(order: int, spacing: float, t: Column) -> Column:
    """The integral of that B-spline from the left, which rises from 0 to the spacing."""
    u = t / spacing + (order + 1) / 2
    terms = (((-1) ** k * math.comb(order + 1, k) / math.factorial(order + 1)) * F.pow(F.greatest(u - k, F.lit(0.0)), F.lit(float(order + 1))) for k in range(order + 2))
    return F.when(u >= order + 1, F.lit(float(spacing))).otherwise(spacing * sum(terms, F.lit(0.0)))
