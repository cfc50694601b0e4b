"""Surface displacement of a rectangular dislocation in an elastic half-space, as Column expressions.

Formulas: Y. Okada, Surface deformation due to shear and tensile faults in a half-space, BSSA 75 (1985), 1135-1154.
At a corner that meets the surface the displacement has no value: null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from .safe import ratio


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def _corner(xi: Column, eta: Column, q: Column, dip: float, alpha: float) -> dict[str, tuple[Column, Column, Column]]:
    """Terms of one corner for strike, dip and opening slip of one: along strike, across it, up."""
    s, c = math.sin(dip), math.cos(dip)
    r = F.sqrt(xi * xi + eta * eta + q * q)
    y, d = eta * c + q * s, eta * s - q * c
    log = F.when(r + eta > 1e-12, F.log(r + eta)).otherwise(-F.log(r - eta))
    if abs(c) > 1e-6:
        x = F.sqrt(xi * xi + q * q)
        i5 = F.when(F.abs(xi) < 1e-12, 0.0).otherwise(alpha * 2 / c * F.atan((eta * (x + q * c) + x * (r + x) * s) / (xi * (r + x) * c)))
        i4 = alpha / c * (_log(r + d) - s * log)
        i3 = alpha * (ratio(y, c * (r + d)) - log) + s / c * i4
        i1 = ratio(-alpha / c * xi, r + d) - s / c * i5
    else:
        i5 = ratio(-alpha * xi * s, r + d)
        i4 = ratio(-alpha * q, r + d)
        i3 = alpha / 2 * (ratio(eta, r + d) + ratio(y * q, F.pow(r + d, 2)) - log)
        i1 = ratio(-alpha / 2 * xi * q, F.pow(r + d, 2))
    i2 = -alpha * log - i3
    e = F.when(r + eta > 1e-12, 1 / (r * (r + eta))).otherwise(0.0)
    f = F.when(r + xi > 1e-12, 1 / (r * (r + xi))).otherwise(0.0)
    turn = F.when(F.abs(q) < 1e-12, 0.0).otherwise(F.atan(xi * eta / (q * r)))
    return {
        "strike": (-(xi * q * e + turn + i1 * s), -(y * q * e + q * c * r * e + i2 * s), -(d * q * e + q * s * r * e + i4 * s)),
        "dip": (-(ratio(q, r) - i3 * s * c), -(y * q * f + c * turn - i1 * s * c), -(d * q * f + s * turn - i5 * s * c)),
        "opening": (q * q * e - i3 * s * s, -d * q * f - s * (xi * q * e - turn) - i1 * s * s, y * q * f + c * (xi * q * e - turn) - i5 * s * s),
    }


def rectangle(x: Column, y: Column, depth: float, dip: float, length: float, width: float, slips: dict[str, float], poisson: float = 0.25) -> tuple[Column, Column, Column]:
    """Displacement (along x, along y, up) at surface points.

    The fault's lower edge lies at ``depth`` from the origin along +x for ``length``, and it rises towards +y over ``width``
    at ``dip`` degrees. ``slips`` has strike (left-lateral), dip (thrust) and opening parts.
    """
    angle, alpha = math.radians(dip), 1 - 2 * poisson
    p, q = y * math.cos(angle) + depth * math.sin(angle), y * math.sin(angle) - depth * math.cos(angle)
    total = [F.lit(0.0)] * 3
    for sign, xi, eta in ((1, x, p), (-1, x, p - width), (-1, x - length, p), (1, x - length, p - width)):
        for kind, terms in _corner(xi, eta, q, angle, alpha).items():
            size = slips.get(kind, 0.0)
            if size:
                total = [t + sign * size / (2 * math.pi) * term for t, term in zip(total, terms, strict=True)]
    return total[0], total[1], total[2]


def fault(e: Column, n: Column, center: tuple[float, float], depth: float, strike: float, dip: float, length: float, width: float, slips: dict[str, float], poisson: float = 0.25) -> tuple[Column, Column, Column]:
    """East, north and up of a fault given by the centre of its upper edge, its depth there and its strike (it dips to the right)."""
    a = math.radians(strike)
    de, dn = e - center[0], n - center[1]
    x = de * math.sin(a) + dn * math.cos(a) + length / 2
    y = -de * math.cos(a) + dn * math.sin(a) + width * math.cos(math.radians(dip))
    along, across, up = rectangle(x, y, depth + width * math.sin(math.radians(dip)), dip, length, width, slips, poisson)
    return along * math.sin(a) - across * math.cos(a), along * math.cos(a) + across * math.sin(a), up


def faults(df, e: str, n: str, patches: list[dict], poisson: float = 0.25):
    """Add ``ue``, ``un``, ``uu``: the sum over patches, each a dict of the arguments of ``fault``; a few dozen patches fit one expression."""
    parts = [fault(F.col(e), F.col(n), poisson=poisson, **p) for p in patches]
    return df.withColumns({c: sum((x[k] for x in parts), F.lit(0.0)) for k, c in enumerate(("ue", "un", "uu"))})
