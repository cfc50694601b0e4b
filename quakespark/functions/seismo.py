"""Magnitudes, moments, elastic constants, stresses and time functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from .safe import ratio

# Intercept and slope of log10(length, width or area) on magnitude, by mechanism, and the magnitudes they hold for.
SCALING = {
    "surface_length": {"SS": (-3.55, 0.74), "R": (-2.86, 0.63), "N": (-2.01, 0.50), "ALL": (-3.22, 0.69)},
    "rupture_length": {"SS": (-2.57, 0.62), "R": (-2.42, 0.58), "N": (-1.88, 0.50), "ALL": (-2.44, 0.59)},
    "rupture_width": {"SS": (-0.76, 0.27), "R": (-1.61, 0.41), "N": (-1.14, 0.35), "ALL": (-1.01, 0.32)},
    "rupture_area": {"SS": (-3.42, 0.90), "R": (-3.99, 0.98), "N": (-2.87, 0.82), "ALL": (-3.49, 0.91)},
}


def moment(magnitude: Column) -> Column:
    """Moment in N m by 1.5 M + 9.1."""
    return F.pow(F.lit(10.0), 1.5 * magnitude + 9.1)


def magnitude(moment_nm: Column) -> Column:
    return 2.0 / 3.0 * (F.log10(moment_nm) - 9.1)


def magnitude_dyne(moment_nm: Column) -> Column:
    """Moment magnitude by the dyne-centimetre convention (constant 10.7)."""
    return 2.0 / 3.0 * F.log10(moment_nm * 1e7) - 10.7


def moment_dyne(magnitude_value: Column) -> Column:
    return F.pow(F.lit(10.0), 1.5 * (magnitude_value + 10.7)) * 1e-7


def patch_moment(shear_modulus: Column | float, area_km2: Column, slip_m: Column) -> Column:
    """Moment in N m of slip on an area."""
    return area_km2 * 1e6 * slip_m * shear_modulus


def scaling(kind: str, magnitude_value: Column, mechanism: str = "ALL") -> Column:
    """Length or width (km) or area (km2) expected at a magnitude."""
    a, b = SCALING[kind][mechanism]
    return F.pow(F.lit(10.0), a + b * magnitude_value)


def elastic(young: Column, poisson: Column) -> dict[str, Column]:
    """The other elastic constants of Young's modulus and Poisson's ratio."""
    shear = ratio(young, 2 * (1 + poisson))
    lame = ratio(young * poisson, (1 + poisson) * (1 - 2 * poisson))
    return {"shear": shear, "lame": lame, "bulk": lame + 2 * shear / 3, "p_modulus": lame + 2 * shear}


def elastic_from_lame(lame: Column, shear: Column) -> dict[str, Column]:
    return {"young": ratio(shear * (3 * lame + 2 * shear), lame + shear), "poisson": ratio(lame, 2 * (lame + shear)), "bulk": lame + 2 * shear / 3}


def elastic_from_bulk(bulk: Column, shear: Column) -> dict[str, Column]:
    return {"young": ratio(9 * bulk * shear, 3 * bulk + shear), "poisson": ratio(3 * bulk - 2 * shear, 2 * (3 * bulk + shear)), "lame": bulk - 2 * shear / 3}


def scalar_moment(m: dict[str, Column]) -> Column:
    """Scalar moment of a symmetric tensor with entries rr, tt, pp, rt, rp, tp."""
    return F.sqrt((m["rr"] ** 2 + m["tt"] ** 2 + m["pp"] ** 2 + 2 * (m["rt"] ** 2 + m["rp"] ** 2 + m["tp"] ** 2)) / 2)


def isotropic(m: dict[str, Column]) -> Column:
    return (m["rr"] + m["tt"] + m["pp"]) / 3


def coulomb(shear_stress: Column, normal_stress: Column, friction: float, cohesion: float = 0.0) -> Column:
    """Coulomb failure stress: shear less friction times (compressive) normal stress less cohesion."""
    return F.abs(shear_stress) - friction * normal_stress - cohesion


def tractions(s: dict[str, Column], strike_deg: Column, dip_deg: Column) -> tuple[Column, Column, Column]:
    """Normal, along-strike and up-dip traction of a stress tensor (ee, en, eu, nn, nu, uu) on a plane."""
    a, d = F.radians(strike_deg), F.radians(dip_deg)
    n = (F.sin(d) * F.cos(a), -F.sin(d) * F.sin(a), F.cos(d))
    t = (s["ee"] * n[0] + s["en"] * n[1] + s["eu"] * n[2], s["en"] * n[0] + s["nn"] * n[1] + s["nu"] * n[2], s["eu"] * n[0] + s["nu"] * n[1] + s["uu"] * n[2])
    along, up = (F.sin(a), F.cos(a), F.lit(0.0)), (-F.cos(a) * F.cos(d), F.sin(a) * F.cos(d), F.sin(d))
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    return dot(t, n), dot(t, along), dot(t, up)


def stress_trace(s: dict[str, Column]) -> Column:
    return s["ee"] + s["nn"] + s["uu"]


def deviatoric(s: dict[str, Column]) -> dict[str, Column]:
    mean = stress_trace(s) / 3
    return {k: v - mean if k in ("ee", "nn", "uu") else v for k, v in s.items()}


def second_invariant(s: dict[str, Column]) -> Column:
    d = deviatoric(s)
    return (d["ee"] ** 2 + d["nn"] ** 2 + d["uu"] ** 2) / 2 + d["en"] ** 2 + d["eu"] ** 2 + d["nu"] ** 2


def strain_rate(l: dict[str, Column]) -> dict[str, Column]:  # noqa: E741
    """Symmetric part of a horizontal velocity gradient (ee, en, ne, nn), its dilatation and rotation."""
    return {"ee": l["ee"], "nn": l["nn"], "en": (l["en"] + l["ne"]) / 2, "dilatation": l["ee"] + l["nn"], "rotation": (l["ne"] - l["en"]) / 2, "max_shear": F.sqrt(((l["ee"] - l["nn"]) / 2) ** 2 + ((l["en"] + l["ne"]) / 2) ** 2)}


def time_function(kind: str, t: Column, at: float = 0.0, tau: float = 1.0, power: int = 2) -> Column:
    """One column of a time-series design: linear, poly, step, exp, log, cos or sin (of period tau)."""
    after = t >= at
    made = {
        "offset": F.lit(1.0),
        "linear": t - at,
        "quadratic": (t - at) ** 2,
        "poly": (t - at) ** power,
        "step": F.when(after, 1.0).otherwise(0.0),
        "linear_finite": F.least(F.greatest(t - at, F.lit(0.0)), F.lit(tau)),
        "exp": F.when(after, 1 - F.exp(-(t - at) / tau)).otherwise(0.0),
        "log": F.when(after, F.log1p(F.greatest(t - at, F.lit(0.0)) / tau)).otherwise(0.0),
        "cos": F.cos(2 * math.pi * (t - at) / tau),
        "sin": F.sin(2 * math.pi * (t - at) / tau),
    }
    if kind not in made:
        raise ValueError(f"unknown time function {kind!r}; known: {', '.join(made)}")
    return made[kind]


def profile_model(kind: str, x: Column, p: dict[str, float]) -> Column:
    """Fault-crossing velocity profiles: step_linear, backslip (interseismic arctangent) and creep."""
    u = x - p.get("center", 0.0)
    if kind == "step_linear":
        return p["a"] + p["b"] * u + F.when(u >= 0, p["step"]).otherwise(0.0)
    arctan = p["rate"] / math.pi * F.atan(u / p["depth"]) + p.get("offset", 0.0)
    if kind == "backslip":
        return arctan
    if kind == "creep":
        return arctan + p["creep"] * (F.when(u >= 0, 0.5).otherwise(-0.5) - F.atan(u / p["creep_depth"]) / math.pi)
    raise ValueError(f"unknown profile model {kind!r}")
