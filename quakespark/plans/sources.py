"""Queries on Green's functions and forward models of patch tables, each beside its DuckDB SQL.

Roles: ``part`` gives points at the surface, ``nation`` 25 rectangular patches with slips; the SQL writes the surface formulas
for rectangles out, the operators integrate point forces over polygons or use the formulas for points at any depth.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import greens
from ..operators.shared import at_places

from .queries import query, r, table

_TERMS = [
    ("-(xi * q * ea + turn + i1 * s)", "-(yt * q * ea + q * c * rr * ea + i2 * s)", "-(dt * q * ea + q * s * rr * ea + i4 * s)"),
    ("-(q / rr - i3 * s * c)", "-(yt * q * fa + c * turn - i1 * s * c)", "-(dt * q * fa + s * turn - i5 * s * c)"),
    ("q * q * ea - i3 * s * s", "-dt * q * fa - s * (xi * q * ea - turn) - i1 * s * s", "yt * q * fa + c * (xi * q * ea - turn) - i5 * s * s"),
]
_SUMS = ", ".join(f"sum(sign * ({t})) / (2 * pi()) AS u{k}{j}" for k, terms in enumerate(_TERMS) for j, t in enumerate(terms))
_TURNED = ", ".join(f"u{k}0 * sin(st) - u{k}1 * cos(st) AS {n}_east, u{k}0 * cos(st) + u{k}1 * sin(st) AS {n}_north, u{k}2 AS {n}_up" for k, n in enumerate(("strike", "dip", "opening")))
GREENS = f"""o AS (SELECT p_partkey AS k, p_partkey % 97 / 2e0 - 7.13e0 AS ox, p_size * 0.9e0 - 4.27e0 AS oy FROM part),
f AS (SELECT n_nationkey AS patch, (n_nationkey % 5) * 8e0 AS cx, (n_nationkey // 5) * 7e0 AS cy, 1 + n_nationkey % 4 * 0.7e0 AS top, radians(n_nationkey * 37 % 360 + 0.5e0) AS st, radians(20e0 + n_nationkey % 3 * 22) AS a, 4e0 + n_nationkey % 3 AS len, 3e0 + n_nationkey % 2 AS wid FROM nation),
g AS (SELECT k, patch, st, len, wid, sin(a) AS s, cos(a) AS c, top + wid * sin(a) AS dep, (ox - cx) * sin(st) + (oy - cy) * cos(st) + len / 2 AS x, -(ox - cx) * cos(st) + (oy - cy) * sin(st) + wid * cos(a) AS y FROM o, f),
h AS (SELECT *, y * c + dep * s AS p, y * s - dep * c AS q FROM g),
e AS (SELECT h.*, sign, x - dx * len AS xi, p - dp * wid AS eta FROM h, (VALUES (1, 0, 0), (-1, 0, 1), (-1, 1, 0), (1, 1, 1)) v(sign, dx, dp)),
t AS (SELECT *, sqrt(xi * xi + eta * eta + q * q) AS rr, eta * c + q * s AS yt, eta * s - q * c AS dt, sqrt(xi * xi + q * q) AS xx FROM e),
i AS (SELECT *, 1 / c * atan((eta * (xx + q * c) + xx * (rr + xx) * s) / (xi * (rr + xx) * c)) AS i5, 0.5e0 / c * (ln(rr + dt) - s * ln(rr + eta)) AS i4, ln(rr + eta) AS lg, atan(xi * eta / (q * rr)) AS turn, 1 / (rr * (rr + eta)) AS ea, 1 / (rr * (rr + xi)) AS fa FROM t),
j AS (SELECT *, 0.5e0 * (yt / (c * (rr + dt)) - lg) + s / c * i4 AS i3, -0.5e0 / c * xi / (rr + dt) - s / c * i5 AS i1 FROM i),
l AS (SELECT *, -0.5e0 * lg - i3 AS i2 FROM j), u AS (SELECT k, patch, st, {_SUMS} FROM l GROUP BY k, patch, st), w AS (SELECT k, patch, {_TURNED} FROM u)"""
SLIP = {"strike": "(1 + patch / 10e0)", "dip": "(2 - patch % 7)", "opening": "(patch % 3 / 4e0)"}
SUMMED = ", ".join(f"round(sum({' + '.join(f'{SLIP[s]} * {s}_{a}' for s in SLIP)}), 5) + 0e0 AS {a}" for a in greens.AXES)


def points(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("row"), (k % 97 / 2.0 - 7.13).alias("x"), (F.col("p_size") * 0.9 - 4.27).alias("y"), F.lit(0.0).alias("depth"))


def placed(obs, work):
    """What ``work`` gives at the distinct places of the points, for every point."""
    return at_places(obs, "row", ("x", "y", "depth"), work)


def rectangles(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("col"), (k % 5 * 8.0).alias("x"), (F.floor(k / 5) * 7.0).alias("y"), (1 + k % 4 * 0.7).alias("depth"), (k * 37 % 360 + 0.5).alias("strike"), (20.0 + k % 3 * 22).alias("dip"), (4.0 + k % 3).alias("length"), (3.0 + k % 2).alias("width"),
        (1 + k / 10).alias("strike_slip"), (2.0 - k % 7).alias("dip_slip"), (k % 3 / 4.0).alias("opening"),
    )


def triangles(spark, d):
    """Two triangles of each rectangle, with its slips."""
    rows = rectangles(spark, d)
    s, a = F.radians("strike"), F.radians("dip")
    across = (F.cos(a) * F.cos(s), -F.cos(a) * F.sin(s), F.sin(a))
    at = lambda i, j: [F.col(c) + i * F.col("length") / 2 * w + j * F.col("width") * v for c, w, v in zip(("x", "y", "depth"), (F.sin(s), F.cos(s), F.lit(0.0)), across, strict=True)]
    halves = [F.struct(F.lit(h).alias("half"), *(v.alias(n) for n, v in zip(greens.TRIANGLE, [v for p in corners for v in at(*p)], strict=True))) for h, corners in enumerate((((-1, 0), (1, 0), (1, 1)), ((-1, 0), (1, 1), (-1, 1))))]
    each = rows.withColumn("t", F.explode(F.array(*halves))).select(F.col("col").alias("patch"), "strike_slip", "dip_slip", "opening", "t.*")
    return each.withColumn("col", F.col("patch") * 2 + F.col("half"))


@query(f"WITH {GREENS} SELECT k, patch, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in greens.VALUES)} FROM w")
def greens_rectangles(spark, d):
    rows = placed(points(spark, d), lambda p: greens.surface(p, rectangles(spark, d)).select("row", F.col("col").alias("patch"), *(r(c, 6) for c in greens.VALUES)))
    return rows.withColumnRenamed("row", "k")


@query(f"WITH {GREENS} SELECT k, {SUMMED} FROM w GROUP BY k")
def forward_patches(spark, d):
    """Displacement of a patch table, summed in the tasks that hold the points."""
    rows = placed(points(spark, d), lambda p: greens.displacement(p, rectangles(spark, d)).select("row", *(r(c, 5) for c in greens.AXES)))
    return rows.withColumnRenamed("row", "k")


@query(f"WITH {GREENS} SELECT k, {SUMMED} FROM w GROUP BY k")
def forward_triangles(spark, d):
    """The same patches cut into triangles, dealt over a grid of blocks as a large patch table would be."""
    rows = placed(points(spark, d), lambda p: greens.displacement(p, triangles(spark, d), "triangle", near=0).select("row", *(r(c, 5) for c in greens.AXES)))
    return rows.withColumnRenamed("row", "k")


@query(f"WITH {GREENS} SELECT k, {SUMMED} FROM w GROUP BY k")
def forward_internal(spark, d):
    """The formulas for points at any depth, at the surface."""
    rows = placed(points(spark, d), lambda p: greens.inside(p, rectangles(spark, d)).select("row", *(r(c, 5) for c in greens.AXES)))
    return rows.withColumnRenamed("row", "k")


@query(f"""WITH {GREENS}, s AS (SELECT k, 0.38e0 * {{e}} - 0.11e0 * {{n}} + 0.92e0 * {{u}} AS v FROM (SELECT k, {', '.join(f"sum({' + '.join(f'{SLIP[s]} * {s}_{a}' for s in ('strike', 'dip'))}) AS {a}" for a in greens.AXES)} FROM w GROUP BY k))
SELECT k AS row, round(v, 5) + 0e0 AS predicted FROM s""".format(e="east", n="north", u="up"))
def greens_line_of_sight(spark, d):
    """Green's functions along a look vector as a (row, col, value) table, and the data that slips predict by it."""
    from . import forward

    patches = rectangles(spark, d)
    model = patches.select(F.explode(F.array(F.struct((F.col("col") * 2).alias("col"), F.col("strike_slip").alias("m")), F.struct((F.col("col") * 2 + 1).alias("col"), F.col("dip_slip").alias("m")))).alias("x")).select("x.*")

    def seen(p):
        looks = p.select("row", F.lit(0.38).alias("le"), F.lit(-0.11).alias("ln"), F.lit(0.92).alias("lu"))
        return forward.predict(greens.along(greens.surface(p, patches), looks), model).select("row", r("predicted", 5))

    return placed(points(spark, d), seen)


@query()
def stress_below_surface(spark, d):
    """Stress at depths of 0 to 9 below the points; no SQL, as the derivatives fill pages (tests compare them with differences)."""
    obs = points(spark, d).withColumn("depth", (F.col("row") % 10).cast("double"))
    rows = placed(obs, lambda p: greens.inside(p, rectangles(spark, d), shear_modulus=30.0).select("row", *(r(f"s_{c}", 6) for c in greens.STRAINS)))
    return rows.withColumnRenamed("row", "k")
