"""Queries on cells split by resolution, traces, layers and joined parameters, each beside its DuckDB SQL.

Roles: ``lineitem`` gives pixels, ``supplier`` traces by nation, ``part`` layers and vertices, ``events`` series.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import aggregates, downsample, joins, meshes, ordered, predicates, sets
from .geodesy import NETWORK, stations
from .queries import query, r, table

_GREENS = "1 / (1 + pow((x - 10) / 10, 2) + pow((y - 10) / 10, 2)) AS g0, 1 / (1 + pow((x - 40) / 8, 2) + pow((y - 30) / 8, 2)) AS g1"


def _round(k: int) -> str:
    """Resolutions of the cells c{k} as r{k}, from two parameters' products."""
    return f"""g{k} AS (SELECT *, {_GREENS} FROM (SELECT *, sx / n AS x, sy / n AS y FROM c{k})), m{k} AS (SELECT sum(g0 * g0) + 0.01e0 AS aa, sum(g0 * g1) AS ab, sum(g1 * g1) + 0.01e0 AS bb FROM g{k}),
r{k} AS (SELECT g{k}.*, (g0 * g0 * bb - 2 * g0 * g1 * ab + g1 * g1 * aa) / (aa * bb - ab * ab) AS resolution FROM g{k}, m{k})"""


def _split(k: int, threshold: float, levels: int) -> str:
    return f"""c{k + 1} AS (SELECT level, ix, iy, n, s, sx, sy FROM r{k} WHERE NOT (resolution > {threshold}e0 AND level < {levels})
  UNION ALL SELECT r.level + 1, f.ix // CAST(pow(2, {levels} - r.level - 1) AS BIGINT) AS ix, f.iy // CAST(pow(2, {levels} - r.level - 1) AS BIGINT) AS iy, sum(f.n), sum(f.s), sum(f.sx), sum(f.sy)
  FROM r{k} r JOIN fine f ON f.ix // CAST(pow(2, {levels} - r.level) AS BIGINT) = r.ix AND f.iy // CAST(pow(2, {levels} - r.level) AS BIGINT) = r.iy WHERE r.resolution > {threshold}e0 AND r.level < {levels} GROUP BY 1, 2, 3)"""


@query(f"""WITH fine AS (SELECT CAST(floor(x / 8) AS BIGINT) AS ix, CAST(floor(y / 8) AS BIGINT) AS iy, count(*) AS n, sum(v) AS s, sum(x) AS sx, sum(y) AS sy FROM (SELECT l_quantity AS x, l_extendedprice / 2000 AS y, l_discount * 100 AS v FROM lineitem) GROUP BY 1, 2),
c0 AS (SELECT 1 AS level, ix // 4 AS ix, iy // 4 AS iy, sum(n) AS n, sum(s) AS s, sum(sx) AS sx, sum(sy) AS sy FROM fine GROUP BY 2, 3), {_round(0)}, {_split(0, 0.4, 3)}, {_round(1)}, {_split(1, 0.4, 3)}, {_round(2)}
SELECT level, ix, iy, round(x, 5) AS x, round(y, 5) AS y, round(s / n, 5) + 0e0 AS value, CAST(n AS BIGINT) AS n, round(resolution, 6) AS resolution FROM r2""")
def downsample_resolution(spark, d):
    """Two rounds of splitting; the SQL has both."""
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 100).alias("v"))

    def greens(cells):
        far = lambda a, b, s: 1 / (1 + F.pow((F.col("x") - a) / s, F.lit(2.0)) + F.pow((F.col("y") - b) / s, F.lit(2.0)))
        both = F.array(F.struct(F.lit(0).alias("col"), far(10, 10, 10).alias("value")), F.struct(F.lit(1).alias("col"), far(40, 30, 8).alias("value")))
        return cells.select("row", F.inline(both))

    out = downsample.by_resolution(rows, "x", "y", "v", (0.0, 0.0), 64.0, 3, greens, 2, 0.4, 0.01, start=1, rounds=2)
    return out.select("level", "ix", "iy", r("x", 5), r("y", 5), r("value", 5), "n", r("resolution", 6))


@query("SELECT event_id, user_id, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-06'")
def series_at_date(spark, d):
    return joins.value_at(table(spark, d, "events").withColumn("day", F.to_date("ts")), "day", dt.date(2024, 1, 6), ["event_id", "user_id", "value"])


@query("SELECT p_size, round(avg(p_retailprice), 5) AS p_retailprice_mean, round(stddev_pop(p_retailprice), 5) AS p_retailprice_std FROM part GROUP BY 1")
def layers_vertical_average(spark, d):
    return aggregates.vertical_average(table(spark, d, "part"), "p_size", "p_retailprice").select("p_size", r("p_retailprice_mean", 5), r("p_retailprice_std", 5))


TRACES = "t AS (SELECT s_nationkey AS nation, s_suppkey AS k, floor(s_acctbal / 4000) AS x, s_suppkey * 53 % 3 * 1e0 AS y FROM supplier)"


def traces(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), k.alias("k"), F.floor(F.col("s_acctbal") / 4000).cast("double").alias("x"), (k * 53 % 3).cast("double").alias("y"))


@query(f"WITH {TRACES}, l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM t WINDOW w AS (PARTITION BY nation ORDER BY k)) SELECT nation, k, x, y FROM l WHERE px IS NULL OR px <> x OR py <> y")
def trace_cleaned(spark, d):
    return ordered.clean_trace(traces(spark, d), ["nation"], "k", "x", "y")


@query(f"""WITH {NETWORK}, l AS (SELECT nation, k, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM s WINDOW w AS (PARTITION BY nation ORDER BY k)),
a AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len, coalesce(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) OVER (PARTITION BY nation ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along FROM l),
p AS (SELECT *, unnest(range(CAST(ceil(along / 1.7e0) AS BIGINT), CAST(ceil((along + len) / 1.7e0) AS BIGINT))) AS i FROM a WHERE len > 0)
SELECT nation, round(i * 1.7e0, 6) AS along, round(x + (i * 1.7e0 - along) / len * (nx - x), 5) + 0e0 AS x, round(y + (i * 1.7e0 - along) / len * (ny - y), 5) + 0e0 AS y FROM p""")
def trace_resampled(spark, d):
    out = ordered.resample_trace(stations(spark, d).select("nation", "k", "x", "y"), ["nation"], "k", "x", "y", 1.7)
    return out.select("nation", r("along", 6), r("x", 5), r("y", 5))


@query(f"""WITH {NETWORK}, l AS (SELECT nation, k, (lead(x) OVER w - lag(x) OVER w) / 2 AS dx, (lead(y) OVER w - lag(y) OVER w) / 2 AS dy, lead(x) OVER w - 2 * x + lag(x) OVER w AS ddx, lead(y) OVER w - 2 * y + lag(y) OVER w AS ddy FROM s WINDOW w AS (PARTITION BY nation ORDER BY k))
SELECT k, round(CASE WHEN dx <> 0 THEN dy / dx END, 5) + 0e0 AS gradient, round(CASE WHEN dx * dx + dy * dy > 0 THEN (ddy * dx - ddx * dy) / pow(dx * dx + dy * dy, 1.5) END, 5) + 0e0 AS curvature FROM l""")
def trace_curvature(spark, d):
    out = ordered.curvature(stations(spark, d), ["nation"], "k", "x", "y")
    return out.select("k", r("gradient", 5), r("curvature", 5))


@query(f"WITH {NETWORK} SELECT CAST(round(x / 2.5e0) AS BIGINT) || ':' || CAST(round(y / 2.5e0) AS BIGINT) AS vertex, count(*) AS n, min(k) AS k FROM s GROUP BY 1")
def vertices_welded(spark, d):
    return sets.weld(stations(spark, d), "x", "y", 2.5).groupBy("vertex").agg(F.count("*").alias("n"), F.min("k").alias("k"))


@query("SELECT o_orderkey % 1000 AS row, CASE o_orderpriority WHEN '2-HIGH' THEN '1-URGENT' ELSE o_orderpriority END AS parameter, round(sum(o_totalprice), 3) AS value FROM orders GROUP BY 1, 2")
def parameters_added(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("row"), F.col("o_orderpriority").alias("parameter"), F.col("o_totalprice").alias("value"))
    return sets.add_parameters(rows, {"2-HIGH": "1-URGENT"}).select("row", "parameter", r("value", 3))


@query("SELECT c_custkey, round(111 * 0.7e0 * cos(radians(c_nationkey)), 6) + 0e0 AS east, round(111 * (c_acctbal / 5000 - 0.2e0), 6) + 0e0 AS north FROM customer")
def geo_flat_offsets(spark, d):
    lat = F.col("c_nationkey").cast("double")
    east, north = geo.flat_distance(F.lit(10.0), lat, F.lit(10.7), lat + F.col("c_acctbal") / 5000 - 0.2)
    return table(spark, d, "customer").select("c_custkey", east.alias("east"), north.alias("north")).select("c_custkey", r("east", 6), r("north", 6))


def _slopes(level: int, levels: int) -> str:
    """The squares of a level with their gradient and curvature, from the means of their quarters."""
    wide = 2 ** (levels - level)
    return f"""q{level} AS (SELECT ix // {wide} AS qx, iy // {wide} AS qy, sum(n) AS n, sum(s) AS s, sum(sx) AS sx, sum(sy) AS sy, sum(sx) / sum(n) AS x, sum(sy) / sum(n) AS y, sum(s) / sum(n) AS v FROM fine GROUP BY 1, 2),
p{level} AS (SELECT qx // 2 AS ix, qy // 2 AS iy, count(*) AS parts, sum(n) AS n, sum(s) AS s, sum(sx) AS sx, sum(sy) AS sy, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, covar_pop(v, v) AS vv FROM q{level} GROUP BY 1, 2),
a{level} AS (SELECT *, xx * yy - xy * xy AS det, (xv * yy - yv * xy) / nullif(xx * yy - xy * xy, 0) AS a, (yv * xx - xv * xy) / nullif(xx * yy - xy * xy, 0) AS b FROM p{level}),
m{level} AS (SELECT {level} AS level, ix, iy, sx / n AS x, sy / n AS y, s / n AS value, CAST(n AS BIGINT) AS n, CASE WHEN parts < 3 OR det <= 1e-12 * xx * yy THEN 0 ELSE abs(a + b) / 2 END AS gradient, CASE WHEN parts < 3 OR det <= 1e-12 * xx * yy THEN 0 ELSE sqrt(greatest(0, vv - a * xv - b * yv)) END AS curvature FROM a{level})"""


def _split_by(what: str, threshold: float) -> str:
    shown = f"level, ix, iy, round(x, 5) AS x, round(y, 5) AS y, round(value, 5) + 0e0 AS value, n, round({what}, 6) + 0e0 AS measure"
    return f"""WITH fine AS (SELECT CAST(floor(x / 8) AS BIGINT) AS ix, CAST(floor(y / 8) AS BIGINT) AS iy, count(*) AS n, sum(v) AS s, sum(x) AS sx, sum(y) AS sy FROM (SELECT l_quantity AS x, l_extendedprice / 2000 AS y, l_discount * 100 + l_quantity / 5 AS v FROM lineitem) GROUP BY 1, 2),
{_slopes(0, 2)}, {_slopes(1, 2)}, {_slopes(2, 2)}
SELECT {shown} FROM m0 WHERE {what} <= {threshold} UNION ALL SELECT {shown} FROM m1 c WHERE {what} <= {threshold} AND (SELECT {what} FROM m0 p WHERE p.ix = c.ix // 2 AND p.iy = c.iy // 2) > {threshold}
UNION ALL SELECT {shown} FROM m2 c WHERE (SELECT {what} FROM m1 p WHERE p.ix = c.ix // 2 AND p.iy = c.iy // 2) > {threshold} AND (SELECT {what} FROM m0 p WHERE p.ix = c.ix // 4 AND p.iy = c.iy // 4) > {threshold}"""


def _by_slopes(spark, d, threshold, what):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 100 + F.col("l_quantity") / 5).alias("v"))
    out = downsample.by_slopes(rows, "x", "y", "v", (0.0, 0.0), 64.0, threshold, 2, what)
    return out.select("level", "ix", "iy", r("x", 5), r("y", 5), r("value", 5), "n", r("measure", 6))


@query(_split_by("gradient", 0.0975))
def downsample_gradient(spark, d):
    return _by_slopes(spark, d, 0.0975, "gradient")


@query(_split_by("curvature", 0.016))
def downsample_curvature(spark, d):
    return _by_slopes(spark, d, 0.016, "curvature")


@query("SELECT l_orderkey, l_linenumber, round(e, 6) AS e FROM (SELECT *, l_discount * 6 AS e, l_tax * 10 AS n FROM lineitem) WHERE abs(sqrt(e * e + n * n + 0.36e0) - 1) <= 0.05")
def pixels_unit_looks(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 6).alias("e"), (F.col("l_tax") * 10).alias("n"), F.lit(0.6).alias("u"))
    return predicates.unit_looks(rows, "e", "n", "u", 0.05).select("l_orderkey", "l_linenumber", r("e", 6))


@query("SELECT event_id FROM events WHERE user_id BETWEEN 20 AND 90 AND value BETWEEN 50 AND 400")
def profile_cleaned(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("along"), "value")
    return predicates.within_profile(rows, 20, 90, 50, 400).select("event_id")


@query("SELECT p_partkey, CASE WHEN (p_partkey % 40 // 5 + p_partkey // 40 // 5) % 2 = 0 THEN 1.5e0 ELSE 0.25e0 END AS slip FROM part")
def patches_checkerboard(spark, d):
    """Slip of a grid of 40 columns in squares of five patches."""
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("i"), F.floor(F.col("p_partkey") / 40).alias("j"))
    return rows.select("p_partkey", meshes.checkerboard("i", "j", 5, 1.5, 0.25).alias("slip"))


@query("""WITH t AS (SELECT s_suppkey AS k, c, CASE c WHEN 0 THEN s_suppkey % 10 WHEN 1 THEN s_suppkey % 10 + 1 ELSE s_suppkey % 10 END * 1e0 AS x, CASE c WHEN 2 THEN s_suppkey // 10 + 1 ELSE s_suppkey // 10 END * 1e0 AS y, s_suppkey % 3 * 0e0 AS z FROM supplier, (VALUES (0), (1), (2)) v(c)),
v AS (SELECT x, y, z, min(k * 3 + c) AS v FROM t GROUP BY 1, 2, 3), f AS (SELECT k, c, v FROM t JOIN v USING (x, y, z))
SELECT a.k, a.v AS v0, b.v AS v1, d.v AS v2 FROM f a JOIN f b ON a.k = b.k AND b.c = 1 JOIN f d ON a.k = d.k AND d.c = 2 WHERE a.c = 0""")
def mesh_indexed(spark, d):
    """Triangles that carry their own corners become faces of shared vertices."""
    k = F.col("s_suppkey")
    x, y = (k % 10).cast("double"), F.floor(k / 10).cast("double")
    rows = table(spark, d, "supplier").select(k.alias("k"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), y.alias("y1"), x.alias("x2"), (y + 1).alias("y2"), *(F.lit(0.0).alias(f"z{j}") for j in range(3)))
    return meshes.indexed(rows, "k", [(f"x{j}", f"y{j}", f"z{j}") for j in range(3)])[1]


@query(f"""{_split_by('gradient', 0.0975).replace('SELECT level, ix, iy, round(x, 5)', ', r AS (SELECT level, ix, iy, round(x, 5)', 1)}),
SELECT (SELECT count(*) FROM lineitem) AS pixels, count(*) AS cells, max(n) AS largest, min(level) AS coarsest, max(level) AS finest, round(sum(n * value) / sum(n), 4) AS mean, round((SELECT count(*) FROM lineitem) / count(*), 4) AS pixels_a_cell FROM r""".replace("),\nSELECT (SELECT", ")\nSELECT (SELECT"))
def downsample_report(spark, d):
    """What a down-sampling keeps."""
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 100 + F.col("l_quantity") / 5).alias("v"))
    cells = downsample.by_slopes(rows, "x", "y", "v", (0.0, 0.0), 64.0, 0.0975, 2)
    out = downsample.report(rows, cells.withColumn("value", F.round("value", 5)), "v")
    return out.select("pixels", "cells", "largest", "coarsest", "finest", r("mean"), r("pixels_a_cell"))
