"""Patches and triangles: contours, parts, distances, covariances, smoothing, gradients and values between layers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_join
from .shared import checkpoint, settled
from ..functions.safe import ratio


def depth_segments(df: DataFrame, key: str, corners: Sequence[tuple[str, str, str]], depths: Sequence[float]) -> DataFrame:
    """(key, depth, x0, y0, x1, y1): where triangles with corners (x, y, depth) meet horizontal planes.

    A corner on a plane counts as below it, so a triangle gives one segment or none, and neighbours agree.
    """
    rows = df.select(key, F.explode(F.array(*(F.lit(float(z)) for z in depths))).alias("depth"), *{c for p in corners for c in p})
    points = []
    for (xa, ya, za), (xb, yb, zb) in zip(corners, [*corners[1:], corners[0]], strict=True):
        a, b = F.col(za), F.col(zb)
        t = ratio(F.col("depth") - a, b - a)
        cut = F.struct((F.col(xa) + t * (F.col(xb) - F.col(xa))).alias("x"), (F.col(ya) + t * (F.col(yb) - F.col(ya))).alias("y"))
        points.append(F.when((a >= F.col("depth")) != (b >= F.col("depth")), cut))
    rows = rows.withColumn("_p", F.array_compact(F.array(*points))).where(F.size("_p") == 2)
    return rows.select(key, "depth", *(F.col("_p")[k][c].alias(f"{c}{k}") for k in (0, 1) for c in "xy"))


def divided(df: DataFrame, x: str, y: str, depth: str, strike: str, dip: str, length: str, width: str, along: int, down: int) -> DataFrame:
    """Each rectangular patch, given by its centre, as ``along`` by ``down`` equal parts, numbered in ``part`` from the upper edge's start along strike."""
    s, d = F.radians(strike), F.radians(dip)
    rows = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(along * down - 1))))
    a = ((F.col("part") % along + 0.5) / along - 0.5) * F.col(length)
    b = (((F.col("part") / along).cast("int") + 0.5) / down - 0.5) * F.col(width)
    moved = {x: F.col(x) + a * F.sin(s) + b * F.cos(d) * F.cos(s), y: F.col(y) + a * F.cos(s) - b * F.cos(d) * F.sin(s), depth: F.col(depth) + b * F.sin(d)}
    return rows.withColumns(moved).withColumns({length: F.col(length) / along, width: F.col(width) / down})


def _apart() -> Column:
    """Distance in space in one sum of squares, so that equal distances are equal numbers."""
    return F.sqrt(sum(F.pow(F.col(f"a{c}") - F.col(f"b{c}"), F.lit(2.0)) for c in "xyz"))


def distances(df: DataFrame, key: str, xyz: tuple[str, str, str], reach: float, salt: int = 1) -> DataFrame:
    """(a, b, distance) of all ordered pairs of patch centres at most ``reach`` apart in space, each patch with itself included."""
    one, two = (df.select(F.col(key).alias(k), *(F.col(c).cast("double").alias(k + n) for c, n in zip(xyz, "xyz", strict=True))) for k in "ab")
    near = range_join(one, two, ("ax", "ay"), ("bx", "by"), reach, salt)
    return near.select("a", "b", _apart().alias("distance")).where(F.col("distance") <= reach)


def model_covariance(pairs: DataFrame, sigma: float, length: float, unit: float) -> DataFrame:
    """(a, b, value) of (sigma * unit / length) squared times exp(-distance / length), from ``distances``."""
    return pairs.select("a", "b", covariance_at(F.col("distance"), sigma, length, unit).alias("value"))


def covariance_at(distance: Column, sigma: float, length: float, unit: float) -> Column:
    """The covariance of slips so far apart."""
    return (sigma * unit / length) ** 2 * F.exp(-distance / length)


def smoothed(pairs: DataFrame, slips: DataFrame, key: str, slip: str, length: float) -> DataFrame:
    """(key, slip): slip spread by a Gaussian of the distance; what each patch hands out adds up to its slip."""
    weights = pairs.withColumn("w", F.exp(-0.5 * F.col("distance") * F.col("distance") / length**2))
    whole = weights.groupBy("b").agg(F.sum("w").alias("whole"))
    given = slips.select(F.col(key).alias("b"), F.col(slip).alias("s")).join(whole, "b").select("b", ratio(F.col("s"), F.col("whole")).alias("s"))
    return weights.join(given, "b").groupBy(F.col("a").alias(key)).agg(F.sum(F.col("w") * F.col("s")).alias(slip))


def sums_within(places: DataFrame, key: str, xyz: tuple[str, str, str], value: str, reach: float, weights: Sequence[Callable[[np.ndarray], np.ndarray]], block: int = 50_000) -> DataFrame:
    """(key, s0 .., nearest, farthest): for each place the sums of weight(distance) times value over all places at most ``reach``
    apart in space, itself included, and the smallest and largest of these distances.

    Places meet in cells of x and y as large as the reach; cells of more than ``block`` places are dealt over several tasks. Pairs are
    worked out in pieces and never written. Places without finite coordinates meet nothing.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    own = places.select(F.col(key).alias("k"), *(F.col(c).cast("double").alias(n) for c, n in zip(xyz, "xyz", strict=True)), F.col(value).cast("double").alias("v"))
    own = own.where(" and ".join(f"abs({c}) < double('inf')" for c in "xyz")).withColumns({"cx": cell("x"), "cy": cell("y")})
    most = own.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // block) or 1
    deal, every = F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    one = own.drop("v").withColumn("i", deal).withColumn("j", every)
    around = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    two = own.select(F.inline(around), *(F.col(c).alias(f"{c}2") for c in "xyzv"), deal.alias("j")).withColumn("i", every)
    names = [f"s{n}" for n in range(len(weights))]

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        def ordered(t: pa.Table, *columns: str) -> list[np.ndarray]:
            got = [t.column(c).to_numpy() for c in columns]
            turn = np.argsort(got[1], kind="stable")
            return [g[turn] for g in got]

        if not left.num_rows or not right.num_rows:  # a side without rows has no columns; each place meets itself in some part
            return pa.table({"k": pa.array([], pa.int64()), **{n: pa.array([], pa.float64()) for n in (*names, "nearest", "farthest")}})
        k, x, y, z = ordered(left, "k", "x", "y", "z")
        y2, x2, z2, v = ordered(right, "y2", "x2", "z2", "v2")
        out = np.zeros((len(k), len(weights) + 2))
        out[:, -2:] = np.nan
        step = max(1, 400_000 // len(x2))
        for a in range(0, len(k), step):
            b = min(a + step, len(k))
            lo, hi = np.searchsorted(x2, x[a] - 1.000001 * reach), np.searchsorted(x2, x[b - 1] + 1.000001 * reach, side="right")
            d = (x[a:b, None] - x2[lo:hi]) ** 2
            d += (y[a:b, None] - y2[lo:hi]) ** 2
            d += (z[a:b, None] - z2[lo:hi]) ** 2
            np.sqrt(d, out=d)
            row, col = np.nonzero(d <= reach)
            if len(row):
                far = d[row, col]
                for n, w in enumerate(weights):
                    out[a:b, n] = np.bincount(row, w(far) * v[lo:hi][col], b - a)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out[a + row[first], -2], out[a + row[first], -1] = np.minimum.reduceat(far, first), np.maximum.reduceat(far, first)
        return pa.table([pa.array(k), *(pa.array(out[:, n]) for n in range(len(weights))), *(pa.array(c, mask=np.isnan(c)) for c in (out[:, -2], out[:, -1]))], ["k", *names, "nearest", "farthest"])

    cells = ("cx", "cy", "i", "j")
    schema = "k long, " + ", ".join(f"{n} double" for n in (*names, "nearest", "farthest"))
    found = one.groupBy(*cells).cogroup(two.groupBy(*cells)).applyInArrow(met, schema).where("k is not null")
    if parts > 1:
        found = found.groupBy("k").agg(*(F.sum(n).alias(n) for n in names), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))
    return found.withColumnRenamed("k", key)


def smoothed_places(places: DataFrame, key: str, xyz: tuple[str, str, str], slip: str, copies: str, length: float, reach: float) -> DataFrame:
    """(key, slip): ``smoothed`` for places that hold ``copies`` patches of ``slip`` in all, without a table of pairs."""
    weight = lambda d: np.exp(-0.5 * d * d / length**2)
    whole = settled(sums_within(places, key, xyz, copies, reach, [weight]).select(key, F.col("s0").alias("_whole")))
    given = settled(places.join(whole, key).withColumn("_s", F.coalesce(ratio(F.col(slip), F.col("_whole")), F.lit(0.0))))
    return sums_within(given, key, xyz, "_s", reach, [weight]).select(key, F.col("s0").alias(slip))


def neighbors(df: DataFrame, key: str, xyz: tuple[str, str, str], k: int, reach: float, doublings: int = 12) -> DataFrame:
    """(a, b, distance, place): the ``k`` nearest other centres of each, ties by the smaller key.

    Rows that have fewer than ``k`` within the reach look again with twice the reach; what is found in the last round is what stays.
    """
    other = df.select(F.col(key).alias("b"), *(F.col(c).cast("double").alias("b" + n) for c, n in zip(xyz, "xyz", strict=True)))
    rest = df.select(F.col(key).alias("a"), *(F.col(c).cast("double").alias("a" + n) for c, n in zip(xyz, "xyz", strict=True)))
    found = None
    for turn in range(doublings):
        near = range_join(rest, other, ("ax", "ay"), ("bx", "by"), reach * 2**turn).where("a <> b")
        pairs = near.select("a", "b", _apart().alias("distance")).where(F.col("distance") <= reach * 2**turn)
        ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("place") <= k)
        got = checkpoint(ranked)
        done = got.where(F.col("place") == k).select("a")
        last = turn == doublings - 1
        own = got if last else got.join(done, "a", "left_semi")
        found = own if found is None else found.unionByName(own)
        rest = rest.join(done, "a", "left_anti")
        if rest.isEmpty():
            break
    return found


def gradients(near: DataFrame, slips: DataFrame, key: str, slip: str) -> DataFrame:
    """(key, gradient): mean absolute difference of slip over distance to the neighbours; those at distance 0 don't count."""
    a, b = (slips.select(F.col(key).alias(k), F.col(slip).alias(f"{k}s")) for k in "ab")
    pairs = near.where("distance > 0").join(a, "a").join(b, "b")
    return pairs.groupBy(F.col("a").alias(key)).agg(F.avg(F.abs(F.col("as") - F.col("bs")) / F.col("distance")).alias("gradient"))


def between_layers(points: DataFrame, layers: DataFrame, by: str, depth: str, value: str) -> DataFrame:
    """Points with the value between the layers above and below them in the same group; the nearest layer's beyond both ends, null without layers."""
    at = points.select(by, F.col(depth).cast("double").alias("_z")).distinct()
    known = layers.select(by, F.col(depth).cast("double").alias("_z"), F.struct(F.col(depth).cast("double").alias("d"), F.col(value).cast("double").alias("v")).alias("_l"))
    both = at.withColumn("_own", F.lit(True)).unionByName(known.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    # Both windows run up to the row, as one that runs from the row to the end begins anew at each.
    above = F.last("_l", ignorenulls=True).over(Window.partitionBy(by).orderBy("_z", "_own").rowsBetween(Window.unboundedPreceding, 0))
    below = F.last("_l", ignorenulls=True).over(Window.partitionBy(by).orderBy(F.desc("_z"), F.desc("_own")).rowsBetween(Window.unboundedPreceding, 0))
    own = both.withColumns({"_a": above, "_b": below}).where("_own")
    z = F.col("_z")
    share = ratio(z - F.col("_a.d"), F.col("_b.d") - F.col("_a.d"))
    whole = F.when(F.col("_a.d") == z, F.col("_a.v")).otherwise(F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")))
    found = own.select(F.col(by).alias("_by"), "_z", F.coalesce(whole, F.col("_a.v"), F.col("_b.v")).alias("_value"))
    met = points.drop(value).join(found, F.col(by).eqNullSafe(F.col("_by")) & F.col(depth).cast("double").eqNullSafe(F.col("_z")))
    return met.withColumn(value, F.col("_value")).select(*(c for c in points.columns if c != value), value)


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, value: str, origin: tuple[float, float], step: float) -> DataFrame:
    """Points with the grid's (ix, iy, value) between their four neighbours; null where one of them is missing or null.

    A neighbour of weight 0 must be there too, but for points on the grid's own lines, which look only along them.
    """
    u, v = (F.col(x) - origin[0]) / step, (F.col(y) - origin[1]) / step
    rows = points.withColumn("_id", F.monotonically_increasing_id())
    fx, fy = u - F.floor(u), v - F.floor(v)
    corner = lambda i, j: F.struct((F.floor(u) + i).cast("long").alias("ix"), (F.floor(v) + j).cast("long").alias("iy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("_w"))
    around = rows.select("_id", *points.columns, F.inline(F.filter(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1))), lambda c: c["_w"] > 0)))
    met = around.join(grid.select("ix", "iy", F.col(value).alias("_v")), ["ix", "iy"], "left")
    missed = F.count(F.when(F.col("_v").isNull(), 1))
    return met.groupBy("_id", *points.columns).agg(F.when(missed == 0, F.sum(F.col("_w") * F.col("_v"))).alias(value)).drop("_id")


def cell_gradients(df: DataFrame, x: str, y: str, value: str, origin: tuple[float, float], size: float) -> DataFrame:
    """(ix, iy, parts, gradient, curvature) of square cells: a plane through the means of their quarters.

    ``gradient`` is the absolute mean of the two slopes, ``curvature`` the deviation of the quarters from the plane. Both are 0 where
    fewer than three quarters hold pixels, or these lie on one line.
    """
    quarter = df.groupBy(*(F.floor((F.col(c) - o) / (size / 2)).cast("long").alias(i) for c, o, i in ((x, origin[0], "qx"), (y, origin[1], "qy")))).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(value).alias("v"))
    sums = quarter.groupBy(F.floor(F.col("qx") / 2).cast("long").alias("ix"), F.floor(F.col("qy") / 2).cast("long").alias("iy")).agg(
        F.count("*").alias("parts"), *(F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "yy", "xy", "xv", "yv", "vv"))
    )
    xx, yy, xy, xv, yv, vv = (F.col(c) for c in ("xx", "yy", "xy", "xv", "yv", "vv"))
    det = xx * yy - xy * xy
    a, b = ratio(xv * yy - yv * xy, det), ratio(yv * xx - xv * xy, det)
    flat = (F.col("parts") < 3) | (det <= 1e-12 * xx * yy)
    left = F.sqrt(F.greatest(F.lit(0.0), vv - a * xv - b * yv))
    return sums.select("ix", "iy", "parts", F.when(flat, 0.0).otherwise(F.abs(a + b) / 2).alias("gradient"), F.when(flat, 0.0).otherwise(left).alias("curvature"))


def linearity(df: DataFrame, by: Sequence[str], x: str, y: str, determination: float = 0.5, share: float = 0.85, least: int = 10) -> DataFrame:
    """(by, n, r2, ratio, linear): groups whose points lie along a line, by regression and by the larger eigenvalue's share of their scatter."""
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_r2(y, x).alias("r2"), F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    top = (a + c) / 2 + F.sqrt(((a - c) / 2) ** 2 + b * b)
    rows = s.withColumn("ratio", F.when(a + c > 0, top / (a + c)))
    met = (F.col("n") >= least) & (F.col("r2") >= determination) & (F.col("ratio") >= share)
    return rows.select(*by, "n", "r2", "ratio", F.coalesce(met, F.lit(False)).alias("linear"))


def cycles_removed(value: Column, regions: Sequence[tuple[Column, int]], wavelength: float) -> Column:
    """Value plus half a wavelength for each cycle of the region that holds it; regions that overlap raise."""
    inside = sum((F.coalesce(r.cast("int"), F.lit(0)) for r, _ in regions), F.lit(0))
    shift = sum((F.when(r, F.lit(n * wavelength / 2)).otherwise(0.0) for r, n in regions), F.lit(0.0))
    return F.when(inside > 1, F.raise_error(F.lit("regions of phase cycles overlap")).cast("double")).otherwise(value + shift)


def profile_crossing(traces: DataFrame, by: Sequence[str], order: str, x: str, y: str, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """(by, distance): from the middle of a profile to its crossing with each trace, positive towards ``start``; null with none or several."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = traces.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    px, py = end[0] - start[0], end[1] - start[1]
    half = (px * px + py * py) ** 0.5 / 2
    side = lambda a, b: px * (F.col(b) - start[1]) - py * (F.col(a) - start[0])
    s0, s1 = side("x0", "y0"), side("x1", "y1")
    t = ratio(s0, s0 - s1)
    cx, cy = F.col("x0") + t * (F.col("x1") - F.col("x0")), F.col("y0") + t * (F.col("y1") - F.col("y0"))
    along = ratio((cx - start[0]) * px + (cy - start[1]) * py, 2 * half)
    hit = ((s0 >= 0) != (s1 >= 0)) & along.between(0.0, 2 * half)
    met = rows.groupBy(*by).agg(F.count(F.when(hit, 1)).alias("n"), F.min(F.when(hit, half - along)).alias("d"))
    return met.select(*by, F.when(F.col("n") == 1, F.col("d")).alias("distance"))


def checkerboard(i: str, j: str, size: int, high: float, low: float = 0.0) -> Column:
    """Slip that alternates in squares of ``size`` patches of a grid, ``high`` where the first patch is."""
    square = F.floor(F.col(i) / size) + F.floor(F.col(j) / size)
    return F.when(F.pmod(square, F.lit(2)) == 0, float(high)).otherwise(float(low))


def indexed(df: DataFrame, key: str, corners: Sequence[tuple[str, str, str]], digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """(v, x, y, z) of the distinct corners and (key, v0, v1, v2) of the triangles, from triangles with their own corners.

    Corners are one vertex where their places agree to ``digits`` decimals; a vertex is named by the smallest (key, corner) that has it,
    as the number 3 * key + corner, so nothing is numbered across the table.
    """
    each = df.select(F.col(key).alias("key"), F.posexplode(F.array(*(F.struct(*((F.round(F.col(c).cast("double"), digits) + 0.0).alias(n) for c, n in zip(p, "xyz", strict=True))) for p in corners))).alias("corner", "p"))
    named = each.groupBy("p").agg(F.min(F.col("key") * 3 + F.col("corner")).alias("v"))
    faces = each.join(named, "p").groupBy("key").agg(*(F.max(F.when(F.col("corner") == k, F.col("v"))).alias(f"v{k}") for k in range(3)))
    return named.select("v", "p.x", "p.y", "p.z"), faces.withColumnRenamed("key", key)
