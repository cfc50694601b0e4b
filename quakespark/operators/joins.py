"""Distance, nearest, interval and as-of joins as equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import same, settled


def _cells(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def range_join(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float, salt: int = 1) -> DataFrame:
    """Pairs of rows at most ``radius`` apart, with their ``distance``.

    Cells are as large as the radius and each left row looks into nine of them. ``salt`` spreads a crowded
    cell's right rows over so many tasks. Column names of the two sides must differ.
    """
    (lx, ly), (rx, ry) = (tuple(F.col(c).cast("double") for c in xy) for xy in (left_xy, right_xy))
    cx, cy = _cells(lx, ly, radius)
    around = F.array(*(F.struct((cx + i).alias("_cx"), (cy + j).alias("_cy"), F.lit(s).alias("_salt")) for i in (-1, 0, 1) for j in (-1, 0, 1) for s in range(salt)))
    a = left.withColumn("_cell", F.explode(around)).select(*left.columns, "_cell._cx", "_cell._cy", "_cell._salt")
    rcx, rcy = _cells(rx, ry, radius)
    spread = F.pmod(F.xxhash64(*right.columns), F.lit(salt)).cast("int") if salt > 1 else F.lit(0)
    b = right.withColumns({"_cx": rcx, "_cy": rcy, "_salt": spread})
    pairs = a.join(b, ["_cx", "_cy", "_salt"]).drop("_cx", "_cy", "_salt")
    return pairs.withColumn("distance", F.sqrt((lx - rx) ** 2 + (ly - ry) ** 2)).where(F.col("distance") <= radius)


def around_points(points: DataFrame, pixels: DataFrame, point_xy: tuple[str, str], pixel_xy: tuple[str, str], radius: float, by: Sequence[str], values: Sequence[str], salt: int = 1) -> DataFrame:
    """Mean, population deviation and number of each value over the pixels around each point.

    Points and pixels at one place are joined once, pixels with their number, mean and scatter.
    """
    first = pixels.agg(*(F.avg(v) for v in values)).first()
    shift = [float(c or 0.0) for c in first]
    parts = lambda v, c: [F.count(v).alias(f"{v}_n"), F.sum(F.col(v) - c).alias(f"{v}_s"), F.sum((F.col(v) - c) * (F.col(v) - c)).alias(f"{v}_q"), F.min(v).alias(f"{v}_lo"), F.max(v).alias(f"{v}_hi")]
    held = pixels.groupBy(*(F.col(c).alias(f"_r{k}") for k, c in enumerate(pixel_xy))).agg(F.count("*").alias("n"), *(p for v, c in zip(values, shift, strict=True) for p in parts(v, c)))
    sums = [f"{v}_{p}" for v in values for p in ("n", "s", "q")]
    ends = [f(f"{v}_{p}").alias(f"{v}_{p}") for v in values for p, f in (("lo", F.min), ("hi", F.max))]
    add = [F.sum(c).alias(c) for c in ("n", *sums)] + ends
    spots = settled(points.select(*point_xy).distinct().withColumn("_spot", F.monotonically_increasing_id()))
    near = range_join(spots.toDF("_l0", "_l1", "_spot"), settled(held), ("_l0", "_l1"), ("_r0", "_r1"), radius, salt).groupBy("_spot").agg(*add)
    met = points.join(spots, same(points, spots, point_xy)).select(*(points[c] for c in by), "_spot").join(near, "_spot").groupBy(*by).agg(*add)

    def figures(v: str, c: float) -> list[Column]:
        mean = F.try_divide(F.col(f"{v}_s"), F.col(f"{v}_n"))
        spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(f"{v}_q"), F.col(f"{v}_n")) - mean * mean))
        return [(mean + c).alias(f"{v}_mean"), F.when(F.col(f"{v}_lo") == F.col(f"{v}_hi"), 0.0).otherwise(spread).alias(f"{v}_std")]

    return met.select(*by, *(f for v, c in zip(values, shift, strict=True) for f in figures(v, c)), "n")


def _halvings(places: DataFrame, x: str, y: str, reach: float, crowd: float = 16.0, most: int = 12) -> int:
    """How often the reach must be halved until a place shares a cell of that size with ``crowd`` others on average."""
    side = F.lit(reach) / F.pow(F.lit(2.0), F.col("_level"))
    each = places.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(most))))
    cells = each.groupBy("_level", F.floor(F.col(x) / side).alias("_x"), F.floor(F.col(y) / side).alias("_y")).agg(F.count("*").cast("double").alias("n"))
    means = dict(cells.groupBy("_level").agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).collect())
    return next((k for k in range(most) if means.get(k, 0.0) <= crowd), most)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], reach: float, doublings: int = 12, salt: int = 1) -> DataFrame:
    """(left_id, right_id, distance): each left row's nearest right row, ties by the smaller right id.

    The search radius doubles for the rows that have found nothing yet; those with nothing within reach * 2^(doublings - 1)
    come with nulls. Rows at one place are looked up once, and the first radius is ``reach`` halved until its cells hold few places,
    so candidates grow with the rows.
    """
    own = left.select(left_id, *left_xy)
    spots = settled(own.select(*left_xy).distinct().withColumn("_spot", F.monotonically_increasing_id()))
    other = settled(right.groupBy(*right_xy).agg(F.min(right_id).alias(right_id)))
    halved = _halvings(other, *right_xy, reach)
    found, rest, radius = None, spots, reach / 2**halved
    for _ in range(doublings + halved):
        pairs = range_join(rest, other, left_xy, right_xy, radius, salt)
        best = settled(pairs.groupBy("_spot").agg(F.min(F.struct("distance", right_id)).alias("_b")).select("_spot", F.col(f"_b.{right_id}").alias(right_id), F.col("_b.distance").alias("distance")))
        found = best if found is None else found.unionByName(best)
        rest = settled(rest.join(best.select("_spot"), "_spot", "left_anti"))
        if rest.isEmpty():
            break
        radius *= 2
    return own.join(spots, same(own, spots, left_xy)).select(own[left_id], "_spot").join(found, "_spot", "left").drop("_spot")


def to_trace(df: DataFrame, x: str, y: str, vertices: Sequence[tuple[float, float]]) -> DataFrame:
    """Add segment, along-trace distance and distance to the nearest point of a polyline; ties go to the first segment.

    The trace is a short list of vertices, written into the expression.
    """
    px, py = F.col(x), F.col(y)
    options, start = [], 0.0
    for k, ((x1, y1), (x2, y2)) in enumerate(zip(vertices[:-1], vertices[1:], strict=True)):
        dx, dy = x2 - x1, y2 - y1
        length = (dx * dx + dy * dy) ** 0.5
        if length == 0:
            continue
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / (length * length)))
        d = F.sqrt((px - (x1 + t * dx)) ** 2 + (py - (y1 + t * dy)) ** 2)
        options.append(F.struct(d.alias("distance"), F.lit(k).alias("segment"), (start + t * length).alias("along")))
        start += length
    best = F.array_min(F.array(*options))
    return df.withColumn("_b", best).withColumns({"segment": F.col("_b.segment"), "along": F.col("_b.along"), "trace_distance": F.col("_b.distance")}).drop("_b")


def signed_distance(df: DataFrame, x: str, y: str, a: tuple[float, float], b: tuple[float, float], name: str = "side") -> DataFrame:
    """Distance from the line through two points, positive to its left."""
    length = ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5
    return df.withColumn(name, ((b[0] - a[0]) * (F.col(y) - a[1]) - (b[1] - a[1]) * (F.col(x) - a[0])) / length)


def in_cells(points: DataFrame, cells: DataFrame, x: str, y: str, size: float, salt: int = 1) -> DataFrame:
    """Points joined with the rectangles (x0, x1, y0, y1) that hold them, half open.

    Rectangles are dealt to grid squares of ``size``; ``salt`` spreads a crowded square's points over so many tasks.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("long"), F.greatest(F.floor(F.col(lo) / size), F.ceil(F.col(hi) / size) - 1).cast("long"))
    dealt = cells.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1"))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    cx, cy = _cells(F.col(x), F.col(y), size)
    spread = F.pmod(F.xxhash64(*points.columns), F.lit(salt)).cast("int") if salt > 1 else F.lit(0)
    joined = points.withColumns({"_cx": cx, "_cy": cy, "_salt": spread}).join(dealt, ["_cx", "_cy", "_salt"])
    return joined.where((F.col(x) >= F.col("x0")) & (F.col(x) < F.col("x1")) & (F.col(y) >= F.col("y0")) & (F.col(y) < F.col("y1"))).drop("_cx", "_cy", "_salt")


def value_at(series: DataFrame, time: str, date, keep: Sequence[str]) -> DataFrame:
    """The rows of one epoch."""
    return series.where(F.col(time) == F.lit(date)).select(*keep)


def offset_between(series: DataFrame, by: str, time: str, value: str, first, second) -> DataFrame:
    """value(second) - value(first) of each series; null if either epoch is missing."""
    at = lambda d: F.max(F.when(F.col(time) == F.lit(d), F.col(value)))
    return series.groupBy(by).agg((at(second) - at(first)).alias("offset"))


def reference_series(series: DataFrame, reference: DataFrame, time: str, value: str, by: str) -> DataFrame:
    """Subtract from each series its mean difference from the reference over common epochs."""
    ref = reference.select(time, F.col(value).alias("_r"))
    shift = series.join(ref, time).groupBy(by).agg(F.avg(F.col(value) - F.col("_r")).alias("_shift"))
    return series.join(shift, by, "left").withColumn(value, F.col(value) - F.coalesce("_shift", F.lit(0.0))).drop("_shift")


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """Add to left rows the right side's values before (at the latest) and after, and the linear interpolation between."""
    a = left.select("*", F.lit(None).cast("double").alias("_t"), F.lit(None).cast("double").alias("_v"))
    b = right.select(by, time, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"))
    both = a.withColumn("_own", F.lit(True)).unionByName(b.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    back = Window.partitionBy(by).orderBy(time, "_own").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.desc(time), "_own").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(~F.col("_own"), F.struct("_t", "_v"))
    both = both.withColumns({"_before": F.last(known, True).over(back), "_after": F.last(known, True).over(ahead)}).where("_own")
    t = F.col(time).cast("double")
    gap = F.col("_after._t") - F.col("_before._t")
    between = F.when(gap == 0, F.col("_before._v")).otherwise(F.col("_before._v") + (F.col("_after._v") - F.col("_before._v")) * (t - F.col("_before._t")) / gap)
    return both.withColumns({"value_before": F.col("_before._v"), "value_after": F.col("_after._v"), "value_between": between}).drop("_before", "_after", "_t", "_v", "_own")


def interval_mean(left: DataFrame, right: DataFrame, by: str, day: str, value: str, days: int) -> DataFrame:
    """Add the mean of the right side's values within ``days`` days of each left row's day."""
    near = right.select(by, F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda k: F.date_add(F.col(day), k))).alias(day), F.col(value).alias("_v"))
    mean = near.groupBy(by, day).agg(F.avg("_v").alias(f"{value}_near"))
    return left.join(mean, [by, day], "left")
