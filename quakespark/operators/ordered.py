"""Running, neighbouring and sliding statistics of ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..functions.safe import ratio


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Add the running sum of a value and the running count of each group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"running_sum": F.sum(value).over(w), "running_count": F.count(F.lit(1)).over(w)})


def running_total(df: DataFrame, order: str, value: str, width: float) -> DataFrame:
    """Running sum over a whole table without one task for all rows.

    Rows are dealt to ranges of ``width`` of the numeric order column; sums of earlier ranges are added to a
    running sum within each range. Ties follow by value.
    """
    rows = df.withColumn("_r", F.floor(F.col(order) / width).cast("long"))
    sums = rows.groupBy("_r").agg(F.sum(value).alias("_s"))
    before = sums.select("_r", (F.sum("_s").over(Window.orderBy("_r")) - F.col("_s")).alias("_b"))  # a row for each range
    w = Window.partitionBy("_r").orderBy(order, value).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, "_r").withColumn("running_sum", F.col("_b") + F.sum(value).over(w)).drop("_r", "_b")


def stairs(df: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Two rows for each event, before and after its step in the running sum."""
    w = Window.partitionBy(*by).orderBy(time, value).rowsBetween(Window.unboundedPreceding, 0)
    steps = df.withColumn("_after", F.sum(value).over(w))
    both = F.array(F.struct(F.lit(0).alias("part"), (F.col("_after") - F.col(value)).alias("total")), F.struct(F.lit(1).alias("part"), F.col("_after").alias("total")))
    return steps.select(*by, time, value, F.inline(both))


def central_difference(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, y: str) -> DataFrame:
    """Add ``derivative``: central difference, one-sided at the ends; null for a single row."""
    w = Window.partitionBy(*by).orderBy(*order)
    x0, x1 = F.coalesce(F.lag(x).over(w), F.col(x)), F.coalesce(F.lead(x).over(w), F.col(x))
    y0, y1 = F.coalesce(F.lag(y).over(w), F.col(y)), F.coalesce(F.lead(y).over(w), F.col(y))
    return df.withColumn("derivative", F.when(x1 != x0, (y1 - y0) / (x1 - x0)))


def zero_crossings(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value and the next one's have strictly opposite signs."""
    later = F.lead(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("next_value", later).where(F.col(value) * F.col("next_value") < 0)


def remove_mean(df: DataFrame, by: Sequence[str], time: str, value: str, start=None, end=None) -> DataFrame:
    """Subtract each series' mean over the closed period from all of it."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(time) >= F.lit(start))
    if end is not None:
        inside = inside & (F.col(time) <= F.lit(end))
    means = df.groupBy(*by).agg(F.avg(F.when(inside, F.when(~F.isnan(value), F.col(value)))).alias("_m"))
    return df.join(means, list(by)).withColumn(value, F.col(value) - F.coalesce("_m", F.lit(0.0))).drop("_m")


def fill_gaps(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Interpolate nulls and NaNs inside a series linearly by row number; the ends stay."""
    w = Window.partitionBy(*by).orderBy(*order)
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col("_i"), F.col(value).alias("v")))
    rows = df.withColumn("_i", F.row_number().over(w))
    back = F.last(good, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(good, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_b": back, "_a": ahead})
    gap = F.col("_a._i") - F.col("_b._i")
    between = F.when(gap == 0, F.col(value)).otherwise(F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_i") - F.col("_b._i")) / gap)
    return rows.withColumn(value, F.coalesce(between, F.col(value))).drop("_i", "_b", "_a")


def smooth_glitches(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Values outside the bounds are replaced by interpolation between good neighbours."""
    return fill_gaps(df.withColumn(value, F.when(F.col(value).between(low, high), F.col(value))), by, order, value)


def sliding(df: DataFrame, by: Sequence[str], position: str, value: str, width: float, step: float, least: int = 1) -> DataFrame:
    """Mean, median, extremes and number in overlapping windows [k * step, k * step + width) of a position."""
    p = F.col(position)
    last = F.floor(p / step).cast("long")
    first = (F.floor((p - width) / step) + 1).cast("long")
    rows = df.withColumn("window", F.explode(F.sequence(first, last)))
    out = rows.groupBy(*by, "window").agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).withColumn("center", F.col("window") * step + width / 2)


def arc_length(df: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Add the distance along a polyline from its first vertex."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.coalesce(F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2), F.lit(0.0))
    return df.withColumn("_d", step).withColumn("along", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def clean_trace(df: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Drop vertices equal to the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    same = (F.col(x) == F.lag(x).over(w)) & (F.col(y) == F.lag(y).over(w))
    return df.withColumn("_s", F.coalesce(same, F.lit(False))).where(~F.col("_s")).drop("_s")


def resample_trace(df: DataFrame, by: Sequence[str], order: str, x: str, y: str, every: float) -> DataFrame:
    """(along, x, y): points each ``every`` along a polyline."""
    w = Window.partitionBy(*by).orderBy("along", order)
    legs = arc_length(clean_trace(df, by, order, x, y), by, order, x, y).withColumns({"_n": F.lead("along").over(w), "_x": F.lead(x).over(w), "_y": F.lead(y).over(w)}).where("_n > along")
    k0, k1 = F.ceil(F.col("along") / every).cast("long"), F.ceil(F.col("_n") / every).cast("long") - 1
    points = legs.where(k0 <= k1).withColumn("_k", F.explode(F.sequence(k0, k1)))
    t = ratio(F.col("_k") * every - F.col("along"), F.col("_n") - F.col("along"))
    return points.select(*by, (F.col("_k") * every).alias("s"), (F.col(x) + t * (F.col("_x") - F.col(x))).alias(x), (F.col(y) + t * (F.col("_y") - F.col(y))).alias(y)).withColumnRenamed("s", "along")


def curvature(df: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Add gradient and curvature of a polyline from central differences."""
    w = Window.partitionBy(*by).orderBy(order)
    dx, dy = (F.lead(x).over(w) - F.lag(x).over(w)) / 2, (F.lead(y).over(w) - F.lag(y).over(w)) / 2
    ddx, ddy = F.lead(x).over(w) - 2 * F.col(x) + F.lag(x).over(w), F.lead(y).over(w) - 2 * F.col(y) + F.lag(y).over(w)
    return df.withColumns({"gradient": F.when(dx != 0, dy / dx), "curvature": F.when(dx * dx + dy * dy > 0, (ddy * dx - ddx * dy) / F.pow(dx * dx + dy * dy, 1.5))})


def gaussian_smooth(df: DataFrame, ix: str, iy: str, value: str, sigma: float, reach: int) -> DataFrame:
    """Weighted mean over grid neighbours up to ``reach`` cells away; cells without a finite value stay so and count nowhere."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    shifts = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(pow(2.718281828459045, -(i * i + j * j) / (2 * sigma * sigma))).alias("w")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    given = good.select(ix, iy, value, F.inline(shifts)).select((F.col(ix) + F.col("dx")).alias(ix), (F.col(iy) + F.col("dy")).alias(iy), (F.col(value) * F.col("w")).alias("_wv"), F.col("w").alias("_w"))
    smooth = given.groupBy(ix, iy).agg(ratio(F.sum("_wv"), F.sum("_w")).alias("smoothed"))
    return good.join(smooth, [ix, iy])


def median_filter(df: DataFrame, ix: str, iy: str, value: str, reach: int) -> DataFrame:
    """Median over grid neighbours up to ``reach`` cells away, leaving out missing ones."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    shifts = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    given = good.select(ix, iy, value, F.inline(shifts)).select((F.col(ix) + F.col("dx")).alias(ix), (F.col(iy) + F.col("dy")).alias(iy), F.col(value).alias("_v"))
    return good.join(given.groupBy(ix, iy).agg(F.median("_v").alias("smoothed")), [ix, iy])


def gap_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], position: Column, gap: float, name: str) -> DataFrame:
    """Add the number of each row's run: a new one begins where the position has moved on by more than ``gap``."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_p", position)
    new = F.when(F.col("_p") - F.lag("_p").over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_new")
