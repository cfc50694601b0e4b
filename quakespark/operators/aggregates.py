"""Statistics of residuals, catalogs, bins and patches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import finite
from ..functions.seismo import magnitude
from .quantiles import quantiles
from ..functions.safe import ratio


def fit_metrics(df: DataFrame, observed: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """rms, variance reduction in per cent (0 without signal), sums of squares, signed misfit, variance and n."""
    o, r = F.col(observed), F.col(observed) - F.col(predicted)
    out = df.groupBy(*by).agg(F.sqrt(F.avg(r * r)).alias("rms"), F.sum(r * r).alias("ss_res"), F.sum(o * o).alias("ss_obs"), F.sum(r).alias("signed_misfit"), F.var_pop(r).alias("variance"), F.count("*").alias("n"))
    return out.withColumn("vr", F.when(F.col("ss_obs") == 0, 0.0).otherwise((1 - F.col("ss_res") / F.col("ss_obs")) * 100))


def fit_report(df: DataFrame, observed: str, predicted: str, dataset: str) -> DataFrame:
    """Metrics of each data set, their average (means of rms and vr, sums of the rest), and of the stacked data."""
    each = fit_metrics(df, observed, predicted, [dataset]).select(F.lit("dataset").alias("scope"), F.col(dataset).cast("string").alias("name"), "rms", "vr", "ss_res", "ss_obs", "n")
    average = each.agg(F.avg("rms").alias("rms"), F.avg("vr").alias("vr"), F.sum("ss_res").alias("ss_res"), F.sum("ss_obs").alias("ss_obs"), F.sum("n").alias("n")).select(F.lit("dataset_average").alias("scope"), F.lit("all").alias("name"), "rms", "vr", "ss_res", "ss_obs", "n")
    stacked = fit_metrics(df, observed, predicted).select(F.lit("stacked").alias("scope"), F.lit("all").alias("name"), "rms", "vr", "ss_res", "ss_obs", "n")
    return each.unionByName(average).unionByName(stacked)


def summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Number, mean, median, extremes, quartiles and population deviation over finite values."""
    v = finite(F.col(column))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"))


def magnitude_histogram(df: DataFrame, column: str, width: float, start: float = 0.0) -> DataFrame:
    """(bin, center, n, n_above): events by magnitude bin, and those at or above its lower edge."""
    counts = df.groupBy(F.floor((F.col(column) - start) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("bin")))  # over bins, not events
    return counts.select("bin", (start + (F.col("bin") + 0.5) * width).alias("center"), "n", above.alias("n_above"))


def b_value_least_squares(df: DataFrame, column: str, width: float, start: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """a and b of log10 N = a - b M over the bins' lower edges."""
    counts = df.groupBy(*by, F.floor((F.col(column) - start) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("bin")))
    y = F.log10(above)
    rows = counts.select(*by, (start + F.col("bin") * width).alias("m"), y.alias("y"))
    return rows.groupBy(*by).agg((-F.regr_slope("y", "m")).alias("b"), F.regr_intercept("y", "m").alias("a"))


def b_value_likelihood(df: DataFrame, column: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """b by maximum likelihood above the smallest magnitude; null below two events, or where all are equal and ``width`` is 0."""
    m = F.col(column)
    return df.groupBy(*by).agg(F.when(F.count(m) >= 2, ratio(math.log10(math.e), F.avg(m) - (F.min(m) - width / 2))).alias("b"), F.count(m).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, size: tuple[float, float], compat: tuple[float, float] | None = None) -> DataFrame:
    """Events by cell (ix, iy); ``compat`` gives the upper ends beyond which partial cells are dropped."""
    ix, iy = F.floor(F.col(x) / size[0]).cast("long"), F.floor(F.col(y) / size[1]).cast("long")
    out = df.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("n"))
    return out.where(((F.col("ix") + 1) * size[0] <= compat[0]) & ((F.col("iy") + 1) * size[1] <= compat[1])) if compat else out


def binned(df: DataFrame, position: str, value: str, width: float, start: float = 0.0, by: Sequence[str] = (), how: str = "mean") -> DataFrame:
    """Mean or median, mean position, population deviation and number by bins of a position."""
    v = F.col(value)
    statistic = {"mean": F.avg(v), "median": F.median(v), "max": F.max(v), "min": F.min(v)}[how]
    return df.groupBy(*by, F.floor((F.col(position) - start) / width).cast("long").alias("bin")).agg(statistic.alias("value"), F.avg(position).alias("position"), F.stddev_pop(v).alias("std"), F.count("*").alias("n"))


def depth_statistics(df: DataFrame, depth: str, value: str, edges: Sequence[float]) -> DataFrame:
    """Mean, max, median and deviation by depth bin [a, b), the last closed; bins without patches have zeros."""
    d = F.col(depth)
    number = sum((F.when(d >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    inside = df.where(d.between(edges[0], edges[-1])).withColumn("bin", number)
    got = inside.groupBy("bin").agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, low double, high double")
    return F.broadcast(bins).join(got, "bin", "left").na.fill(0)


def depth_layers(df: DataFrame, depth: str, tolerance: float) -> DataFrame:
    """Layers of patch depths: distinct depths, grouped while the gap is at most ``tolerance``; their medians."""
    distinct = df.select(F.round(depth, 4).alias("d")).distinct()
    order = Window.orderBy("d")  # over distinct depths of a mesh
    new = F.when(F.col("d") - F.lag("d").over(order) <= tolerance, 0).otherwise(1)
    return distinct.withColumn("layer", F.sum(new).over(order)).groupBy("layer").agg(F.median("d").alias("depth"), F.count("*").alias("n"))


def normalize(df: DataFrame, column: str, how: str = "max") -> DataFrame:
    """Divide by the largest or summed absolute value, the Euclidean length, or the 95th percentile; by 0 never."""
    v = F.abs(F.col(column))
    if how == "p95":
        factor = F.lit(quantiles(df, v, [0.95])[0])
    else:
        factor = {"max": F.max(v), "sum": F.sum(v), "l2": F.sqrt(F.sum(v * v))}[how]
    one = df.agg(F.coalesce(factor, F.lit(0.0)).alias("_f"))
    return df.join(F.broadcast(one)).withColumn(column, F.when(F.col("_f") == 0, F.col(column)).otherwise(F.col(column) / F.col("_f"))).drop("_f")


def moments(df: DataFrame, area_km2: str, slip: str, shear_modulus: float, by: Sequence[str] = ()) -> DataFrame:
    """Moment, moment magnitude, potency, and mean and largest slip of patches."""
    m = F.sum(F.col(area_km2) * 1e6 * F.col(slip) * shear_modulus)
    out = df.groupBy(*by).agg(m.alias("moment"), F.sum(F.col(area_km2) * 1e6 * F.col(slip)).alias("potency"), F.avg(slip).alias("mean_slip"), F.max(slip).alias("max_slip"), F.sum(area_km2).alias("area_km2"), F.count("*").alias("n"))
    return out.withColumn("magnitude", magnitude(F.col("moment")))


def centroid(df: DataFrame, weight: str, *columns: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted means of the columns, null where the weights add up to 0."""
    return df.groupBy(*by).agg(*(ratio(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(c) for c in columns))


def stress_drop(df: DataFrame, area_km2: str, slip: str, shear_modulus: float, by: Sequence[str], threshold: float = 0.1, shape: float = 2.44) -> DataFrame:
    """Moment over area to the power 1.5, of patches that slip at least ``threshold`` of the largest slip; null without area."""
    top = df.groupBy(*by).agg(F.max(slip).alias("_top"))
    used = df.join(top, list(by)).where(F.col(slip) >= threshold * F.col("_top"))
    out = used.groupBy(*by).agg(F.sum(area_km2).alias("area_km2"), F.sum(F.col(area_km2) * 1e6 * F.col(slip) * shear_modulus).alias("moment"))
    return out.withColumn("stress_drop", ratio(shape * F.col("moment"), F.pow(F.col("area_km2") * 1e6, 1.5)))


def counts_by_patch(events: DataFrame, patches: DataFrame, patch: str, area: str | None = None) -> DataFrame:
    """Events of every patch, zero where none, and by area (null where that is 0)."""
    got = events.groupBy(patch).agg(F.count("*").alias("n"))
    out = patches.join(got, patch, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("rate", ratio(F.col("n"), F.col(area))) if area else out


def trimmed_mean(df: DataFrame, value: str, fraction: float, by: Sequence[str]) -> DataFrame:
    """Mean without the floor(n * fraction) smallest and largest values of each group.

    Groups are summed by distinct value before they are ordered, so many equal values are one row.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*by).orderBy(value)
    counts = counts.withColumns({"_end": F.sum("_c").over(up), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    cut = F.floor(F.col("_n") * fraction)
    used = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_n") - cut) - F.greatest(F.col("_end") - F.col("_c"), cut))
    return counts.groupBy(*by).agg(ratio(F.sum(F.col(value) * used), F.sum(used)).alias("trimmed_mean"), F.first("_n").alias("n"))


def spread(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Population deviation, 1.4826 times the median absolute deviation, and standard error of the mean."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_m"))
    rows = df.join(middle, list(by))
    return rows.groupBy(*by).agg(F.stddev_pop(value).alias("std"), (1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("mad"), (F.stddev_pop(value) / F.sqrt(F.count("*"))).alias("sem"))


def value_diagnostics(df: DataFrame, column: str, low: float, high: float, central: float = 0.98) -> DataFrame:
    """Finite count, extremes, mean, the central range of percentiles and the share outside [low, high]."""
    v = finite(F.col(column))
    ends = [F.lit(x).cast("double") for x in quantiles(df, v, [(1 - central) / 2, (1 + central) / 2])]
    return df.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.any_value(ends[0]).alias("low"), F.any_value(ends[1]).alias("high"), F.avg(F.when(v.isNotNull(), F.when(v.between(low, high), 0.0).otherwise(1.0))).alias("clipped"))


def vertical_average(df: DataFrame, depth: str, *columns: str) -> DataFrame:
    """Mean and population deviation of each column's finite values at each depth."""
    return df.groupBy(depth).agg(*(f for c in columns for f in (F.avg(finite(F.col(c))).alias(f"{c}_mean"), F.stddev_pop(finite(F.col(c))).alias(f"{c}_std"))))


def tensor_sum(df: DataFrame, entries: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Summed moment tensor (rr, tt, pp, rt, rp, tp in this order), scalar moment and magnitude."""
    out = df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in entries))
    square: Column = sum((F.col(c) ** 2 * (1 if k < 3 else 2) for k, c in enumerate(entries)), F.lit(0.0))
    return out.withColumn("moment", F.sqrt(square / 2)).withColumn("magnitude", magnitude(F.col("moment")))
