"""Spatial, temporal and value filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import align_longitude, is_finite


def box(df: DataFrame, x: str, y: str, bounds: tuple[float, float, float, float], closed: bool = False) -> DataFrame:
    """Rows inside (x0, x1, y0, y1); the edges count only if ``closed``."""
    x0, x1, y0, y1 = bounds
    a, b = F.col(x), F.col(y)
    inside = (a >= x0) & (a <= x1) & (b >= y0) & (b <= y1) if closed else (a > x0) & (a < x1) & (b > y0) & (b < y1)
    return df.where(inside)


def between(df: DataFrame, column: str, low=None, high=None, closed: bool = False) -> DataFrame:
    """Rows with a value between the bounds; None is no bound."""
    c = F.col(column)
    if low is not None:
        df = df.where(c >= F.lit(low) if closed else c > F.lit(low))
    if high is not None:
        df = df.where(c <= F.lit(high) if closed else c < F.lit(high))
    return df


def in_polygon(x: Column, y: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule: the number of edges to the right of the point is odd."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if y1 != y2:
            crosses = ((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + F.when(crosses, 1).otherwise(0)
    return crossings % 2 == 1


def in_boxes(lon: Column, lat: Column, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    """Inside any of the closed boxes, longitudes taken on the branch of the box's centre."""
    found = F.lit(False)
    for x0, x1, y0, y1 in boxes:
        found = found | (align_longitude(lon, (x0 + x1) / 2).between(x0, x1) & lat.between(y0, y1))
    return found


def in_circle(x: Column, y: Column, center: tuple[float, float], radius: float) -> Column:
    return (x - center[0]) ** 2 + (y - center[1]) ** 2 <= radius**2


def region(df: DataFrame, inside: Column, remove: bool = True) -> DataFrame:
    """Rows outside the region, or inside with ``remove`` false; unknown counts as outside."""
    known = F.coalesce(inside, F.lit(False))
    return df.where(~known if remove else known)


def keep_names(df: DataFrame, column: str, names: Sequence[str], keep: bool = True) -> DataFrame:
    """Stations on a list, or those that aren't."""
    return df.where(F.col(column).isin(*names) if keep else ~F.col(column).isin(*names))


def drop_zeros(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) != 0)


def drop_non_finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are all finite."""
    for c in columns:
        df = df.where(is_finite(F.col(c)))
    return df


def limit_amplitude(df: DataFrame, threshold: float, *columns: str) -> DataFrame:
    """Rows whose vector length over the columns is at most the threshold."""
    return df.where(F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))) <= threshold)


def rules(df: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that all rules keep, and a report (rule, n_input, n_removed, n_kept) as the rules act one after another."""
    names = list(conditions)
    first = F.coalesce(*(F.when(~F.coalesce(conditions[n], F.lit(False)), F.lit(k)) for k, n in enumerate(names)), F.lit(len(names)))
    tagged = df.withColumn("_fails", first)
    counts = tagged.groupBy("_fails").agg(F.count("*").alias("n"))
    labels = df.sparkSession.createDataFrame(list(enumerate(names)), "k int, rule string")
    joined = F.broadcast(labels).join(counts, counts["_fails"] >= labels["k"], "left").groupBy("k", "rule")
    report = joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_input"), F.coalesce(F.sum(F.when(F.col("_fails") == F.col("k"), F.col("n"))), F.lit(0)).alias("n_removed"))
    report = report.withColumn("n_kept", F.col("n_input") - F.col("n_removed")).orderBy("k").drop("k")
    return tagged.where(F.col("_fails") == len(names)).drop("_fails"), report


def outliers(df: DataFrame, column: str, method: str = "zscore", limit: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows within ``limit``: standard deviations (zscore), interquartile ranges (iqr), or absolute value.

    Groups of at most 2 (zscore) or 4 (iqr) finite values stay whole; values that aren't finite go.
    """
    c = F.col(column)
    df = df.where(is_finite(c))
    if method == "absolute":
        return df.where(F.abs(c) <= limit)
    if method == "zscore":
        stats = df.groupBy(*by).agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"), F.count("*").alias("_n"))
        keep = (F.col("_n") <= 2) | (F.col("_s") == 0) | (F.abs(c - F.col("_m")) <= limit * F.col("_s"))
    elif method == "iqr":
        stats = df.groupBy(*by).agg(F.percentile(c, 0.25).alias("_m"), F.percentile(c, 0.75).alias("_s"), F.count("*").alias("_n"))
        spread = F.col("_s") - F.col("_m")
        keep = (F.col("_n") <= 4) | c.between(F.col("_m") - limit * spread, F.col("_s") + limit * spread)
    else:
        raise ValueError(f"unknown method {method!r}")
    joined = df.join(stats, list(by)) if by else df.join(F.broadcast(stats))  # one row
    return joined.where(keep).select(df.columns)


def depth_window(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Patches with a depth in [low, high]."""
    return df.where(F.col(column).between(low, high))


def drop_vertical(df: DataFrame, up: str) -> DataFrame:
    """Pixels whose look vector isn't straight up; a null look goes too."""
    return df.where(F.col(up) != 1.0)


def unit_looks(df: DataFrame, e: str, n: str, u: str, tolerance: float = 1e-5) -> DataFrame:
    """Rows whose look vector has length one; null vectors go."""
    return df.where(F.abs(F.sqrt(F.col(e) ** 2 + F.col(n) ** 2 + F.col(u) ** 2) - 1) <= tolerance)


def within_profile(df: DataFrame, low: float, high: float, bottom: float, top: float, along: str = "along", value: str = "value") -> DataFrame:
    """Rows of a profile outside both a range of places and a range of values go; ranges are closed, null values go."""
    return df.where(F.col(along).between(low, high) & F.col(value).between(bottom, top))
