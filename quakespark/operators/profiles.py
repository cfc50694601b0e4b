"""Swath profiles: points in a rectangle about a line, in along and across coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import to_trace


def swath(df: DataFrame, x: str, y: str, center: tuple[float, float], azimuth: float, length: float, width: float) -> DataFrame:
    """Rows in a rectangle of a centre, compass azimuth, length and width, with ``along`` and ``across``."""
    a = math.radians(azimuth)
    east, north = F.col(x) - center[0], F.col(y) - center[1]
    along, across = east * math.sin(a) + north * math.cos(a), east * math.cos(a) - north * math.sin(a)
    return df.withColumns({"along": along, "across": across}).where((F.abs("along") <= length / 2) & (F.abs("across") <= width / 2))


def swath_along_trace(df: DataFrame, x: str, y: str, vertices: Sequence[tuple[float, float]], width: float) -> DataFrame:
    """Rows within half the width of a polyline (round ends), with segment, along and trace_distance."""
    return to_trace(df, x, y, vertices).where(F.col("trace_distance") <= width / 2)


def reference_profile(df: DataFrame, position: str, value: str, low: float, high: float, how: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """Subtract the mean, or the straight line, of the closed window of positions from each profile."""
    v, p = (F.when(F.col(position).between(low, high), F.col(c)) for c in (value, position))
    slope, level = (F.lit(0.0), F.avg(v)) if how == "mean" else (F.regr_slope(v, p), F.regr_intercept(v, p))
    fit = df.groupBy(*by).agg(slope.alias("_a"), level.alias("_b"))
    joined = df.join(fit, list(by)) if by else df.join(F.broadcast(fit))
    return joined.withColumn(value, F.col(value) - (F.col("_a") * F.col(position) + F.col("_b"))).drop("_a", "_b")


def side_offset(df: DataFrame, position: str, value: str, gap: float, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Offset at 0 of the lines fitted to either side of a gap; null unless each side has more than ``least`` rows."""
    p = F.col(position)
    right, left = p >= gap / 2, p <= -gap / 2
    at = lambda side: F.regr_intercept(F.when(side, F.col(value)), F.when(side, p))
    enough = (F.count(F.when(right, 1)) > least) & (F.count(F.when(left, 1)) > least)
    return df.groupBy(*by).agg(F.when(enough, at(right) - at(left)).alias("offset"), F.count("*").alias("n"))
