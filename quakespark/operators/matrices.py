"""Sparse tables (row, col, value) of Green's functions and maps: rotated, stacked, scaled and resampled as joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_total


def sensitivity(greens: DataFrame, data: DataFrame) -> DataFrame:
    """(col, sensitivity): the diagonal of G' W G, with W from (row, weight); rows without a weight don't count."""
    return greens.join(data.select("row", "weight"), "row").groupBy("col").agg(F.sum(F.col("value") * F.col("value") * F.col("weight")).alias("sensitivity"))


def column_norms(greens: DataFrame, how: str = "l2") -> DataFrame:
    """(col, norm): Euclidean length (l2) or absolute sum (l1) of each column."""
    v = F.col("value")
    return greens.groupBy("col").agg({"l2": F.sqrt(F.sum(v * v)), "l1": F.sum(F.abs(v))}[how].alias("norm"))


def equalized(greens: DataFrame, groups: DataFrame, how: str = "l2") -> DataFrame:
    """(row, col, value, scale): columns scaled by the mean norm over their part's, groups being (col, patch, part).

    The columns of a patch (its slip components) have one norm, the root of their summed squares, so that rakes stay; a part
    (a patch alone, or all of a depth) has the mean of its columns' norms. Columns without a part keep their values with
    scale 1; parts that nothing sees get scale 0.
    """
    norms = groups.join(column_norms(greens, how), "col", "left").withColumn("norm", F.coalesce("norm", F.lit(0.0)))
    patches = norms.groupBy("part", "patch").agg(F.sqrt(F.sum(F.col("norm") * F.col("norm"))).alias("own"), F.count("*").alias("n"))
    parts = patches.groupBy("part").agg((F.sum(F.col("own") * F.col("n")) / F.sum("n")).alias("own"), F.sum("n").alias("n"))
    mean = parts.agg((F.sum(F.col("own") * F.col("n")) / F.sum("n")).alias("mean"))  # one row
    scales = groups.join(parts, "part").join(F.broadcast(mean)).select("col", F.when(F.col("own") == 0, 0.0).otherwise(F.col("mean") / F.col("own")).alias("scale"))
    out = greens.join(scales, "col", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    return out.select("row", "col", (F.col("value") * F.col("scale")).alias("value"), "scale")


def rotated(strike: Column, dip: Column, strike_slip: Column, dip_slip: Column, azimuth: float) -> tuple[Column, Column]:
    """Green's functions of slip along an azimuth (degrees) and across it, from those of strike and dip slip on planes of given angles (degrees).

    The slip lies in the plane and its horizontal part points along the azimuth: seen from the strike, whose unit vector is
    horizontal, against the way up the plane, of which only the cosine of the dip is horizontal.
    """
    apart = F.radians(strike - azimuth)
    rake = F.atan2(F.sin(apart), F.cos(F.radians(dip)) * F.cos(apart))
    return strike_slip * F.cos(rake) + dip_slip * F.sin(rake), strike_slip * F.sin(rake) - dip_slip * F.cos(rake)


def stacked(*tables: DataFrame) -> DataFrame:
    """One (dataset, row, col, value) table of several datasets' (row, col, value); rows follow those of earlier datasets."""
    out, start = None, 0
    for k, t in enumerate(tables):
        own = t.select(F.lit(k).alias("dataset"), (F.col("row") + start).alias("row"), "col", "value")
        out = own if out is None else out.unionByName(own)
        last = t.agg(F.max("row")).first()[0]
        start += 0 if last is None else last + 1
    return out


def resampled(samples: DataFrame, order: str, weight: str, u: float, width: float) -> DataFrame:
    """Each sample as often as systematic resampling draws it: draws (k + u) / n for k < n meet the running shares of the weights.

    ``order`` is numeric and distinct, 0 <= u < 1; running sums are made by ranges of ``width`` of it. Adds ``copies``; samples drawn never stay with 0.
    """
    return draws(samples, order, weight, u, width).drop("draw")


def draws(samples: DataFrame, order: str, weight: str, u: float, width: float) -> DataFrame:
    """The same with ``draw``, the number of draws that met earlier samples."""
    n, whole = samples.agg(F.count("*"), F.sum(weight)).first()
    run = running_total(samples, order, weight, width)
    upto = lambda c: F.greatest(F.lit(0), F.least(F.lit(n), F.floor(F.round(c / float(whole or 1.0) * n - u, 9)) + 1))
    before = upto(F.col("running_sum") - F.col(weight))
    return run.withColumns({"copies": (upto(F.col("running_sum")) - before).cast("long"), "draw": before.cast("long")}).drop("running_sum")
