"""Forward models on (observation x source) pairs, and linear inversion from sparse (row, col, value) tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..functions.safe import ratio
from ..operators import inversion


def mogi(x: Column, y: Column, x0: Column | float, y0: Column | float, depth: Column | float, volume: Column | float, poisson: float = 0.25) -> tuple[Column, Column, Column]:
    """Surface displacement (east, north, up) of a point source of volume change, all in one unit of length."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    dx, dy, d = x - lit(x0), y - lit(y0), lit(depth)
    c = ratio(lit(volume) * ((1 - poisson) / math.pi), F.pow(dx * dx + dy * dy + d * d, 1.5))
    return c * dx, c * dy, c * d


def volume_of_pressure(pressure: Column, radius: Column, shear_modulus: float) -> Column:
    """Volume change of a spherical cavity much smaller than its depth, under a change of pressure."""
    return 0.75 * _sphere(radius) * pressure / shear_modulus


def pressure_of_volume(volume: Column, radius: Column, shear_modulus: float) -> Column:
    return volume * shear_modulus / (0.75 * _sphere(radius))


def _sphere(radius: Column) -> Column:
    return 4 / 3 * math.pi * F.pow(radius, F.lit(3.0))


def predict(greens: DataFrame, model: DataFrame, correction: DataFrame | None = None) -> DataFrame:
    """(row, predicted): sum over parameters of value times the parameter; rows of (row, predicted) may be added."""
    out = greens.join(model, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("m")).alias("predicted"))
    return out if correction is None else out.unionByName(correction).groupBy("row").agg(F.sum("predicted").alias("predicted"))


def gram(greens: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, j, value) of G'WG and (i, value) of G'Wd, for data (row, d, weight)."""
    sums = inversion.products(greens, data.withColumn("part", F.lit(0)))
    return sums.where("j >= 0").select("i", "j", "value"), sums.where("j < 0").select("i", "value")


def least_squares(greens: DataFrame, data: DataFrame, parameters: int, damping: float = 0.0, nonnegative: bool = False) -> np.ndarray:
    """Parameters 0 .. n-1 that fit the data; the n x n system is solved on the driver, rows never reach it."""
    g, d, _, _ = inversion.parts(greens, data.withColumn("part", F.lit(0)), parameters).get(0, (np.zeros((parameters, parameters)), np.zeros(parameters), 0.0, 0))
    g = g + damping * np.eye(parameters)
    return inversion.bounded(g, d, np.zeros(parameters), np.full(parameters, np.inf)) if nonnegative else np.linalg.lstsq(g, d, rcond=None)[0]
