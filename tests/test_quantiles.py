"""Exact percentiles against NumPy, over ties, heavy tails and tiny tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.operators import quantiles


@pytest.mark.parametrize("kind", ["normal", "tails", "ties", "one", "equal"])
def test_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "BINS", 16)
    monkeypatch.setattr(quantiles, "MOST", 10)
    rng = np.random.default_rng(5)
    v = {"normal": rng.normal(size=3000), "tails": np.exp(rng.normal(size=2000) * 8), "ties": rng.integers(0, 7, 2000) * 1.5, "one": np.array([2.5]), "equal": np.full(200, 3.25)}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    shares = [0.0, 0.01, 0.333, 0.5, 0.95, 1.0]
    assert quantiles.quantiles(df, F.col("v"), shares) == pytest.approx(list(np.quantile(v, shares)), rel=1e-12)


def test_no_values(spark):
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "v double"), F.col("v"), [0.5]) == [None]
