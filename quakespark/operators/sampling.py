"""Sequential Monte Carlo: tempered stages, weights and covariances as sums, seeded Metropolis chains in partitions.

Samples are rows (chain, m, fit): parameters and their log-likelihood. Every random number comes from a generator seeded with
(seed, stage, chain), so a task that runs again draws the same, however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matrices
from .shared import checkpoint

#: Candidates for the next exponent that are tried in one pass.
TRIES = 64
Likelihood = Callable[[np.ndarray], np.ndarray]
SAMPLES = "chain long, m array<double>, fit double, accepted long"


def next_beta(samples: DataFrame, beta: float, fit: str = "fit", variation: float = 1.0, passes: int = 4) -> float:
    """The exponent up to 1 at which the weights exp((beta' - beta) fit) have a coefficient of variation of ``variation``.

    Each pass sums the weights for ``TRIES`` exponents at once and narrows the interval to one step of them. A null or NaN
    fit has weight 0; without samples the exponent is 1.
    """
    fits = samples.where(F.col(fit).isNotNull() & ~F.isnan(fit))
    n, top = samples.count(), fits.agg(F.max(fit)).first()[0]
    low, high = beta, 1.0
    if not n or top is None or np.isinf(top):
        return 1.0
    for _ in range(passes):
        tries = np.linspace(low, high, TRIES + 1)[1:]
        each = fits.select((F.col(fit) - top).alias("d"), F.explode(F.array(*(F.lit(float(t) - beta) for t in tries))).alias("t"))
        weight = F.exp(F.col("t") * F.col("d"))
        sums = {r["t"]: r for r in each.groupBy("t").agg(F.sum(weight).alias("s"), F.sum(weight * weight).alias("q")).collect()}
        got = [sums[float(t) - beta] for t in tries]
        spread = np.array([np.sqrt(max(n * r["q"] / r["s"] ** 2 - 1, 0.0)) if r["s"] else np.inf for r in got])
        over = np.flatnonzero(spread > variation)
        if not len(over):
            return float(high)
        low, high = (tries[over[0] - 1] if over[0] else low), tries[over[0]]
    return float(high)


def spread(samples: DataFrame, size: int, weight: str = "weight") -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and covariance of the parameters, from one pass of sums about a first mean."""
    m = [F.col("m")[k] for k in range(size)]
    first = samples.agg(F.sum(weight).alias("w"), *(F.avg(v).alias(f"m{k}") for k, v in enumerate(m))).first()
    if not first["w"]:
        return np.zeros(size), np.zeros((size, size))
    shift = np.array([first[f"m{k}"] for k in range(size)])
    d = [v - float(s) for v, s in zip(m, shift, strict=True)]
    w = F.col(weight)
    sums = samples.agg(*(F.sum(w * x).alias(f"d{k}") for k, x in enumerate(d)), *(F.sum(w * d[i] * d[j]).alias(f"c{i}_{j}") for i in range(size) for j in range(i, size))).first()
    mean = np.array([sums[f"d{k}"] for k in range(size)]) / first["w"]
    second = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) / first["w"]
    return shift + mean, second - np.outer(mean, mean)


def drawn(spark: SparkSession, low: np.ndarray, high: np.ndarray, chains: int, likelihood: Likelihood, seed: int) -> DataFrame:
    """Samples from uniform priors between two corners."""
    low, high = np.asarray(low, float), np.asarray(high, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chain = batch.column(0).to_numpy()
            m = np.array([np.random.default_rng([seed, 0, int(c)]).uniform(low, high) for c in chain]).reshape(len(chain), len(low))
            yield _rows(chain, m, likelihood(m), np.zeros(len(chain), np.int64))

    return checkpoint(spark.range(chains).mapInArrow(run, SAMPLES))


def _rows(chain: np.ndarray, m: np.ndarray, fit: np.ndarray, accepted: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(m).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), flat)
    return pa.RecordBatch.from_arrays([pa.array(chain), lists, pa.array(np.asarray(fit, float)), pa.array(accepted)], ["chain", "m", "fit", "accepted"])


def moved(samples: DataFrame, beta: float, root: np.ndarray, low: np.ndarray, high: np.ndarray, likelihood: Likelihood, steps: int, seed: int, stage: int) -> DataFrame:
    """Each sample after ``steps`` Metropolis steps on likelihood ** beta within the bounds; ``root`` is the proposals' Cholesky factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chain, fit = batch.column("chain").to_numpy(), batch.column("fit").to_numpy().copy()
            m = batch.column("m").flatten().to_numpy().reshape(batch.num_rows, -1).copy()
            draws = [np.random.default_rng([seed, stage, int(c)]) for c in chain]
            jump = np.array([r.normal(size=(steps, m.shape[1])) for r in draws]) @ root.T
            toss = np.log(np.array([r.random(steps) for r in draws]))
            accepted = np.zeros(len(chain), np.int64)
            for k in range(steps):
                new = m + jump[:, k]
                inside = ((new >= low) & (new <= high)).all(1)
                got = np.full(len(chain), -np.inf)
                if inside.any():
                    got[inside] = likelihood(new[inside])
                take = inside & (toss[:, k] < beta * (got - fit))
                m[take], fit[take] = new[take], got[take]
                accepted += take
            yield _rows(chain, m, fit, accepted)

    return samples.select("chain", "m", "fit").mapInArrow(run, SAMPLES)


def sampled(spark: SparkSession, low: np.ndarray, high: np.ndarray, likelihood: Likelihood, chains: int = 2000, steps: int = 25, seed: int = 1, stages: int = 100) -> tuple[DataFrame, list[float]]:
    """Samples (chain, m, fit, accepted) of the posterior under uniform priors, and the exponents of the stages.

    ``likelihood`` takes (n, parameters) and gives n log-likelihoods; it is sent to the tasks, so what it holds must be small
    (sums of products, not data). A stage weighs the samples for the next exponent, draws them by those weights, and
    moves each copy. Proposals are scaled by how many of the last stage's steps were taken.
    """
    low, high = np.asarray(low, float), np.asarray(high, float)
    now, beta, betas, scale = drawn(spark, low, high, chains, likelihood, seed), 0.0, [], 2.38 / np.sqrt(len(low))
    for stage in range(1, stages + 1):
        ahead = next_beta(now, beta)
        top = now.agg(F.max("fit")).first()[0]
        weighted = checkpoint(now.withColumn("weight", F.exp((ahead - beta) * (F.col("fit") - float(top)))))
        _, covariance = spread(weighted, len(low))
        u = float(np.random.default_rng([seed, stage]).random())
        # a copy takes the number of the draw that chose it
        picked = matrices.draws(weighted, "chain", "weight", u, max(1.0, chains / 64)).where("copies > 0")
        copies = picked.select("m", "fit", F.explode(F.sequence(F.col("draw"), F.col("draw") + F.col("copies") - 1)).alias("chain"))
        root = scale * np.linalg.cholesky(covariance + 1e-12 * np.eye(len(low)) * max(np.trace(covariance), 1e-300))
        now, beta = checkpoint(moved(copies, ahead, root, low, high, likelihood, steps, seed, stage)), ahead
        betas.append(beta)
        taken = (now.agg(F.avg("accepted")).first()[0] or 0.0) / steps
        scale *= np.clip(taken / 0.25, 0.5, 2.0)
        if beta >= 1:
            return now, betas
    raise RuntimeError(f"the exponent didn't reach 1 in {stages} stages")
