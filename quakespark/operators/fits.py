"""Linear fits by normal equations: Spark sums the products, the driver solves a system as large as the number of parameters."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.geo import is_finite
from .quantiles import quantiles


def _sums(design: Sequence[Column], value: Column, weight: Column) -> list[Column]:
    n = len(design)
    products = [F.sum(design[i] * design[j] * weight).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    return products + [F.sum(design[i] * value * weight).alias(f"d{i}") for i in range(n)]


def normal_equations(df: DataFrame, design: Sequence[Column], value: str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row (a group): g{i}_{j} and d{i}, the sums of weighted products."""
    return df.groupBy(*by).agg(*_sums(design, F.col(value), F.lit(1.0) if weight is None else weight), F.count("*").alias("n"))


def solve(df: DataFrame, design: Sequence[Column], value: str, weight: Column | None = None, damping: float = 0.0) -> np.ndarray:
    """Least-squares parameters; a singular system gives the shortest solution."""
    n = len(design)
    row = normal_equations(df, design, value, weight).first()
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    return np.linalg.lstsq(g + damping * np.eye(n), np.array([row[f"d{i}"] or 0.0 for i in range(n)]), rcond=None)[0]


def evaluate(design: Sequence[Column], parameters: Sequence[float]) -> Column:
    return sum((c * float(p) for c, p in zip(design, parameters, strict=True)), F.lit(0.0))


def ramp(x: Column, y: Column, kind: str = "linear") -> list[Column]:
    """Design of a surface: constant, linear, bilinear or quadratic."""
    one = F.lit(1.0)
    return {"constant": [one], "linear": [one, x, y], "bilinear": [one, x, y, x * y], "quadratic": [one, x, y, x * y, x * x, y * y]}[kind]


def remove_ramp(df: DataFrame, x: str, y: str, value: str, kind: str = "linear", used: Column | None = None) -> DataFrame:
    """Fit a surface to the finite rows that ``used`` marks, and subtract it from all rows."""
    design = ramp(F.col(x), F.col(y), kind)
    good = df.where(is_finite(F.col(value)))
    parameters = solve(good.where(used) if used is not None else good, design, value)
    return df.withColumn(value, F.col(value) - evaluate(design, parameters))


def huber(df: DataFrame, design: Sequence[Column], value: str, bend: float = 1.345, rounds: int = 200, tolerance: float = 1e-8, scaled: int = 4) -> np.ndarray:
    """Robust parameters: weights fall beyond ``bend`` scales, the scale being 1.4826 median absolute deviations.

    The scale is worked out anew in the first ``scaled`` rounds, which take several passes each; later ones, of one pass, keep it.
    Raises if the parameters don't settle.
    """
    now, scale = solve(df, design, value), 0.0
    for k in range(rounds):
        off = F.col(value) - evaluate(design, now)
        if k < scaled:
            middle = quantiles(df, off, [0.5])[0] or 0.0
            scale = 1.4826 * (quantiles(df, F.abs(off - middle), [0.5])[0] or 0.0)
            if scale == 0:
                return now
        weight = F.least(F.lit(1.0), bend * scale / F.greatest(F.abs(off), F.lit(1e-300)))
        new = solve(df, design, value, weight)
        done = np.abs(new - now).max() <= tolerance * max(1.0, np.abs(now).max())
        now = new
        if done:
            return now
    raise RuntimeError(f"robust parameters didn't settle in {rounds} rounds")


def linear_by_group(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, determination and number of each series; null below two points."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def helmert(df: DataFrame, x: str, y: str, east: str, north: str) -> np.ndarray:
    """Translation east and north, rotation and scale of a plane network, about its centre."""
    cx, cy = df.agg(F.avg(x), F.avg(y)).first()
    dx, dy = F.col(x) - cx, F.col(y) - cy
    rows = df.select(F.inline(F.array(F.struct(F.lit(1.0).alias("e"), F.lit(0.0).alias("n"), dy.alias("r"), dx.alias("s"), F.col(east).alias("v")), F.struct(F.lit(0.0).alias("e"), F.lit(1.0).alias("n"), (-dx).alias("r"), dy.alias("s"), F.col(north).alias("v")))))
    return solve(rows, [F.col(c) for c in ("e", "n", "r", "s")], "v")


def decay(df: DataFrame, by: Sequence[str], t: str, value: str, kind: str = "exp", rounds: int = 60, close: float = 1e-7) -> DataFrame:
    """(by, offset, amplitude, tau, rms, n, settled): offset + amplitude * f(t / tau) fitted to each series, t counted from the onset.

    ``kind`` is exp (f = 1 - exp(-u)) or log (f = ln(1 + u)); f is 0 before the onset. All series are fitted at once by Levenberg-Marquardt:
    a round is one aggregate of products at the parameters on trial, one row a series, and a step worked out on those rows, so a
    series of any length is never gathered. Rows with a null or non-finite number don't count. Series of fewer than three rows,
    without rows after the onset, or whose sums give no step, come back with ``settled`` false and what they have.
    """
    from .shared import checkpoint, settled

    keys = [F.col(c) for c in by]
    time, v = F.col(t).cast("double"), F.col(value).cast("double")
    rows = checkpoint(df.where(is_finite(time) & is_finite(v)).select(*keys, time.alias("_t"), v.alias("_v")))
    after = F.when(F.col("_t") > 0, F.col("_t"))
    first = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("c"), (F.stddev_pop("_v") * 0).alias("a"), F.log(F.avg(after)).alias("s"))
    state = first.select(*by, "n", "c", "a", "s", F.lit(1e-3).alias("damping"), F.lit(None).cast("double").alias("best"), F.col("c").alias("tc"), F.col("a").alias("ta"), F.col("s").alias("ts"), (F.col("s").isNull() | (F.col("n") < 3)).alias("stuck"), F.lit(False).alias("settled"))
    names = ["c", "a", "s", "damping", "best", "tc", "ta", "ts", "stuck", "settled"]
    sums = [f"p{i}{j}" for i in range(3) for j in range(i, 3)] + [f"r{i}" for i in range(3)] + ["cost"]
    state = checkpoint(state)
    schema = rows.select(*by).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            old, trial = (np.stack([get(c) for c in cs], -1) for cs in (("c", "a", "s"), ("tc", "ta", "ts")))
            p = np.empty((b.num_rows, 3, 3))
            for i in range(3):
                for j in range(i, 3):
                    p[:, i, j] = p[:, j, i] = get(f"p{i}{j}")
            g, cost, best, damping = np.stack([get(f"r{i}") for i in range(3)], -1), get("cost"), get("best"), get("damping")
            stuck, settled = get("stuck") > 0, get("settled") > 0
            better = ~(cost >= best) & np.isfinite(cost)  # the first round has no best cost
            now = np.where(better[:, None], trial, old)
            damping = np.where(better, damping / 5, damping * 4)
            ok = better & ~stuck & np.isfinite(p).all((1, 2))
            size = np.sqrt(np.where(np.einsum("nii->ni", p) > 0, np.einsum("nii->ni", p), 1.0))
            scaled = np.where(ok[:, None, None], p / size[:, :, None] / size[:, None, :], np.eye(3))
            go = np.linalg.solve(scaled + (damping[:, None, None] + 1e-14) * np.eye(3), np.where(ok[:, None], g / size, 0.0)[:, :, None])[:, :, 0] / size
            go[:, 2] = np.clip(go[:, 2], -2, 2)
            moves = np.abs(go * size).max(1)
            settled = settled | (ok & (moves <= close * np.sqrt(np.maximum(cost, 1e-300)) + 1e-14)) | (~better & (damping > 1e12))
            # a refused step: shorter, from where it started
            short = old + (trial - old) / 4
            ahead = np.where(better[:, None], now + go, short)
            stuck = stuck | settled
            out = [*now.T, damping, np.where(better, cost, best), *np.where(stuck[:, None], now, ahead).T]
            columns = [b.column(c) for c in (*by, "n")] + [pa.array(x, mask=~np.isfinite(x)) for x in out] + [pa.array(stuck), pa.array(settled)]
            yield pa.RecordBatch.from_arrays(columns, [*by, "n", *names])

    tau, amplitude = F.exp(F.col("ts")), F.col("ta")
    u = F.when(F.col("_t") > 0, F.col("_t")).otherwise(0.0) / tau
    f, slope = (1 - F.exp(-u), -u * F.exp(-u)) if kind == "exp" else (F.log1p(u), -u / (1 + u))
    design = [F.lit(1.0), F.col("_f"), amplitude * F.col("_d")]
    off = F.col("_v") - F.col("tc") - amplitude * F.col("_f")
    kept = StructType([*schema.fields, StructField("n", LongType()), *(StructField(c, BooleanType() if c in ("stuck", "settled") else DoubleType()) for c in names)])
    same = [F.col(f"_k{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)]
    for _ in range(rounds):
        open_ = state.where("not stuck")
        if open_.isEmpty():
            break
        tried = open_.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), "tc", "ta", "ts")
        met = rows.join(tried, functools.reduce(lambda x, y: x & y, same), "inner").select(*by, "_v", "tc", "ta", f.alias("_f"), slope.alias("_d"))
        products = [F.sum(design[i] * design[j]).alias(f"p{i}{j}") for i in range(3) for j in range(i, 3)] + [F.sum(design[i] * off).alias(f"r{i}") for i in range(3)] + [F.sum(off * off).alias("cost")]
        made = met.groupBy(*by).agg(*products).select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), *sums)
        going = open_.join(made, functools.reduce(lambda x, y: x & y, same)).select(*by, "n", *names, *sums)
        state = settled(state.where("stuck").unionByName(going.mapInArrow(step, kept)))
    return state.select(*by, F.col("c").alias("offset"), F.col("a").alias("amplitude"), F.exp("s").alias("tau"), F.sqrt(F.col("best") / F.col("n")).alias("rms"), "n", "settled")


def with_covariance(df: DataFrame, design: Sequence[Column], value: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Least-squares parameters, their covariance by the residuals' own variance, that variance, and the number of rows.

    Only sums of products reach the driver. Without more rows than parameters the variance is NaN.
    """
    w, v, n = F.lit(1.0) if weight is None else weight, F.col(value), len(design)
    row = df.agg(*_sums(design, v, w), F.sum(v * v * w).alias("vv"), F.count("*").alias("n")).first()
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    d = np.array([row[f"d{i}"] or 0.0 for i in range(n)])
    m = np.linalg.lstsq(g, d, rcond=None)[0]
    free = row["n"] - n
    variance = max((row["vv"] or 0.0) - 2 * m @ d + m @ g @ m, 0.0) / free if free > 0 else float("nan")
    return m, variance * np.linalg.pinv(g, hermitian=True), variance, row["n"]


def _slopes_up_to(x: np.ndarray, y: np.ndarray, slope: float) -> int:
    """How many pairs of different x have a slope of at most ``slope``: inversions of y - slope x, counted bit by bit of their ranks."""
    n = len(x)
    z = y - slope * x
    order = np.lexsort((z, x))
    z, x = z[order], x[order]
    rank = np.empty(n, np.int64)
    # of equal z a later x counts as lower, and rows of one x stand in their order
    rank[np.lexsort((np.arange(n), -x, z))] = np.arange(n)
    total = 0
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        by = np.argsort(rank >> (bit + 1), kind="stable")
        group, one = (rank >> (bit + 1))[by], (rank >> bit & 1)[by]
        ones = np.cumsum(one)
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        before = np.repeat(ones[head] - one[head], np.diff(np.append(head, n)))
        total += int((ones - before)[one == 0].sum())
    return total


def _middle_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The median of the slopes of all pairs of different x, by bisection on their number."""
    _, same = np.unique(x, return_counts=True)
    pairs = len(x) * (len(x) - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return float("nan")
    order = np.argsort(x, kind="stable")
    sx, sy = x[order], y[order]
    gap = np.diff(np.unique(sx)).min()
    reach = (sy.max() - sy.min()) / gap + 1e-300

    def ranked(k: int) -> float:
        low, high = -reach, reach
        for _ in range(200):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (low, mid) if _slopes_up_to(x, y, mid) >= k else (mid, high)
        return high

    first = ranked((pairs + 1) // 2)
    return first if pairs % 2 else (first + ranked(pairs // 2 + 1)) / 2


def theil_sen(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, slope, intercept, n): the median slope of all pairs of a series, and the median of y - slope x.

    No list of pairs is made: the pairs below a slope are counted as inversions, n log n a count. A series (16 bytes a row) is one
    task's. Rows with null or non-finite numbers don't count; the slope is null without two different x.
    """
    kept = df.where(is_finite(F.col(x).cast("double")) & is_finite(F.col(y).cast("double"))).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    schema = StructType([*df.select(*by).schema.fields, StructField("slope", DoubleType()), StructField("intercept", DoubleType()), StructField("n", LongType())])

    def fit(t: pa.Table) -> pa.Table:
        px, py = t.column("_x").to_numpy(), t.column("_y").to_numpy()
        slope = _middle_slope(px, py)
        known = np.isfinite(slope)
        cut = float(np.median(py - slope * px)) if known else None
        return pa.table({**{c: t.column(c).slice(0, 1) for c in by}, "slope": pa.array([slope if known else None], pa.float64()), "intercept": pa.array([cut], pa.float64()), "n": pa.array([len(px)], pa.int64())})

    return kept.groupBy(*by).applyInArrow(fit, schema)
