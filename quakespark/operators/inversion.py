"""Linear inversion: Spark adds up products of rows in dense blocks, or passes over the rows with the parameters at hand.

Greens' functions are sparse rows (row, col, value); data are (row, d, weight[, part]). Two ways:

* Normal equations (``parts``, ``solve``, ``variance_components``): rows are shuffled once, each task multiplies blocks of them and
  hands on sums for pairs of parameters, so nothing is larger than parameters squared. For up to some thousands of parameters;
  the driver then solves the small system, with bounds, equalities and inequalities.
* Row passes (``iterated``): no product of parameters is ever made; each pass sends the parameters to the tasks and adds up
  one vector. For many parameters.

Loops raise ``NotSettled`` where they end without an answer. Rows without Green's functions add to the sums of data only, Green's
functions without data count for nothing, null values and weights are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

#: Cells of a dense block of rows.
CELLS = 4_000_000


class NotSettled(RuntimeError):
    """A solver ended without reaching its tolerance, or the constraints exclude each other."""


def products(greens: DataFrame, data: DataFrame) -> DataFrame:
    """(part, i, j, value): sums of G'WG, and of G'Wd where j is -1, for pairs of columns that share a row.

    Rows are shuffled once, whole ones to a task; each task multiplies dense blocks and sums them before the second shuffle.
    """
    rows = greens.select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")).dropna(subset=["col", "value"])
    given = data.select("row", F.col("part").cast("int").alias("part"), F.col("d").cast("double").alias("d"), F.col("weight").cast("double").alias("weight")).dropna()
    whole = rows.join(given, "row").withColumn("own", F.xxhash64("part", "row")).select("part", "own", "col", "value", "d", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[list[np.ndarray]] = []

        def add(part: np.ndarray, own: np.ndarray, col: np.ndarray, value: np.ndarray, d: np.ndarray, weight: np.ndarray) -> None:
            for p in np.unique(part):
                at = part == p
                known, code = np.unique(col[at], return_inverse=True)
                _, first, line = np.unique(own[at], return_index=True, return_inverse=True)
                for a in range(0, len(first), max(1, CELLS // len(known))):
                    use = (line >= a) & (line < a + max(1, CELLS // len(known)))
                    n = min(len(first) - a, max(1, CELLS // len(known)))
                    g, seen = np.zeros((n, len(known) + 1)), np.zeros((n, len(known) + 1))
                    np.add.at(g, (line[use] - a, code[use]), value[at][use])
                    seen[line[use] - a, code[use]] = 1
                    g[:, -1], seen[:, -1] = d[at][first[a : a + n]], 1
                    weighted = g[:, :-1] * weight[at][first[a : a + n], None]
                    together = seen[:, :-1].T @ seen > 0
                    i, j = np.nonzero(together)
                    keys = np.append(known, -1)
                    old = sums.get(int(p))
                    pair, v = np.stack([known[i], keys[j]], 1), (weighted.T @ g)[i, j]
                    if old is not None:
                        pair, v = np.concatenate([old[0], pair]), np.concatenate([old[1], v])
                    pair, where = np.unique(pair, axis=0, return_inverse=True)
                    sums[int(p)] = pair, np.bincount(where.ravel(), v, len(pair))

        def flush(last: bool) -> None:
            if not held:
                return
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            cut = len(columns[0])
            if not last:  # the last row may go on in the next batch
                cut = int(np.flatnonzero((columns[1] != columns[1][-1]) | (columns[0] != columns[0][-1]))[-1]) + 1 if len(np.unique(columns[1])) > 1 else 0
                held.append([c[cut:] for c in columns])
            if cut:
                add(*(c[:cut] for c in columns))

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(6)])
            if sum(len(h[0]) for h in held) > CELLS // 16:
                flush(False)
        flush(True)
        for p, (pair, v) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(v)], ["part", "i", "j", "value"])

    dealt = whole.repartition("part", "own").sortWithinPartitions("part", "own")
    return dealt.mapInArrow(run, "part int, i long, j long, value double").groupBy("part", "i", "j").agg(F.sum("value").alias("value"))


def parts(greens: DataFrame, data: DataFrame, parameters: int) -> dict[int, tuple[np.ndarray, np.ndarray, float, int]]:
    """For each ``part`` of the data: G'WG, G'Wd, d'Wd and the number of rows. What is gathered is parts x parameters squared."""
    good = data.dropna(subset=["part", "d", "weight"])
    out = {r.part: (np.zeros((parameters, parameters)), np.zeros(parameters), r.s or 0.0, r.n) for r in good.groupBy("part").agg(F.sum(F.col("d") * F.col("d") * F.col("weight")).alias("s"), F.count("*").alias("n")).collect()}
    for r in products(greens, good).collect():
        if r.j < 0:
            out[r.part][1][r.i] += r.value
        else:
            out[r.part][0][r.i, r.j] += r.value
    return out


def bounded(g: np.ndarray, d: np.ndarray, low: Sequence[float], high: Sequence[float]) -> np.ndarray:
    """The parameters within their bounds that make m'Gm / 2 - d'm least."""
    return constrained(g, d, low=low, high=high)


def constrained(
    g: np.ndarray, d: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None, equal: np.ndarray | None = None, to: np.ndarray | None = None,
    low: Sequence[float] | None = None, high: Sequence[float] | None = None, rounds: int = 200, close: float = 1e-9,
) -> np.ndarray:
    """The parameters that make m'Gm / 2 - d'm least, where a m <= b, equal m = to and low <= m <= high.

    A primal-dual interior-point method with Mehrotra's corrector; at its end the constraints that hold the answer are solved
    for as equalities, so the answer lies on them. Raises ``NotSettled`` if the constraints exclude each other.
    """
    n = len(d)
    rows, limits = [np.zeros((0, n)) if a is None else np.atleast_2d(np.asarray(a, float))], [np.zeros(0) if b is None else np.atleast_1d(np.asarray(b, float))]
    for sign, bound in ((-1, low), (1, high)):
        if bound is not None:
            finite = np.flatnonzero(np.isfinite(bound))
            rows.append(sign * np.eye(n)[finite])
            limits.append(sign * np.asarray(bound, float)[finite])
    c, limit = np.concatenate(rows), np.concatenate(limits)
    e, to = (np.zeros((0, n)), np.zeros(0)) if equal is None else (np.atleast_2d(np.asarray(equal, float)), np.atleast_1d(np.asarray(to, float)))
    # all in one scale: parameters by their own curvature, rows of constraints by their length
    size = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    h, f = g / np.outer(size, size), d / size
    c, e = c / size, e / size
    long_c, long_e = (np.maximum(np.linalg.norm(x, axis=1), 1e-300) for x in (c, e))
    c, limit, e, to = c / long_c[:, None], limit / long_c, e / long_e[:, None], to / long_e

    def solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(matrix, right, rcond=None)[0]

    def within(m: np.ndarray) -> np.ndarray:
        """On its bounds, where rounding leaves it a trace outside."""
        for bound, none, inner in ((low, -np.inf, np.maximum), (high, np.inf, np.minimum)):
            if bound is not None:
                m = inner(m, np.where(np.isfinite(bound), bound, none))
        return m

    def held(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([e, c[which]])
        matrix = np.block([[h, both.T], [both, np.zeros((len(both), len(both)))]])
        out = solved(matrix, np.concatenate([f, to, limit[which]]))
        return out[:n], out[n + len(e) :]

    m, k = held(np.zeros(len(c), bool))[0], len(c)
    if len(e) and np.abs(e @ m - to).max() > 1e-7 * (1 + np.abs(to).max()):
        raise NotSettled("the equalities exclude each other")
    if not k or (c @ m - limit).max() <= 1e-12 * (1 + np.abs(limit).max()):
        return within(m / size)
    scale = 1 + max(np.abs(f).max(initial=0), np.abs(limit).max(initial=0), np.abs(to).max(initial=0))
    s, y, z = np.maximum(limit - c @ m, 1.0), np.ones(k), np.zeros(len(e))
    for _ in range(rounds):
        dual, primal, even = h @ m - f + c.T @ y + e.T @ z, c @ m + s - limit, e @ m - to
        gap = s @ y / k
        if max(np.abs(dual).max(), np.abs(primal).max(), np.abs(even).max(initial=0), gap) <= close * scale:
            break
        if s.min() < 1e-200 or y.max() > 1e30:
            break  # running off: nothing meets the constraints
        # a trace of damping, so that directions that nothing decides don't stop the step
        left = np.block([[h + 1e-13 * np.eye(n) + c.T @ ((y / s)[:, None] * c), e.T], [e, -1e-13 * np.eye(len(e))]])

        def step(product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            right = -dual + c.T @ ((product - y * primal) / s)  # noqa: B023
            out = np.linalg.solve(left, np.concatenate([right, -even]))  # noqa: B023
            dm, dz = out[:n], out[n:]
            ds = -primal - c @ dm  # noqa: B023
            return dm, dz, ds, -(product + y * ds) / s  # noqa: B023

        far = lambda v, dv: min(1.0, float(np.min(np.where(dv < 0, -v / np.where(dv < 0, dv, -1), np.inf), initial=np.inf)))
        _, _, ds, dy = step(s * y)
        ahead = (s + far(s, ds) * ds) @ (y + far(y, dy) * dy) / k
        dm, dz, ds, dy = step(s * y + ds * dy - (ahead / gap) ** 3 * gap)
        far_on = 0.995 * min(far(s, ds), far(y, dy))
        if far_on < 1e-12:
            break
        m, s, y, z = m + far_on * dm, s + far_on * ds, y + far_on * dy, z + far_on * dz
    off = max((c @ m - limit).max(), np.abs(e @ m - to).max(initial=0))
    if not np.isfinite(off) or off > 1e-6 * scale:
        raise NotSettled("no parameters meet the constraints")
    if np.abs(h @ m - f + c.T @ y + e.T @ z).max() > 1e-6 * scale or s @ y / k > 1e-6 * scale:
        raise NotSettled(f"the constrained solution didn't settle in {rounds} rounds")
    active = y > s
    for _ in range(k):  # drop constraints that pull the wrong way, take up those that are broken
        exact, pull = held(active)
        wrong, broken = np.flatnonzero(active)[pull < -1e-9 * scale], np.flatnonzero((c @ exact - limit > 1e-9 * scale) & ~active)
        if not len(wrong) and not len(broken):
            return within(exact / size if np.abs(exact - m).max() <= 1e-3 * scale else m / size)
        active[wrong], active[broken] = False, True
    return within(m / size)


def solve(
    greens: DataFrame, data: DataFrame, parameters: int, prior: np.ndarray | None = None, prior_weight: np.ndarray | None = None, low: Sequence[float] | None = None, high: Sequence[float] | None = None,
    smoothing: np.ndarray | None = None, a: np.ndarray | None = None, b: np.ndarray | None = None, equal: np.ndarray | None = None, to: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and their covariance (without constraints): weighted data, a prior with a weight matrix, rows of smoothing, and constraints."""
    sums = parts(greens, data.withColumn("part", F.lit(0)), parameters)
    g, d = sum((x[0] for x in sums.values()), np.zeros((parameters, parameters))), sum((x[1] for x in sums.values()), np.zeros(parameters))
    if prior_weight is not None:
        g = g + prior_weight
        d = d + prior_weight @ (np.zeros(parameters) if prior is None else prior)
    if smoothing is not None:
        g = g + smoothing.T @ smoothing
    covariance = np.linalg.pinv(g)
    if all(x is None for x in (low, high, a, equal)):
        return np.linalg.lstsq(g, d, rcond=None)[0], covariance
    return constrained(g, d, a, b, equal, to, low, high), covariance


def rake_limits(low: Sequence[float], high: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``a m <= 0`` that keep each patch's rake (degrees) between two angles less than 180 apart, for columns 2k of strike and 2k + 1 of dip slip."""
    n = len(low)
    rows = np.zeros((2 * n, 2 * n))
    for k, (one, two) in enumerate(zip(np.radians(low), np.radians(high), strict=True)):
        rows[2 * k, 2 * k : 2 * k + 2] = np.sin(one), -np.cos(one)
        rows[2 * k + 1, 2 * k : 2 * k + 2] = -np.sin(two), np.cos(two)
    return rows, np.zeros(2 * n)


def variance_components(
    greens: DataFrame, data: DataFrame, parameters: int, smoothing: np.ndarray | None = None, rounds: int = 200, close: float = 1e-8, rigorous: bool = False,
) -> tuple[np.ndarray, dict[int, float]]:
    """Parameters, and the variance of each part of the data (and of the smoothing, as part -1) that its own residuals give back.

    Simple: each round solves with the parts' weights, then takes a part's squared residuals over its redundancy as its variance.
    Rigorous: Helmert's equations between all parts; a part whose equation gives none above 0 takes the simple step that round.
    """
    sums = parts(greens, data, parameters)
    if smoothing is not None:
        sums[-1] = (smoothing.T @ smoothing, np.zeros(parameters), 0.0, len(smoothing))
    return components_of_variance(sums, rounds, close, rigorous)


def components_of_variance(sums: dict[int, tuple[np.ndarray, np.ndarray, float, int]], rounds: int = 200, close: float = 1e-8, rigorous: bool = False) -> tuple[np.ndarray, dict[int, float]]:
    """The same from the parts' sums of products."""
    keys = list(sums)
    variance = dict.fromkeys(keys, 1.0)
    if not keys:
        return np.zeros(0), variance
    m = np.zeros(len(sums[keys[0]][1]))
    for _ in range(rounds):
        weighted = [sums[k][0] / variance[k] for k in keys]
        g = sum(weighted)
        m = np.linalg.lstsq(g, sum(sums[k][1] / variance[k] for k in keys), rcond=None)[0]
        shares = [np.linalg.pinv(g) @ w for w in weighted]
        left = np.array([max(sums[k][2] - 2 * m @ sums[k][1] + m @ sums[k][0] @ m, 0.0) / variance[k] for k in keys])
        n = np.array([sums[k][3] for k in keys], float)
        free = n - [np.trace(s) for s in shares]
        factor = left / np.maximum(free, 1e-9)
        if rigorous:
            helmert = np.array([[np.sum(s * t.T) for t in shares] for s in shares])
            full = np.linalg.lstsq(helmert + np.diag(n - 2 * np.array([np.trace(s) for s in shares])), left, rcond=None)[0]
            factor = np.where(full > 0, full, factor)
        factor = np.where(factor > 0, factor, 1e-12)
        variance = {k: max(variance[k] * f, 1e-300) for k, f in zip(keys, factor, strict=True)}
        if (np.abs(factor - 1) <= close).all() or all(variance[k] < 1e-20 * max(1.0, sums[k][2]) for k in keys):
            return m, variance
    raise NotSettled(f"variance components didn't settle in {rounds} rounds")


def iterated(greens: DataFrame, data: DataFrame, parameters: int, damping: float = 0.0, nonnegative: bool = False, rounds: int = 2000, close: float = 1e-10) -> np.ndarray:
    """Least squares by passes over the rows: conjugate gradients, or accelerated projected gradients for parameters of 0 or more.

    Rows are packed once and stored; a pass sends the parameters to the tasks, each adds up its rows' part of G'W(Gm - d) and
    only sums for one vector are shuffled, so nothing as large as parameters squared is ever made.
    """
    rows = greens.join(data.select("row", "d", "weight").dropna(), "row").dropna(subset=["col", "value"])
    packed = checkpoint(rows.groupBy("row").agg(F.collect_list(F.struct(F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))).alias("g"), F.first("d").cast("double").alias("d"), F.first("weight").cast("double").alias("w")).select(F.col("g.col").alias("col"), F.col("g.value").alias("value"), "d", "w"))
    spark = packed.sparkSession

    def passed(vector: np.ndarray | None, squares: bool = False) -> np.ndarray:
        """G'WG vector, or G'Wd without one, or the sums of weighted squares of each column."""
        sent = spark.sparkContext.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            for b in batches:
                col, value = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
                line = np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy())
                d, w = b.column(2).to_numpy(), b.column(3).to_numpy()
                if squares:
                    side = w[line] * value * value
                else:
                    along = d if sent.value is None else np.bincount(line, value * sent.value[col], b.num_rows)
                    side = (w * along)[line] * value
                total = (0 if total is None else total) + np.bincount(col, side, parameters)
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["col", "v"])

        got = packed.mapInArrow(run, "col long, v double").groupBy("col").agg(F.sum("v").alias("v")).toArrow()
        sent.unpersist()
        out = np.zeros(parameters)
        out[got.column("col").to_numpy()] = got.column("v").to_numpy()
        return out

    side, size = passed(None), np.sqrt(passed(None, squares=True) + damping)
    size = np.where(size > 0, size, 1.0)
    curved = lambda v: (passed(v / size) + damping * v / size) / size
    side, m = side / size, np.zeros(parameters)
    least = close * max(np.linalg.norm(side), 1e-300)
    if not nonnegative:
        left, way = side.copy(), side.copy()
        for _ in range(rounds):
            if np.linalg.norm(left) <= least:
                return m / size
            bent = curved(way)
            if way @ bent <= 0:
                break
            step = left @ left / (way @ bent)
            m, old = m + step * way, left
            left = left - step * bent
            way = left + left @ left / (old @ old) * way
        if np.linalg.norm(left) <= 1e3 * least:
            return m / size
        raise NotSettled(f"conjugate gradients didn't settle in {rounds} passes")
    top, v = 1.0, np.ones(parameters) / np.sqrt(max(1, parameters))
    for _ in range(30):
        v = curved(v)
        top = np.linalg.norm(v)
        if top == 0:
            return m
        v = v / top
    top, ahead, speed = 1.05 * top, m.copy(), 1.0
    for _ in range(rounds):
        slope = curved(ahead) - side
        new = np.maximum(ahead - slope / top, 0.0)
        if np.linalg.norm(new - ahead) * top <= least:
            return new / size
        if (ahead - new) @ (new - m) > 0:  # the momentum leads uphill: start it anew
            speed, ahead, m = 1.0, new.copy(), new
            continue
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, m, speed = new + (speed - 1) / faster * (new - m), new, faster
    raise NotSettled(f"projected gradients didn't settle in {rounds} passes")


def checkerboard(columns: int, rows: int, size: int, high: float, low: float = 0.0) -> np.ndarray:
    """Slips of a grid of patches, row by row, that alternate in squares of ``size`` patches."""
    i, j = np.divmod(np.arange(columns * rows), columns)
    return np.where((i // size + j // size) % 2 == 0, high, low)
