"""Stitched lines beside a walk, contours beside their segments, and samplers beside closed forms."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.operators import chains, sampling


def walk(segments):
    """Lines as {smallest segment: (closed, [(segment, reversed)])}, one after the other."""
    ends = defaultdict(list)
    for s, (a, b) in segments.items():
        ends[a].append((s, False))
        ends[b].append((s, True))
    left, out = set(segments), {}
    while left:
        s = min(left)
        line, seen = [(s, False)], {s}

        def onward(seg, back):
            node = segments[seg][0 if back else 1]
            if len(ends[node]) != 2:
                return None
            other = next(x for x in ends[node] if x[0] != seg)
            return other

        closed = False
        while (nxt := onward(*line[-1])) is not None:
            if nxt[0] in seen:
                closed = True
                break
            line.append(nxt)
            seen.add(nxt[0])
        if not closed:
            back = [(s, True)]
            while (nxt := onward(*back[-1])) is not None:
                back.append(nxt)
                seen.add(nxt[0])
            line = [(x, not r) for x, r in back[:0:-1]] + line
        out[s] = (closed, line)
        left -= seen
    return out


@pytest.mark.parametrize("seed", range(1))
def test_lines_and_loops(spark, seed):
    rng = random.Random(seed)
    segments, node, names = {}, 0, list(range(1000))
    rng.shuffle(names)
    for size, loop in [(1, False), (2, False), (40, False), (3, True), (33, True), (64, True), (5, False), (2, False)]:
        nodes = list(range(node, node + size + (not loop)))
        node += size + 1
        for i in range(size):
            pair = (nodes[i], nodes[(i + 1) % len(nodes)])
            segments[names.pop()] = pair if rng.random() < 0.5 else pair[::-1]
    for k in range(5):  # a star: lines end where more than two meet
        segments[names.pop()] = (5000, 5001 + k)
    want = walk(segments)
    rows = [(s, a, b, "x") for s, (a, b) in segments.items()] + [(2000, 7, 7, "x"), (2001, None, 3, "x"), (2002, *next(iter(segments.values()))[::-1], "x")]
    got = defaultdict(list)
    for r in chains.stitched(spark.createDataFrame(rows, "seg long, a long, b long, dart string").repartition(4), "seg", "a", "b").collect():
        got[r.line].append((r.pos, r.seg, r.reversed, r.a, r.b, r.closed, r.n))
    assert set(got) == set(want)
    for line, (closed, parts) in want.items():
        own = sorted(got[line])
        assert [x[0] for x in own] == list(range(len(parts))) and [x[1:3] for x in own] == parts
        assert all(x[5] == closed and x[6] == len(parts) for x in own) and all(x[4] == y[3] for x, y in zip(own, own[1:], strict=False))
    assert chains.stitched(spark.createDataFrame([], "seg long, a long, b long"), "seg", "a", "b").count() == 0


def test_contours_of_a_cone(spark):
    n = 12
    vertices = [(i * n + j, float(i), float(j), float(np.hypot(i - 5.5, j - 5.5))) for i in range(n) for j in range(n)]
    faces = [(2 * (i * n + j) + k, *c) for i in range(n - 1) for j in range(n - 1) for k, c in enumerate([(i * n + j, i * n + n + j, i * n + j + 1), (i * n + n + j, i * n + n + j + 1, i * n + j + 1)])]
    got = chains.contours(spark.createDataFrame(faces, "face long, a long, b long, c long"), spark.createDataFrame(vertices, "v long, x double, y double, z double"), [2.0, 4.0, 7.0]).collect()
    lines = defaultdict(list)
    for r in got:
        lines[r.depth, r.line].append((r.pos, r.x, r.y, r.closed))
    assert sorted(d for d, _ in lines) == [2.0, 4.0, 7.0, 7.0, 7.0, 7.0]
    for (depth, _), points in lines.items():
        points.sort()
        assert [p[0] for p in points] == list(range(len(points))) and points[0][3] == (depth < 7)
        steps = [np.hypot(p[1] - q[1], p[2] - q[2]) for p, q in zip(points, points[1:], strict=False)]
        assert max(steps) < 1.5 and all(abs(np.hypot(p[1] - 5.5, p[2] - 5.5) - depth) < 0.2 for p in points)


def gaussian(center, covariance):
    inverse = np.linalg.inv(covariance)
    return lambda m: -0.5 * np.einsum("ni,ij,nj->n", m - center, inverse, m - center)


def test_sampler_of_a_gaussian(spark):
    center, covariance = np.array([1.0, -2.0]), np.array([[0.2, 0.1], [0.1, 0.3]])
    samples, betas = sampling.sampled(spark, [-4, -6], [6, 4], gaussian(center, covariance), chains=1200, steps=10, seed=3)
    assert betas == sorted(betas) and betas[-1] == 1 and len(betas) > 2 and samples.count() == 1200
    assert samples.select("chain").distinct().count() == 1200
    mean, own = sampling.spread(samples.withColumn("weight", F.lit(1.0)), 2)
    assert np.abs(mean - center).max() < 0.08 and np.abs(own - covariance).max() < 0.08


def test_sampler_repeats_however_rows_are_dealt(spark):
    fit = gaussian(np.zeros(2), np.eye(2))
    start = sampling.drawn(spark, np.full(2, -3.0), np.full(2, 3.0), 50, fit, 7)
    one, two = (sorted(map(tuple, sampling.moved(start.repartition(k), 0.5, np.eye(2), np.full(2, -3.0), np.full(2, 3.0), fit, 5, 7, 1).select("chain", "fit", "accepted").collect())) for k in (1, 6))
    assert one == two


def test_next_beta(spark):
    rng = np.random.default_rng(0)
    fit = -rng.exponential(50, 500)
    rows = spark.createDataFrame([(float(f),) for f in fit] + [(float("nan"),), (None,)], "fit double")
    got = sampling.next_beta(rows, 0.01)
    w = np.append(np.exp((got - 0.01) * (fit - fit.max())), [0, 0])
    assert w.std() / w.mean() == pytest.approx(1.0, abs=1e-3)
    assert sampling.next_beta(rows.limit(0), 0.5) == 1 and sampling.next_beta(spark.createDataFrame([(1.0,)] * 5, "fit double"), 0.2) == 1


def test_query_of_a_line_by_sampling(spark, sf):
    from quakespark.plans import lines

    rows = np.array([(1.0, r.b, r.d) for r in spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 50 / 10).alias("b"), (F.col("o_totalprice") / 100000).alias("d")).collect()])
    g, variance = rows[:, :2].T @ rows[:, :2], max(1.0, len(rows) / 40)
    want, spread = np.linalg.solve(g, rows[:, :2].T @ rows[:, 2]), np.sqrt(np.diag(np.linalg.inv(g)) * variance)
    got = lines.smc_line(spark, sf).orderBy("col").collect()
    assert all(abs(r["mean"] - want[k]) < 0.35 * spread[k] and r["deviation"] == pytest.approx(spread[k], rel=0.25) for k, r in enumerate(got))
