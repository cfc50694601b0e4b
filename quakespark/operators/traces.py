"""Fault traces as ordered vertices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..functions.safe import ratio


def reversed_trace(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Vertices numbered from the other end."""
    return df.withColumn(order, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) - 1)


def oriented(df: DataFrame, by: Sequence[str], order: str, x: str, start: str = "low") -> DataFrame:
    """Vertices numbered from the end with the lower (or higher) coordinate ``x``; nothing changes if both ends are equal."""
    whole = Window.partitionBy(*by)
    first, last = F.min_by(x, order).over(whole), F.max_by(x, order).over(whole)
    turn = first > last if start == "low" else first < last
    rows = df.withColumn("turn", F.coalesce(turn, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(F.col("turn"), -F.col(order)).otherwise(F.col(order)))) - 1
    return rows.withColumn(order, place).drop("turn")


def crossings(df: DataFrame, by: Sequence[str], order: str, x: str, y: str, value: float, tolerance: float = 1e-9) -> DataFrame:
    """(by, x, y): where traces cross a constant ``x``; a vertex on it counts once."""
    run = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumns({"x2": F.lead(x).over(run), "y2": F.lead(y).over(run)})
    on = F.abs(F.col(x) - value) <= tolerance
    beside = (F.col(x) - value) * (F.col("x2") - value) < 0
    share = ratio(value - F.col(x), F.col("x2") - F.col(x))
    after = F.abs(F.col("x2") - value) <= tolerance
    return rows.where(on | (beside & ~after)).select(*by, F.lit(float(value)).alias("x"), F.when(on, F.col(y)).otherwise(F.col(y) + share * (F.col("y2") - F.col(y))).alias("y"))


def polynomial_smooth(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], window: int = 5, degree: int = 2) -> DataFrame:
    """Each vertex from the polynomial that fits the odd ``window`` around it; vertices nearer to an end stay as they are."""
    half = window // 2
    weights = np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))[0]
    run = Window.partitionBy(*by).orderBy(order)
    count = F.count("*").over(run.rowsBetween(-half, half))

    def smooth(c: str) -> Column:
        total = sum((float(w) * (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(run) for k, w in zip(range(-half, half + 1), weights, strict=True)), F.lit(0.0))
        return F.when(count == 2 * half + 1, total).otherwise(F.col(c))

    return df.withColumns({c: smooth(c) for c in columns})


def simplified(df: DataFrame, by: Sequence[str], order: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Vertices that stay when those within ``tolerance`` of the chord between kept ones go, farthest first. One trace is one group."""

    def keep(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        px, py = t.column(x).to_numpy().astype(float), t.column(y).to_numpy().astype(float)
        stay, spans = {0, len(px) - 1}, [(0, len(px) - 1)]
        while spans:
            a, b = spans.pop()
            if b - a < 2:
                continue
            dx, dy = px[b] - px[a], py[b] - py[a]
            size = np.hypot(dx, dy)
            ox, oy = px[a + 1 : b] - px[a], py[a + 1 : b] - py[a]
            far = np.abs(dx * oy - dy * ox) / size if size else np.hypot(ox, oy)
            k = int(far.argmax())
            if far[k] > tolerance:
                stay.add(a + 1 + k)
                spans += [(a, a + 1 + k), (a + 1 + k, b)]
        return t.take(pa.array(sorted(stay)))

    return df.groupBy(*by).applyInArrow(keep, df.schema)


def extended(df: DataFrame, by: Sequence[str], order: str, x: str, y: str, length: float) -> DataFrame:
    """End vertices moved outwards by ``length`` along the end segments."""
    run, back = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by).orderBy(F.desc(order))
    rows = df.withColumns({"_f": F.row_number().over(run), "_b": F.row_number().over(back), "_nx": F.lead(x).over(run), "_ny": F.lead(y).over(run), "_px": F.lag(x).over(run), "_py": F.lag(y).over(run)})

    def moved(c: str, n: str, p: str) -> Column:
        ahead, behind = F.hypot(F.col("_nx") - F.col(x), F.col("_ny") - F.col(y)), F.hypot(F.col("_px") - F.col(x), F.col("_py") - F.col(y))
        return F.when((F.col("_f") == 1) & (ahead > 0), F.col(c) + (F.col(c) - F.col(n)) / ahead * length).when((F.col("_b") == 1) & (behind > 0), F.col(c) + (F.col(c) - F.col(p)) / behind * length).otherwise(F.col(c))

    return rows.withColumns({x: moved(x, "_nx", "_px"), y: moved(y, "_ny", "_py")}).drop("_f", "_b", "_nx", "_ny", "_px", "_py")


def trimmed(df: DataFrame, by: Sequence[str], arc: str, low: float, high: float) -> DataFrame:
    """Vertices whose distance along the trace (from ``ordered.arc_length``) lies within the bounds, ends included."""
    return df.where(F.col(arc).between(low, high))


def shallow_edge(patches: DataFrame, by: Sequence[str], depth: str, sort: str, within: float = 0.0) -> DataFrame:
    """A fault's trace: its patches at the least depth (or within ``within`` of it), numbered along ``sort``."""
    top = F.min(depth).over(Window.partitionBy(*by))
    rows = patches.withColumn("_top", top).where(F.col(depth) <= F.col("_top") + within).drop("_top")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(sort)) - 1)
