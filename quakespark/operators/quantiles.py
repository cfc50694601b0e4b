"""Exact percentiles of a whole table, found by narrowing bins, so that no task or driver gathers all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of one round, and values of an interval that are listed at most.
BINS, MOST = 4096, 4096


def _around(v: DataFrame, rank: int, low: float, high: float, inside: int) -> tuple[float, float | None]:
    """The value of a rank, and the next one if it is at hand."""
    below = 0
    while low < high and inside > MOST:
        place = F.least(F.floor((F.col("v") / 2 - low / 2) / ((high / 2 - low / 2) / BINS)), F.lit(BINS - 1))
        bins = v.where(F.col("v").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for b in sorted(bins, key=lambda b: b.bin):
            if rank < below + b.n:
                low, high, inside = b.low, b.high, b.n
                break
            below += b.n
    if low == high:
        return low, low if rank + 1 < below + inside else None
    counts = v.where(F.col("v").between(low, high)).groupBy("v").count().collect()
    found = None
    for value, n in sorted(map(tuple, counts)):
        if found is not None:
            return found, value
        below += n
        if rank < below:
            found = value
            if rank + 1 < below:
                return found, value
    return found, None


def quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Percentiles of the non-null values, linear between neighbours; None for an empty table.

    A round counts values in bins between the bounds and goes on in the bin that holds the wanted rank, until few
    values or equal ones are left. NaN must be taken out before.
    """
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    out = []
    for share in shares:
        place = share * (n - 1)
        rank = min(int(place), n - 1)
        own, after = _around(v, rank, low, high, n)
        if place > rank:
            if after is None:
                after = v.where(F.col("v") > own).agg(F.min("v")).first()[0]
            own += (place - rank) * (after - own)
        out.append(own)
    return out
