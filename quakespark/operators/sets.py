"""Unions, differences and de-duplication of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(*tables: DataFrame, tag: str | None = None) -> DataFrame:
    """UNION ALL by name; ``tag`` adds each row's table number."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn(tag, F.lit(k)) if tag else t
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def import_stations(own: DataFrame, other: DataFrame, station: str, prefer: str = "own") -> DataFrame:
    """Union of two networks; stations in both come from own or other, or from both with ``prefer='both'``."""
    if prefer == "both":
        return own.unionByName(other)
    if prefer == "other":
        return own.join(other.select(station), station, "left_anti").unionByName(other)
    return own.unionByName(other.join(own.select(station), station, "left_anti"))


def subtract_stations(own: DataFrame, other: DataFrame, station: str, *values: str) -> DataFrame:
    """Differences of the values of stations in both networks."""
    theirs = other.select(station, *(F.col(v).alias(f"_{v}") for v in values))
    return own.join(theirs, station).select(station, *((F.col(v) - F.col(f"_{v}")).alias(v) for v in values))


def all_dates(*tables: DataFrame, column: str) -> DataFrame:
    """The distinct dates of all tables."""
    return merge(*(t.select(column) for t in tables)).distinct()


def weld(df: DataFrame, x: str, y: str, tolerance: float) -> DataFrame:
    """Add ``vertex``: points in one tolerance cell share the cell's smallest point's key."""
    key = F.struct(F.round(F.col(x) / tolerance).cast("long").alias("i"), F.round(F.col(y) / tolerance).cast("long").alias("j"))
    return df.withColumn("vertex", F.concat_ws(":", key.i.cast("string"), key.j.cast("string")))


def add_parameters(df: DataFrame, same: dict[str, str], name: str = "parameter", row: str = "row", value: str = "value") -> DataFrame:
    """Columns of a design in (row, parameter, value) form that stand for one parameter are summed."""
    mapping = F.create_map(*(F.lit(x) for kv in same.items() for x in kv)) if same else None
    target = F.coalesce(mapping[F.col(name)], F.col(name)) if same else F.col(name)
    return df.groupBy(row, target.alias(name)).agg(F.sum(value).alias(value))
