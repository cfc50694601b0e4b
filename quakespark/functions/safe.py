"""Divisions that give null where the divisor is 0, so that one degenerate row doesn't stop a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column | float, b: Column | float) -> Column:
    """a / b, null where b is 0 or either is null."""
    one, two = (v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b))
    return F.try_divide(one, two)
