"""Series of epochs: empty ones, slip histories, dates that go; and clusters by centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .shared import checkpoint


def initialized(stations: DataFrame, start: str, end: str, days: int, columns: Sequence[str]) -> DataFrame:
    """Each station at each date from start to end, its values 0."""
    dates = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.make_dt_interval(F.lit(days))))
    return stations.withColumn("date", dates).withColumns({c: F.lit(0.0) for c in columns})


def without_dates(df: DataFrame, date: str, dates: Sequence) -> DataFrame:
    """Rows of other dates."""
    return df.where(~F.coalesce(F.col(date).isin(list(dates)), F.lit(False)))


def chosen(df: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is among ``ids``, or is not."""
    return df.join(ids.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def slip_at(events: DataFrame, patch: str, time: str, slip: str, when) -> DataFrame:
    """(patch, slip): what has slipped on each patch by a time."""
    return events.groupBy(patch).agg(F.coalesce(F.sum(F.when(F.col(time) <= when, F.col(slip))), F.lit(0.0)).alias(slip))


def predicted(events: DataFrame, greens: DataFrame, patch: str, time: str, slip: str, row: str = "row") -> DataFrame:
    """(row, time, predicted): displacement of each observation at the times of slip, added up over patches and time."""
    from pyspark.sql import Window

    steps = events.join(greens.withColumnRenamed("col", patch), patch).groupBy(row, time).agg(F.sum(F.col("value") * F.col(slip)).alias("step"))
    run = Window.partitionBy(row).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(row, time, F.sum("step").over(run).alias("predicted"))


def asperities(pairs: DataFrame, patches: DataFrame, face: str, high) -> DataFrame:
    """(face, asperity): the smallest face of each connected group of patches that meet the condition."""
    good = checkpoint(patches.where(high).select(F.col(face).alias("face")))
    inner = pairs.join(good, "face", "left_semi").join(good.withColumnRenamed("face", "neighbor"), "neighbor", "left_semi")
    label = graph.components(inner, "face", "neighbor").withColumnRenamed("node", "face")
    return good.join(label, "face", "left").select(F.col("face").alias(face), F.coalesce("component", "face").alias("asperity"))


def centered(df: DataFrame, columns: Sequence[str], centers: Sequence[Sequence[float]], rounds: int = 10) -> tuple[DataFrame, list[list[float]]]:
    """Clusters by nearest centre (the first of equals), the centres moved to their clusters' means ``rounds`` times or until they rest.

    A round is one aggregate; only the centres reach the driver. Empty clusters keep their centre.
    """
    now = [list(map(float, c)) for c in centers]

    def assigned() -> DataFrame:
        far = [sum((F.pow(F.col(c) - x, 2) for c, x in zip(columns, center, strict=True)), F.lit(0.0)) for center in now]
        return df.withColumn("cluster", F.array_position(F.array(*far), F.array_min(F.array(*far))).cast("int") - 1)

    for _ in range(rounds):
        means = {r[0]: list(r)[1:] for r in assigned().groupBy("cluster").agg(*(F.avg(c) for c in columns)).collect()}
        new = [means.get(k, center) for k, center in enumerate(now)]
        if new == now:
            break
        now = new
    return assigned(), now
