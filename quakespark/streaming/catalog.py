"""Running catalog statistics over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seismo import moment


def windowed_moment(events: DataFrame, time: str, mag: str, width: str = "1 day", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Events, summed moment and largest magnitude of each tumbling window; the same on a batch table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(moment(F.col(mag))).alias("moment"), F.max(mag).alias("largest")).select(F.col("window.start").alias("start"), *by, "n", "moment", "largest")
