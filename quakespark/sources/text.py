"""Readers and writers of observation files, as text scans split into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import positive_longitude


def fields(spark: SparkSession, path: str, names: Sequence[str], text: Sequence[str] = (), separator: str = r"\s+", comment: str | None = "#") -> DataFrame:
    """Lines with at least as many fields as names; fields not in ``text`` are numbers, and lines where they aren't go."""
    line = F.trim(F.col("value"))
    rows = spark.read.text(path).where(line != "")
    if comment:
        rows = rows.where(~line.startswith(comment))
    parts = F.split(line, separator)
    rows = rows.select(parts.alias("p")).where(F.size("p") >= len(names))
    rows = rows.select(*((F.trim(F.get("p", F.lit(k))) if n in text else F.expr(f"try_cast(trim(p[{k}]) as double)")).alias(n) for k, n in enumerate(names)))
    return rows.dropna(subset=[n for n in names if n not in text])


def stations(spark: SparkSession, path: str, up: bool = True, factor: float = 1.0, least_error: float = 1.0) -> DataFrame:
    """Station velocities ``station lon lat e n [u] se sn [su]``; errors of 0 become ``least_error``, rows with NaN go."""
    names = ["station", "lon", "lat", "ve", "vn", "vu", "se", "sn", "su"] if up else ["station", "lon", "lat", "ve", "vn", "se", "sn"]
    rows = fields(spark, path, names, text=["station"])
    for c in names[1:]:
        rows = rows.where(~F.isnan(c))
    if not up:
        rows = rows.withColumns({"vu": F.lit(0.0), "su": F.lit(least_error)})
    scale = {c: F.col(c) * factor for c in ("ve", "vn", "vu")} | {c: F.when(F.col(c) == 0, least_error).otherwise(F.col(c)) * factor for c in ("se", "sn", "su")}
    return rows.withColumns(scale | {"lon": positive_longitude(F.col("lon"))})


def pixels(spark: SparkSession, path: str, factor: float = 1.0, step: float = 0.0) -> DataFrame:
    """Line-of-sight pixels ``lon lat value err e n u``: (value + step) * factor."""
    rows = fields(spark, path, ["lon", "lat", "value", "err", "los_e", "los_n", "los_u"])
    return rows.withColumns({"value": (F.col("value") + step) * factor, "err": F.col("err") * factor, "lon": positive_longitude(F.col("lon"))})


def catalog(spark: SparkSession, path: str, formats: Sequence[str] = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss"), separator: str = r"\s+") -> DataFrame:
    """Events ``lon lat depth mag time``; the first time format that fits counts."""
    rows = fields(spark, path, ["lon", "lat", "depth", "mag", "time"], text=["time"], separator=separator)
    return rows.withColumn("ts", F.coalesce(*(F.try_to_timestamp("time", F.lit(f)) for f in formats))).drop("time")


def pipe_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Events of ``|``-separated web-service text: time, latitude, longitude, depth, magnitude and place."""
    p = F.split("value", r"\|")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(p.alias("p")).where(F.size("p") >= 12)
    number = lambda k: F.expr(f"try_cast(trim(p[{k}]) as double)")
    return rows.select(F.try_to_timestamp(F.trim(F.get("p", F.lit(1)))).alias("ts"), number(2).alias("lat"), number(3).alias("lon"), number(4).alias("depth"), number(10).alias("mag"), F.trim(F.get("p", F.lit(12))).alias("place"))


def geojson_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Events of GeoJSON feature collections."""
    schema = "features array<struct<id: string, properties: struct<mag: double, time: bigint, place: string>, geometry: struct<coordinates: array<double>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = lambda k: F.get("f.geometry.coordinates", F.lit(k))
    return rows.select(F.col("f.id").alias("id"), F.timestamp_millis("f.properties.time").alias("ts"), at(0).alias("lon"), at(1).alias("lat"), at(2).alias("depth"), F.col("f.properties.mag").alias("mag"), F.col("f.properties.place").alias("place"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, segment, seq, header, x, y, z): multi-segment text whose segments begin with ``>``, each file read as one value."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?m)^>")).alias("segment", "block")).where("trim(block) <> '' and segment > 0")
    lines = files.select("file", "segment", F.trim(F.get(F.split("block", "\n"), F.lit(0))).alias("header"), F.posexplode(F.split("block", "\n")).alias("seq", "line")).where("seq > 0 and trim(line) <> ''")
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select("file", "segment", "seq", "header", *(F.get(parts, F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")))


def write_text(df: DataFrame, path: str, columns: Sequence[Column | str], separator: str = " ") -> None:
    """One line a row; parts are written by the tasks that hold them."""
    df.select(F.concat_ws(separator, *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns)).alias("value")).write.text(path)
