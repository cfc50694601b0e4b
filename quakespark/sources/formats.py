"""Text formats of observation files: each is a layout, a map from column to its place among the line's fields (from 0).

Readers are text scans split into columns; lines whose numbers aren't numbers (headers), whose date doesn't exist or that have
too few fields go; a tensor's time that doesn't exist is null. ``rejected`` gives the lines that a layout leaves out.
Writers make one line a row in the tasks that hold the rows.
"""

from __future__ import annotations

import functools
import io
import itertools
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import positive_longitude
from .grids import _store
from .text import segments

_TIME = ("year", "month", "day", "hour", "minute", "second")
# Places of the fields in each format.
CATALOGS: dict[str, dict[str, int]] = {
    "lat_first": {**{c: k for k, c in enumerate(_TIME)}, "lat": 6, "lon": 7, "depth": 8, "mag": 9},
    "lon_first": {**{c: k for k, c in enumerate(_TIME)}, "lon": 6, "lat": 7, "depth": 8, "mag": 9},
    "network_headed": {**{c: k for k, c in enumerate(_TIME)}, "lat": 7, "lon": 8, "depth": 9, "mag": 10},
    "relocated": {"id": 0, "lat": 1, "lon": 2, "depth": 3, **{c: k + 10 for k, c in enumerate(_TIME)}, "mag": 16},
}
SERIES: dict[str, dict[str, int]] = {
    "values": {**{c: k for k, c in enumerate(_TIME)}, "value": 6, "error": 7},
    "daily_trailing_time": {"e": 1, "n": 2, "u": 3, "se": 4, "sn": 5, "su": 6, **{c: k + 11 for k, c in enumerate(_TIME)}},
}
TABLES: dict[str, dict[str, int]] = {
    "velocities_lon_first": {"lon": 0, "lat": 1, "ve": 2, "vn": 3, "se": 4, "sn": 5, "rho": 6, "station": 7},
    "velocities_up_lon_first": {"lon": 0, "lat": 1, "ve": 2, "vn": 3, "vu": 4, "se": 5, "sn": 6, "su": 7, "rho": 8, "station": 9},
    "station_list": {"station": 0, "lon": 1, "lat": 2},
    "benchmarks": {"station": 0, "lon": 1, "lat": 2, "velocity": 3, "error": 4},
    "creep_days": {"year": 0, "day": 1, "offset": 2},
    "layers": {"depth": 0, "vp": 1, "vs": 2, "density": 3},
    "decimated": {"number": 0, "lon": 3, "lat": 4, "value": 5, "error": 6, "los_e": 8, "los_n": 9, "los_u": 10},
    "offsets": {"number": 0, "lon": 3, "lat": 4, "east": 5, "north": 6, "error_east": 7, "error_north": 8},
    "cells": {"number": 0, **{f"{a}{k + 1}": 10 + 2 * k + j for k in range(4) for j, a in enumerate("xy")}},
    "triangles": {"number": 0, **{f"{a}{k + 1}": 2 + 2 * k + j for k in range(3) for j, a in enumerate("xy")}},
    "xyz": {"lon": 0, "lat": 1, "value": 2},
    "network_solution": {"station": 0, "lat": 7, "lon": 8, "vn": 19, "ve": 20, "vu": 21, "sn": 22, "se": 23, "su": 24},
    "solution_velocities": {"station": 0, "vn": 7, "ve": 8, "vu": 9, "sn": 10, "se": 11, "su": 12},
    "solution_places": {"station": 0, "lat": 8, "lon": 9},
    "by_axis": {"velocity": 1, "error": 2, "east": 3, "north": 4, "up": 5, "station": 9, "lon": 10, "lat": 11},
    "cross_fault_pairs": {"station": 0, "lon1": 1, "lat1": 2, "lon2": 3, "lat2": 4, "strike": 5, "parallel": 6},
    "cross_fault_points": {"station": 0, "lon": 1, "lat": 2, "width": 3, "strike": 4, "parallel": 5},
    "cross_fault_uneven": {"station": 0, "lon": 1, "lat": 2, "width1": 3, "width2": 4, "strike": 5, "parallel": 6},
}
_WORDS = frozenset({"station", "id"})
# Spark's name for the partition of nulls, and what it escapes in partitions' names.
NO_STATION = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_LINES = "part-0.txt"
_STATIONS = "station string, lines long"


def table(spark: SparkSession, path: str, layout: Mapping[str, int], separator: str = r"\s+", comment: str | None = "#") -> DataFrame:
    """The layout's columns of each line: stations and ids are text, all others numbers."""
    return _fields(spark, path, layout, separator, comment).where("_complete").select(*layout)


def rejected(spark: SparkSession, path: str, layout: Mapping[str, int], separator: str = r"\s+", comment: str | None = "#") -> DataFrame:
    """(value): the lines that ``table`` leaves out, without blank lines and comments."""
    return _fields(spark, path, layout, separator, comment).where("not _complete").select(F.col("_line").alias("value"))


def _fields(spark: SparkSession, path: str, layout: Mapping[str, int], separator: str, comment: str | None) -> DataFrame:
    line = F.trim(F.col("value"))
    rows = spark.read.text(path).where(line != "")
    if comment:
        rows = rows.where(~line.startswith(comment))
    rows = rows.withColumn("p", F.split(line, separator))
    number = lambda k: F.expr(f"try_cast(trim(get(p, {k})) as double)")
    rows = rows.select(F.col("value").alias("_line"), (F.size("p") > max(layout.values())).alias("_long"), *((F.trim(F.get("p", F.lit(k))) if c in _WORDS else number(k)).alias(c) for c, k in layout.items()))
    given = [F.nanvl(c, F.lit(None).cast("double")).isNotNull() for c in layout if c not in _WORDS]
    return rows.withColumn("_complete", functools.reduce(lambda a, b: a & b, given, F.col("_long")))


def _timed(rows: DataFrame) -> DataFrame:
    whole = [F.col(c).try_cast("int") for c in _TIME[:-1]]
    return rows.withColumn("ts", F.try_make_timestamp(*whole, F.floor("second").try_cast("int").try_cast("decimal(8,6)"))).drop(*_TIME).where("ts is not null")


def catalog(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Events of a catalog with time in six fields; seconds are cut to whole ones."""
    return _timed(table(spark, path, CATALOGS[layout]))


def degree_minute_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Events ``id year month day hour minute second latN min lonE min depth mag``: degrees end in a hemisphere, S and W are negative."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 13)
    number = lambda k: F.expr(f"try_cast(p[{k}] as double)")

    def degrees(k: int, negative: str) -> Column:
        whole = F.expr(f"try_cast(substring(p[{k}], 1, length(p[{k}]) - 1) as double)") + number(k + 1) / 60
        return F.when(F.upper(F.expr(f"right(p[{k}], 1)")) == negative, -whole).otherwise(whole)

    rows = rows.select(*(number(k + 1).alias(c) for k, c in enumerate(_TIME)), degrees(7, "S").alias("lat"), degrees(9, "W").alias("lon"), number(11).alias("depth"), number(12).alias("mag"))
    return _timed(rows.dropna())


def series(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Time series with time in six fields."""
    return _timed(table(spark, path, SERIES[layout]))


def station_list(spark: SparkSession, path: str) -> DataFrame:
    """Stations with velocities of zero."""
    return table(spark, path, TABLES["station_list"]).withColumns({c: F.lit(0.0) for c in ("ve", "vn", "vu")})


def velocities(spark: SparkSession, path: str, up: bool = False, factor: float = 1.0) -> DataFrame:
    """Velocities with position first and station last; without ``up`` the vertical is null."""
    rows = table(spark, path, TABLES["velocities_up_lon_first" if up else "velocities_lon_first"])
    rows = rows.withColumns({c: F.col(c) * factor for c in ("ve", "vn", "se", "sn") + (("vu", "su") if up else ())})
    return rows if up else rows.withColumns({"vu": F.lit(None).cast("double"), "su": F.lit(None).cast("double")})


def network_solution(spark: SparkSession, path: str, factor: float = 1.0, least_error: float = 1.0) -> DataFrame:
    """Station velocities of a network's solution file; errors of 0 become ``least_error``."""
    return _velocities(table(spark, path, TABLES["network_solution"]), factor, least_error)


def paired_solution(spark: SparkSession, velocities: str, places: str, factor: float = 1.0, least_error: float = 1.0) -> DataFrame:
    """Station velocities from a file of velocities and one of coordinates; stations that aren't in both go."""
    rows = table(spark, velocities, TABLES["solution_velocities"]).join(table(spark, places, TABLES["solution_places"]), "station")
    return _velocities(rows, factor, least_error)


def by_axis(spark: SparkSession, path: str, factor: float = 1.0) -> DataFrame:
    """Station velocities from one line for each direction, marked by a 1 for east, north or up; directions without a line are 0."""
    rows = table(spark, path, TABLES["by_axis"])
    along = lambda value, axis: F.coalesce(F.max(F.when(F.col(axis) == 1, F.col(value))), F.lit(0.0)) * factor
    sums = [along(value, axis).alias(f"{c}{axis[0]}") for c, value in (("v", "velocity"), ("s", "error")) for axis in ("east", "north", "up")]
    out = rows.groupBy("station").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"), *sums)
    return out.withColumn("lon", positive_longitude(F.col("lon")))


def _velocities(rows: DataFrame, factor: float, least_error: float) -> DataFrame:
    scaled = {c: F.col(c) * factor for c in ("ve", "vn", "vu")} | {c: F.when(F.col(c) == 0, least_error).otherwise(F.col(c)) * factor for c in ("se", "sn", "su")}
    return rows.withColumns(scaled | {"lon": positive_longitude(F.col("lon"))})


def cross_fault(spark: SparkSession, path: str, layout: str = "pairs") -> DataFrame:
    """Offsets across a fault (station, lon1, lat1, lon2, lat2, strike, parallel, parallel_error, across, across_error, up, up_error).

    ``layout`` is pairs (two points), points (a point on the fault and the width around it) or uneven (a width on either side).
    Places in degrees; widths in km. What a line doesn't have is null.
    """
    fields = TABLES[f"cross_fault_{layout}"]
    most = max(fields.values())
    more = {c: most + 1 + k for k, c in enumerate(("parallel_error", "across", "across_error", "up", "up_error"))}
    line = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.expr(f"try_cast(get(p, {k}) as double)")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#")).select(line.alias("p")).where(F.size("p") > most)
    rows = rows.select(F.get("p", F.lit(0)).alias("station"), *(number(k).alias(c) for c, k in {**fields, **more}.items() if c != "station")).dropna(subset=[c for c in fields if c != "station"])
    if layout != "pairs":
        a, b = ("width1", "width2") if layout == "uneven" else ("width", "width")
        s, half = F.radians("strike"), 1.0 if layout == "uneven" else 0.5
        east, north = F.cos(s) / (111.0 * F.cos(F.radians("lat"))), -F.sin(s) / 111.0
        for n, width, side in (("1", a, 1), ("2", b, -1)):
            rows = rows.withColumns({f"lon{n}": F.col("lon") + side * half * F.col(width) * east, f"lat{n}": F.col("lat") + side * half * F.col(width) * north})
    return rows.select("station", "lon1", "lat1", "lon2", "lat2", "strike", "parallel", *more)


def creep(spark: SparkSession, path: str) -> DataFrame:
    """(station, date, offset): one file a station, named after it; the day is added to the 1st of January."""
    station = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/.]*)?$", 1)
    rows = spark.read.text(path).select(station.alias("station"), *(F.expr(f"try_cast(get(split(trim(value), '\\\\s+'), {k}) as double)").alias(c) for c, k in TABLES["creep_days"].items())).dropna()
    return rows.select("station", F.date_add(F.to_date(F.try_make_timestamp(F.col("year").try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))), F.col("day").try_cast("int")).alias("date"), "offset")


def decimated(spark: SparkSession, values: str, cells: str, factor: float = 1.0, step: float = 0.0, triangular: bool = False) -> DataFrame:
    """Decimated pixels with the corners of their cells: two files joined by the cells' numbers; (value + step) * factor."""
    rows = table(spark, values, TABLES["decimated"])
    rows = rows.withColumns({"value": (F.col("value") + step) * factor, "error": F.col("error") * factor, "lon": positive_longitude(F.col("lon"))})
    return rows.join(_corners(spark, cells, triangular), "number")


def decimated_offsets(spark: SparkSession, values: str, cells: str, factor: float = 1.0, triangular: bool = False) -> DataFrame:
    """The same for offsets east and north."""
    rows = table(spark, values, TABLES["offsets"])
    rows = rows.withColumns({c: F.col(c) * factor for c in ("east", "north", "error_east", "error_north")})
    return rows.join(_corners(spark, cells, triangular), "number")


def _corners(spark: SparkSession, path: str, triangular: bool) -> DataFrame:
    sides = 3 if triangular else 4
    corner = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    return table(spark, path, TABLES["triangles" if triangular else "cells"]).select("number", F.array(*(corner(k + 1) for k in range(sides))).alias("corners"))


def moment_tensors(spark: SparkSession, path: str) -> DataFrame:
    """Moment-tensor solutions: a line that begins with P and the origin time, then twelve ``name: value`` lines each."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^\s*(?=P[A-Z]{3}\s*[0-9]{4}\s)")).alias("b")).where(F.trim("b").startswith("P"))
    value = lambda name: F.expr(f"try_cast(regexp_extract(b, '(?m)^{name}:\\\\s*(\\\\S+)', 1) as double)").alias(name.lower().replace(" ", "_"))
    head = lambda k: F.regexp_extract("b", r"^\s*P[A-Z]{3}\s*([0-9]{4})\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([0-9]+)", k).try_cast("int")
    ts = F.try_make_timestamp(head(1), head(2), head(3), head(4), head(5), head(6).try_cast("decimal(8,6)"))
    return blocks.select(F.regexp_extract("b", r"(?m)^event name:\s*(\S+)", 1).alias("event"), ts.alias("ts"), *map(value, ("latitude", "longitude", "depth", "Mrr", "Mtt", "Mpp", "Mrt", "Mrp", "Mtp")))


def kml_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(place, seq, lon, lat, height): the coordinates of each ``coordinates`` element."""
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<coordinates>(.*?)</coordinates>"), F.lit(1))).alias("place", "c"))
    each = each.select("place", F.posexplode(F.split(F.trim("c"), r"\s+")).alias("seq", "p"))
    at = lambda k: F.expr(f"try_cast(get(split(p, ','), {k}) as double)")
    return each.select("place", "seq", at(0).alias("lon"), at(1).alias("lat"), at(2).alias("height")).where("lon is not null and lat is not null")


def patches(spark: SparkSession, path: str) -> DataFrame:
    """(file, patch, header, corners): fault patches as multi-segment text, one segment a patch of three or four corners."""
    rows = segments(spark, path)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z")))
    return rows.groupBy("file", F.col("segment").alias("patch")).agg(F.first("header").alias("header"), F.transform(ordered, lambda c: F.struct(c.x.alias("x"), c.y.alias("y"), c.z.alias("z"))).alias("corners"))


def surface(spark: SparkSession, path: str) -> DataFrame:
    """(face, x1 .. z3): triangles of a surface in VRTX and TRGL lines, the corners looked up by number."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p"))
    number = lambda k: F.expr(f"try_cast(get(p, {k}) as double)")
    vertices = rows.where(F.get("p", F.lit(0)).isin("VRTX", "PVRTX")).select(number(1).cast("long").alias("v"), number(2).alias("x"), number(3).alias("y"), number(4).alias("z"))
    faces = rows.where(F.get("p", F.lit(0)) == "TRGL").select(*(number(k).cast("long").alias(f"v{k}") for k in (1, 2, 3)))
    faces = faces.withColumn("face", F.xxhash64("v1", "v2", "v3"))
    for k in (1, 2, 3):
        faces = faces.join(vertices.toDF(f"v{k}", f"x{k}", f"y{k}", f"z{k}"), f"v{k}")
    return faces


# Writers


def write(df: DataFrame, path: str, layout: Mapping[str, int], separator: str = " ", empty: str = "0") -> None:
    """One line a row with the layout's columns at their places; places that no column has hold ``empty``."""
    by_place = {k: c for c, k in layout.items()}
    fields = [F.coalesce(F.col(by_place[k]).cast("string"), F.lit("NaN")) if k in by_place else F.lit(empty) for k in range(max(by_place) + 1)]
    df.select(F.concat_ws(separator, *fields).alias("value")).write.text(path)


def timed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The six fields of a time, for ``write``."""
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.floor(F.second(ts)).cast("int")}
    return df.withColumns(parts)


def write_patches(df: DataFrame, path: str, corners: str, header: Column) -> None:
    """Fault patches as multi-segment text: a header line that begins with ``>``, then a line for each corner."""
    lines = F.transform(F.col(corners), lambda c: F.concat_ws(" ", c.x.cast("string"), c.y.cast("string"), c.z.cast("string")))
    df.select(F.concat_ws("\n", F.concat(F.lit("> "), header), F.array_join(lines, "\n")).alias("value")).write.text(path)


def _station_folder(station: str, name: str | None) -> str:
    """A station's folder, named as Spark names partitions."""
    escaped = lambda x: _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", x)
    return f"{escaped(station)}={escaped(name) if name else NO_STATION}"


def _opened(spark: SparkSession, path: str) -> str | None:
    """The path as a URI with its store, if ``pyarrow.fs`` opens that store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    try:
        _store(uri)
    except (ValueError, OSError, NotImplementedError):
        return None
    return uri


def write_series_by_station(df: DataFrame, path: str, station: str, columns: Sequence[str]) -> None:
    """One folder of lines for each station, as ``partitionBy`` lays them out, and a table ``_stations`` of (station, lines).

    Spark deals and sorts the rows by station; the tasks write the files through ``pyarrow.fs``, a station's lines in one, whole or not
    at all, as Spark's own writer takes some 40 ms a folder on a local disk. An empty name is none, as for Spark. In stores that
    ``pyarrow.fs`` doesn't open, Spark's writer it is, without ``_stations``.
    """
    spark = df.sparkSession
    deal = 4 * spark.sparkContext.defaultParallelism
    value = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")
    uri = _opened(spark, path)
    if uri is None:
        df.select(station, value).repartition(deal, station).write.partitionBy(station).text(path)
        return
    store, root = _store(uri)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, pa.Array]]:
        for b in batches:
            each, begin = pc.run_end_encode(b.column("station")), 0
            for end, name in zip(each.run_ends.to_pylist(), each.values.to_pylist(), strict=True):
                yield name, b.column("value").slice(begin, end - begin)
                begin = end

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(uri)

        def written(name: str | None, parts: Iterator[pa.Array]) -> int:
            folder, n = f"{root}/{_station_folder(station, name)}", 0
            store.create_dir(folder, recursive=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                for lines in parts:
                    out.write("".join(f"{x}\n" for x in lines.to_pylist()).encode())
                    n += len(lines)
            store.move(part, f"{folder}/{_LINES}")
            return n

        done = ((name, written(name, (lines for _, lines in own))) for name, own in itertools.groupby(runs(batches), lambda r: r[0]))
        while some := list(itertools.islice(done, 10_000)):
            names, counts = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["station", "lines"])

    name = F.col(station).cast("string")
    dealt = df.select(F.when(~name.isin("", NO_STATION), name).alias("station"), value).repartition(deal, "station").sortWithinPartitions("station")
    dealt.mapInArrow(write, _STATIONS).write.parquet(f"{path}/_stations")


def series_by_station(spark: SparkSession, path: str, station: str) -> DataFrame:
    """(station, value): the lines that ``write_series_by_station`` wrote; stations are text, null for the lines of none.

    The folders that ``_stations`` names are dealt over the tasks, so that no folder is listed and no name passes the driver.
    """
    uri = _opened(spark, path)
    if uri is None:
        return spark.read.text(path).select(F.col(station).cast("string").alias("station"), "value")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(uri)
        batch = lambda names, lines: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], ["station", "value"])
        names, lines = [], []
        for name in itertools.chain.from_iterable(b.column("station").to_pylist() for b in batches):
            with io.TextIOWrapper(store.open_input_stream(f"{root}/{_station_folder(station, name)}/{_LINES}"), "utf-8", "replace") as file:
                while some := [x.removesuffix("\n") for x in itertools.islice(file, 50_000)]:
                    names += [name] * len(some)
                    lines += some
                    if len(lines) >= 50_000:
                        yield batch(names, lines)
                        names, lines = [], []
        if lines:
            yield batch(names, lines)

    stations = spark.read.schema(_STATIONS).parquet(f"{path}/_stations").select("station")
    return stations.repartition(4 * spark.sparkContext.defaultParallelism, "station").mapInArrow(read, "station string, value string")
