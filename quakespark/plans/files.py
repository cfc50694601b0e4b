"""Round trips through files: each query writes a table in a format of ``sources.formats`` to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import folder
from ..sources import formats, grids, text
from .queries import query, r, table


def place(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def rounded(df: DataFrame, *columns: str, keys=()) -> DataFrame:
    return df.select(*keys, *((F.round(c, 6) + 0.0).alias(c) for c in columns))


CATALOG = "SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(user_id / 2e0, 6) AS lat, round(user_id * 1e0, 6) AS lon, round(value / 10, 6) AS depth, round(value / 100, 6) AS mag FROM events"


def _events(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") / 2).alias("lat"), F.col("user_id").cast("double").alias("lon"), (F.col("value") / 10).alias("depth"), (F.col("value") / 100).alias("mag"))
    return formats.timed(rows)


def _said(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "lat", "lon", "depth", "mag", keys=("ts",))


def _catalog(spark, d, layout: str) -> DataFrame:
    path = place(spark, layout)
    rows = _events(spark, d).withColumn("id", F.concat(F.lit("e"), F.col("event_id")))
    formats.write(rows, path, formats.CATALOGS[layout])
    return _said(formats.catalog(spark, path, layout))


@query(CATALOG)
def file_catalog_lat_first(spark, d):
    return _catalog(spark, d, "lat_first")


@query(CATALOG)
def file_catalog_lon_first(spark, d):
    return _catalog(spark, d, "lon_first")


@query(CATALOG)
def file_catalog_headed(spark, d):
    return _catalog(spark, d, "network_headed")


@query(CATALOG)
def file_catalog_relocated(spark, d):
    return _catalog(spark, d, "relocated")


@query(CATALOG.replace("round(user_id / 2e0, 6)", "round(-user_id / 2e0, 6) + 0.0"))
def file_catalog_degree_minutes(spark, d):
    path = place(spark, "degree_minutes")
    whole = lambda c, side: F.concat(F.floor(F.col(c)).cast("string"), F.lit(side))
    rows = _events(spark, d).select(F.concat_ws(" ", F.lit("e"), "year", "month", "day", "hour", "minute", "second", whole("lat", "S"), ((F.col("lat") % 1) * 60).cast("string"), whole("lon", "E"), ((F.col("lon") % 1) * 60).cast("string"), "depth", "mag").alias("value"))
    rows.write.text(path)
    return _said(formats.degree_minute_catalog(spark, path))


@query(CATALOG)
def file_catalog_timestamps(spark, d):
    path = place(spark, "timestamps")
    text.write_text(_events(spark, d), path, ["lon", "lat", "depth", "mag", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")])
    return _said(text.catalog(spark, path))


@query(CATALOG)
def file_catalog_pipes(spark, d):
    path = place(spark, "pipes")
    no = F.lit("")
    text.write_text(_events(spark, d), path, ["event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "lat", "lon", "depth", no, no, no, no, no, "mag", no, F.lit("there")], separator="|")
    return _said(text.pipe_catalog(spark, path))


@query("SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value, round(value / 10, 6) AS error FROM events")
def file_series_values(spark, d):
    path = place(spark, "values")
    rows = formats.timed(table(spark, d, "events")).withColumn("error", F.col("value") / 10)
    formats.write(rows, path, formats.SERIES["values"])
    return rounded(formats.series(spark, path, "values").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "value", "error", keys=("ts",))


@query("SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS e, round(value / 2, 6) AS n, round(-value, 6) AS u, round(value / 10, 6) AS se FROM events")
def file_series_daily(spark, d):
    path = place(spark, "daily")
    v = F.col("value")
    rows = formats.timed(table(spark, d, "events")).withColumns({"e": v, "n": v / 2, "u": -v, "se": v / 10, "sn": v / 10, "su": v / 10})
    formats.write(rows, path, formats.SERIES["daily_trailing_time"])
    return rounded(formats.series(spark, path, "daily_trailing_time").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "e", "n", "u", "se", keys=("ts",))


STATIONS = "SELECT s_name AS station, round(s_nationkey * 10e0, 6) AS lon, round(s_nationkey - 10e0, 6) AS lat"


def _stations(spark, d) -> DataFrame:
    v = F.col("s_acctbal")
    return table(spark, d, "supplier").select(F.col("s_name").alias("station"), (F.col("s_nationkey") * 10.0).alias("lon"), (F.col("s_nationkey") - 10.0).alias("lat"), (v / 100).alias("ve"), (v / 200).alias("vn"), (v / 400).alias("vu"), F.lit(0.5).alias("se"), F.lit(0.25).alias("sn"), F.lit(1.0).alias("su"), F.lit(0.0).alias("rho"), (v / 7).alias("velocity"), F.lit(2.0).alias("error"))


@query(STATIONS + ", round(s_acctbal / 50, 6) AS ve, round(s_acctbal / 100, 6) AS vn, 1e0 AS se FROM supplier")
def file_velocities_lon_first(spark, d):
    path = place(spark, "velocities")
    formats.write(_stations(spark, d), path, formats.TABLES["velocities_lon_first"])
    return rounded(formats.velocities(spark, path, factor=2.0), "lon", "lat", "ve", "vn", "se", keys=("station",))


@query(STATIONS + ", round(s_acctbal / 100, 6) AS ve, round(s_acctbal / 400, 6) AS vu, 1e0 AS su FROM supplier")
def file_velocities_up(spark, d):
    path = place(spark, "velocities_up")
    formats.write(_stations(spark, d), path, formats.TABLES["velocities_up_lon_first"])
    return rounded(formats.velocities(spark, path, up=True), "lon", "lat", "ve", "vu", "su", keys=("station",))


@query(STATIONS + ", round(s_acctbal / 100, 6) AS ve, round(s_acctbal / 400, 6) AS vu, 1e0 AS su FROM supplier")
def file_station_velocities(spark, d):
    path = place(spark, "stations")
    text.write_text(_stations(spark, d), path, ["station", "lon", "lat", "ve", "vn", "vu", "se", "sn", "su"])
    return rounded(text.stations(spark, path), "lon", "lat", "ve", "vu", "su", keys=("station",))


@query(STATIONS + ", 0e0 AS ve FROM supplier")
def file_station_list(spark, d):
    path = place(spark, "list")
    formats.write(_stations(spark, d), path, formats.TABLES["station_list"])
    return rounded(formats.station_list(spark, path), "lon", "lat", "ve", keys=("station",))


@query(STATIONS + ", round(s_acctbal / 7, 6) AS velocity, 2e0 AS error FROM supplier")
def file_benchmarks(spark, d):
    path = place(spark, "benchmarks")
    formats.write(_stations(spark, d), path, formats.TABLES["benchmarks"])
    return rounded(formats.table(spark, path, formats.TABLES["benchmarks"]), "lon", "lat", "velocity", "error", keys=("station",))


CELL = {f"{a}{k + 1}": (s * 0.5 if a == "x" else t * 0.5) for k, (s, t) in enumerate(((-1, 1), (1, 1), (1, -1), (-1, -1))) for a in "xy"}


def _decimated(spark, d, layout: str, cells: str) -> tuple[str, str]:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("number"), (F.col("p_partkey") % 90).cast("double").alias("lon"), F.col("p_size").cast("double").alias("lat"), F.col("p_retailprice").alias("value"), (F.col("p_retailprice") / 100).alias("error"), F.lit(0.5).alias("los_e"), F.lit(0.1).alias("los_n"), F.lit(0.8).alias("los_u"))
    rows = rows.withColumns({"east": F.col("value"), "north": -F.col("value"), "error_east": F.col("error"), "error_north": F.col("error")} | {n: F.col("lon" if n[0] == "x" else "lat") + v for n, v in CELL.items()})
    paths = place(spark, layout), place(spark, cells)
    formats.write(rows, paths[0], formats.TABLES[layout])
    formats.write(rows, paths[1], formats.TABLES[cells])
    return paths


CORNER = "round(p_partkey % 90 - 0.5e0, 6) + 0.0 AS x1, round(p_size + 0.5e0, 6) AS y1, round(p_partkey % 90 + 0.5e0, 6) AS x3, round(p_size - 0.5e0, 6) AS y3"


def _corner(df: DataFrame, *columns: str) -> DataFrame:
    at = lambda k, c: F.element_at("corners", k)[c].alias(f"{c}{k}")
    flat = df.select("number", *columns, *(at(k, c) for k in (1, 3) for c in "xy"))
    return rounded(flat, "number", *columns, "x1", "y1", "x3", "y3")


@query(f"SELECT p_partkey * 1e0 AS number, round((p_retailprice + 1) * 2, 6) AS value, round(p_retailprice / 50, 6) AS error, {CORNER} FROM part")
def file_decimated(spark, d):
    return _corner(formats.decimated(spark, *_decimated(spark, d, "decimated", "cells"), factor=2.0, step=1.0), "value", "error")


@query(f"SELECT p_partkey * 1e0 AS number, round(p_retailprice, 6) AS value, {CORNER} FROM part")
def file_decimated_triangles(spark, d):
    return _corner(formats.decimated(spark, *_decimated(spark, d, "decimated", "triangles"), triangular=True), "value")


@query(f"SELECT p_partkey * 1e0 AS number, round(p_retailprice, 6) AS east, round(-p_retailprice, 6) AS north, {CORNER} FROM part")
def file_decimated_offsets(spark, d):
    return _corner(formats.decimated_offsets(spark, *_decimated(spark, d, "offsets", "cells")), "east", "north")


@query("SELECT round(p_partkey % 90 * 1e0, 6) AS lon, round(p_size * 1e0, 6) AS lat, round((p_retailprice + 3) * 0.5e0, 6) AS value FROM part")
def file_pixels(spark, d):
    path = place(spark, "pixels")
    rows = table(spark, d, "part").select((F.col("p_partkey") % 90).cast("double").alias("lon"), F.col("p_size").cast("double").alias("lat"), "p_retailprice", F.lit(1.0).alias("err"), F.lit(0.5).alias("e"), F.lit(0.1).alias("n"), F.lit(0.8).alias("u"))
    text.write_text(rows, path, rows.columns)
    return rounded(text.pixels(spark, path, factor=0.5, step=3.0), "lon", "lat", "value")


@query("SELECT round(p_partkey % 90 * 1e0, 6) AS lon, round(p_size * 1e0, 6) AS lat, round(p_retailprice, 6) AS value FROM part")
def file_xyz(spark, d):
    path = place(spark, "xyz")
    rows = table(spark, d, "part").select((F.col("p_partkey") % 90).alias("lon"), F.col("p_size").alias("lat"), F.col("p_retailprice").alias("value"))
    formats.write(rows, path, formats.TABLES["xyz"])
    return rounded(formats.table(spark, path, formats.TABLES["xyz"]), "lon", "lat", "value")


@query("SELECT round(p_size * 1e0, 6) AS depth, round(p_retailprice / 200, 6) AS vp, round(p_retailprice / 350, 6) AS vs, round(p_retailprice / 400, 6) AS density FROM part")
def file_layers(spark, d):
    path = place(spark, "layers")
    v = F.col("p_retailprice")
    formats.write(table(spark, d, "part").select(F.col("p_size").alias("depth"), (v / 200).alias("vp"), (v / 350).alias("vs"), (v / 400).alias("density")), path, formats.TABLES["layers"])
    return rounded(formats.table(spark, path, formats.TABLES["layers"]), "depth", "vp", "vs", "density")


@query("SELECT CAST(strftime(make_date(1990 + p_size, 1, 1) + INTERVAL (p_partkey % 300) DAY, '%Y-%m-%d') AS VARCHAR) AS date, round(p_retailprice, 6) AS offset FROM part")
def file_creep(spark, d):
    path = place(spark, "creep")
    formats.write(table(spark, d, "part").select((F.col("p_size") + 1990).alias("year"), (F.col("p_partkey") % 300).alias("day"), F.col("p_retailprice").alias("offset")), path, formats.TABLES["creep_days"])
    return formats.creep(spark, path).select(F.col("date").cast("string").alias("date"), F.round("offset", 6).alias("offset"))


@query("SELECT p_partkey AS id, CAST(c AS BIGINT) AS corner, round(p_size + c * 1e0, 6) AS x, round(p_retailprice - c, 6) AS y, round(c * 2e0, 6) AS z FROM part, range(4) t(c)")
def file_patches(spark, d):
    path = place(spark, "patches")
    corners = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((F.col("p_size") + k * 1.0).alias("x"), (F.col("p_retailprice") - k).alias("y"), (k * 2.0).alias("z")))
    formats.write_patches(table(spark, d, "part").withColumn("corners", corners), path, "corners", F.col("p_partkey").cast("string"))
    rows = formats.patches(spark, path).select(F.col("header").cast("long").alias("id"), F.posexplode("corners").alias("corner", "c"))
    return rounded(rows.select("id", F.col("corner").cast("long").alias("corner"), "c.*"), "x", "y", "z", keys=("id", "corner"))


@query("SELECT CAST(p_partkey AS BIGINT) AS v1, round(p_size * 1e0, 6) AS x1, round(p_size + 1e0, 6) AS y2, 5e0 AS z3 FROM part")
def file_surface(spark, d):
    path = place(spark, "surface")
    k, s = F.col("p_partkey"), F.col("p_size")
    vertex = lambda n, x, y, z: F.concat_ws(" ", F.lit("VRTX"), n.cast("string"), x.cast("string"), y.cast("string"), z.cast("string"))
    second, third = -2 * k - 1, -2 * k - 2  # keys aren't negative, so no number is given twice
    lines = F.array(vertex(k, s, s, F.lit(0)), vertex(second, s, s + 1, F.lit(1)), vertex(third, s + 1, s, F.lit(5)), F.concat_ws(" ", F.lit("TRGL"), k.cast("string"), second.cast("string"), third.cast("string")))
    table(spark, d, "part").select(F.explode(lines).alias("value")).write.text(path)
    rows = formats.surface(spark, path)
    return rounded(rows, "x1", "y2", "z3", keys=("v1",))


@query("SELECT n_name AS event, strftime(make_date(2000 + n_regionkey, 3, n_nationkey + 1), '%Y-%m-%d') AS day, round(n_nationkey * 2e0, 6) AS latitude, round(-n_nationkey * 3e0, 6) + 0.0 AS longitude, round(n_regionkey + 0.5e0, 6) AS depth, round(n_nationkey * 1e24 / 1e24, 6) AS mrr FROM nation")
def file_moment_tensors(spark, d):
    path = place(spark, "tensors")
    n, k = F.col("n_nationkey"), F.col("n_regionkey")
    pair = lambda name, v: F.concat(F.lit(f"{name}: "), v.cast("string"))
    head = F.concat_ws(" ", F.lit("PDEW"), (k + 2000).cast("string"), F.lit("3"), (n + 1).cast("string"), F.lit("10 20 30.50 x"))
    names = ("time shift", "half duration")
    lines = [head, pair("event name", F.col("n_name")), *(pair(x, F.lit(1.5)) for x in names), pair("latitude", n * 2.0), pair("longitude", n * -3.0), pair("depth", k + 0.5), pair("Mrr", n * 1e24), *(pair(x, F.lit(1e23)) for x in ("Mtt", "Mpp", "Mrt", "Mrp", "Mtp"))]
    table(spark, d, "nation").select(F.concat_ws("\n", *lines).alias("value")).write.text(path)
    rows = formats.moment_tensors(spark, path).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "mrr": F.col("mrr") / 1e24})
    return rounded(rows, "latitude", "longitude", "depth", "mrr", keys=("event", "day"))


@query("SELECT CAST(s AS BIGINT) AS seq, round(n_nationkey + s * 1e0, 6) AS lon, round(n_regionkey - s * 1e0, 6) + 0.0 AS lat FROM nation, range(3) t(s)")
def file_kml(spark, d):
    path = place(spark, "kml")
    at = lambda s: F.concat_ws(",", (F.col("n_nationkey") + s).cast("string"), (F.col("n_regionkey") - s).cast("string"), F.lit("0"))
    table(spark, d, "nation").select(F.concat(F.lit("<Placemark><coordinates>"), F.concat_ws(" ", *(at(s) for s in range(3))), F.lit("</coordinates></Placemark>")).alias("value")).write.text(path)
    return rounded(formats.kml_coordinates(spark, path).withColumn("seq", F.col("seq").cast("long")), "lon", "lat", keys=("seq",))


@query("SELECT CAST(user_id AS BIGINT) AS station, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def file_series_by_station(spark, d):
    path = place(spark, "by_station")
    formats.write_series_by_station(table(spark, d, "events"), path, "user_id", ["ts", "value"])
    rows = formats.series_by_station(spark, path, "user_id").select(F.col("station").cast("long"), F.expr("try_cast(element_at(split(value, ' '), -1) as double)").alias("v"))
    return rows.groupBy("station").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


# Binary grids


def _grid(spark, d):
    """A grid of 50 columns: the mean price of the lines of each quantity, for rows of orders."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("row"), (F.col("l_quantity") - 1).cast("long").alias("col"), "l_extendedprice")
    return rows.groupBy("row", "col").agg((F.max("l_extendedprice") / 1000).cast("float").cast("double").alias("value"), F.count("*").cast("double").alias("lines"))


_GRID = "g AS (SELECT l_orderkey % 500 AS row, CAST(l_quantity - 1 AS BIGINT) AS col, CAST(CAST(max(l_extendedprice) / 1000 AS FLOAT) AS DOUBLE) AS value, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_GRID} SELECT row, col, round(30 + 0.1e0 * col, 6) AS x, round(50 - 0.1e0 * row, 6) AS y, round(value, 4) AS value FROM g")
def grid_raw(spark, d):
    """Written as bands of raw numbers and read again, several ranges a band."""
    path = place(spark, "grid")
    grids.write_raw(_grid(spark, d), path, 50, x=(30.0, 0.1), y=(50.0, -0.1), rows_per_file=128)
    back = grids.read(spark, path, bytes=8000).where("value is not null")
    return back.select("row", "col", r("x", 6), r("y", 6), r("value"))


@query(f"WITH {_GRID} SELECT row, col, round(30 + 0.1e0 * col, 6) AS x, round(50 - 0.1e0 * row, 6) AS y, round(value, 4) AS value, lines FROM g WHERE row BETWEEN 100 AND 180")
def grid_netcdf(spark, d):
    """Written as NetCDF files of two variables and read again, ranges outside the rows asked for left out."""
    path = place(spark, "grid")
    grids.write_netcdf(_grid(spark, d), path, 50, ["value", "lines"], x=(30.0, 0.1), y=(50.0, -0.1), rows_per_file=128)
    back = grids.read(spark, path, "netcdf", variables="value,lines", bytes=8000).where("row >= 100 and row <= 180 and value is not null")
    return back.select("row", "col", r("x", 6), r("y", 6), r("value"), "lines")


# Networks and offsets across faults


_NET = "n AS (SELECT 's' || s_suppkey AS station, (s_suppkey * 7) % 360 * 1e0 AS lon, s_nationkey * 1e0 AS lat, s_acctbal / 1000 AS ve, s_suppkey % 11 / 2e0 AS vn, s_suppkey % 5 - 2e0 AS vu, s_suppkey % 4 / 4e0 AS s FROM supplier)"


def _net(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("station"), (k * 7 % 360).cast("double").alias("lon"), F.col("s_nationkey").cast("double").alias("lat"), (F.col("s_acctbal") / 1000).alias("ve"), (k % 11 / 2).alias("vn"), (k % 5 - 2.0).alias("vu"), *((k % 4 / 4).alias(c) for c in ("se", "sn", "su")))


_SOLUTION = f"WITH {_NET} SELECT station, round(lon, 6) AS lon, round(lat, 6) AS lat, round(ve * 2, 6) AS ve, round(vn * 2, 6) AS vn, round(vu * 2, 6) + 0e0 AS vu, CASE WHEN s = 0 THEN 2 ELSE s * 2 END AS se FROM n"


@query(_SOLUTION)
def file_network_solution(spark, d):
    path = place(spark, "solution")
    formats.write(_net(spark, d), path, formats.TABLES["network_solution"])
    return rounded(formats.network_solution(spark, path, 2.0), "lon", "lat", "ve", "vn", "vu", "se", keys=("station",))


@query(_SOLUTION)
def file_paired_solution(spark, d):
    one, two = place(spark, "velocities"), place(spark, "places")
    formats.write(_net(spark, d), one, formats.TABLES["solution_velocities"])
    formats.write(_net(spark, d), two, formats.TABLES["solution_places"])
    return rounded(formats.paired_solution(spark, one, two, 2.0), "lon", "lat", "ve", "vn", "vu", "se", keys=("station",))


@query(f"WITH {_NET} SELECT station, round(lon, 6) AS lon, round(lat, 6) AS lat, round(ve, 6) AS ve, round(vn, 6) AS vn, 0e0 AS vu, round(s, 6) AS se FROM n")
def file_by_axis(spark, d):
    """Lines for east and north only, so that the vertical is 0."""
    path = place(spark, "axes")
    axis = lambda v, e, n: F.struct(F.col(v).alias("velocity"), F.col("se").alias("error"), F.lit(e).alias("east"), F.lit(n).alias("north"), F.lit(0).alias("up"))
    rows = _net(spark, d).select("station", "lon", "lat", "se", F.explode(F.array(axis("ve", 1, 0), axis("vn", 0, 1))).alias("a")).select("station", "lon", "lat", "a.*")
    formats.write(rows, path, formats.TABLES["by_axis"])
    return rounded(formats.by_axis(spark, path), "lon", "lat", "ve", "vn", "vu", "se", keys=("station",))


@query(f"WITH {_NET} SELECT station, round(lon + cos(radians(vn * 30)) / (111 * cos(radians(lat))), 6) AS lon1, round(lat - sin(radians(vn * 30)) / 111, 6) + 0e0 AS lat1, round(lat + sin(radians(vn * 30)) / 111, 6) + 0e0 AS lat2, round(ve, 6) AS parallel, round(s, 6) AS parallel_error, CAST(NULL AS DOUBLE) AS across FROM n")
def file_cross_fault(spark, d):
    """Points on a fault with a width of 2 km, strike and offset."""
    path = place(spark, "offsets")
    rows = _net(spark, d).select("station", "lon", "lat", F.lit(2.0).alias("width"), (F.col("vn") * 30).alias("strike"), F.col("ve").alias("parallel"), F.col("se").alias("parallel_error"))
    formats.write(rows, path, {**formats.TABLES["cross_fault_points"], "parallel_error": 6})
    return rounded(formats.cross_fault(spark, path, "points"), "lon1", "lat1", "lat2", "parallel", "parallel_error", "across", keys=("station",))
