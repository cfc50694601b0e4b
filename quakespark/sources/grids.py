"""Binary grids as a Spark data source: raw binary with or without a header file, and NetCDF classic files.

A grid is a file, or a folder of bands of rows written by ``write_raw`` or ``write_netcdf``. A task reads a range of whole rows of
bounded size by seeking to it, so one file is read by many tasks; comparisons of ``row`` with numbers leave out
the others' ranges. Rows are (row, col, x, y, value ...), row by row from the file's first; a fill value is null. Files are opened
through ``pyarrow.fs``. HDF5-based files (NetCDF 4, MATLAB 7.3) need a library that isn't there and raise.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a file that one task reads at most, unless one row is longer.
BYTES = 32 << 20
# NetCDF classic external types and ENVI data types.
NETCDF_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Layer:
    """Where the rows of a grid's variable lie in a file, and how their numbers read."""

    path: str
    rows: int
    columns: int
    kind: str
    start: int
    row_step: int
    column_step: int
    first: int = 0
    x: tuple[float, float] | None = None
    y: tuple[float, float] | None = None
    xs: tuple[int, str] | None = None
    ys: tuple[int, str] | None = None
    fill: float | None = None
    scale: float = 1.0
    shift: float = 0.0


def envi_header(text: str) -> dict[str, str]:
    """The fields of an ENVI header, braces and their lines joined."""
    joined = re.sub(r"\{([^}]*)\}", lambda m: m[1].replace("\n", " "), text)
    return {k.strip().lower(): v.strip() for k, v in (line.split("=", 1) for line in joined.splitlines() if "=" in line)}


def raw_layers(path: str, options: dict[str, str]) -> list[Layer]:
    """A raw file's bands: from an ENVI header beside it, or from the options width, dtype, bands, interleave, header, x0, dx, y0, dy, fill."""
    store, name = _store(path)
    text = ""
    for beside in (f"{name}.hdr", re.sub(r"\.[^./]*$", ".hdr", name)):
        if beside != name and store.get_file_info(beside).type == fs.FileType.File:
            with store.open_input_file(beside) as f:
                text = f.read().decode()
            break
    given = envi_header(text)
    size = store.get_file_info(name).size
    place = [p.strip() for p in given.get("map info", "").split(",")]
    width = int(options.get("width") or given["samples"])
    kind = np.dtype(options.get("dtype") or (">" if given.get("byte order", "0") == "1" else "<") + ENVI_TYPES[int(given.get("data type", 4))])
    bands, header = int(options.get("bands") or given.get("bands", 1)), int(options.get("header") or given.get("header offset", 0))
    woven = (options.get("interleave") or given.get("interleave", "bsq")).lower()
    rows = int(given["lines"]) if "lines" in given else (size - header) // (width * bands * kind.itemsize)
    if header + rows * width * bands * kind.itemsize > size:
        raise ValueError(f"{path} has {size} bytes, fewer than its header says")
    corner = {"x0": float(place[3]) + (1.5 - float(place[1])) * float(place[5]), "dx": float(place[5]), "y0": float(place[4]) - (1.5 - float(place[2])) * float(place[6]), "dy": -float(place[6])} if len(place) > 6 else {}
    at = {k: float(options.get(k) or corner.get(k, d)) for k, d in (("x0", 0.0), ("dx", 1.0), ("y0", 0.0), ("dy", 1.0))}
    fill = options.get("fill") or given.get("data ignore value")
    item, line = kind.itemsize, width * kind.itemsize
    steps = {"bsq": (line, item, rows * line), "bil": (bands * line, item, line), "bip": (bands * line, bands * item, item)}[woven]
    return [Layer(path, rows, width, kind.str, header + b * steps[2], steps[0], steps[1], int(options.get("first") or 0), (at["x0"], at["dx"]), (at["y0"], at["dy"]), fill=None if fill is None else float(fill)) for b in range(bands)]


class _Header:
    """A reader of NetCDF classic headers, which reads on as far as the header goes."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.data, self.at = file, file.read(1 << 16), 4
        if self.data[:3] != b"CDF" or self.data[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file" + (": HDF5-based files aren't read" if self.data[1:4] == b"HDF" else ""))
        self.wide = self.data[3] == 5

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.data):
            more = self.file.read(1 << 16)
            if not more:
                raise ValueError("the NetCDF header is cut off")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def count(self) -> int:
        return struct.unpack(">q" if self.wide else ">i", self.take(8 if self.wide else 4))[0]

    def number(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def items(self) -> range:
        self.number()
        return range(self.count())

    def attributes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in self.items():
            name, kind, n = self.name(), self.number(), self.count()
            raw = self.padded(n * np.dtype(NETCDF_TYPES[kind]).itemsize)
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, NETCDF_TYPES[kind]).tolist()
        return out


def netcdf_variables(path: str) -> tuple[dict[str, dict], int]:
    """Name, dimensions, shape, type, attributes, first byte and bytes of a step of the first dimension of each variable, and the size of a record."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        h = _Header(f)
        records = h.count()
        dims = [(h.name(), h.count()) for _ in h.items()]
        h.attributes()
        out, record = {}, 0
        for _ in h.items():
            own, n = h.name(), h.count()
            ids = [h.count() for _ in range(n)]
            attributes, kind = h.attributes(), h.number()
            size = h.count()
            begin = struct.unpack(">q" if h.data[3] > 1 else ">i", h.take(8 if h.data[3] > 1 else 4))[0]
            shape = [dims[i][1] or records for i in ids]
            moving = bool(ids) and dims[ids[0]][1] == 0
            record += size if moving else 0
            out[own] = {"dims": [dims[i][0] for i in ids], "shape": shape, "kind": NETCDF_TYPES[kind], "attributes": attributes, "begin": begin, "record": moving}
    moving = [v for v in out.values() if v["record"]]
    if len(moving) == 1:  # a single record variable isn't padded
        record = int(np.prod(moving[0]["shape"][1:])) * np.dtype(moving[0]["kind"]).itemsize
    return out, record


def netcdf_layers(path: str, options: dict[str, str]) -> list[Layer]:
    """The variables named by the option ``variables`` (else all of two dimensions or more), their last two dimensions being y and x.

    Of more dimensions the option ``layer`` gives the place along the first.
    """
    known, record = netcdf_variables(path)
    wanted = [v.strip() for v in options["variables"].split(",")] if options.get("variables") else [k for k, v in known.items() if len(v["shape"]) >= 2]
    out = []
    for name in wanted:
        v = known[name]
        item, shape, steps = np.dtype(v["kind"]).itemsize, v["shape"], []
        for k in range(len(shape)):
            steps.append(record if k == 0 and v["record"] else int(np.prod(shape[k + 1 :])) * item)
        layer = int(options.get("layer") or 0) if len(shape) > 2 else 0
        one = lambda key, default: float(v["attributes"][key][0]) if isinstance(v["attributes"].get(key), list) else default  # noqa: B023, E731
        places = [known.get(d) for d in v["dims"][-2:]]
        axes = [(p["begin"], p["kind"]) if p and len(p["shape"]) == 1 and not p["record"] else None for p in places]
        out.append(Layer(path, shape[-2], shape[-1], v["kind"], v["begin"] + layer * steps[0], steps[-2], item, x=(0.0, 1.0), y=(0.0, 1.0), ys=axes[0], xs=axes[1], fill=one("_FillValue", one("missing_value", None)), scale=one("scale_factor", 1.0), shift=one("add_offset", 0.0)))
    return out


@dataclass
class Rows(InputPartition):
    """A range of rows of a file's layers."""

    layers: list[Layer] = field(default_factory=list)
    begin: int = 0
    end: int = 0

    def __post_init__(self) -> None:
        InputPartition.__init__(self, (self.begin, self.end))


def _read(part: Rows) -> Iterator[pa.RecordBatch]:
    head = part.layers[0]
    store, name = _store(head.path)
    n = part.end - part.begin
    with store.open_input_file(name) as f:

        def axis(given: tuple[int, str] | None, line: tuple[float, float] | None, a: int, b: int) -> np.ndarray:
            if given is None:
                return line[0] + line[1] * np.arange(a, b)
            item = np.dtype(given[1]).itemsize
            f.seek(given[0] + a * item)
            return np.frombuffer(f.read((b - a) * item), given[1]).astype(float)

        xs, ys = axis(head.xs, head.x, 0, head.columns), axis(head.ys, head.y, part.begin, part.end)
        values = []
        for layer in part.layers:
            item = np.dtype(layer.kind).itemsize
            span = (layer.columns - 1) * layer.column_step + item
            f.seek(layer.start + part.begin * layer.row_step)
            raw = f.read((n - 1) * layer.row_step + span)
            if len(raw) < (n - 1) * layer.row_step + span:
                raise ValueError(f"{layer.path} is cut off")
            cells = np.ndarray((n, layer.columns), layer.kind, raw, strides=(layer.row_step, layer.column_step)).astype(float)
            none = np.isnan(cells) if layer.fill is None else np.isnan(cells) | (cells == np.float64(np.dtype(layer.kind).type(layer.fill)))
            values.append((np.where(none, 0, cells) * layer.scale + layer.shift, none))
    step = max(1, (1 << 20) // max(1, head.columns))
    for a in range(0, n, step):
        b = min(n, a + step)
        row = np.repeat(np.arange(part.begin + a, part.begin + b) + head.first, head.columns)
        columns = [pa.array(row), pa.array(np.tile(np.arange(head.columns), b - a)), pa.array(np.tile(xs, b - a)), pa.array(np.repeat(ys[a:b], head.columns))]
        columns += [pa.array(v[a:b].ravel(), mask=none[a:b].ravel()) for v, none in values]
        yield pa.RecordBatch.from_arrays(columns, ["row", "col", "x", "y", *(f"c{k}" for k in range(len(values)))])


class GridReader(DataSourceReader):
    def __init__(self, files: list[list[Layer]], names: list[str], size: int):
        self.files, self.names, self.size, self.low, self.high = files, names, size, -np.inf, np.inf

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value)
            yield f  # the ranges are cut roughly, Spark looks at each row

    def partitions(self) -> list[Rows]:
        out = []
        for layers in self.files:
            head = layers[0]
            step = max(1, self.size // max(1, sum(x.row_step for x in layers)))
            for a in range(0, head.rows if head.columns else 0, step):
                b = min(head.rows, a + step)
                if head.first + b > self.low and head.first + a <= self.high:
                    out.append(Rows(layers, a, b))
        return out or [Rows()]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for batch in _read(partition) if partition.layers else ():
            yield batch.rename_columns(self.names)


class GridSource(DataSource):
    """The data source ``grid``: options path, kind (raw or netcdf), bytes, and those of ``raw_layers`` and ``netcdf_layers``."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def _files(self) -> list[list[Layer]]:
        options = {k.lower(): v for k, v in self.options.items()}
        store, path = _store(options["path"])
        make = netcdf_layers if options.get("kind") == "netcdf" else raw_layers
        if store.get_file_info(path).type != fs.FileType.Directory:
            return [make(options["path"], options)]
        files = sorted(i.path for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("band-") and not i.base_name.endswith(".json"))
        whole = f"{path}/grid.json"
        extra = {}
        if store.get_file_info(whole).type == fs.FileType.File:
            with store.open_input_file(whole) as f:
                extra = json.loads(f.read())
        out = []
        for f in files:
            first = int(re.search(r"band-(\d+)", f)[1])
            given = options | extra
            layers = make(f"file://{f}" if isinstance(store, fs.LocalFileSystem) else f"{options['path']}/{f.rsplit('/', 1)[1]}", given)
            for layer in layers:
                layer.first = first
                if layer.ys is None and layer.y is not None:
                    layer.y = (layer.y[0] + first * layer.y[1], layer.y[1])
            out.append(layers)
        return out

    def _names(self, files: list[list[Layer]]) -> list[str]:
        named = self.options.get("variables")
        n = len(files[0]) if files else 1
        return [v.strip() for v in named.split(",")] if named else ["value"] if n == 1 else [f"value{k}" for k in range(n)]

    def schema(self) -> str:
        return "row long, col long, x double, y double, " + ", ".join(f"`{c}` double" for c in self._names(self._files()))

    def reader(self, schema) -> GridReader:
        files = self._files()
        return GridReader(files, ["row", "col", "x", "y", *self._names(files)], int(self.options.get("bytes") or BYTES))


def read(spark: SparkSession, path: str, kind: str = "raw", **options: object) -> DataFrame:
    """(row, col, x, y, value ...) of a grid file or folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
    return spark.read.format("grid").options(kind=kind, **{k: str(v) for k, v in options.items()}).load(path)


def _bands(df: DataFrame, folder: str, width: int, columns: Sequence[str], rows_per_file: int, make) -> None:
    """Each band of rows is written by one task, under its first row's number, whole or not at all."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)

    def write(t: pa.Table) -> pa.Table:
        store, path = _store(folder)
        row, col = t.column("row").to_numpy(), t.column("col").to_numpy()
        first = int(row.min()) // rows_per_file * rows_per_file
        n = int(row.max()) - first + 1
        cells = np.full((len(columns), n, width), np.nan)
        for k, c in enumerate(columns):
            cells[k, row - first, col] = t.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy()
        part = f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(make(cells, first))
        store.move(part, f"{path}/band-{first:012d}")
        return pa.table({"first": [first]})

    given = df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *columns).where(F.col("row").isNotNull() & F.col("col").between(0, width - 1))
    given.groupBy(F.floor(F.col("row") / rows_per_file).alias("band")).applyInArrow(write, "first long").count()


def write_raw(df: DataFrame, folder: str, width: int, value: str = "value", x: tuple[float, float] = (0.0, 1.0), y: tuple[float, float] = (0.0, 1.0), rows_per_file: int = 1024) -> None:
    """(row, col, value) as a folder of 32-bit bands of whole rows; cells without a row are NaN. x and y are first place and step."""
    _bands(df, folder, width, [value], rows_per_file, lambda cells, first: cells.astype("<f4").tobytes())
    store, path = _store(folder)
    with store.open_output_stream(f"{path}/grid.json") as out:
        out.write(json.dumps({"width": width, "dtype": "<f4", "x0": x[0], "dx": x[1], "y0": y[0], "dy": y[1]}).encode())


def netcdf_bytes(xs: np.ndarray, ys: np.ndarray, variables: dict[str, np.ndarray]) -> bytes:
    """A NetCDF classic file (64-bit offsets) of variables over y and x."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    arrays = [("x", [1], np.asarray(xs, ">f8")), ("y", [0], np.asarray(ys, ">f8")), *((k, [0, 1], np.asarray(v, ">f4")) for k, v in variables.items())]
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + text("y") + struct.pack(">i", len(ys)) + text("x") + struct.pack(">i", len(xs)) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(arrays))
    entries = [text(name) + struct.pack(">i", len(ids)) + b"".join(struct.pack(">i", i) for i in ids) + struct.pack(">ii", 0, 0) + struct.pack(">i", 6 if a.itemsize == 8 else 5) + struct.pack(">i", min(a.nbytes + -a.nbytes % 4, (1 << 31) - 4)) for name, ids, a in arrays]
    at = len(head) + sum(len(e) + 8 for e in entries)
    body = b""
    for e, (_, _, a) in zip(entries, arrays, strict=True):
        head += e + struct.pack(">q", at)
        body += a.tobytes() + b"\0" * (-a.nbytes % 4)
        at += a.nbytes + -a.nbytes % 4
    return head + body


def write_netcdf(df: DataFrame, folder: str, width: int, columns: Sequence[str], x: tuple[float, float] = (0.0, 1.0), y: tuple[float, float] = (0.0, 1.0), rows_per_file: int = 1024) -> None:
    """(row, col, columns ...) as a folder of NetCDF files, each with a band of rows and its own y; cells without a row are NaN."""
    xs = x[0] + x[1] * np.arange(width)
    _bands(df, folder, width, list(columns), rows_per_file, lambda cells, first: netcdf_bytes(xs, y[0] + y[1] * np.arange(first, first + cells.shape[1]), dict(zip(columns, cells, strict=True))))
