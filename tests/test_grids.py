"""Binary grids: layouts written by hand, ranges of rows, round trips, and what is refused."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakespark.sources import grids


def cells(df, *names):
    return {(r.row, r.col): tuple(r[n] for n in names) for r in df.collect()}


def test_raw_files_in_every_layout(spark, tmp_path):
    data = np.arange(2 * 7 * 5, dtype=">i2").reshape(2, 7, 5)
    data[1, 3, 2] = -99
    woven = {"bsq": data, "bil": data.transpose(1, 0, 2), "bip": data.transpose(1, 2, 0)}
    for kind, array in woven.items():
        path = tmp_path / f"{kind}.dat"
        path.write_bytes(b"header" + array.tobytes())
        df = grids.read(spark, str(path), width=5, dtype=">i2", bands=2, header=6, interleave=kind, fill=-99, x0=10, dx=0.5, y0=3, dy=-1, bytes=40)
        assert df.rdd.getNumPartitions() > 1 and df.columns == ["row", "col", "x", "y", "value0", "value1"]
        got = cells(df, "value0", "value1", "x", "y")
        assert len(got) == 35 and got[3, 2][1] is None
        assert all(v == (data[0, i, j], None if (i, j) == (3, 2) else data[1, i, j], 10 + 0.5 * j, 3.0 - i) for (i, j), v in got.items())


def test_envi_header_and_cut_off_file(spark, tmp_path):
    data = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "a.img").write_bytes(data.tobytes())
    (tmp_path / "a.hdr").write_text("ENVI\nsamples = 4\nlines = 3\nbands = 1\ndata type = 4\nbyte order = 0\ninterleave = bsq\nmap info = {Geographic, 1,\n 1, 100.0, 40.0, 0.5, 0.25, WGS-84}\n")
    got = cells(grids.read(spark, str(tmp_path / "a.img")), "value", "x", "y")
    assert got[0, 0] == (0.0, 100.25, 39.875) and got[2, 3] == (11.0, 101.75, 39.375)
    (tmp_path / "a.img").write_bytes(data.tobytes()[:-4])
    with pytest.raises(Exception, match="fewer"):
        grids.read(spark, str(tmp_path / "a.img")).count()


def classic(variables, records=0):
    """A small NetCDF file with a record dimension, written field by field."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = [("t", 0), ("y", 3), ("x", 2)]
    head = b"CDF\x01" + struct.pack(">i", records) + struct.pack(">ii", 10, 3) + b"".join(text(n) + struct.pack(">i", s) for n, s in dims) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(variables))
    entries = []
    for name, ids, kind, array, attributes in variables:
        atts = struct.pack(">ii", 12, len(attributes)) + b"".join(text(k) + struct.pack(">iif", 5, 1, v) for k, v in attributes.items()) if attributes else struct.pack(">ii", 0, 0)
        per = array.nbytes // (records if ids[0] == 0 else 1)
        entries.append((text(name) + struct.pack(">i", len(ids)) + b"".join(struct.pack(">i", i) for i in ids) + atts + struct.pack(">ii", kind, per + -per % 4), ids[0] == 0, array))
    at = len(head) + sum(len(e[0]) + 4 for e in entries)
    out, fixed = head, b""
    for e, moving, array in (x for x in entries if not x[1]):
        fixed += array.tobytes() + b"\0" * (-array.nbytes % 4)
    where, moved = at, at + len(fixed)
    for e, moving, array in entries:
        if moving:
            out += e + struct.pack(">i", moved)
            moved += array.nbytes // records + -(array.nbytes // records) % 4
        else:
            out += e + struct.pack(">i", where)
            where += array.nbytes + -array.nbytes % 4
    for t in range(records):
        for _, moving, array in entries:
            if moving:
                raw = array[t].tobytes()
                fixed += raw + b"\0" * (-len(raw) % 4)
    return out + fixed


def test_netcdf_records_scales_and_layers(spark, tmp_path):
    x, y = np.array([5.0, 6.0], ">f8"), np.array([1.0, 2.0, 4.0], ">f4")
    z = np.arange(12, dtype=">i2").reshape(2, 3, 2)
    w = np.arange(100, 112, dtype=">f4").reshape(2, 3, 2)
    path = tmp_path / "a.nc"
    path.write_bytes(classic([("x", [2], 6, x, {}), ("y", [1], 5, y, {}), ("z", [0, 1, 2], 3, z, {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": 9.0}), ("w", [0, 1, 2], 5, w, {})], 2))
    for layer in (0, 1):
        got = cells(grids.read(spark, str(path), "netcdf", variables="z,w", layer=layer, bytes=8), "z", "w", "x", "y")
        assert got == {(i, j): (None if z[layer, i, j] == 9 else z[layer, i, j] * 0.5 + 1, w[layer, i, j], x[j], y[i]) for i in range(3) for j in range(2)}
    (tmp_path / "b.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    with pytest.raises(Exception, match="HDF5"):
        grids.read(spark, str(tmp_path / "b.nc"), "netcdf").count()


def test_round_trips_and_pruned_ranges(spark, tmp_path):
    rows = spark.range(40 * 9).select(F.floor(F.col("id") / 9).alias("row"), (F.col("id") % 9).alias("col"), (F.col("id") * 0.5).alias("value"), (F.col("id") * -2.0).alias("second"), F.lit("k").alias("band")).where("not (row = 3 and col = 4)")
    grids.write_raw(rows, str(tmp_path / "raw"), 9, x=(1.0, 0.25), y=(50.0, -0.5), rows_per_file=7)
    grids.write_netcdf(rows, str(tmp_path / "nc"), 9, ["value", "second"], x=(1.0, 0.25), y=(50.0, -0.5), rows_per_file=16)
    for df in (grids.read(spark, str(tmp_path / "raw"), bytes=80), grids.read(spark, str(tmp_path / "nc"), "netcdf", variables="value,second", bytes=100)):
        got = cells(df, "value", "x", "y")
        assert got == {(i, j): (None if (i, j) == (3, 4) else (9 * i + j) * 0.5, 1 + 0.25 * j, 50 - 0.5 * i) for i in range(40) for j in range(9)}
        some = df.where("row >= 10 and row < 13")
        assert some.count() == 27 and some.rdd.getNumPartitions() < df.rdd.getNumPartitions()
        assert df.where("row = 1000").count() == 0
    assert cells(grids.read(spark, str(tmp_path / "nc"), "netcdf", variables="second"), "second")[39, 8] == (-2.0 * 359,)
