"""One file read and written by many tasks: blocks, windows, bands, large files."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.operators.grid import from_matrix
from catchwater.sources import files, formats, raster_source
from tests.test_files import tiff


def matrix(rows, ny, nx):
    out = np.full((ny, nx), np.inf)
    for r in rows:
        assert np.isinf(out[r["row"], r["col"]])
        out[r["row"], r["col"]] = r["z"]
    return out


def test_one_file_by_many_tasks(spark, tmp_path):
    z = np.round(np.random.default_rng(4).normal(size=(61, 47)) * 100).astype(np.float32)
    for packing, predictor, tile in ((1, 1, 0), (1, 1, 16), (5, 3, 0), (8, 3, 16), (8, 1, 0)):
        path = f"{tmp_path}/{packing}-{predictor}-{tile}.tif"
        with open(path, "wb") as f:
            f.write(tiff(z, packing, predictor, tile=tile))
        df = files.read_arrays(spark, path, partition=700)
        assert df.rdd.getNumPartitions() > 4
        assert (matrix(df.collect(), 61, 47) == z).all()
        cut = matrix(files.read_arrays(spark, path, rows=(5, 40), cols=(20, 30), partition=700).collect(), 61, 47)
        assert (cut[5:40, 20:30] == z[5:40, 20:30]).all() and np.isfinite(cut).sum() == 350
        window = files.read_raster(spark, path, rows=(5, 40), cols=(20, 300))
        assert (window.matrix("z") == z[5:40, 20:]).all() and window.validated() is window
        assert '"33922": [0.0, 0.0, 0.0, 140.0, 190.0, 0.0]' in window.meta.geo
    for order in "CF":
        np.save(f"{tmp_path}/{order}.npy", np.asarray(z, order=order))
        df = files.read_arrays(spark, f"{tmp_path}/{order}.npy", cols=(3, 9), partition=700)
        got = matrix(df.collect(), 61, 47)
        assert df.rdd.getNumPartitions() > 1 and (got[:, 3:9] == z[:, 3:9]).all() and np.isfinite(got).sum() == 61 * 6
    folder = files.read_arrays(spark, str(tmp_path))
    assert folder.count() == 7 * 61 * 47 and folder.select("path").distinct().count() == 7
    assert files.read_arrays(spark, f"{tmp_path}/C.npy", rows=(70, 80)).count() == 0
    with pytest.raises(Exception, match="no file"):
        files.read_arrays(spark, f"{tmp_path}/none.tif").count()


def test_windows_read_only_what_they_hold(tmp_path):
    z = np.arange(64 * 32, dtype=np.float32).reshape(64, 32)
    layout, starts, sizes = formats.tiff_layout(lambda at, n, data=tiff(z, 1, 1, tile=16): data[at : at + n])
    assert [p[0] for p in formats.pieces(layout, starts, sizes, (20, 30, 17, 20), (0, 1), 1 << 20)] == [3]
    assert [p[2:] for p in formats.pieces(layout, starts, sizes, (20, 30, 17, 20), (0, 1), 128)] == [(128, a, a + 2) for a in (4, 6, 8, 10, 12)]
    layout, starts, sizes = formats.tiff_layout(lambda at, n, data=tiff(z, 8, 1): data[at : at + n])
    assert [p[0] for p in formats.pieces(layout, starts, sizes, (20, 30, 0, 1), (0, 1), 1)] == [6, 7, 8, 9]


def test_filters_are_windows(spark, tmp_path):
    z = np.arange(40 * 30, dtype=np.float64).reshape(40, 30)
    np.save(f"{tmp_path}/a.npy", z)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df = files.read_arrays(spark, f"{tmp_path}/a.npy", partition=480).where("row >= 10 and row < 14 and col > 27 and z <> 0")
        assert df.rdd.getNumPartitions() == 2  # four rows of 240 bytes
        assert sorted(r["z"] for r in df.collect()) == [r * 30 + c for r in range(10, 14) for c in (28, 29)]
        cells = files.read_arrays(spark, f"{tmp_path}/a.npy", partition=240).where("i >= 95 and i <= 125 and band = 0")
        assert cells.rdd.getNumPartitions() == 2 and sorted(r["i"] for r in cells.collect()) == list(range(95, 126))
        assert files.read_arrays(spark, f"{tmp_path}/a.npy").where("band = 1").count() == 0
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def several(z, planes, packing):
    """A TIFF of (rows, columns, bands), one strip a plane or in all."""
    ny, nx, n = z.shape
    parts = [z[:, :, k].tobytes() for k in range(n)] if planes else [z.tobytes()]
    parts = [p if packing == 1 else zlib.compress(p) for p in parts]
    starts = np.cumsum([8, *map(len, parts)])
    entries = [(256, 3, [nx]), (257, 3, [ny]), (258, 3, [8 * z.dtype.itemsize] * n), (259, 3, [packing]), (273, 4, starts[:-1].tolist()), (277, 3, [n]), (278, 3, [ny]), (279, 4, [len(p) for p in parts]), (284, 3, [2 if planes else 1]), (339, 3, [3] * n)]
    at = int(starts[-1])
    free, table, more = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, field, value in entries:
        raw = struct.pack("<" + {3: "H", 4: "I"}[field] * len(value), *value)
        table += struct.pack("<HHI", tag, field, len(value)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(more)))
        more += raw if len(raw) > 4 else b""
    return b"II" + struct.pack("<HI", 42, at) + b"".join(parts) + struct.pack("<H", len(entries)) + table + bytes(4) + more


def test_bands(spark, tmp_path):
    z = np.random.default_rng(5).random((9, 7, 3)).astype(np.float32)
    for planes in (False, True):
        for packing in (1, 8):
            path = f"{tmp_path}/{planes}{packing}.tif"
            with open(path, "wb") as f:
                f.write(several(z, planes, packing))
            for band in range(3):
                assert (files.read_raster(spark, path, band=band).matrix("z") == z[:, :, band]).all()
            assert files.read_arrays(spark, path, partition=100).count() == 9 * 7 * 3


def test_written_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BAND", 4)
    z = np.cumsum(np.random.default_rng(6).normal(size=(30, 21)), 1)
    z[3, 4] = np.nan
    raster = from_matrix(spark, z, dx=2.5)
    for kind in ("<f4", "<f8"):
        for packing, predictor in ((1, 1), (8, 1), (8, 3), (1, 3)):
            path = f"{tmp_path}/{kind[1:]}{packing}{predictor}.tif"
            files.write_tiff(raster, path, kind=kind, packing=packing, predictor=predictor)
            back = files.read_raster(spark, path)
            assert np.array_equal(back.matrix("z"), z.astype(kind), equal_nan=True) and back.meta.dx == 2.5
    files.write_npy(raster, f"{tmp_path}/a.npy", kind="<f8")
    assert np.array_equal(np.load(f"{tmp_path}/a.npy"), z, equal_nan=True)
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]
    for bad in ({"packing": 5}, {"predictor": 2}, {"kind": "<i4"}):
        with pytest.raises(ValueError):
            files.write_tiff(raster, f"{tmp_path}/bad.tif", **bad)
    with pytest.raises(Exception, match="were written of"):  # rows are missing
        files.write_npy(raster.with_cells(raster.cells.where("row < 8")), f"{tmp_path}/less.npy")
    assert not [f for f in os.listdir(tmp_path) if f.startswith("less")]


def test_files_beyond_four_gigabytes(spark, tmp_path):
    """Sparse files: only what the window holds is read."""
    nx = ny = 34_000
    rows = files.band_rows(nx)
    sizes = [min(rows, ny - k) * nx * 4 for k in range(0, ny, rows)]
    head, starts, tail = formats.tiff_frame(nx, ny, rows, sizes, dx=3.0)
    assert head[2] == 43 and formats.tiff_frame(10, 10, 10, [400])[0][2] == 42
    with open(f"{tmp_path}/a.tif", "wb") as f:
        f.write(head)
        f.seek(starts[-1] + sizes[-1])
        f.write(tail)
        f.seek(starts[33_000 // rows] + (33_000 % rows * nx + 100) * 4)
        f.write(np.array([7.5], "<f4").tobytes())
    with open(f"{tmp_path}/a.npy", "wb") as f:
        f.write(formats.npy_frame(nx, ny))
        f.seek((33_000 * nx + 100) * 4, 1)
        f.write(np.array([7.5], "<f4").tobytes())
        f.truncate(len(formats.npy_frame(nx, ny)) + nx * ny * 4)
    for name in ("a.tif", "a.npy"):
        window = files.read_raster(spark, f"{tmp_path}/{name}", rows=(32_999, 33_002), cols=(99, 102))
        assert window.matrix("z").tolist() == [[0, 0, 0], [0, 7.5, 0], [0, 0, 0]]
    parts = raster_source.RasterReader({"path": f"{tmp_path}/a.npy"}).partitions()
    assert len(parts) == pytest.approx(nx * ny * 4 / raster_source.PARTITION, abs=25) and sum(p[2] for x in parts for p in x.pieces) == nx * ny * 4


def test_adlers_join():
    a, b = os.urandom(5000), os.urandom(70_000)
    assert formats.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    assert formats.joined_adler(1, zlib.adler32(b), len(b)) == zlib.adler32(b)


def test_a_task_that_runs_again_writes_the_same(tmp_path):
    import pyarrow as pa

    writer = raster_source.PlacedWriter({"path": f"{tmp_path}/x", "size": "6"})
    parts = [pa.RecordBatch.from_arrays([pa.array([at]), pa.array([data])], ["at", "data"]) for at, data in ((3, b"def"), (0, b"abc"))]
    writer.write(iter(parts[:1]))  # lost after writing
    writer.commit([writer.write(iter(parts[:1])), writer.write(iter(parts[1:]))])
    assert (tmp_path / "x").read_bytes() == b"abcdef"
    other = raster_source.PlacedWriter({"path": f"{tmp_path}/y", "size": "6"})
    other.abort([])
    with pytest.raises(ValueError):
        other.commit([other.write(iter(parts[:1]))])
    with pytest.raises(ValueError):
        raster_source.PlacedWriter({"path": "mock:///x", "size": "6"})


def test_paths_that_only_spark_opens(spark, tmp_path):
    z = np.arange(12.0).reshape(3, 4)
    np.save(f"{tmp_path}/a.npy", z)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./in", f"file://{tmp_path}")
    raster = files.read_raster(spark, "viewfs://own/in/a.npy", rows=(1, 3))
    assert raster.cells.where(F.col("z") >= 0).count() == 8 and (raster.matrix("z") == z[1:]).all()
