"""Raster files: Parquet cell tables (the native form), .npy arrays, GeoTIFF, and PNG pictures.

Files of other formats are read and written in parallel through the sources of raster_source: reading by blocks of one file,
writing by bands of rows that tasks pack and lay at their places. The driver sees headers and, of packed bands, their sizes.
Place, reference system and missing value of a GeoTIFF are kept in the raster's description and written again. Paths that
only Spark can open are read as whole files, one task a file (2 GB at most).
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwater.operators.grid import Meta, Raster
from catchwater.plans.iterate import dropped, written
from catchwater.sources import formats
from catchwater.sources.formats import NODATA_TAG, lzw_decoded, tiff_band, tiff_place  # noqa: F401
from catchwater.sources.raster_source import CELLS, layout_at, listed, registered

#: Rows of a band at most, and bytes.
BAND, BAND_BYTES = 256, 8 << 20
#: Schemes that tasks can open without Spark.
OPEN = re.compile(r"(file:|s3://|gs://|gcs://|hdfs://|abfss?://|(?![a-z0-9+.-]+://))")


def write_cells(raster: Raster, path: str) -> None:
    """cells and meta as Parquet under path."""
    raster.cells.write.mode("overwrite").parquet(f"{path}/cells")
    raster.cells.sparkSession.createDataFrame([(json.dumps(asdict(raster.meta)),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_cells(spark: SparkSession, path: str) -> Raster:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    return Raster(spark.read.parquet(f"{path}/cells"), Meta(**meta))


def read_arrays(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, partition: int | None = None) -> DataFrame:
    """(path, band, i, row, col, z) of .npy and TIFF files: a file or a folder; rows, cols: a window (from, to).

    partition: bytes of a file for a task. Filters on row, col, band and i prune too where spark.sql.python.filterPushdown.enabled is set.
    """
    if not OPEN.match(path):
        cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_decoded, CELLS)
        for name, span in (("row", rows), ("col", cols)):
            cells = cells if span is None else cells.where((F.col(name) >= span[0]) & (F.col(name) < span[1]))
        return cells
    options = {k: f"{v[0]}:{v[1]}" for k, v in (("rows", rows), ("cols", cols)) if v is not None}
    options |= {} if partition is None else {"bytes": str(partition)}
    if (spark.conf.get("spark.sql.python.filterPushdown.enabled", None) or "").lower() == "true":
        options["filters"] = "true"
    return registered(spark).read.format("raster_file").options(**options).load(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            name, raw = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
            z = np.load(io.BytesIO(raw)) if raw[:6] == b"\x93NUMPY" else tiff_band(raw)
            col = np.arange(z.shape[1])
            for row in range(z.shape[0]):
                n = len(col)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.zeros(n, np.int32)), pa.array(row * n + col), pa.array(np.full(n, row)), pa.array(col), pa.array(z[row].astype(np.float64))], ["path", "band", "i", "row", "col", "z"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            raw = batch.column("content")[k].as_py()
            layout, _, _ = formats.layout_of(lambda at, n: raw[at : at + n])
            yield pa.RecordBatch.from_arrays([batch.column("path").slice(k, 1), pa.array([layout.nx]), pa.array([layout.ny]), pa.array([layout.dx]), pa.array([layout.geo])], ["path", "nx", "ny", "dx", "geo"])


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(path, nx, ny, dx, geo) of .npy and TIFF files, from their headers."""
    schema = "path string, nx long, ny long, dx double, geo string"
    if not OPEN.match(path):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_told, schema)
    rows = []
    for name in listed(path):
        layout, _, _ = layout_at(name)
        rows.append((name, layout.nx, layout.ny, layout.dx, layout.geo))
    return spark.createDataFrame(rows, schema)


def read_raster(spark: SparkSession, path: str, mode: str = "normal", band: int = 0, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> Raster:
    """One band of a .npy or TIFF file as a raster, or a window of it, whose cells count from its own corner.

    A window keeps the reference system; the place of its corner is moved where the file tells one by a tie point.
    """
    told = read_meta(spark, path).first()
    if told is None:
        raise ValueError(f"no file at {path}")
    cells = read_arrays(spark, path, rows, cols).where(F.col("band") == band).drop("path", "band")
    meta = Meta(told["nx"], told["ny"], told["dx"], mode, told["geo"])
    if rows is None and cols is None:
        return Raster(cells, meta)
    (r0, r1), (c0, c1) = ((a, min(b, n)) for (a, b), n in ((rows or (0, meta.ny), meta.ny), (cols or (0, meta.nx), meta.nx)))
    nx = c1 - c0
    cells = cells.select(((F.col("row") - r0) * nx + F.col("col") - c0).alias("i"), (F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "z")
    geo = json.loads(meta.geo or "{}")
    if len(geo.get("33922", [])) == 6:
        i, j, k, x, y, z = geo["33922"]
        geo["33922"] = [i, j, k, x + c0 * meta.dx, y - r0 * meta.dx, z]
    return Raster(cells, Meta(nx, r1 - r0, meta.dx, mode, json.dumps(geo, sort_keys=True) if geo else ""))


def band_rows(nx: int) -> int:
    return max(1, min(BAND, BAND_BYTES // (8 * nx)))


def _bands(raster: Raster, field: str, pack: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """band and what `pack` makes of each band of rows, NaN where a cell is missing: packed by tasks."""
    nx, ny, rows = raster.meta.nx, raster.meta.ny, band_rows(raster.meta.nx)
    names = ["band", *(c.split()[0] for c in schema.split(", "))]

    def packed(part: pa.Table) -> pa.Table:
        band = part["band"][0].as_py()
        out = np.full((min(rows, ny - band * rows), nx), np.nan)
        out[np.asarray(part["row"]) - band * rows, np.asarray(part["col"])] = np.asarray(part["v"], np.float64)
        return pa.table([pa.array([x]) for x in (band, *pack(out))], names=names)

    cells = raster.cells.select("row", "col", F.col(field).cast("double").alias("v")).withColumn("band", F.floor(F.col("row") / rows))
    return cells.groupBy("band").applyInArrow(packed, f"band long, {schema}")


def _laid(parts: DataFrame, path: str, size: int, *more: tuple[int, bytes]) -> None:
    """Rows (at, data) of tasks and what frames them as one file of `size` bytes."""
    spark = registered(parts.sparkSession)
    frame = spark.createDataFrame([(at, bytearray(data)) for at, data in more if data], "at long, data binary")
    parts.select("at", "data").union(frame).write.format("placed_bytes").option("size", str(size)).mode("append").save(path)


def _sized(bands: DataFrame, *columns: str) -> tuple[DataFrame, list]:
    """The bands, written, and their sizes in order."""
    bands = written(bands, "bands")
    return bands, bands.select("band", F.length("data").alias("n"), *columns).orderBy("band").collect()


def write_npy(raster: Raster, path: str, field: str = "z", kind: str = "<f4") -> tuple[float, float]:
    """The field as .npy; returns its least and largest value."""
    nx, ny, rows, size = raster.meta.nx, raster.meta.ny, band_rows(raster.meta.nx), np.dtype(kind).itemsize
    head = formats.npy_frame(nx, ny, kind)
    bands = _bands(raster, field, lambda z: (formats.strip_bytes(z, kind),), "data binary")
    _laid(bands.withColumn("at", len(head) + F.col("band") * (rows * nx * size)), path, len(head) + nx * ny * size, (0, head))
    v = F.col(field).cast("float" if size == 4 else "double")
    low, high = raster.cells.where(~F.isnan(field)).agg(F.min(v), F.max(v)).first()
    return (np.inf, -np.inf) if low is None else (low, high)


def write_tiff(raster: Raster, path: str, field: str = "z", kind: str = "<f4", packing: int = 1, predictor: int = 1) -> None:
    """The field as a GeoTIFF in strips; packing 1 is plain, 8 deflated; predictor 3 helps deflating numbers with a fraction."""
    if packing not in (1, 8) or predictor not in (1, 3) or kind not in ("<f4", "<f8"):
        raise ValueError("strips are plain or deflated, with predictor 1 or 3, of 4 or 8 bytes a number")
    meta, rows = raster.meta, band_rows(raster.meta.nx)
    missing = json.loads(meta.geo or "{}").get(str(NODATA_TAG), "").rstrip("\0 ")
    bands = _bands(raster, field, lambda z: (formats.strip_bytes(np.where(np.isnan(z), float(missing), z) if missing else z, kind, packing, predictor),), "data binary")
    count = -(-meta.ny // rows)
    if packing == 1:
        sizes = [min(rows, meta.ny - k * rows) * meta.nx * np.dtype(kind).itemsize for k in range(count)]
    else:
        bands, told = _sized(bands)
        sizes = [r["n"] for r in told]
    if len(sizes) != count:
        raise ValueError("rows are missing")
    head, starts, tail = formats.tiff_frame(meta.nx, meta.ny, rows, sizes, kind, packing, predictor, meta.dx, meta.geo)
    _placed(bands, starts, sizes, path, head, tail)


def _placed(bands: DataFrame, starts: list[int], sizes: list[int], path: str, head: bytes, tail: bytes) -> None:
    places = bands.sparkSession.createDataFrame(list(enumerate(starts)), "band long, at long")
    end = (starts[-1] + sizes[-1]) if starts else len(head)
    _laid(bands.join(places, "band"), path, end + len(tail), (0, head), (end, tail))
    dropped(bands)


def write_png(raster: Raster, path: str, bits: int = 8, field: str = "z") -> None:
    """A grey PNG of the field's normalised values."""
    from catchwater.operators.terrain import normalised

    nx, ny = raster.meta.nx, raster.meta.ny
    levels = raster.with_cells(raster.cells.select("i", "row", "col").join(normalised(raster, (1 << bits) - 1, field), "i"))
    bands, told = _sized(_bands(levels, "value", lambda z: formats.png_lines(z, bits), "data binary, adler long, raw long"), "adler", "raw")
    head, tail = formats.png_frame(nx, ny, bits, [(r["adler"], r["raw"]) for r in told])
    sizes = [r["n"] for r in told]
    _placed(bands, [len(head) + int(x) for x in np.cumsum([0, *sizes])[:-1]], sizes, path, head, tail)
