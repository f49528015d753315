"""Raster files as Spark data sources: `raster_file` reads, `placed_bytes` writes.

raster_file: the header of each file is read where the query is planned; a partition is some megabytes of strips, tiles or
rows of a file, read by byte ranges and decoded by its task, so one file is read by many. Windows prune: the options rows and
cols ("from:to") and bands, and, where Spark's session allows filters in Python sources, filters on row, col, band and i.
Strips and tiles outside are not read, and of plain blocks only the rows inside. A deflated or LZW block is the least unit.

placed_bytes: rows (at, data) are bytes and where they belong in the file. Tasks write them at their places in one file beside
the target; each reports how many bytes it wrote, and only if they are all there the driver gives the file its name. A task
that is run again writes the same bytes to the same places.

Paths are those of pyarrow's file systems (local, s3, gs, hdfs); placed_bytes needs one that writes at places, so a shared
folder that all executors mount.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from catchwater.sources import formats

CELLS = "path string, band int, i long, row long, col long, z double"
#: Bytes of a file that a task reads, and cells of a batch that it hands on.
PARTITION, BATCH = 16 << 20, 1 << 16
ENDS = (".tif", ".tiff", ".npy")
FAR = 1 << 62


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def ranged(path: str) -> tuple[formats.Ranged, pa.NativeFile]:
    system, place = opened(path)
    file = system.open_input_file(place)
    return lambda at, n: file.read_at(n, at), file


def listed(path: str) -> list[str]:
    """A file, or the raster files of a folder by name."""
    system, place = opened(path)
    if system.get_file_info(place).type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no file at {path}")
    if system.get_file_info(place).is_file:
        return [path]
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in system.get_file_info(pafs.FileSelector(place)) if f.is_file and f.base_name.lower().endswith(ENDS))


def layout_at(path: str) -> tuple[formats.Layout, np.ndarray, np.ndarray]:
    read, file = ranged(path)
    with file:
        return formats.layout_of(read)


@dataclass
class Part(InputPartition):
    """Pieces of one file (see formats.pieces) and what of them is wanted: rows, columns, bands."""

    path: str
    layout: formats.Layout
    pieces: list[tuple[int, int, int, int, int]]
    window: tuple[int, int, int, int]
    bands: tuple[int, int]


def _span(text: str | None) -> tuple[int, int]:
    low, _, high = (text or ":").partition(":")
    return int(low or 0), int(high or FAR)


class RasterFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_file"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return (Filtered if self.options.get("filters") == "true" else RasterReader)(self.options)


class RasterReader(DataSourceReader):
    def __init__(self, options):
        if "path" not in options:
            raise ValueError("raster_file needs a path")
        self.path, self.target = options["path"], int(options.get("bytes", PARTITION))
        self.spans = {"row": _span(options.get("rows")), "col": _span(options.get("cols")), "band": _span(options.get("bands")), "i": (0, FAR)}

    def partitions(self) -> list[Part]:
        out = []
        for path in listed(self.path):
            layout, starts, sizes = layout_at(path)
            rows, cols, i = self.spans["row"], self.spans["col"], self.spans["i"]
            window = (max(rows[0], i[0] // layout.nx), min(rows[1], layout.ny, -(-i[1] // layout.nx)), cols[0], min(cols[1], layout.nx))
            bands = (self.spans["band"][0], min(self.spans["band"][1], layout.bands))
            held, size = [], 0
            if window[0] < window[1] and window[2] < window[3] and bands[0] < bands[1]:
                for piece in formats.pieces(layout, starts, sizes, window, bands, self.target):
                    if held and size + piece[2] > self.target:
                        out.append(Part(path, layout, held, window, bands))
                        held, size = [], 0
                    held.append(piece)
                    size += piece[2]
            if held:
                out.append(Part(path, layout, held, window, bands))
        return out or [Part("", None, [], (0, 0, 0, 0), (0, 0))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.pieces:
            return
        layout, (r0, r1, c0, c1) = partition.layout, partition.window
        read, file = ranged(partition.path)
        with file:
            for k, start, size, first, last in partition.pieces:
                plane, top, left = layout.place(k)
                z = formats.decoded(layout, read(start, size))[: last - first]
                row, col = np.arange(top + first, top + first + len(z)), np.arange(left, min(left + layout.wide, layout.held[0]))
                z = z[:, : len(col)]
                if layout.turned:
                    row, col, z = col, row, z.transpose(1, 0, 2)
                inside_r, inside_c = (row >= r0) & (row < r1), (col >= c0) & (col < c1)
                row, col, z = row[inside_r], col[inside_c], z[inside_r][:, inside_c]
                for s in range(z.shape[2]):
                    band = plane if layout.planes else s
                    if partition.bands[0] <= band < partition.bands[1]:
                        yield from self._cells(partition, band, row, col, formats.cleaned(layout, z[:, :, s]))

    @staticmethod
    def _cells(partition: Part, band: int, row: np.ndarray, col: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // max(1, len(col)))
        for a in range(0, len(row), step):
            r = np.repeat(row[a : a + step], len(col))
            c = np.tile(col, len(row[a : a + step]))
            n = len(r)
            columns = [pa.array([partition.path] * n, pa.string()), pa.array(np.full(n, band, np.int32)), pa.array(r * partition.layout.nx + c), pa.array(r), pa.array(c), pa.array(z[a : a + step].ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "band", "i", "row", "col", "z"])


class Filtered(RasterReader):
    """Takes filters on places and bands as windows."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            bounds = {EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, FAR), GreaterThanOrEqual: lambda v: (v, FAR), LessThan: lambda v: (0, v), LessThanOrEqual: lambda v: (0, v + 1)}.get(type(f))
            if name in self.spans and bounds:
                low, high = bounds(f.value)
                was = self.spans[name]
                self.spans[name] = (max(was[0], low), min(was[1], high))
            if name not in ("row", "col", "band") or not bounds:
                yield f  # whole rows are read for i


@dataclass
class Written(WriterCommitMessage):
    n: int


class PlacedBytes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def schema(self) -> str:
        return "at long, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PlacedWriter(self.options)


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, options):
        system, self.path = opened(options["path"])
        if not isinstance(system, pafs.LocalFileSystem):
            raise ValueError("placed_bytes writes to folders that are mounted; others take cell tables (write_cells)")
        self.size = int(options["size"])
        self.beside = f"{self.path}.{uuid.uuid4().hex}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        file, n = os.open(self.beside, os.O_WRONLY | os.O_CREAT, 0o644), 0
        try:
            for batch in iterator:
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data"), strict=True):
                    raw = memoryview(data.as_buffer())
                    while len(raw):
                        done = os.pwrite(file, raw, at)
                        at, raw, n = at + done, raw[done:], n + done
            os.fsync(file)
        finally:
            os.close(file)
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        n = sum(m.n for m in messages if m)
        if n != self.size or not os.path.exists(self.beside) or os.path.getsize(self.beside) != n:
            self.abort(messages)
            raise ValueError(f"{n} bytes were written of {self.size}; executors have to share the folder of {self.path}")
        os.replace(self.beside, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.beside):
            os.remove(self.beside)


def registered(spark: SparkSession) -> SparkSession:
    for source in (RasterFile, PlacedBytes):
        spark.dataSource.register(source)
    return spark
