"""Steps of a stencil, several in one pass: a task takes a tile with a halo as wide as the steps reach and does them at once.

After each step the outermost cells of the halo are no longer right, as their neighbours are missing; after all of them the
tile itself is still right. So one shuffle and one written table serve as many steps as the halo holds. Halos follow the
boundary mode: wrapped axes go on at the far end, in custom mode only at cells of code 9, and cells of code 0 are nobody's
neighbours, as in grid.gather.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchwater.operators.grid import D4, NODATA, OUTLET, PERIODIC, Meta, Raster
from catchwater.plans.iterate import dropped, written

#: Cells on a side of a tile, and steps that one pass takes at most.
SIZE, STEPS = 256, 16
OPPOSITE = {"t": "b", "b": "t", "l": "r", "r": "l"}
_SHIFT = {d: (rows, cols) for d, rows, cols in D4}


@dataclass
class Tile:
    """A tile with its halo as arrays, NaN where there is no cell; row, col: each cell's true place."""

    meta: Meta
    row: np.ndarray
    col: np.ndarray
    fields: dict[str, np.ndarray]
    there: np.ndarray

    def __post_init__(self):
        meta, custom = self.meta, self.meta.mode == "custom"
        bc = self.fields.get("bc")
        edge_rows = (self.row == 0) | (self.row == meta.ny - 1)
        edge_cols = (self.col == 0) | (self.col == meta.nx - 1)
        coded = custom & (bc == PERIODIC) if custom else np.zeros(self.row.shape, bool)
        east_west = coded & ~edge_rows if custom else np.full(self.row.shape, meta.mode == "periodic_EW")
        north_south = coded & edge_rows if custom else np.full(self.row.shape, meta.mode == "periodic_NS")
        ends = {"t": (self.row == 0) & ~north_south, "b": (self.row == meta.ny - 1) & ~north_south, "l": (self.col == 0) & ~east_west, "r": (self.col == meta.nx - 1) & ~east_west}
        target = self.there & (bc != NODATA) if custom else self.there
        self.links = {d: self.there & ~ends[d] & self._moved(target, d, False) for d in ends}
        self.nodata = (bc == NODATA) if custom else np.zeros(self.row.shape, bool)
        if custom:
            self.leave = bc == OUTLET
        elif meta.mode == "periodic_EW":
            self.leave = edge_rows
        else:
            self.leave = edge_cols if meta.mode == "periodic_NS" else edge_rows | edge_cols

    @staticmethod
    def _moved(a: np.ndarray, d: str, empty) -> np.ndarray:
        """For each cell, what the cell beside it in direction d holds."""
        out, (dr, dc) = np.full_like(a, empty), _SHIFT[d]
        ny, nx = a.shape
        out[max(0, -dr) : ny - max(0, dr), max(0, -dc) : nx - max(0, dc)] = a[max(0, dr) : ny + min(0, dr), max(0, dc) : nx + min(0, dc)]
        return out

    def near(self, a: np.ndarray, d: str) -> np.ndarray:
        """Each cell's neighbour's value, NaN where it has none."""
        return np.where(self.links[d], self._moved(a, d, np.nan), np.nan)

    def landed(self, sent: dict[str, np.ndarray]) -> np.ndarray:
        """For each cell the sum of what its neighbours send towards it; sent: by direction, 0 or NaN where nothing goes."""
        total = np.zeros(self.row.shape)
        for d, a in sent.items():
            total += np.nan_to_num(self._moved(np.where(self.links[d], a, 0.0), OPPOSITE[d], 0.0))
        return total


Kernel = Callable[[Tile, int], dict[str, np.ndarray]]


def _copies(place: str, n: int, halo: int, wraps: bool) -> Column:
    """(tile, place inside the tile with halo) for each tile whose tile or halo holds the row or column, wrapped copies too."""
    last, at = (n - 1) // SIZE, F.col(place)
    turns = -(-halo // n) if wraps else 0

    def of(turn: Column) -> Column:
        v = at + turn * n
        low, high = F.greatest(F.lit(0), F.floor((v - halo) / SIZE)), F.least(F.lit(last), F.floor((v + halo) / SIZE))
        held = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), high - low).cast("long")), lambda k: (low + k <= high) & (v >= (low + k) * SIZE - halo) & (v < F.least((low + k + 1) * SIZE, F.lit(n)) + halo))
        return F.transform(held, lambda k: F.struct((low + k).cast("long").alias("t"), (v - (low + k) * SIZE + halo).cast("int").alias("at"), ((turn == 0) & (F.floor(at / SIZE) == low + k)).alias("own")))

    return F.flatten(F.transform(F.sequence(F.lit(-turns), F.lit(turns)), of))


def stepped(raster: Raster, kernel: Kernel, steps: int, halo: int, fields: tuple[str, ...], changed: tuple[str, ...]) -> DataFrame:
    """The cells after `steps` steps of a kernel that reads `fields` and returns arrays of `changed` after them.

    halo: how far the steps reach together. Other columns stay as they are.
    """
    meta, custom = raster.meta, raster.meta.mode == "custom"
    wraps_ew, wraps_ns = custom or meta.mode == "periodic_EW", custom or meta.mode == "periodic_NS"
    names, read = raster.cells.columns, tuple(dict.fromkeys((*fields, *(("bc",) if custom else ()))))
    df = raster.cells.select("*", F.explode(_copies("row", meta.ny, halo, wraps_ns)).alias("__r"), F.col("col").alias("__col"))
    df = df.select(*names, "__r", F.explode(_copies("col", meta.nx, halo, wraps_ew)).alias("__c"))
    df = df.select(*names, F.col("__r.t").alias("__tr"), F.col("__c.t").alias("__tc"), F.col("__r.at").alias("__ar"), F.col("__c.at").alias("__ac"), (F.col("__r.own") & F.col("__c.own")).alias("__own"))
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in changed else f.dataType) for f in raster.cells.schema.fields])

    def run(part: pa.Table) -> pa.Table:
        r, c = np.asarray(part["__ar"]), np.asarray(part["__ac"])
        shape = (int(r.max()) + 1, int(c.max()) + 1)

        def laid(name: str, empty, kind=np.float64) -> np.ndarray:
            out = np.full(shape, empty, kind)
            out[r, c] = np.asarray(part[name].cast(pa.from_numpy_dtype(kind)))
            return out

        there = np.zeros(shape, bool)
        there[r, c] = True
        tile = Tile(meta, laid("row", -1, np.int64), laid("col", -1, np.int64), {f: laid(f, np.nan) for f in read}, there)
        with np.errstate(all="ignore"):
            new = kernel(tile, steps)
        own = np.flatnonzero(np.asarray(part["__own"]))
        kept, places = part.take(pa.array(own)), (r[own], c[own])
        return pa.table([pa.array(new[n][places]) if n in changed else kept[n] for n in names], names=names)

    return df.groupBy("__tr", "__tc").applyInArrow(run, schema)


def advanced(raster: Raster, kernel: Kernel, n: int, reach: int, fields: tuple[str, ...], changed: tuple[str, ...], edge: int = 0, at_once: int | None = None) -> Raster:
    """n steps, up to `at_once` (STEPS) in a pass. A step reaches `reach` cells, all steps of a pass together `edge` more.

    The states between passes are deleted, the given one is the caller's.
    """
    at_once, first = at_once or STEPS, True
    while n > 0:
        m = min(n, at_once)
        before, raster = raster, raster.with_cells(written(stepped(raster, kernel, m, m * reach + edge, fields, changed), "state"))
        if not first:
            dropped(before.cells)
        n, first = n - m, False
    return raster
