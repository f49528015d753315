"""Rasters as cell tables: a cell is a row (i, row, col, ...), i = row * nx + col, beside a small description."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes of a custom boundary raster.
NODATA, INTERIOR, OUTLET, INLET, PERIODIC = 0, 1, 3, 7, 9
MODES = ("normal", "periodic_EW", "periodic_NS", "custom")
#: Directions in the order in which ties go: four neighbours, eight neighbours, as (name, rows down, columns right).
D4 = (("t", -1, 0), ("l", 0, -1), ("r", 0, 1), ("b", 1, 0))
D8 = (("tl", -1, -1), ("t", -1, 0), ("tr", -1, 1), ("l", 0, -1), ("r", 0, 1), ("bl", 1, -1), ("b", 1, 0), ("br", 1, 1))


@dataclass(frozen=True)
class Meta:
    """Shape, cell size, boundary mode and, as JSON, what a file told of place and reference system."""

    nx: int
    ny: int
    dx: float = 1.0
    mode: str = "normal"
    geo: str = ""

    def __post_init__(self):
        if self.mode not in MODES:
            object.__setattr__(self, "mode", "normal")  # an unknown mode counts as normal
        if self.nx < 1 or self.ny < 1 or self.dx <= 0:
            raise ValueError("a raster has at least one cell and a positive cell size")


@dataclass(frozen=True)
class Raster:
    """cells: i, row, col and one column for each field (z, bc, h, ...); meta: shape, cell size, boundary mode."""

    cells: DataFrame
    meta: Meta

    def with_cells(self, cells: DataFrame) -> Raster:
        return Raster(cells, self.meta)

    def with_columns(self, **columns: Column) -> Raster:
        return self.with_cells(self.cells.withColumns(columns))

    def field(self, name: str) -> DataFrame:
        """One field as (row, col, value)."""
        return self.cells.select("row", "col", F.col(name).alias("value"))

    def matrix(self, name: str) -> np.ndarray:
        """One field as an (ny, nx) array on the driver, for rasters that fit there."""
        out = np.full((self.meta.ny, self.meta.nx), np.nan)
        data = self.cells.select("row", "col", name).toPandas()
        out[data["row"].to_numpy(), data["col"].to_numpy()] = data[name].to_numpy()
        return out

    def rows(self, name: str) -> DataFrame:
        """One field as (row, values), the values of a row in an array."""
        return self.cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", name))), lambda s: s[name]).alias("values"))

    def validated(self) -> Raster:
        """Raises ValueError unless every cell is there once."""
        n, ids, least, most = self.cells.agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
        if n != self.meta.nx * self.meta.ny or ids != n or (n and (least != 0 or most != n - 1)):
            raise ValueError("the cells are not a whole raster")
        return self


def from_table(df: DataFrame, index: str, value: str, nx: int, ny: int | None = None, dx: float = 1.0, mode: str = "normal", bc: Column | None = None) -> Raster:
    """A raster of a table whose `index` counts cells row by row; ny is found from the largest index if not given."""
    if ny is None:
        ny = int(df.agg(F.max(index)).first()[0] or 0) // nx + 1
    i = F.col(index).cast("long")
    columns = [i.alias("i"), F.floor(i / nx).cast("long").alias("row"), F.pmod(i, F.lit(nx)).cast("long").alias("col"), F.col(value).cast("double").alias("z")]
    return Raster(df.select(*columns, *([bc.cast("byte").alias("bc")] if bc is not None else [])), Meta(nx, ny, dx, mode))


def from_matrix(spark: SparkSession, z: np.ndarray, dx: float = 1.0, mode: str = "normal", boundaries: np.ndarray | None = None) -> Raster:
    """A raster of an array on the driver."""
    z = np.asarray(z, np.float64)
    ny, nx = z.shape
    import pandas as pd

    i = np.arange(nx * ny, dtype=np.int64)
    data = {"i": i, "row": i // nx, "col": i % nx, "z": z.ravel()}
    if boundaries is not None:
        data["bc"] = np.asarray(boundaries).ravel().astype(np.int8)
        mode = "custom"
    return Raster(spark.createDataFrame(pd.DataFrame(data)), Meta(nx, ny, dx, mode))


def from_arrays(df: DataFrame, row: str, values: str, nx: int, ny: int, dx: float = 1.0) -> Raster:
    """A raster of one array of nx numbers for each row number."""
    cells = df.select(F.col(row).cast("long").alias("row"), F.posexplode(values).alias("col", "z"))
    cells = cells.select((F.col("row") * nx + F.col("col")).alias("i"), "row", F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"))
    return Raster(cells, Meta(nx, ny, dx))


def with_boundaries(raster: Raster, bc: Column) -> Raster:
    """The raster with a code for each cell and the custom mode."""
    return Raster(raster.cells.withColumn("bc", bc.cast("byte")), replace(raster.meta, mode="custom"))


def edge_class(meta: Meta) -> Column:
    """0 inside; 1 to 8 for top left, top, top right, left, right, bottom left, bottom, bottom right."""
    top, bottom = F.col("row") == 0, F.col("row") == meta.ny - 1
    left, right = F.col("col") == 0, F.col("col") == meta.nx - 1
    chain = F.when(top & left, 1).when(top & right, 3).when(top, 2).when(bottom & left, 6).when(bottom & right, 8).when(bottom, 7)
    return chain.when(left, 4).when(right, 5).otherwise(0)


def on_edge(meta: Meta) -> Column:
    return (F.col("row") == 0) | (F.col("row") == meta.ny - 1) | (F.col("col") == 0) | (F.col("col") == meta.nx - 1)


def can_leave(meta: Meta) -> Column:
    """Whether water may leave the raster at a cell."""
    if meta.mode == "custom":
        return F.col("bc") == OUTLET
    if meta.mode == "periodic_EW":
        return (F.col("row") == 0) | (F.col("row") == meta.ny - 1)
    if meta.mode == "periodic_NS":
        return (F.col("col") == 0) | (F.col("col") == meta.nx - 1)
    return on_edge(meta)


def is_nodata(meta: Meta) -> Column:
    return F.col("bc") == NODATA if meta.mode == "custom" else F.lit(False)


#: Cells on a side of a tile.
TILE = 128


def tiled(meta: Meta, size: int = 2 * TILE) -> Callable[[Column], Column]:
    """Tiles as a function of the cell's number, for the loops of plans.iterate."""
    across = -(-meta.nx // size)
    return lambda i: F.floor(i / (meta.nx * size)) * across + F.floor(F.pmod(i, F.lit(meta.nx)) / size)


def _copies(place: str, n: int, wraps: bool) -> Column:
    """(tile, place) of a row or column: in its own tile and, at a tile's border, in the next; past the far ends if wrapped."""
    at, last = F.col(place), (n - 1) // TILE
    own = F.floor(at / TILE)
    pair = lambda tile, where: F.struct(tile.cast("long").alias("t"), where.cast("long").alias("at"))
    more = [
        F.when((F.pmod(at, F.lit(TILE)) == 0) & (at > 0), pair(own - 1, at)),
        F.when((F.pmod(at + 1, F.lit(TILE)) == 0) & (at < n - 1), pair(own + 1, at)),
    ]
    if wraps:
        more += [F.when(at == 0, pair(F.lit(last), F.lit(n))), F.when(at == n - 1, pair(F.lit(0), F.lit(-1)))]
    return F.array_compact(F.array(pair(own, at), *more))


def gather(raster: Raster, *fields: str, eight: bool = False) -> DataFrame:
    """The cells with each field of each neighbour, as field_direction (i_t, z_t, ...); null where there is none.

    Cells are dealt to tiles in one shuffle, those at a tile's border to the tiles beside it too; a task lays a tile's rows
    out as a grid and takes all neighbours at once, diagonals included. Wrapped axes have the far end beside their first and
    last tile. In custom mode a cell of code 9 wraps on the axis of its edge (a corner: north-south), and a cell of code 0 is
    nobody's neighbour.
    """
    meta, fields, names = raster.meta, tuple(dict.fromkeys(("i", *fields))), raster.cells.columns
    custom = meta.mode == "custom"
    wraps_ew, wraps_ns = custom or meta.mode == "periodic_EW", custom or meta.mode == "periodic_NS"
    directions = D8 if eight else D4
    df = raster.cells.select("*", F.explode(_copies("row", meta.ny, wraps_ns)).alias("__r"))
    df = df.select(*names, "__r", F.explode(_copies("col", meta.nx, wraps_ew)).alias("__c"))
    df = df.select(*names, F.col("__r.t").alias("__tr"), F.col("__c.t").alias("__tc"), F.col("__r.at").alias("__r"), F.col("__c.at").alias("__c"))
    kinds = raster.cells.schema
    schema = T.StructType([*kinds.fields, *(T.StructField(f"{f}_{d}", kinds[f].dataType) for d, _, _ in directions for f in fields)])

    def near(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        r, c, row, col = (np.asarray(part[n], np.int64) for n in ("__r", "__c", "row", "col"))
        r0, c0 = int(r.min()) - 1, int(c.min()) - 1
        at = np.full((int(r.max()) - r0 + 2, int(c.max()) - c0 + 2), -1, np.int64)
        at[r - r0, c - c0] = np.arange(len(r))
        tr, tc = part["__tr"][0].as_py(), part["__tc"][0].as_py()
        own = np.flatnonzero((r == row) & (c == col) & (row // TILE == tr) & (col // TILE == tc))
        kept = part.select(names).take(pa.array(own))
        r, c, row, col = r[own] - r0, c[own] - c0, row[own], col[own]
        out = [kept[n] for n in names]
        if custom:
            code = np.asarray(pc.fill_null(part["bc"].cast(pa.int64()), NODATA))
            coded, frame = code[own] == PERIODIC, (row == 0) | (row == meta.ny - 1)
            held = np.append(code != NODATA, False)
        for _, dr, dc in directions:
            to = at[r + dr, c + dc]
            if custom:  # an axis wraps only at cells of code 9
                over_ns, over_ew = (row + dr < 0) | (row + dr >= meta.ny), (col + dc < 0) | (col + dc >= meta.nx)
                to = np.where((over_ns & ~(coded & frame)) | (over_ew & ~(coded & ~frame)) | ~held[to], -1, to)
            places = pa.array(to, mask=to < 0)
            out += [part[f].take(places) for f in fields]
        return pa.table(out, names=schema.names)

    return df.groupBy("__tr", "__tc").applyInArrow(near, schema)


def edges(raster: Raster, *fields: str, eight: bool = False) -> DataFrame:
    """Directed neighbour pairs (i, k, j, each field and field_j): k counts directions, absent links have no row."""
    directions = D8 if eight else D4
    near = gather(raster, *fields, eight=eight)
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"i_{d}").alias("j"), *(F.col(f"{f}_{d}").alias(f"{f}_j") for f in fields)) for k, (d, _, _) in enumerate(directions)])
    return near.select("i", *fields, F.explode(pairs).alias("e")).where("e.j is not null").select("i", *fields, "e.*")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def tile_ids(meta: Meta, size: int, shift: tuple[int, int] = (0, 0), of: Column | None = None) -> Column:
    """Tiles counted from 1 row by row, rolled by (rows, columns), of each cell or of the cell number `of`."""
    across = -(-meta.nx // size)
    row, col = (F.col("row"), F.col("col")) if of is None else (F.floor(of / meta.nx), F.pmod(of, F.lit(meta.nx)))
    r, c = F.floor(F.pmod(row - shift[0], F.lit(meta.ny)) / size), F.floor(F.pmod(col - shift[1], F.lit(meta.nx)) / size)
    return (r * across + c + 1).cast("long")
