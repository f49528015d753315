"""Masks and editors' data operations: nodata neighbours, sea level, polygons, brushes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.operators.grid import D4, OUTLET, Raster, any_of, gather, on_edge


def inside_polygon(points: Sequence[tuple[float, float]], x: Column, y: Column) -> Column:
    """Whether (x, y) is inside by the even-odd rule; false for fewer than three points."""
    if len(points) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        if y1 != y2:
            at = F.lit(float(x1)) + (y - F.lit(float(y1))) * F.lit((x2 - x1) / (y2 - y1))
            crossings = crossings + (((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < at)).cast("int")
    return F.pmod(crossings, F.lit(2)) == 1


def below_sea(raster: Raster, level: float) -> Raster:
    """bc = 0 where z is below the level."""
    return raster.with_columns(bc=F.when(F.col("z") < level, F.lit(0)).otherwise(F.col("bc")).cast("byte"))


def no_data(level: float | None = None) -> Column:
    missing = (F.col("bc") == 0) | F.isnan("z")
    return missing if level is None else missing | (F.col("z") < level)


def beside_nodata(raster: Raster, nodata: Column) -> DataFrame:
    """(i, beside): whether any of the four neighbours is without data."""
    near = gather(raster.with_columns(nd=nodata), "nd")
    return near.select("i", any_of([F.coalesce(F.col(f"nd_{d}"), F.lit(False)) for d, _, _ in D4]).alias("beside"))


def lasso_outlets(raster: Raster, nodata: Column, points: Sequence[tuple[float, float]]) -> Raster:
    """bc = 3 inside the polygon (of column, row points) at cells with data on the edge or beside missing data."""
    near = gather(raster.with_columns(nd=nodata), "nd")
    beside = any_of([F.coalesce(F.col(f"nd_{d}"), F.lit(False)) for d, _, _ in D4])
    on = inside_polygon(points, F.col("col").cast("double"), F.col("row").cast("double")) & ~F.col("nd") & (on_edge(raster.meta) | beside)
    return raster.with_cells(near.withColumn("bc", F.when(on, F.lit(OUTLET)).otherwise(F.col("bc")).cast("byte")).select(*raster.cells.columns))


def brush(raster: Raster, field: str, at: Sequence[tuple[int, int]], radius: int, amount: float) -> Raster:
    """field plus a Gaussian (sigma half the radius, summing to `amount`) around each (row, col) of a stroke."""
    sigma = max(radius / 2, 1e-9)
    kernel = {(r, c): math.exp(-(r * r + c * c) / (2 * sigma * sigma)) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius}
    total = sum(kernel.values())
    spark, meta = raster.cells.sparkSession, raster.meta
    drops = [(int(r + dr), int(c + dc), amount * w / total) for r, c in at for (dr, dc), w in kernel.items()]
    if not drops:
        return raster
    added = spark.createDataFrame(drops, "row long, col long, w double").where((F.col("row") >= 0) & (F.col("row") < meta.ny) & (F.col("col") >= 0) & (F.col("col") < meta.nx))
    added = added.groupBy((F.col("row") * meta.nx + F.col("col")).alias("i")).agg(F.sum("w").alias("w"))
    joined = raster.cells.join(added, "i", "left")
    return raster.with_cells(joined.withColumn(field, F.col(field) + F.coalesce("w", F.lit(0.0))).select(*raster.cells.columns))


def lasso_rain(raster: Raster, field: str, points: Sequence[tuple[float, float]], value: float, additive: bool = True, discharge: bool = False) -> Raster:
    """field plus value inside the polygon, or value shared over its cells; a discharge is divided by the cell area."""
    on = inside_polygon(points, F.col("col").cast("double"), F.col("row").cast("double"))
    share = value
    if not additive:
        share = value / max(raster.cells.where(on).count(), 1)
    if discharge:
        share /= raster.meta.dx**2
    return raster.with_columns(**{field: F.when(on, F.col(field) + F.lit(share)).otherwise(F.col(field))})
