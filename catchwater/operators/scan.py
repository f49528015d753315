"""Prefix sums and element-wise combinations of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchwater.operators.grid import Raster


def prefix_sum(df: DataFrame, index: str = "i", value: str = "x", block: int = 65_536, into: str = "total") -> DataFrame:
    """df with the inclusive sum of value in order of index.

    Two levels: sums inside blocks of the index in parallel windows, then one window over one row a block.
    """
    blocked = df.withColumn("__b", F.floor(F.col(index) / block))
    sums = blocked.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = sums.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__o"))
    inside = F.sum(value).over(Window.partitionBy("__b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    return blocked.withColumn(into, inside).join(before, "__b").withColumn(into, F.col(into) + F.col("__o")).drop("__b", "__o")


def zipped(a: Raster, b: DataFrame, field: str, other: str, weight: float | None = None, mean: bool = False) -> Raster:
    """field + other, field + weight * other, or weight * other + (1 - weight) * field; b: (i, other)."""
    w = F.lit(1.0 if weight is None else weight)
    new = w * F.col("__o") + (F.lit(1.0) - w) * F.col(field) if mean else F.col(field) + w * F.col("__o")
    joined = a.cells.join(b.select("i", F.col(other).alias("__o")), "i")
    return a.with_cells(joined.withColumn(field, new).select(*a.cells.columns))


def scaled(a: Raster, field: str, factor: float) -> Raster:
    return a.with_columns(**{field: F.col(field) * F.lit(factor)})


def swapped(a: Raster, one: str, two: str) -> Raster:
    return a.with_columns(**{one: F.col(two), two: F.col(one)})
