"""Receivers: the neighbour that a cell drains to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.functions.columns import drawn
from catchwater.operators.grid import D4, D8, Raster, gather, is_nodata


def first_largest(values: list[Column], results: list[Column], otherwise: Column) -> Column:
    """The result of the first largest positive value, or `otherwise`; nulls do not take part."""
    most = F.greatest(F.lit(0.0), *values)
    chain = F.when(most <= 0, otherwise)
    return reduce(lambda c, vr: c.when(vr[0] == most, vr[1]), zip(values, results, strict=True), chain)


def receivers(raster: Raster, field: str = "z", eight: bool = False, diagonal: float = 1.0) -> DataFrame:
    """(i, rcv): steepest descent; equal slopes go to the first direction; a flat or lowest cell is its own receiver.

    Cells without data are left out. diagonal: length of a diagonal step in cells.
    """
    near = gather(raster, field, eight=eight).where(~is_nodata(raster.meta))
    directions = D8 if eight else D4
    slopes = [(F.col(field) - F.col(f"{field}_{d}")) / F.lit(raster.meta.dx * (diagonal if r and c else 1.0)) for d, r, c in directions]
    return near.select("i", first_largest(slopes, [F.col(f"i_{d}") for d, _, _ in directions], F.col("i")).alias("rcv"))


def stochastic_receivers(raster: Raster, seed: int, reps: int = 1, field: str = "z", exponent: float = 0.5) -> DataFrame:
    """(rep, i, rcv): the largest of uniform * slope**exponent over lower neighbours, for `reps` draws at once.

    The draw is a function of seed, rep, cell and direction, so it does not depend on partitions or retries.
    """
    near = gather(raster, field).where(~is_nodata(raster.meta)).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    values = []
    for k, (d, _, _) in enumerate(D4):
        slope = (F.col(field) - F.col(f"{field}_{d}")) / F.lit(raster.meta.dx)
        values.append(F.when(slope > 0, drawn(seed, F.col("rep"), F.col("i"), F.lit(k)) * F.pow(slope, F.lit(exponent))))
    return near.select("rep", "i", first_largest(values, [F.col(f"i_{d}") for d, _, _ in D4], F.col("i")).alias("rcv"))


def donors(links: DataFrame) -> DataFrame:
    """(i, donors, n): the cells that drain into i, in order."""
    return links.where("rcv <> i").groupBy(F.col("rcv").alias("i")).agg(F.sort_array(F.collect_list("i")).alias("donors"), F.count("*").alias("n"))


def pits(raster: Raster, links: DataFrame, leave: Column) -> DataFrame:
    """Cells that drain nowhere and where water cannot leave."""
    return links.where("rcv = i").join(raster.cells.where(~leave), "i", "left_semi").select("i")
