"""Walkers on a raster: seeded placement, steps downhill, claims of cells, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.functions.columns import drawn
from catchwater.operators.grid import D4, D8, Raster, can_leave, gather, is_nodata
from catchwater.operators.routing import first_largest
from catchwater.operators.scan import prefix_sum
from catchwater.plans.iterate import dropped, written


def numbered(raster: Raster, inside: bool = True) -> tuple[DataFrame, int]:
    """(k, pos) of the cells that can hold a walker (inside: where water cannot leave), counted from 0, and how many there are."""
    good = ~is_nodata(raster.meta) & (~can_leave(raster.meta) if inside else F.lit(True))
    valid = prefix_sum(raster.cells.withColumn("x", good.cast("long")), "i", "x").where("x = 1").select((F.col("total") - 1).alias("k"), F.col("i").alias("pos"))
    valid = written(valid, "cells")
    total = valid.count()
    if not total:
        raise ValueError("no cell can hold a walker")
    return valid, total


def placed(raster: Raster, n: int, seed: int, inside: bool = True) -> DataFrame:
    """(pid, pos): n walkers on random cells with data, by a draw of seed and pid."""
    valid, total = numbered(raster, inside)
    walkers = raster.cells.sparkSession.range(n).select(F.col("id").alias("pid"), F.floor(drawn(seed, F.col("id")) * total).alias("k"))
    return walkers.join(valid, "k").select("pid", "pos")


def next_cells(raster: Raster, field: str = "z", eight: bool = False, seed: int | None = None, exponent: float = 0.0) -> DataFrame:
    """(i, next, lowest): the steepest lower neighbour (times a seeded uniform to the exponent), itself if none, and the lowest neighbour's height."""
    directions = D8 if eight else D4
    values = []
    for k, (d, _, _) in enumerate(directions):
        s = (F.col(field) - F.col(f"{field}_{d}")) / raster.meta.dx
        values.append(F.when(s > 0, s if seed is None else s * F.pow(drawn(seed, F.col("i"), F.lit(k)), F.lit(exponent))))
    near = gather(raster, field, eight=eight)
    lowest = F.least(*[F.col(f"{field}_{d}") for d, _, _ in directions])
    return near.select("i", first_largest(values, [F.col(f"i_{d}") for d, _, _ in directions], F.col("i")).alias("next"), lowest.alias("lowest"))


def moved(walkers: DataFrame, nexts: DataFrame) -> DataFrame:
    """(pid, pos) after one step; a walker on a lowest cell stays."""
    return walkers.join(nexts.select(F.col("i").alias("pos"), "next"), "pos").select("pid", F.col("next").alias("pos"))


def histogram(walkers: DataFrame) -> DataFrame:
    """(pos, n): walkers on each cell."""
    return walkers.groupBy("pos").agg(F.count("*").alias("n"))


def _first(claims: DataFrame) -> DataFrame:
    """(pid, pos): of the walkers that claim a cell, the smallest."""
    return claims.groupBy("pos").agg(F.min("pid").alias("pid")).select("pid", "pos")


def collision_step(raster: Raster, walkers: DataFrame, seed: int, step: int = 0, eight: bool = False, lift: float = 5e-3, draws: int = 10_000) -> tuple[Raster, DataFrame]:
    """One step in which a cell takes one walker.

    Walkers at outlets start anew; those on a local minimum of z + h raise its water to just above the lowest neighbour;
    all propose their next cell; the smallest pid gets a cell. The others draw cells until each has a free one: a draw
    depends on seed, step, attempt and pid. More walkers than cells are an error.
    """
    surface = raster.with_columns(zh=F.col("z") + F.col("h"))
    nexts = next_cells(surface, "zh", eight).join(surface.cells.select("i", "zh", (can_leave(raster.meta) | is_nodata(raster.meta)).alias("out")), "i")
    at = walkers.join(nexts.select(F.col("i").alias("pos"), "next", "lowest", "zh", "out"), "pos")
    low = at.where("not out and zh <= lowest").select(F.col("pos").alias("i"), "lowest").distinct()
    h = raster.cells.join(low, "i", "left").withColumn("h", F.when(F.col("lowest").isNull(), F.col("h")).otherwise(F.greatest(F.col("h"), F.col("lowest") + F.lit(lift) - F.col("z"))))
    valid, total = numbered(raster)
    settled = written(_first(at.where("not out").select("pid", F.col("next").alias("pos"))), "walkers")
    left = written(walkers.select("pid").join(settled, "pid", "left_anti"), "left")
    for attempt in range(draws):
        n = left.count()
        if not n:
            return raster.with_cells(h.select(*raster.cells.columns)), settled
        if n > total:
            raise ValueError("there are more walkers than cells")
        drawn_ = left.select("pid", F.floor(drawn(seed, F.lit(step), F.lit(attempt), F.col("pid")) * total).alias("k")).join(valid, "k").select("pid", "pos")
        won = _first(drawn_.join(settled.select("pos"), "pos", "left_anti"))
        before, settled = settled, written(settled.union(won), "walkers")
        old, left = left, written(left.join(settled, "pid", "left_anti"), "left")
        dropped(before, old)
    raise ValueError("walkers found no free cell")
