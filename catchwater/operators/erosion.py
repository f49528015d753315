"""Uplift, stream-power erosion, sediment source and deposition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.operators.accumulate import affine, as_tree
from catchwater.operators.grid import Raster, can_leave
from catchwater.plans.iterate import some, written


@dataclass(frozen=True)
class Params:
    kr: float = 2e-5
    kd: float = 1e-2
    dt: float = 1e3
    m: float = 0.45


def uplift(raster: Raster, rate: Column | float, dt: float = 1e3, everywhere: bool = False) -> Raster:
    """z grows by rate * dt, at cells that water can leave only if `everywhere`."""
    risen = F.col("z") + (rate if isinstance(rate, Column) else F.lit(float(rate))) * F.lit(dt)
    return raster.with_columns(z=risen if everywhere else F.when(can_leave(raster.meta), F.col("z")).otherwise(risen))


def stream_power(raster: Raster, links: DataFrame, p: Params = Params()) -> DataFrame:
    """(i, z) after one implicit step: z' = (z + K z'[rcv]) / (1 + K) with K = kr q**m dt / dx; outlets keep z.

    The recurrence along the receivers is affine, so it takes as many rounds as the logarithm of the longest path.
    """
    k = F.lit(p.kr * p.dt / raster.meta.dx) * F.pow(F.col("q"), F.lit(p.m))
    leave = can_leave(raster.meta)
    terms = raster.cells.select("i", F.when(leave, F.lit(0.0)).otherwise(k / (1 + k)).alias("a"), F.when(leave, F.col("z")).otherwise(F.col("z") / (1 + k)).alias("b"), leave.alias("leave"))
    ends = links.join(terms, "i").select("i", F.when(F.col("leave"), F.col("i")).otherwise(F.col("rcv")).alias("rcv"), "a", "b")
    return affine(ends, meta=raster.meta).select("i", F.col("x").alias("z"))


def sediment_source(before: DataFrame, after: DataFrame, dx: float, dt: float) -> DataFrame:
    """(i, qs): what erosion between two states gives a second."""
    new = after.select("i", F.col("z").alias("new"))
    return before.select("i", "z").join(new, "i").select("i", ((F.col("z") - F.col("new")) * F.lit(dx * dx / dt)).alias("qs"))


def deposit(raster: Raster, links: DataFrame, p: Params = Params(), rounds: int = 64) -> DataFrame:
    """(i, z, qs): sediment laid down at ever farther receivers.

    Each round, cell i (no outlet, qs > 0) gives min(kd qs / q[p], qs / dx**2) to p, its receiver, then p's receiver after
    twice the way, and so on; all cells of a round act at once.
    """
    dx2 = raster.meta.dx**2
    state = written(raster.cells.select("i", "z", "q", "qs", can_leave(raster.meta).alias("leave")).join(as_tree(links), "i"), "sediment")
    for _ in range(rounds):
        if not some(state.where("p is not null")):
            break
        up = state.select(F.col("i").alias("p"), F.col("q").alias("qp"), F.col("p").alias("up"))
        step = state.join(up, "p", "left")
        on = F.col("up").isNotNull() & ~F.col("leave") & (F.col("qs") > 0)
        step = written(step.withColumn("d", F.when(on, F.least(F.lit(p.kd) * F.col("qs") / F.col("qp"), F.col("qs") / dx2)).otherwise(F.lit(0.0))), "sediment")
        gain = step.where("d > 0").groupBy(F.col("p").alias("i")).agg(F.sum("d").alias("gain"))
        new = step.join(gain, "i", "left").select("i", (F.col("z") + F.coalesce("gain", F.lit(0.0)) * F.lit(p.dt)).alias("z"), "q", (F.col("qs") - F.col("d") * dx2).alias("qs"), "leave", F.col("up").alias("p"))
        state = written(new, "sediment")
    return state.select("i", "z", "qs")


def stream_power_transport(raster: Raster, links: DataFrame, p: Params = Params(), implicit: bool = False, rounds: int = 5, limit: int = 50, tolerance: float = 1e-3) -> Raster:
    """Erosion, its sediment and deposition: once, or until the mean change of z is small and `rounds` are done.

    `limit` implicit rounds that do not settle are an error.
    """
    first = raster.cells
    state = raster
    for k in range(limit if implicit else 1):
        eroded = written(stream_power(raster.with_cells(first), links, p), "eroded")
        qs = sediment_source(first, eroded, raster.meta.dx, p.dt)
        cells = first.drop("z", "qs").join(eroded, "i").join(qs, "i")
        laid = deposit(raster.with_cells(cells), links, p).select("i", F.col("z").alias("z1"))
        done = written(state.cells.join(laid, "i"), "laid")
        change = done.agg(F.avg(F.abs(F.col("z1") - F.col("z")))).first()[0] or 0.0
        state = raster.with_cells(done.withColumn("z", F.col("z1")).drop("z1"))
        if not implicit or (k + 1 >= rounds and change <= tolerance):
            return state
    raise ValueError("erosion and deposition did not settle")
