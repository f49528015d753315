"""Sums along flow paths: single receivers, several receivers, ensembles, affine recurrences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.functions.columns import positive_slope
from catchwater.operators.grid import D4, TILE, Meta, Raster, can_leave, edges, gather, is_nodata, tiled
from catchwater.operators.routing import stochastic_receivers
from catchwater.plans import condense
from catchwater.plans.condense import Blocks, accumulated
from catchwater.plans.iterate import Block, ancestors, by_index, descendants


def as_tree(links: DataFrame, *more: str) -> DataFrame:
    """Receiver links as parent links: p is null at a root."""
    return links.withColumn("p", F.when(F.col("rcv") != F.col("i"), F.col("rcv"))).drop("rcv").select(*(c for c in links.columns if c != "rcv" and c not in more), "p", *more)


def _blocks(meta: Meta | None) -> Block:
    return by_index if meta is None else tiled(meta)


def _levels(meta: Meta | None) -> Blocks:
    """Tiles whose side grows eightfold with each level."""
    return condense.by_index if meta is None else lambda level: tiled(meta, 2 * TILE << 3 * level)


def drainage_cells(links: DataFrame, meta: Meta | None = None) -> DataFrame:
    """(i, q): how many cells drain through i, itself included. meta: the raster's, to follow paths by tiles."""
    return descendants(as_tree(links).withColumn("q", F.lit(1).cast("long")), block=_blocks(meta))


def accumulate(links: DataFrame, sources: DataFrame, value: str = "q", meta: Meta | None = None) -> DataFrame:
    """(i, value): the sum of sources (i, value) over all cells that drain through i."""
    return descendants(as_tree(links).join(sources.select("i", value), "i"), value, block=_blocks(meta))


def constant_discharge(raster: Raster, links: DataFrame, rate: float, area: bool = True) -> DataFrame:
    """(i, q) of a rate everywhere, times the cell area or not; counted in whole cells first."""
    unit = rate * raster.meta.dx**2 if area else rate
    return drainage_cells(links, raster.meta).select("i", (F.col("q") * F.lit(unit)).alias("q"))


def ensemble(raster: Raster, rate: float, reps: int, seed: int, area: bool = True, memory: float | None = None) -> DataFrame:
    """(i, q): mean of `reps` stochastic routings or, with `memory`, their exponential average from 0 in order of draw.

    All draws run in one pass, keyed by draw.
    """
    links = stochastic_receivers(raster, seed, reps)
    counts = descendants(as_tree(links).withColumn("q", F.lit(1).cast("long")), keys=("rep",), block=tiled(raster.meta))
    weight = F.lit(1.0 / reps) if memory is None else F.lit(1 - memory) * F.pow(F.lit(float(memory)), F.lit(reps - 1) - F.col("rep"))
    unit = rate * raster.meta.dx**2 if area else rate
    return counts.groupBy("i").agg((F.sum(F.col("q") * weight) * unit).alias("q"))


def ensemble_of(raster: Raster, sources: DataFrame, reps: int, seed: int, field: str = "z") -> DataFrame:
    """(i, q): the mean over `reps` stochastic routings of what sources (i, q) gather, all draws in one pass, keyed by draw."""
    tree = as_tree(stochastic_receivers(raster, seed, reps, field)).join(sources.select("i", "q"), "i")
    return descendants(tree, keys=("rep",), block=tiled(raster.meta)).groupBy("i").agg((F.sum("q") / reps).alias("q"))


def with_loss(links: DataFrame, sources: DataFrame, kept: DataFrame, meta: Meta | None = None) -> DataFrame:
    """(i, q, loss): each cell keeps the fraction a of what reaches it (its own source included) and passes the rest on.

    kept: (i, a). The mass that reaches a cell is a sum over paths of products of 1 - a; see plans.condense.
    """
    graph = links.where("rcv <> i").select(F.col("i").alias("src"), F.col("rcv").alias("dst"))
    weights = graph.join(kept.select(F.col("i").alias("src"), (F.lit(1.0) - F.col("a")).alias("w")), "src")
    return accumulated(weights, sources, _levels(meta)).join(kept, "i", "left").select("i", "q", (F.col("q") * F.coalesce("a", F.lit(0.0))).alias("loss"))


def slope_weights(raster: Raster, field: str = "z", emit: Column | None = None, *carried: str) -> DataFrame:
    """(i, carried, k, j, s, w): links to lower neighbours, their slope and its share of the cell's downward slopes.

    emit: which cells send anything (all but cells without data by default). The four slopes stand in one gathered row and
    are added in the order of directions.
    """
    near = gather(raster, field)
    if emit is not None:
        near = near.where(emit)
    slope = {d: positive_slope(F.col(field), F.col(f"{field}_{d}"), raster.meta.dx) for d, _, _ in D4}
    near = near.select("i", *carried, *(F.col(f"i_{d}") for d in slope), *(s.alias(f"s_{d}") for d, s in slope.items()))
    near = near.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"s_{d}") for d in slope]))
    links = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"i_{d}").alias("j"), F.col(f"s_{d}").alias("s")) for k, d in enumerate(slope)])
    return near.select("i", *carried, "total", F.explode(F.filter(links, lambda x: x["s"] > 0)).alias("e")).select("i", *carried, "e.*", (F.col("e.s") / F.col("total")).alias("w"))


def multiple_flow(raster: Raster, sources: DataFrame, field: str = "z") -> DataFrame:
    """(i, q): sources shared over all lower neighbours by slope."""
    w = slope_weights(raster, field)
    return accumulated(w.select(F.col("i").alias("src"), F.col("j").alias("dst"), "w"), sources, _levels(raster.meta))


def indegree(raster: Raster, field: str = "z") -> DataFrame:
    """(i, n): how many neighbours are strictly higher."""
    return edges(raster, field).groupBy("i").agg(F.count_if(F.col(f"{field}_j") > F.col(field)).alias("n"))


def affine(links: DataFrame, a: str = "a", b: str = "b", meta: Meta | None = None) -> DataFrame:
    """(i, x) with x = a * x[rcv] + b; at a root x = b. links: (i, rcv, a, b)."""
    tree = links.select("i", F.when(F.col("rcv") != F.col("i"), F.col("rcv")).alias("p"), F.when(F.col("rcv") != F.col("i"), F.col(a)).otherwise(F.lit(0.0)).alias("a"), F.col(b).alias("b"))
    done = ancestors(tree, {"a": "a", "b": "b"}, {"a": lambda n, f: n["a"] * f["a"], "b": lambda n, f: n["b"] + n["a"] * f["b"]}, block=_blocks(meta))
    return done.select("i", F.col("b").alias("x"))


def discharge_sources(raster: Raster, rate: float) -> DataFrame:
    """(i, q): rain in volume a second."""
    return raster.cells.where(~is_nodata(raster.meta)).select("i", F.lit(rate * raster.meta.dx**2).alias("q"))


def outlets(raster: Raster) -> DataFrame:
    return raster.cells.where(can_leave(raster.meta)).select("i")
