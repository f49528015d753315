"""The lowest value that comes down to each cell of a forest, where a value falls by a step at each cell and is cut off by rising ground.

A value v passes a cell of height z if v <= z - drop, and goes on as v - drop. Passing a whole path is again such a rule: n
steps and one bar, the least of the bars on the way. So only the lowest value at a cell counts, and the rule for two pieces
of a path is found from theirs. A task follows all paths of a tile by pointer doubling and leaves what comes out at its border
and the rules of its entries; the entries, a forest of their own, are solved at once where one block holds them, else by
doubling; a second reading of the tiles brings what enters down to all cells. Rounds grow with the logarithm of the borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from catchwater.plans import iterate
from catchwater.plans.iterate import Block, dropped, written


def followed(up: np.ndarray, bar: np.ndarray, value: np.ndarray, drop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Brings values down along parents `up` (-1: none here).

    Returns the values, each cell's last cell here, steps and bar of the rule from the cell to beyond its last one, and
    whether the parents lead round.
    """
    up, bar, value, last = up.copy(), bar.copy(), value.copy(), np.arange(len(up))
    steps = np.ones(len(up), np.int64)
    for _ in range(len(up).bit_length() + 1):
        on = np.flatnonzero(up >= 0)
        if not len(on):
            break
        far, v = up[on], value[on]
        through = v <= bar[on]
        np.minimum.at(value, far[through], v[through] - steps[on][through] * drop)
        new = steps[on] + steps[far], np.minimum(bar[on], bar[far] + steps[on] * drop), last[far], up[far]
        steps[on], bar[on], last[on], up[on] = new
    return value, last, steps, bar, bool((up >= 0).any())


def _tile(part: pa.Table) -> tuple[np.ndarray, ...]:
    """Cells in order: i, z, parent (-1: none), parent's place here (-1), whether values start there."""
    part = part.filter(part["z"].is_valid()).sort_by("i")
    i, z, start = np.asarray(part["i"], np.int64), np.asarray(part["z"], np.float64), np.asarray(part["start"])
    p = np.asarray(pc.fill_null(part["p"], -1), np.int64)
    place = np.minimum(np.searchsorted(i, p), max(0, len(i) - 1))
    return i, z, p, np.where((p >= 0) & (i[place] == p), place, -1) if len(i) else p, start


def _down(tile: tuple[np.ndarray, ...], drop: float, entered: np.ndarray | None = None, values: np.ndarray | None = None):
    i, z, p, up, start = tile
    value = np.full(len(i), np.inf)
    if entered is not None:
        np.minimum.at(value, np.searchsorted(i, entered), values)
    first = start & (up >= 0)
    np.minimum.at(value, up[first], z[first] - drop)
    return followed(up, np.where(p < 0, -np.inf, z - drop), value, drop)


def lowest(cells: DataFrame, drop: float, block: Block, at_once: int | None = None) -> DataFrame:
    """(i, new): the value at each cell that one passes, of cells (i, z, p, start). A cell that starts sends z - drop to its parent.

    p is null where a path ends; no value passes there. Parents that lead round are an error.
    """
    at_once = iterate.BLOCK if at_once is None else at_once
    cells = written(cells.select("i", F.col("z").cast("double").alias("z"), "p", "start", block(F.col("i")).cast("long").alias("b")), "cells")
    crossing = cells.where(block(F.col("p")) != F.col("b")).select(F.col("p").alias("i"), block(F.col("p")).cast("long").alias("b")).distinct()
    rows = cells.unionByName(crossing, allowMissingColumns=True)
    seen = Observation()
    told = rows.groupBy("b").applyInArrow(lambda part: _border(part, drop), "i long, p long, v double, n long, bar double")
    border = written(told.observe(seen, F.min("n").alias("least"), F.count("n").alias("entries")), "border")
    if (seen.get["least"] or 1) < 0:
        raise ValueError("the links have a cycle")
    inflow = border.where("n is null").groupBy("i").agg(F.min("v").alias("v"))
    entries = border.where("n is not null").select("i", "p", "n", "bar").join(inflow, "i", "left").select("i", "p", "n", "bar", F.coalesce("v", F.lit(float("inf"))).alias("v"))
    if seen.get["entries"] <= at_once:
        solved = written(entries.withColumn("b", F.lit(0)).groupBy("b").applyInArrow(lambda part: _at_once(part, drop), "i long, v double"), "inflow")
        if some_nan(solved):
            raise ValueError("the links have a cycle")
    else:
        solved = _doubled(entries, drop)
    into = solved.where("v < double('inf')").select("i", "v", block(F.col("i")).cast("long").alias("b"))
    out = written(cells.groupBy("b").cogroup(into.groupBy("b")).applyInArrow(lambda own, more: _filled(own, more, drop), "i long, new double"), "lowered")
    dropped(cells, border, solved)
    return out


def some_nan(solved: DataFrame) -> bool:
    return bool(solved.where("isnan(v)").limit(1).count())


def _border(part: pa.Table, drop: float) -> pa.Table:
    """(i, null, v, null, null) for values that come out to cell i of another tile; (i, p, null, n, bar) for the rule of entry i."""
    entries = np.unique(np.asarray(part.filter(part["z"].is_null())["i"], np.int64))
    tile = _tile(part)
    i, z, p, up, start = tile
    value, last, steps, bar, ring = _down(tile, drop)
    leave = np.flatnonzero((p >= 0) & (up < 0))
    out = np.where(value[leave] <= z[leave] - drop, value[leave] - drop, np.inf)
    out = np.where(start[leave], np.minimum(out, z[leave] - drop), out)
    leave, out = leave[np.isfinite(out)], out[np.isfinite(out)]
    at = np.searchsorted(i, entries)
    to = p[last[at]]
    n = np.full(len(at), -1) if ring else steps[at]
    if ring and not len(at):
        entries, to, n, at = np.array([-1]), np.array([-1]), np.array([-1]), np.array([0])
    names = ["i", "p", "v", "n", "bar"]
    one = pa.table([pa.array(p[leave]), pa.nulls(len(leave), pa.int64()), pa.array(out), pa.nulls(len(leave), pa.int64()), pa.nulls(len(leave), pa.float64())], names=names)
    two = pa.table([pa.array(entries, pa.int64()), pa.array(to, pa.int64(), mask=to < 0), pa.nulls(len(at), pa.float64()), pa.array(n, pa.int64()), pa.array(bar[at])], names=names)
    return pa.concat_tables([one, two])


def _rules(part: pa.Table, drop: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Values of entries (i, p, n, bar, v) brought down along their rules, by doubling."""
    part = part.sort_by("i")
    i, p = np.asarray(part["i"], np.int64), np.asarray(pc.fill_null(part["p"], -1), np.int64)
    up = np.where(p >= 0, np.searchsorted(i, p), -1)
    value, steps, bar = (np.asarray(part[c]).copy() for c in ("v", "n", "bar"))
    for _ in range(len(i).bit_length() + 1):
        on = np.flatnonzero(up >= 0)
        if not len(on):
            return i, value, False
        far, v = up[on], value[on]
        through = v <= bar[on]
        np.minimum.at(value, far[through], v[through] - steps[on][through] * drop)
        steps[on], bar[on], up[on] = steps[on] + steps[far], np.minimum(bar[on], bar[far] + steps[on] * drop), up[far]
    return i, value, bool((up >= 0).any())


def _at_once(part: pa.Table, drop: float) -> pa.Table:
    """A ring is told by values that are no numbers."""
    i, value, ring = _rules(part, drop)
    return pa.table([pa.array(i), pa.array(np.full(len(i), np.nan) if ring else value)], names=["i", "v"])


def _doubled(entries: DataFrame, drop: float, depth: int = 40) -> DataFrame:
    state = written(entries, "rules")
    for _ in range(depth):
        if not state.where("p is not null").limit(1).count():
            return state.select("i", "v")
        sent = state.where("p is not null and v <= bar").groupBy(F.col("p").alias("i")).agg(F.min(F.col("v") - F.col("n") * F.lit(drop)).alias("more"))
        far = state.select(F.col("i").alias("p"), F.col("p").alias("p2"), F.col("n").alias("n2"), F.col("bar").alias("bar2"))
        step = state.join(far, "p", "left").join(sent, "i", "left")
        step = step.select("i", F.col("p2").alias("p"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.least("bar", F.coalesce(F.col("bar2") + F.col("n") * F.lit(drop), "bar")).alias("bar"), F.least("v", F.coalesce("more", "v")).alias("v"))
        before, state = state, written(step, "rules")
        dropped(before)
    raise ValueError("the links have a cycle")


def _filled(own: pa.Table, more: pa.Table, drop: float) -> pa.Table:
    tile = _tile(own)
    i, z, p, _, _ = tile
    value, *_ = _down(tile, drop, np.asarray(more["i"], np.int64), np.asarray(more["v"], np.float64))
    low = np.flatnonzero((p >= 0) & (value <= z - drop))
    return pa.table([pa.array(i[low]), pa.array(value[low])], names=["i", "new"])
