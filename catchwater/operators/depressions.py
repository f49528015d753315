"""Depressions: basins, their lowest saddles, rerouting by carving or jumping, filling and breaching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.functions.columns import larger, lesser
from catchwater.operators.accumulate import as_tree
from catchwater.operators.grid import D4, Meta, Raster, can_leave, edges, gather, tiled
from catchwater.plans import envelope, spill
from catchwater.plans.iterate import Block, ancestors, by_index, descendants, dropped, written


def roots(links: DataFrame, meta: Meta | None = None) -> DataFrame:
    """(i, root): the cell at the end of each cell's path."""
    tree = as_tree(links).withColumn("root", F.coalesce("p", "i"))
    return ancestors(tree, {"root": "root"}, {"root": lambda near, far: far["root"]}, block=by_index if meta is None else tiled(meta))


def basins(raster: Raster, links: DataFrame) -> DataFrame:
    """(i, root, bid): bid is the pit's index plus 1, or 0 where the path ends at a cell that water can leave."""
    leave = raster.cells.select(F.col("i").alias("root"), can_leave(raster.meta).alias("leave"))
    return roots(links, raster.meta).join(leave, "root").select("i", "root", F.when(F.col("leave"), F.lit(0)).otherwise(F.col("root") + 1).cast("long").alias("bid"))


def saddles(raster: Raster, labels: DataFrame, field: str = "z") -> DataFrame:
    """(bid, saddle, outlet, height, other): each basin's lowest way out, by the labels (i, bid) of basins.

    Labels are gathered with the heights, so links need no join. Ties go by (height, lesser cell, greater cell), one order
    for all basins, so choices can only loop in pairs.
    """
    cells = raster.cells.select("i", "row", "col", F.col(field).alias("v"), *(["bc"] if raster.meta.mode == "custom" else [])).join(labels.select("i", "bid"), "i")
    pairs = edges(raster.with_cells(cells), "v", "bid").where("bid <> 0 and bid <> bid_j")
    way = F.struct(F.greatest("v", "v_j").alias("height"), F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "j", F.col("bid_j").alias("other"))
    best = pairs.groupBy("bid").agg(F.min(way).alias("s"))
    return best.select("bid", F.col("s.i").alias("saddle"), F.col("s.j").alias("outlet"), F.col("s.height").alias("height"), F.col("s.other").alias("other"))


def spill_pairs(raster: Raster, labels: DataFrame, field: str = "z") -> DataFrame:
    """(a, b, height, low, high, i, j): the lowest saddle from each basin a to each other basin b, from cell i to cell j."""
    cells = raster.cells.select("i", "row", "col", F.col(field).alias("v"), *(["bc"] if raster.meta.mode == "custom" else [])).join(labels.select("i", "bid"), "i")
    pairs = edges(raster.with_cells(cells), "v", "bid").where("bid <> 0 and bid <> bid_j")
    way = F.struct(F.greatest("v", "v_j").alias("height"), F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "j")
    return pairs.groupBy(F.col("bid").alias("a"), F.col("bid_j").alias("b")).agg(F.min(way).alias("s")).select("a", "b", "s.*")


def _carved(links: DataFrame, found: DataFrame, block: Block = by_index) -> DataFrame:
    """Turns round the links from each saddle down to its pit and leads the saddle to its outlet."""
    tree = as_tree(links)
    marks = tree.join(found.select(F.col("saddle").alias("i"), F.lit(1).cast("long").alias("q")), "i", "left").select("i", "p", F.coalesce("q", F.lit(0).cast("long")).alias("q"))
    below = descendants(marks, block=block).where("q > 0").select("i")  # cells on the way from a saddle to its pit
    turned = tree.where("p is not null").join(below, "i", "left_semi").select(F.col("p").alias("i"), F.col("i").alias("new"), F.lit(1).alias("rank"))
    changes = turned.union(found.select(F.col("saddle").alias("i"), F.col("outlet").alias("new"), F.lit(0).alias("rank")))
    changes = changes.groupBy("i").agg(F.min(F.struct("rank", "new"))["new"].alias("new"))
    return links.join(changes, "i", "left").select("i", F.coalesce("new", "rcv").alias("rcv"))


def reroute(raster: Raster, links: DataFrame, carve: bool = True, field: str = "z", at_once: int = spill.AT_ONCE) -> DataFrame:
    """(i, rcv) without pits: each basin drains over its lowest saddle, joined basins over theirs, see plans.spill.

    carve: turn the path from saddle to pit round; else the pit jumps to the outlet cell. Without any way out of the raster
    the last basin keeps its pit. The raster is read for basins, for their saddles and for the new links, however many rounds
    of joining there are.
    """
    links = written(links.select("i", "rcv"), "receivers")
    labels = written(basins(raster, links), "basins")
    found = spill.tree(spill_pairs(raster, labels, field), carve, _carved, at_once)
    if carve:
        new = _carved(links, found, tiled(raster.meta))
    else:
        jump = found.select((F.col("bid") - 1).alias("i"), F.col("outlet").alias("new"))
        new = links.join(jump, "i", "left").select("i", F.coalesce("new", "rcv").alias("rcv"))
    out = written(new, "receivers")
    dropped(links, labels, found)
    return out


def _heights(raster: Raster, links: DataFrame, field: str) -> DataFrame:
    return as_tree(links).join(raster.cells.select("i", F.col(field).cast("double").alias("v")), "i")


def fill(raster: Raster, links: DataFrame, epsilon: float = 1e-3, field: str = "z") -> DataFrame:
    """(i, z): every cell at least epsilon above its receiver: max(z, filled receiver + epsilon)."""
    done = ancestors(
        _heights(raster, links, field),
        {"m": F.col("v"), "d": F.lit(1).cast("long")},
        {"m": lambda n, f: larger(n["m"], f["m"] + n["d"] * epsilon), "d": lambda n, f: n["d"] + f["d"]},
        block=tiled(raster.meta),
    )
    return done.select("i", F.col("m").alias("z"))


def breach(raster: Raster, links: DataFrame, slope: float = 0.56, field: str = "z") -> DataFrame:
    """(i, z): no steeper than `slope` above the receiver: min(z, capped receiver + slope * dx); a root caps nothing."""
    ends = links.where("rcv = i").select(F.col("i").alias("rcv"), F.lit(True).alias("end"))
    tree = links.join(ends, "rcv", "left").select("i", F.when(F.col("end").isNull(), F.col("rcv")).alias("p"))
    step = slope * raster.meta.dx
    done = ancestors(
        tree.join(raster.cells.select("i", F.col(field).cast("double").alias("v")), "i"),
        {"m": F.col("v"), "d": F.lit(1).cast("long")},
        {"m": lambda n, f: lesser(n["m"], f["m"] + n["d"] * step), "d": lambda n, f: n["d"] + f["d"]},
        block=tiled(raster.meta),
    )
    return done.select("i", F.col("m").alias("z"))


def fill_into_water(raster: Raster, links: DataFrame, epsilon: float = 1e-3) -> DataFrame:
    """(i, z, h): the surface z + h filled; what it rises is water."""
    surface = raster.with_columns(zh=F.col("z") + F.col("h"))
    risen = fill(surface, links, epsilon, "zh").select("i", F.col("z").alias("zf"))
    return raster.cells.join(risen, "i").select("i", "z", (F.col("h") + F.col("zf") - (F.col("z") + F.col("h"))).alias("h"))


def split_surface(surface: str = "zh", bed: str = "z") -> dict:
    """Bed and depth of a surface: a surface below the bed lowers the bed to it."""
    below = F.col(surface) < F.col(bed)
    return {"h": F.when(below, F.lit(0.0)).otherwise(F.col(surface) - F.col(bed)), bed: F.when(below, F.col(surface)).otherwise(F.col(bed))}


def carve_down(raster: Raster, links: DataFrame, drop: float = 2e-3, field: str = "z") -> DataFrame:
    """(i, z): from every local minimum that water cannot leave, the steepest path lowered by `drop` a step until a lower cell or a root.

    links: receivers that lead out of the pits, see reroute(); a pit that is its own receiver stays as it is. Where ways
    meet, the lowest wins; see plans.envelope.
    """
    near = gather(raster, field)
    low = F.least(*[F.col(f"{field}_{d}") for d, _, _ in D4])
    starts = near.select("i", F.col(field).alias("z"), (~can_leave(raster.meta) & (F.col(field) <= low)).alias("start"))
    cells = starts.join(links, "i").select("i", "z", F.when(F.col("rcv") != F.col("i"), F.col("rcv")).alias("p"), F.coalesce("start", F.lit(False)).alias("start"))
    lowered = envelope.lowest(cells, drop, tiled(raster.meta))
    return raster.cells.select("i", F.col(field).alias("z")).join(lowered, "i", "left").select("i", F.coalesce("new", "z").alias("z"))
