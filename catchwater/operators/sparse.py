"""Discharge on walkers' cells alone: a raster stored by tiles, of which steps read only those near walkers.

The raster is written once, a folder for each tile; what steps change is a small table laid over it. A step finds the cells
within two cells of its walkers, reads their tiles (the list of tiles prunes the scan) and writes these cells anew, so its
cost follows walkers, not the raster. Several walkers on a cell count once; those on cells without data do nothing. A cell
of code 9 is taken to face another of code 9.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.functions.columns import drawn, positive_slope
from catchwater.operators.grid import D4, TILE, Meta, Raster, any_of, gather, is_nodata, tile_ids
from catchwater.operators.hydro import Params
from catchwater.operators.particles import moved, next_cells
from catchwater.plans.iterate import dropped, shared_dir, written

#: Tiles of a stored raster, about: the list of tiles to read stays a small table.
TILES = 4096


@dataclass(frozen=True)
class Stored:
    """base: the cells with their tile, as stored; changed: the cells that differ from it, if any."""

    base: DataFrame
    changed: DataFrame | None
    meta: Meta

    def near(self, walkers: DataFrame, hops: int) -> tuple[Raster, list[DataFrame]]:
        """The cells within `hops` of the walkers, `on` where one stands, and the tables that they read."""
        side = _side(self.meta)
        reach = walkers.select(F.col("pos").alias("at")).distinct().select("at", F.explode(_around(self.meta, hops)).alias("i"))
        reach = reach.groupBy("i").agg(F.max(F.col("i") == F.col("at")).alias("on"))
        reach = written(reach.withColumn("tile", tile_ids(self.meta, side, of=F.col("i"))), "reach")
        tiles = written(reach.groupBy("tile").agg(F.count("*").alias("n")), "tiles")
        cells = self.base.join(tiles.where("n > 0"), "tile", "left_semi")
        if self.changed is not None:
            cells = cells.join(self.changed.select("i"), "i", "left_anti").unionByName(self.changed)
        return Raster(cells.drop("tile").join(reach.select("i", "on"), "i"), self.meta), [reach, tiles]

    def with_changed(self, cells: DataFrame) -> Stored:
        """The state with other values at some cells."""
        cells = cells.withColumn("tile", tile_ids(self.meta, _side(self.meta))).select(*self.base.columns)
        if self.changed is not None:
            cells = self.changed.join(cells.select("i"), "i", "left_anti").unionByName(cells)
        return replace(self, changed=written(cells, "changed"))

    def raster(self) -> Raster:
        """The whole raster as it stands."""
        cells = self.base
        if self.changed is not None:
            cells = cells.join(self.changed.select("i"), "i", "left_anti").unionByName(self.changed)
        return Raster(cells.drop("tile"), self.meta)


def _side(meta: Meta) -> int:
    """Cells on a side of a stored tile."""
    return TILE * max(1, math.ceil(math.sqrt(meta.nx * meta.ny / TILES) / TILE))


def _around(meta: Meta, hops: int) -> Column:
    """The numbers of the cells within `hops` steps of the cell number `at`; wrapped wherever some cell may wrap."""
    custom = meta.mode == "custom"
    row, col = F.floor(F.col("at") / meta.nx), F.pmod("at", F.lit(meta.nx))
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-hops, hops + 1) for c in range(abs(r) - hops, hops - abs(r) + 1)])
    moves = F.transform(steps, lambda s: F.struct((row + s["r"]).alias("r"), (col + s["c"]).alias("c")))
    place = lambda x, n, wraps: F.pmod(x, F.lit(n)) if wraps else x
    wrapped = F.transform(moves, lambda s: F.struct(place(s["r"], meta.ny, custom or meta.mode == "periodic_NS").alias("r"), place(s["c"], meta.nx, custom or meta.mode == "periodic_EW").alias("c")))
    inside = F.filter(wrapped, lambda s: (s["r"] >= 0) & (s["r"] < meta.ny) & (s["c"] >= 0) & (s["c"] < meta.nx))
    return F.transform(inside, lambda s: (s["r"] * meta.nx + s["c"]).cast("long"))


def stored(raster: Raster) -> Stored:
    """The raster written by tiles; rows of 128 cells' height are written by a task each, in order."""
    cells = raster.cells.withColumn("tile", tile_ids(raster.meta, _side(raster.meta)))
    path = f"{shared_dir(cells.sparkSession)}/tiles-{uuid.uuid4().hex}"
    cells.repartition("tile", F.floor(F.col("row") / TILE)).sortWithinPartitions("tile", "i").write.partitionBy("tile").parquet(path)
    base = cells.sparkSession.read.schema(cells.schema).parquet(path)
    base.__dict__["shared_path"] = path
    return Stored(base, None, raster.meta)


def _sloped(region: Raster) -> DataFrame:
    """The region's cells with their slope to each lower neighbour, s_t and so on, and their sum."""
    near = gather(region.with_columns(zh=F.col("z") + F.col("h")), "zh")
    near = near.withColumns({f"s_{d}": positive_slope(F.col("zh"), F.col(f"zh_{d}"), region.meta.dx) for d, _, _ in D4})
    return near.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"s_{d}") for d, _, _ in D4]))


def depth_step(state: Stored, walkers: DataFrame, p: Params = Params(), source: Column | None = None) -> Stored:
    """q and h after a step at the walkers' cells (pid, pos); the others stay.

    A cell's q is its source (a rate of depth; the rain if not given) over its area and what neighbours' shares of slope
    bring. It loses water by Manning's law where it slopes on both axes. The state given is left as it is.
    """
    dx, columns = state.meta.dx, state.base.drop("tile").columns
    region, read = state.near(walkers, 2)
    near = written(_sloped(region), "near")
    links = F.array(*[F.struct(F.col(f"i_{d}").alias("i"), (F.col("q") * F.col(f"s_{d}") / F.col("total")).alias("w")) for d, _, _ in D4])
    own = near.where(F.col("on") & ~is_nodata(state.meta))
    sent = near.where("total > 0").where(~is_nodata(state.meta)).select(F.explode(links).alias("e")).where("e.i is not null").select("e.*")
    got = sent.join(own.select("i"), "i", "left_semi").groupBy("i").agg(F.sum("w").alias("more"))
    mx, my = F.greatest("s_l", "s_r"), F.greatest("s_t", "s_b")
    leaves = F.lit(dx / p.manning) * F.pow("h", F.lit(5.0 / 3.0)) * F.sqrt(F.greatest(F.sqrt(mx * mx + my * my), F.lit(1e-4)))
    q = (source if source is not None else F.lit(p.rain)) * (dx * dx) + F.coalesce("more", F.lit(0.0))
    df = own.join(got, "i", "left").withColumns({"q": q, "leaves": F.when((mx > 0) & (my > 0) & (F.col("h") > 0), leaves).otherwise(0.0)})
    df = df.withColumn("h", F.greatest(F.lit(0.0), F.col("h") + F.lit(p.dt) * (F.col("q") - F.col("leaves")) / (dx * dx)))
    out = state.with_changed(df.select(*columns))
    dropped(near, *read)
    return out


def discharge_step(state: Stored, walkers: DataFrame, source: Column, seed: int, step: int = 0, lift: float = 1e-2) -> Stored:
    """q, the signed face shares wx (right) and wy (bottom), and h after a step at the walkers' cells and their neighbours.

    A walker's cell sets the faces towards its lower neighbours to its shares of slope; without any its water rises by a
    draw of seed, step and cell, times `lift`. Neighbours without a walker then have what leaves them scaled to sum to 1,
    so that a face taken over by a walker doesn't lose or add water. q becomes the source and what faces bring from q.
    """
    columns, nodata = state.base.drop("tile").columns, is_nodata(state.meta)
    region, read = state.near(walkers, 2)
    on = F.col("on") & ~nodata
    near = _sloped(region).withColumn("on", on)
    near = near.withColumns({f"x_{d}": F.when(F.col("on") & (F.col(f"s_{d}") > 0), F.col(f"s_{d}") / F.col("total")) for d, _, _ in D4})
    near = near.withColumn("h", F.when(F.col("on") & (F.col("total") <= 0), F.col("h") + F.lit(lift) * drawn(seed, F.lit(step), F.col("i"))).otherwise(F.col("h")))
    faces = gather(Raster(near.select(*columns, "on", *(f"x_{d}" for d, _, _ in D4)), state.meta), "on", "x_t", "x_l", "x_r", "x_b", "wx", "wy")
    faces = faces.withColumns(
        {
            "wx": F.coalesce("x_r", -F.col("x_l_r"), "wx"),
            "wy": F.coalesce("x_b", -F.col("x_t_b"), "wy"),
            "left": F.coalesce("x_r_l", F.when(F.col("i_l").isNotNull(), -F.col("x_l")), "wx_l", F.lit(0.0)),
            "top": F.coalesce("x_b_t", F.when(F.col("i_t").isNotNull(), -F.col("x_t")), "wy_t", F.lit(0.0)),
            "beside": ~F.col("on") & ~nodata & any_of([F.coalesce(f"on_{d}", F.lit(False)) for d, _, _ in D4]),
        }
    )
    zero = F.lit(0.0)
    total = F.greatest(zero, F.col("wx")) + F.greatest(zero, F.col("wy")) + F.greatest(zero, -F.col("left")) + F.greatest(zero, -F.col("top"))
    faces = faces.withColumn("f", F.when(F.col("beside") & (total > 0), 1 / total).otherwise(1.0))
    near = gather(Raster(faces.select(*columns, "on", "beside", "f"), state.meta), "f", "q", "wx", "wy")
    flow = lambda w, sign, d: F.coalesce(F.greatest(zero, sign * F.col(w)) * F.col(f"f_{d}") * F.col(f"q_{d}"), zero)
    came = flow("wy_t", 1, "t") + flow("wx_l", 1, "l") + flow("wx", -1, "r") + flow("wy", -1, "b")
    scaled = lambda w, d: F.col(w) * F.when(F.col(w) > 0, F.col("f")).otherwise(F.coalesce(f"f_{d}", F.lit(1.0)))
    new = {"q": F.when(F.col("on") | F.col("beside"), source + came).otherwise(F.col("q")), "wx": scaled("wx", "r"), "wy": scaled("wy", "b")}
    out = state.with_changed(near.withColumns(new).select(*columns))
    dropped(*read)
    return out


def run(state: Stored, walkers: DataFrame, steps: int, p: Params = Params(), source: Column | None = None) -> tuple[Stored, DataFrame]:
    """The state and the walkers after `steps` depth steps, each followed by the walkers' step down z + h."""
    first = state
    for _ in range(steps):
        before, state = state, depth_step(state, walkers, p, source)
        region, read = state.near(walkers, 1)
        nexts = next_cells(region.with_columns(zh=F.col("z") + F.col("h")), "zh")
        at, walkers = walkers, written(moved(walkers, nexts), "walkers")
        dropped(at if before is not first else None, before.changed if before is not first else None, *read)
    return state, walkers
