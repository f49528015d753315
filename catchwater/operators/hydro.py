"""Shallow water on cell tables: rain, diffusive and inertial steps, sweeps, weights, smoothing, diagnostics.

Every step reads the state of the step before and returns a new table; loops write their state to the shared folder each
round. Water depth is h, bed z, discharge q (volume a second), unit face discharges qx (left face) and qy (top face).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.functions.columns import drawn, positive_slope, sign
from catchwater.operators.accumulate import slope_weights
from catchwater.operators.grid import D4, Raster, can_leave, gather, is_nodata, tile_ids
from catchwater.plans.iterate import dropped, written


@dataclass(frozen=True)
class Params:
    rain: float = 0.01 / 3600
    manning: float = 0.033
    edge_slope: float = 1e-2
    dt: float = 1e-3
    dt_inertial: float = 0.1
    least_flow: float = 1e-3
    froude: float = 1.0
    gravity: float = 9.81


def rain(raster: Raster, p: Params, rate: Column | None = None, dt: float | None = None) -> Raster:
    """h grows by rate * dt where there is data; the rate may be a column."""
    more = (rate if rate is not None else F.lit(p.rain)) * F.lit(p.dt_inertial if dt is None else dt)
    return raster.with_columns(h=F.when(is_nodata(raster.meta), F.col("h")).otherwise(F.col("h") + more))


def outlet_depth(raster: Raster, value: float) -> Raster:
    return raster.with_columns(h=F.when(can_leave(raster.meta), F.lit(value)).otherwise(F.col("h")))


def _surface(raster: Raster) -> Raster:
    return raster.with_columns(zh=F.col("z") + F.col("h"))


def two_axis_slope(dx: float, field: str = "zh", own: Column | None = None) -> tuple[Column, Column]:
    """Largest positive slope to the left or right and to the top or bottom, of a gathered table."""
    v = F.col(field) if own is None else own
    s = {d: positive_slope(v, F.col(f"{field}_{d}"), dx) for d, _, _ in D4}
    return F.greatest(s["l"], s["r"]), F.greatest(s["t"], s["b"])


def _sloped(raster: Raster) -> tuple[DataFrame, Column]:
    """The gathered cells and the norm of the two-axis slope of z + h; 0 at outlets and without data."""
    mx, my = two_axis_slope(raster.meta.dx)
    off = can_leave(raster.meta) | is_nodata(raster.meta)
    return gather(_surface(raster), "zh"), F.when(off, F.lit(0.0)).otherwise(F.sqrt(mx * mx + my * my))


def hydraulic_slope(raster: Raster) -> DataFrame:
    """(i, sw): norm of the two-axis slope of z + h; 0 at outlets and without data."""
    near, slope = _sloped(raster)
    return near.select("i", slope.alias("sw"))


def shear_stress(raster: Raster, density: float = 1000.0, gravity: float = 9.81) -> DataFrame:
    """(i, tau): slope times depth times density times gravity."""
    near, slope = _sloped(raster)
    return near.select("i", (slope * F.col("h") * density * gravity).alias("tau"))


def _capacity(h: Column, slope: Column, dx: float, manning: float) -> Column:
    return F.lit(dx) * F.pow(h, F.lit(5.0 / 3.0)) / F.lit(manning) * F.sqrt(slope)


def outflow_capacity(raster: Raster, p: Params = Params()) -> DataFrame:
    """(i, qo): what can leave a cell by Manning's law; 0 at pits and outlets."""
    mx, my = two_axis_slope(raster.meta.dx)
    norm = F.sqrt(mx * mx + my * my)
    off = can_leave(raster.meta) | is_nodata(raster.meta) | (norm <= 0)
    return gather(_surface(raster), "zh").select("i", F.when(off, F.lit(0.0)).otherwise(_capacity(F.col("h"), norm, raster.meta.dx, p.manning)).alias("qo"))


def manning_core(raster: Raster, links: DataFrame, p: Params = Params()) -> Raster:
    """Depth after one step of a discharge q against Manning outflow towards the receiver; never below 0."""
    surface = raster.cells.select(F.col("i").alias("rcv"), (F.col("z") + F.col("h")).alias("zr"))
    df = raster.cells.join(links, "i").join(surface, "rcv")
    dx = raster.meta.dx
    slope = F.when(F.col("rcv") == F.col("i"), F.lit(p.edge_slope)).otherwise(F.greatest((F.col("z") + F.col("h") - F.col("zr")) / dx, F.lit(1e-4)))
    dh = F.greatest((F.col("q") - _capacity(F.col("h"), slope, dx, p.manning)) / F.lit(dx * dx) * p.dt, -F.col("h"))
    return raster.with_cells(df.withColumn("h", F.col("h") + dh).select(*raster.cells.columns))


def _arrived(w: DataFrame, q: DataFrame) -> DataFrame:
    return _landed(w.join(q.select("i", "q"), "i"))


def _landed(w: DataFrame) -> DataFrame:
    return w.groupBy(F.col("j").alias("i")).agg(F.sum(F.col("q") * F.col("w")).alias("more"))


def sharing(raster: Raster) -> DataFrame:
    """(i, k, j, s, w): the shares by which diffuse() sends q over the water surface."""
    return slope_weights(_surface(raster), "zh", ~(can_leave(raster.meta) | is_nodata(raster.meta)))


def diffuse(raster: Raster, source: Column, q: str = "q", keep_old: float = 0.0, to_outlets: bool = True, weights: DataFrame | None = None) -> DataFrame:
    """(i, q): source plus what lower-neighbour weights bring from q, blended with the old q.

    Outlets and cells without data send nothing; outlets receive if to_outlets, else they keep their source. Without given
    weights, a cell's links carry its q, so what it sends needs no join.
    """
    emit = ~(can_leave(raster.meta) | is_nodata(raster.meta))
    if weights is None:
        more = _landed(slope_weights(_surface(raster.with_columns(q=F.col(q))), "zh", emit, "q"))
    else:
        more = _arrived(weights, raster.cells.select("i", F.col(q).alias("q")))
    got = F.coalesce("more", F.lit(0.0)) if to_outlets else F.when(can_leave(raster.meta), F.lit(0.0)).otherwise(F.coalesce("more", F.lit(0.0)))
    return raster.cells.join(more, "i", "left").select("i", (F.lit(1.0 - keep_old) * (source + got) + F.lit(keep_old) * F.col(q)).alias("q"))


def face_weights(raster: Raster) -> DataFrame:
    """(i, wx, wy): signed shares of a cell's outflow: wx over its right face (negative: from the right cell), wy over its bottom face."""
    emit = ~(can_leave(raster.meta) | is_nodata(raster.meta))
    w = slope_weights(_surface(raster), "zh", emit)
    k = F.col("k")  # top, left, right, bottom
    faces = w.select(F.when((k == 0) | (k == 1), F.col("j")).otherwise(F.col("i")).alias("i"), F.when(k.isin(1, 2), F.when(k == 2, F.col("w")).otherwise(-F.col("w"))).alias("wx"), F.when(k.isin(0, 3), F.when(k == 3, F.col("w")).otherwise(-F.col("w"))).alias("wy"))
    summed = faces.groupBy("i").agg(F.sum("wx").alias("wx"), F.sum("wy").alias("wy"))
    return raster.cells.select("i").join(summed, "i", "left").select("i", F.coalesce("wx", F.lit(0.0)).alias("wx"), F.coalesce("wy", F.lit(0.0)).alias("wy"))


def renormalised(raster: Raster, wx: str = "wx", wy: str = "wy") -> DataFrame:
    """(i, wx, wy): signed shares on right and bottom faces (see face_weights) scaled so that each cell's outflows sum to 1.

    A face's share belongs to the cell that it leaves: positive to its own cell, negative to the cell on its other side.
    Faces that nothing leaves, and those of cells without data or towards no cell, stay as they are.
    """
    share = raster.with_cells(raster.cells.select("i", "row", "col", F.col(wx).alias("wx"), F.col(wy).alias("wy"), *(["bc"] if raster.meta.mode == "custom" else [])))
    out = lambda c, sign: F.greatest(F.lit(0.0), F.coalesce(sign * F.col(c), F.lit(0.0)))
    total = F.when(~is_nodata(raster.meta), out("wx", 1) + out("wy", 1) + out("wx_l", -1) + out("wy_t", -1))
    near = gather(share, "wx", "wy")
    summed = raster.with_cells(near.select(*share.cells.columns, total.alias("total")))
    scaled = lambda w, d: F.col(w) / F.coalesce(F.nullif(F.when(F.col(w) > 0, F.col("total")).otherwise(F.col(f"total_{d}")), F.lit(0.0)), F.lit(1.0))
    return gather(summed, "total").select("i", scaled("wx", "r").alias("wx"), scaled("wy", "b").alias("wy"))


def minima_step(raster: Raster, links: DataFrame, p: Params = Params(), keep_old: float = 0.0, lift: float = 5e-3) -> Raster:
    """h, q and lm after one fused step that sends water by slope and, from flagged cells without a way down, over saved links.

    A cell without a lower neighbour is flagged and rises by `lift`. A flagged cell sends nothing to neighbours whose saved
    receiver it is; with no slope left, all its water takes its own saved link. The receivers of flagged cells are flagged
    from the next step on. links: (i, rcv). One gathering of surface and receivers, one sum at the cells that water reaches.
    """
    dx = raster.meta.dx
    saved = raster.cells.join(links.select("i", "rcv"), "i", "left").withColumn("zh", F.col("z") + F.col("h"))
    near = gather(raster.with_cells(saved), "zh", "rcv")
    inside = ~(can_leave(raster.meta) | is_nodata(raster.meta))
    lower = F.lit(False)
    for d, _, _ in D4:
        lower = lower | F.coalesce(F.col(f"zh_{d}") < F.col("zh"), F.lit(False))
    near = near.withColumns({"inside": inside, "pit": inside & ~lower}).withColumn("flag", F.col("lm") | F.col("pit"))
    slope = {d: F.when(F.col("flag") & F.coalesce(F.col(f"rcv_{d}") == F.col("i"), F.lit(False)), F.lit(0.0)).otherwise(positive_slope(F.col("zh"), F.col(f"zh_{d}"), dx)) for d, _, _ in D4}
    near = near.withColumns({f"s_{d}": s for d, s in slope.items()})
    total = F.col("s_t") + F.col("s_l") + F.col("s_r") + F.col("s_b")
    near = near.withColumn("total", total)
    part = lambda j, w: F.struct(j.alias("j"), w.alias("w"))
    down = F.array(*[part(F.col(f"i_{d}"), F.col("q") * F.col(f"s_{d}") / F.col("total")) for d, _, _ in D4])
    sent = near.where("inside").select(F.explode(F.when(F.col("total") > 0, down).otherwise(F.array(part(F.col("rcv"), F.col("q"))))).alias("e"), F.lit(False).alias("lead"))
    told = near.where("inside and flag and rcv is not null").select(F.struct(F.col("rcv").alias("j"), F.lit(0.0).alias("w")).alias("e"), F.lit(True).alias("lead"))
    got = sent.where("e.j is not null and e.w > 0").union(told).groupBy(F.col("e.j").alias("i")).agg(F.sum("e.w").alias("more"), F.max("lead").alias("led"))
    mx, my = F.greatest("s_l", "s_r"), F.greatest("s_t", "s_b")
    leaves = F.when(F.col("inside"), _capacity(F.col("h"), F.greatest(F.sqrt(mx * mx + my * my), F.lit(1e-4)), dx, p.manning)).otherwise(0.0)
    df = near.withColumn("leaves", leaves).join(got, "i", "left")
    q = (1 - keep_old) * (F.lit(p.rain * dx * dx) + F.coalesce("more", F.lit(0.0))) + keep_old * F.col("q")
    df = df.withColumn("q", q)
    rise = F.when(F.col("pit"), F.lit(lift)).otherwise(0.0) + F.lit(p.dt / dx**2) * (F.col("q") - F.col("leaves"))
    df = df.withColumns({"h": F.greatest(F.lit(0.0), F.col("h") + rise), "lm": F.col("flag") | F.coalesce("led", F.lit(False))})
    return raster.with_cells(df.select(*raster.cells.columns))


def diffusive_step(raster: Raster, p: Params = Params(), dt: float | None = None, keep_old: float = 0.5, floor: float = 1e-6) -> Raster:
    """One fused step: q takes its inflow, h the balance of q and Manning outflow over the two-axis slope."""
    q = diffuse(raster, F.lit(p.rain * raster.meta.dx**2), keep_old=keep_old)
    mx, my = two_axis_slope(raster.meta.dx)
    norm = F.greatest(F.sqrt(mx * mx + my * my), F.lit(floor))
    df = gather(_surface(raster), "zh").drop("q").join(q, "i")
    return raster.with_cells(df.withColumn("h", _depth(raster, norm, p, dt)).select(*raster.cells.columns))


def _depth(raster: Raster, norm: Column, p: Params, dt: float | None) -> Column:
    dx = raster.meta.dx
    balance = F.col("h") + (F.col("q") - _capacity(F.col("h"), norm, dx, p.manning)) / F.lit(dx * dx) * F.lit(p.dt if dt is None else dt)
    return F.when(can_leave(raster.meta), F.lit(0.0)).when(is_nodata(raster.meta), F.col("h")).otherwise(F.greatest(F.lit(0.0), balance))


def depth_step(raster: Raster, p: Params = Params(), dt: float | None = None, mask: Column | None = None) -> Raster:
    """h after the balance of a given q and Manning outflow; outlets stay dry; with a mask, only masked cells change."""
    mx, my = two_axis_slope(raster.meta.dx)
    new = _depth(raster, F.sqrt(mx * mx + my * my), p, dt)
    df = gather(_surface(raster), "zh").withColumn("h", new if mask is None else F.when(mask, new).otherwise(F.col("h")))
    return raster.with_cells(df.select(*raster.cells.columns))


def splat(raster: Raster, dt: float) -> Raster:
    """h grows by q * dt / dx**2 inside."""
    off = can_leave(raster.meta) | is_nodata(raster.meta)
    return raster.with_columns(h=F.when(off, F.col("h")).otherwise(F.col("h") + F.col("q") * F.lit(dt / raster.meta.dx**2)))


def analytic_depth(raster: Raster, p: Params = Params(), keep_old: float = 0.0, mask: Column | None = None) -> Raster:
    """h relaxed to the depth at which Manning's law carries q: (q n / (sqrt(slope) dx)) ** 0.6.

    A flat cell counts as sloping 1e-2 on both axes; with a mask it takes the bed's slope, and 1e-3 if that is flat too.
    """
    dx = raster.meta.dx
    mx, my = two_axis_slope(dx)
    flat = (mx <= 0) & (my <= 0)
    near = gather(_surface(raster), "zh", "z")
    if mask is None:
        mx, my = F.when(flat, F.lit(1e-2)).otherwise(mx), F.when(flat, F.lit(1e-2)).otherwise(my)
    else:
        bx, by = two_axis_slope(dx, "z")
        none = (bx <= 0) & (by <= 0)
        mx = F.when(flat, F.when(none, F.lit(1e-3)).otherwise(bx)).otherwise(mx)
        my = F.when(flat, F.when(none, F.lit(1e-3)).otherwise(by)).otherwise(my)
    target = F.pow(F.col("q") * p.manning / (F.sqrt(F.sqrt(mx * mx + my * my)) * dx), F.lit(0.6))
    new = F.lit(1 - keep_old) * target + F.lit(keep_old) * F.col("h")
    off = can_leave(raster.meta) | is_nodata(raster.meta)
    if mask is not None:
        off = off | ~mask
    return raster.with_cells(near.withColumn("h", F.when(off, F.col("h")).otherwise(new)).select(*raster.cells.columns))


def _face(df: DataFrame, side: str, name: str, axis: str, n: int, inside: Column, p: Params, dx: float) -> DataFrame:
    """df with face discharge `name` after the inertial update towards a side; step by step, so that no expression doubles."""
    dt, g, q = p.dt_inertial, p.gravity, F.col(name)
    hi, hn, zi, zn, place = F.col("h"), F.col(f"h_{side}"), F.col("z"), F.col(f"z_{side}"), F.col(axis)
    deep, slope, flow, new = F.col("__deep"), F.col("__slope"), F.col("__flow"), F.col("__new")
    df = df.withColumn("__deep", F.greatest(zi + hi, zn + hn) - F.greatest(zi, zn))
    df = df.withColumn("__slope", F.when(place == n - 1, F.lit(p.edge_slope)).when(place <= 2, F.lit(-p.edge_slope)).otherwise(((zn + hn) - (zi + hi)) / dx))
    df = df.withColumn("__new", (q - g * deep * dt * slope) / (1 + F.try_divide(g * deep * dt * p.manning**2 * F.abs(q), F.pow(deep, F.lit(10.0 / 3.0)))))
    fastest = deep * F.sqrt(g * deep) * p.froude
    df = df.withColumn("__flow", F.when(F.abs(new) > fastest, sign(new) * fastest).otherwise(new))
    limited = F.when((flow > 0) & (flow * dt / dx > hi / 4), hi * dx / 5 / dt).when((flow < 0) & (F.abs(flow) * dt / dx > hn / 4), -hn * dx / 5 / dt).otherwise(flow)
    dry = ((hi <= 0) & (hn <= 0)) | (deep <= p.least_flow)
    return df.withColumn(name, F.when(~inside | hn.isNull(), q).when(dry, F.lit(0.0)).otherwise(limited)).drop("__deep", "__slope", "__new", "__flow")


def inertial_faces(raster: Raster, p: Params = Params()) -> Raster:
    """qx and qy after one local-inertial update; the first row and column keep theirs."""
    near, meta = gather(raster, "h", "z"), raster.meta
    inside = (F.col("row") != 0) & (F.col("col") != 0) & ~is_nodata(meta)
    near = _face(near, "t", "qy", "row", meta.ny, inside, p, meta.dx)
    near = _face(near, "l", "qx", "col", meta.nx, inside, p, meta.dx)
    return raster.with_cells(near.select(*raster.cells.columns))


def inertial_depth(raster: Raster, p: Params = Params()) -> Raster:
    """h after the faces' fluxes; a missing neighbour brings nothing; not clipped."""
    near = gather(raster, "qx", "qy")
    net = F.coalesce("qy_b", F.lit(0.0)) - F.col("qy") + F.coalesce("qx_r", F.lit(0.0)) - F.col("qx")
    return raster.with_cells(near.withColumn("h", F.col("h") + F.lit(p.dt_inertial / raster.meta.dx) * net).select(*raster.cells.columns))


def diffusion_flux_step(raster: Raster, source: Column, p: Params = Params(), omega: float = 0.5) -> Raster:
    """Face fluxes by sign * max(h)**(5/3) / n * sqrt(slope) on right and bottom faces, and the depth they leave, relaxed."""
    dx, dt = raster.meta.dx, p.dt
    surface = _surface(raster)
    near = gather(surface, "zh", "h")

    def flux(d: str) -> Column:
        s = (F.col("zh") - F.col(f"zh_{d}")) / dx
        return F.coalesce(sign(s) * F.pow(F.greatest("h", f"h_{d}"), F.lit(5 / 3)) / p.manning * F.sqrt(F.abs(s)), F.lit(0.0))

    flow = raster.with_cells(near.withColumns({"fx": flux("r"), "fy": flux("b")}).select(*raster.cells.columns, "fx", "fy"))
    around = gather(flow, "fx", "fy")
    net = F.coalesce("fx_l", F.lit(0.0)) - F.col("fx") + F.coalesce("fy_t", F.lit(0.0)) - F.col("fy")
    new = F.greatest(F.lit(0.0), F.col("h") + dt * (net / dx + source))
    off = can_leave(raster.meta) | is_nodata(raster.meta)
    return raster.with_cells(around.withColumn("h", F.when(off, F.col("h")).otherwise((1 - omega) * F.col("h") + omega * new)).select(*raster.cells.columns))


def additive_step(raster: Raster, dt: float, omega: float = 0.5) -> Raster:
    """h = (1 - omega) h + omega dt q / dx**2."""
    return raster.with_columns(h=F.lit(1 - omega) * F.col("h") + F.lit(omega * dt / raster.meta.dx**2) * F.col("q"))


def raised_pits(raster: Raster, field: str = "zh", lift: float = 1e-3) -> Raster:
    """Local minima raised in steps of `lift` to the first height above their lowest neighbour, in closed form."""
    near = gather(raster, field)
    lowest = F.least(*[F.col(f"{field}_{d}") for d, _, _ in D4])
    steps = F.floor((lowest - F.col(field)) / lift) + 1
    off = can_leave(raster.meta) | is_nodata(raster.meta)
    new = F.when(~off & (F.col(field) <= lowest), F.col(field) + steps * lift).otherwise(F.col(field))
    return raster.with_cells(near.withColumn(field, new).select(*raster.cells.columns))


def sweep(raster: Raster, source: Column, omega: float = 1.0, mask: Column | None = None, parity: int | None = None, tile: int | None = None) -> DataFrame:
    """(i, q): one relaxed Jacobi sweep of q = source + inflow by slope shares of zh.

    mask: cells that change. parity: only cells of one colour change. tile: links between tiles use the frozen qapp column.
    """
    off = can_leave(raster.meta) | is_nodata(raster.meta)
    cells = raster if tile is None else raster.with_columns(tile=tile_ids(raster.meta, tile))
    if tile is None:
        more = _landed(slope_weights(cells, "zh", ~off, "q"))
    else:
        w = slope_weights(cells, "zh", ~off, "q", "qapp", "tile")
        sent = F.when(F.col("tile") == tile_ids(raster.meta, tile, of=F.col("j")), F.col("q")).otherwise(F.col("qapp"))
        more = w.groupBy(F.col("j").alias("i")).agg(F.sum(sent * F.col("w")).alias("more"))
    on = F.lit(True) if mask is None else mask
    if parity is not None:
        on = on & (F.pmod(F.col("row") + F.col("col"), F.lit(2)) == parity) & ~off
    new = (1 - omega) * F.col("q") + omega * (source + F.coalesce("more", F.lit(0.0)))
    return raster.cells.join(more, "i", "left").select("i", F.when(on, new).otherwise(F.col("q")).alias("q"))


def spread_mask(raster: Raster, mask: Column) -> DataFrame:
    """(i): masked cells and the cells that they send water to."""
    w = slope_weights(raster, "zh").join(raster.cells.where(mask).select("i"), "i", "left_semi")
    return w.select(F.col("j").alias("i")).union(raster.cells.where(mask).select("i")).distinct()


def smoothed(raster: Raster, tau: float = 0.2, outer: int | None = None, tolerance: float = 1e-4, sigma: float | None = None, sweeps: int = 1, limit: int = 10_000) -> Raster:
    """h after the water surface is smoothed at constant volume: `outer` rounds, or until no cell moves by the tolerance.

    Without a number of rounds, `limit` rounds that do not settle are an error.
    Each round: a red and a black Laplacian step of eta = z + h (weights exp(-|dz/dx|/sigma) with sigma), a floor at the
    bed, and one shift that restores the volume, found by bisections that try 24 shifts in each pass over the table.
    """
    dx = raster.meta.dx
    area = dx * dx
    state = written(raster.cells.withColumn("eta", F.col("z") + F.col("h")), "surface")
    target = state.agg(F.sum(area * F.greatest(F.lit(0.0), F.col("eta") - F.col("z")))).first()[0] or 0.0
    for k in range(limit if outer is None else outer):
        step = raster.with_cells(state.withColumn("old", F.col("eta")))
        for _ in range(sweeps):
            for parity in (0, 1):
                step = raster.with_cells(diffused(step, parity, tau, sigma))
        floored = written(step.cells.withColumn("eta", F.greatest("eta", "z")), "surface")
        shift = matching_shift(floored, target, area)
        before, state = state, written(floored.withColumn("eta", F.greatest(F.col("z"), F.col("eta") + F.lit(shift))), "surface")
        dropped(before, floored)
        if (state.agg(F.max(F.abs(F.col("eta") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
        if outer is None and k + 1 == limit:
            raise ValueError("the surface did not settle")
    return raster.with_cells(state.withColumn("h", F.greatest(F.lit(0.0), F.col("eta") - F.col("z"))).select(*raster.cells.columns))


def diffused(raster: Raster, parity: int, tau: float, sigma: float | None = None) -> DataFrame:
    """The cells with eta moved by tau times its differences to the neighbours, for one colour."""
    near = gather(raster, "eta", "z")
    total = F.lit(0.0)
    for d, _, _ in D4:
        weight = F.lit(1.0) if sigma is None else F.exp(-F.abs((F.col(f"z_{d}") - F.col("z")) / raster.meta.dx) / sigma)
        total = total + F.coalesce(weight * (F.col(f"eta_{d}") - F.col("eta")), F.lit(0.0))
    on = F.pmod(F.col("row") + F.col("col"), F.lit(2)) == parity
    return near.withColumn("eta", F.when(on, F.col("eta") + tau * total).otherwise(F.col("eta"))).select(*raster.cells.columns)


def matching_shift(cells: DataFrame, target: float, area: float, passes: int = 5, tries: int = 24) -> float:
    """The shift c with sum(area * max(0, eta + c - z)) = target.

    Each pass over the cells narrows the range 23-fold; the volume is piecewise linear in the shift, so the last range is
    interpolated, which is exact unless a cell falls dry inside it.
    """
    top, n = cells.agg(F.max(F.abs(F.col("eta") - F.col("z"))), F.count("*")).first()
    if not n:
        return 0.0
    low, high = -(top or 0.0) - 1.0, (top or 0.0) + 1.0 + target / (area * n)
    under, over = 0.0, None
    for _ in range(passes):
        shifts = [low + (high - low) * k / (tries - 1) for k in range(tries)]
        sums = cells.agg(*[F.sum(area * F.greatest(F.lit(0.0), F.col("eta") + F.lit(c) - F.col("z"))) for c in shifts]).first()
        above = max(1, next((k for k, v in enumerate(sums) if (v or 0.0) >= target), tries - 1))
        low, high, under, over = shifts[above - 1], shifts[above], sums[above - 1] or 0.0, sums[above] or 0.0
    return low + (high - low) * min(max((target - under) / (over - under), 0.0), 1.0) if over and over > under else low


def volume_shifted(cells: DataFrame, shift: float, area: float) -> DataFrame:
    return cells.agg(F.sum(area * F.greatest(F.lit(0.0), F.col("eta") + F.lit(shift) - F.col("z"))).alias("volume"))


def max_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("difference"))


def run(raster: Raster, step: Callable[[Raster], Raster], n: int) -> Raster:
    """n steps, each written; the states between are deleted, the given one is the caller's."""
    for k in range(n):
        before, raster = raster, raster.with_cells(written(step(raster).cells, "state"))
        if k:
            dropped(before.cells)
    return raster


def bumped(raster: Raster, seed: int, amount: float = 1e-2) -> Raster:
    """h of local minima raised by a seeded uniform amount."""
    near = gather(_surface(raster), "zh")
    lowest = F.least(*[F.col(f"zh_{d}") for d, _, _ in D4])
    off = can_leave(raster.meta) | is_nodata(raster.meta)
    return raster.with_cells(near.withColumn("h", F.when(~off & (F.col("zh") <= lowest), F.col("h") + drawn(seed, F.col("i")) * amount).otherwise(F.col("h"))).select(*raster.cells.columns))
