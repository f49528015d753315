"""Flood runs: steps of hydro, many in a pass where neighbours are all that they need (plans.blocked), and rounds of routing, filling and accumulation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.operators import accumulate, depressions, hydro, kernels
from catchwater.operators.grid import Raster, can_leave
from catchwater.operators.routing import receivers
from catchwater.plans.blocked import Kernel, Tile, advanced
from catchwater.plans.iterate import dropped, settled, written

Forcing = float | Column | Callable[[Raster], Raster] | None


class Flood:
    """The state of a flood: a raster with z, h, q, qx and qy. Methods return a new Flood."""

    def __init__(self, raster: Raster, params: hydro.Params = hydro.Params()):
        blank = {c: F.lit(0.0) for c in ("h", "q", "qx", "qy") if c not in raster.cells.columns}
        self.raster, self.params = raster.with_columns(**blank) if blank else raster, params

    def _with(self, raster: Raster) -> Flood:
        return Flood(raster, self.params)

    def set_depth(self, h: Column | float) -> Flood:
        return self._with(self.raster.with_columns(h=h if isinstance(h, Column) else F.lit(float(h))))

    def _source(self, rain: Forcing) -> Column:
        """Rain as volume a second: None is the rate of the parameters, a number or a column a rate."""
        if rain is None:
            rain = self.params.rain
        if isinstance(rain, bool) or not isinstance(rain, (int, float, Column)):
            raise TypeError("rain is a rate or a column of rates")
        return (rain if isinstance(rain, Column) else F.lit(float(rain))) * F.lit(self.raster.meta.dx**2)

    def _advanced(self, kernel: Kernel, n: int, reach: int, fields: tuple[str, ...], changed: tuple[str, ...], edge: int = 0, at_once: int | None = None, **more: Column) -> Flood:
        """n steps of a kernel, many in a pass; more: columns for the kernel alone, found once."""
        given = self.raster.with_columns(**{f"__{c}": v.cast("double") for c, v in more.items()}) if more else self.raster
        own = {f"__{c}": c for c in more}

        def named(tile: Tile, steps: int) -> dict:
            tile.fields.update({own[f]: tile.fields[f] for f in own})
            return kernel(tile, steps)

        done = advanced(given, named, n, reach, (*fields, *own), changed, edge, at_once)
        return self._with(done.with_cells(done.cells.select(*self.raster.cells.columns)))

    def run_inertial(self, n: int, rain: Forcing = None, at_once: int | None = None) -> Flood:
        """n local-inertial steps: rain (a rate, a column that is found once, or a function of the raster, which is asked each step), faces, depth."""
        if callable(rain) and not isinstance(rain, Column):

            def step(r: Raster) -> Raster:
                return hydro.inertial_depth(hydro.inertial_faces(rain(r), self.params), self.params)

            return self._with(hydro.run(self.raster, step, n))
        rate = F.lit(float(self.params.rain)) if rain is None else rain if isinstance(rain, Column) else F.lit(float(rain))
        return self._advanced(kernels.inertial(self.params), n, 1, ("z", "h", "qx", "qy"), ("h", "qx", "qy"), at_once=at_once, rate=rate)

    def route(self, rain: Forcing = None, lakes: bool = True, carve: bool = True, epsilon: float = 2e-3, stochastic: int = 0, seed: int = 0) -> tuple[Flood, DataFrame]:
        """Receivers of the water surface, with lakes filled, and the discharge that they gather.

        stochastic: the discharge is the mean over so many random routings of the filled surface, all drawn and summed in
        one pass, keyed by draw.
        """
        surface = self.raster.with_columns(zh=F.col("z") + F.col("h"))
        links = receivers(surface, "zh")
        raster = self.raster
        if lakes:
            links = depressions.reroute(surface, links, carve, "zh")
            wet = depressions.fill_into_water(self.raster, links, epsilon).select("i", F.col("h").alias("hf"))
            raster = raster.with_cells(raster.cells.join(wet, "i").withColumn("h", F.col("hf")).drop("hf"))
        sources = raster.cells.select("i", self._source(rain).alias("q"))
        if stochastic:
            q = accumulate.ensemble_of(raster.with_columns(zh=F.col("z") + F.col("h")), sources, stochastic, seed, "zh")
        else:
            q = accumulate.accumulate(links, sources, meta=raster.meta)
        cells = raster.cells.drop("q").join(q, "i").select(*raster.cells.columns)
        return self._with(raster.with_cells(written(cells, "routed"))), links

    def run_graphflood(self, n: int, rain: Forcing = None, lakes: bool = True, keep_old: float = 0.0, diffusions: int = 0, stochastic: int = 0, seed: int = 0) -> Flood:
        """n rounds of routing, filling, accumulation (over random routings if asked for), optional diffusion and Manning depth."""
        state = self
        for k in range(n):

            def cells(state: Flood = state, k: int = k) -> DataFrame:
                before = state.raster.cells.select("i", F.col("q").alias("q0"))
                routed, links = state.route(rain, lakes, stochastic=stochastic, seed=(seed << 20) + k)
                mixed = routed.raster.cells.join(before, "i").withColumn("q", (1 - keep_old) * F.col("q") + keep_old * F.col("q0")).drop("q0")
                wet = routed._with(routed.raster.with_cells(mixed)).diffuse(diffusions, rain)
                return hydro.manning_core(wet.raster, links, self.params).cells

            last, state = state, self._with(self.raster.with_cells(settled(cells, "state")))
            if k:
                dropped(last.raster.cells)
        return state

    def diffuse(self, n: int, rain: Forcing = None, keep_old: float = 0.0) -> Flood:
        """n sharings of q among lower neighbours. The surface stays, so its shares are found once, however many sharings there are."""
        if not n:
            return self
        shares, raster = written(hydro.sharing(self.raster), "shares"), self.raster
        for k in range(n):
            q = hydro.diffuse(raster, self._source(rain), keep_old=keep_old, weights=shares)
            before, raster = raster, raster.with_cells(written(raster.cells.drop("q").join(q, "i").select(*raster.cells.columns), "diffused"))
            if k:
                dropped(before.cells)
        dropped(shares)
        return self._with(raster)

    def run_sweeps(self, n: int, omega: float = 1.0, rain: Forcing = None, mask: Column | None = None, tile: int | None = None, at_once: int | None = None) -> Flood:
        """n sweeps of q over the raised water surface; with tiles, what crosses them is frozen for the run. The mask is found once."""
        base = self.raster.with_columns(zh=F.col("z") + F.col("h"), qapp=F.col("q"))
        more = {"source": self._source(rain)} | ({} if mask is None else {"on": mask})
        state = self._with(hydro.raised_pits(base))._advanced(kernels.sweeps(omega, tile), n, 1, ("zh", "q", "qapp"), ("q",), 1, at_once, **more)
        split = state.raster.with_columns(**depressions.split_surface())
        return self._with(split.with_cells(split.cells.drop("zh", "qapp")))

    def run_diffusive(self, n: int, dt: float | None = None, keep_old: float = 0.5, at_once: int | None = None) -> Flood:
        return self._advanced(kernels.diffusive(self.params, dt, keep_old), n, 2, ("z", "h", "q"), ("h", "q"), at_once=at_once)

    def run_depth(self, n: int, dt: float | None = None, mask: Column | None = None, at_once: int | None = None) -> Flood:
        """n depth steps at constant q; the mask is found once."""
        return self._advanced(kernels.depth(self.params, dt), n, 1, ("z", "h", "q"), ("h",), at_once=at_once, **({} if mask is None else {"on": mask}))

    def run_analytic(self, n: int, keep_old: float = 0.2, mask: Column | None = None, at_once: int | None = None) -> Flood:
        return self._advanced(kernels.analytic(self.params, keep_old), n, 1, ("z", "h", "q"), ("h",), at_once=at_once, **({} if mask is None else {"on": mask}))

    def run_flux_diffusion(self, n: int, rain: Forcing = None, dt: float = 0.01, omega: float = 0.5, at_once: int | None = None) -> Flood:
        p = replace(self.params, dt=dt)
        return self._advanced(kernels.flux_diffusion(p, omega), n, 1, ("z", "h"), ("h",), at_once=at_once, source=self._source(rain) / self.raster.meta.dx**2)

    def run_velocity(self, n: int, rain: Forcing = None, dt: float = 1e-3, omega: float = 0.5, at_once: int | None = None) -> Flood:
        """n steps of face velocities ux and uy (right and bottom face; 0 if the raster has none) and upwind fluxes of h ** (5/3)."""
        blank = {c: F.lit(0.0) for c in ("ux", "uy") if c not in self.raster.cells.columns}
        state = self._with(self.raster.with_columns(**blank)) if blank else self
        return state._advanced(kernels.velocity(self.params, dt, omega), n, 1, ("z", "h", "ux", "uy"), ("h", "ux", "uy"), at_once=at_once, source=self._source(rain) / self.raster.meta.dx**2)

    def run_over_minima(self, links: DataFrame, n: int = 1, keep_old: float = 0.0) -> Flood:
        """n fused steps over slopes and, where there is no way down, over saved links; the raster keeps its flags in lm."""
        raster = self.raster if "lm" in self.raster.cells.columns else self.raster.with_columns(lm=F.lit(False))
        return self._with(hydro.run(raster, lambda r: hydro.minima_step(r, links, self.params, keep_old), n))

    def warm_up(self, n: int, dt: float = 0.01, omega: float = 0.5) -> Flood:
        return self._with(hydro.run(self.raster, lambda r: hydro.additive_step(r, dt, omega), n))

    def splat(self, n: int = 1, dt: float | None = None) -> Flood:
        return self._with(hydro.run(self.raster, lambda r: hydro.splat(r, self.params.dt if dt is None else dt), n))

    def fill_lakes(self, epsilon: float = 2e-3, discharge: bool = False, rain: Forcing = None) -> Flood:
        """Depressions filled with water; with the discharge that the filled surface gathers if asked for."""

        def cells() -> DataFrame:
            filled = self.route(rain, True, True, epsilon)[0].raster.cells
            return filled if discharge else filled.drop("q").join(self.raster.cells.select("i", "q"), "i").select(*self.raster.cells.columns)

        return self._with(self.raster.with_cells(settled(cells, "lakes")))

    def spread(self, **how) -> Flood:
        return self._with(hydro.smoothed(self.raster, **how))

    def drain_outlets(self, value: float = 0.0) -> Flood:
        return self._with(hydro.outlet_depth(self.raster, value))

    def get(self, name: str) -> DataFrame:
        """(i, name) of a state column or of sw, tau, qo."""
        derived = {"sw": hydro.hydraulic_slope, "tau": hydro.shear_stress, "qo": lambda r: hydro.outflow_capacity(r, self.params)}
        return derived[name](self.raster) if name in derived else self.raster.cells.select("i", name)

    def outflow(self) -> DataFrame:
        """Total discharge at the cells that water can leave."""
        return self.raster.cells.where(can_leave(self.raster.meta)).agg(F.sum("q").alias("q"))
