"""Many steps in a pass over tiles with halos, against the single steps of hydro."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.operators import flood, hydro
from catchwater.operators.grid import from_matrix
from catchwater.plans import blocked


def state(spark, mode):
    r = np.random.default_rng(3)
    z = np.round(r.random((17, 13)) * 8) / 4
    if mode == "custom":
        bc = np.ones(z.shape, np.int8)
        bc[0], bc[-1], bc[:, 0], bc[:, -1] = 3, 9, 9, 3
        bc[0, ::3], bc[::2, -1], bc[5:8, 4] = 9, 9, 0
        raster = from_matrix(spark, z, 2.0, boundaries=bc)
    else:
        raster = from_matrix(spark, z, 2.0, mode)
    wet = raster.with_columns(h=(F.col("i") % 7) / 8.0, q=(F.col("i") % 11) / 4.0, qx=((F.col("i") % 5) - 2) / 16.0, qy=((F.col("i") % 3) - 1) / 16.0, name=F.concat(F.lit("c"), "i"))
    return wet.with_cells(wet.cells.persist())


def columns(raster, *names):
    found = sorted((r["i"], *(r[n] for n in names), r["name"]) for r in raster.cells.select("i", *names, "name").collect())
    assert [f[0] for f in found] == list(range(17 * 13)) and all(f[-1] == f"c{f[0]}" for f in found)
    return np.array([f[1:-1] for f in found])


@pytest.mark.parametrize("mode", ["periodic_EW", "periodic_NS", "custom"])
def test_steps_equal_single_ones(spark, monkeypatch, mode):
    monkeypatch.setattr(blocked, "SIZE", 6)
    p = hydro.Params(rain=1e-2, dt=0.05)
    raster, n = state(spark, mode), 3
    f = flood.Flood(raster, p)
    even = F.col("i") % 2 == 0
    single = {
        "inertial": (lambda r: hydro.inertial_depth(hydro.inertial_faces(hydro.rain(r, p), p), p), ("h", "qx", "qy"), lambda k: f.run_inertial(n, at_once=k)),
        "diffusive": (lambda r: hydro.diffusive_step(r, p), ("h", "q"), lambda k: f.run_diffusive(n, at_once=k)),
        "depth": (lambda r: hydro.depth_step(r, p), ("h",), lambda k: f.run_depth(n, at_once=k)),
        "masked depth": (lambda r: hydro.depth_step(r, p, mask=even), ("h",), lambda k: f.run_depth(n, mask=even, at_once=k)),
        "analytic": (lambda r: hydro.analytic_depth(r, p, 0.2), ("h",), lambda k: f.run_analytic(n, at_once=k)),
        "masked analytic": (lambda r: hydro.analytic_depth(r, p, 0.2, even), ("h",), lambda k: f.run_analytic(n, mask=even, at_once=k)),
        "flux": (lambda r: hydro.diffusion_flux_step(r, F.lit(p.rain), p, 0.5), ("h",), lambda k: f.run_flux_diffusion(n, dt=p.dt, at_once=k)),
    }
    for name, (step, names, run) in single.items():
        if mode != "custom" and name not in ("inertial", "diffusive"):
            continue
        want = columns(hydro.run(raster, step, n), *names)
        for k in (1, 2, 16) if mode == "custom" and name in ("inertial", "diffusive") else (2,):
            got = columns(run(k).raster, *names)
            assert np.isfinite(want).all() and np.allclose(got, want, rtol=1e-11, atol=1e-13), (name, k)


@pytest.mark.parametrize("mode", ["custom"])
def test_sweeps_equal_single_ones(spark, monkeypatch, mode):
    monkeypatch.setattr(blocked, "SIZE", 6)
    raster = state(spark, mode)
    f, third = flood.Flood(raster), F.col("i") % 3 > 0
    for mask, tile in ((None, None), (third, 4)):
        r = hydro.raised_pits(raster.with_columns(zh=F.col("z") + F.col("h"), qapp=F.col("q")))
        for _ in range(3):
            q = hydro.sweep(r, F.lit(0.5 * 4), 0.8, mask, tile=tile)
            r = r.with_cells(r.cells.drop("q").join(q, "i").select(*r.cells.columns))
        want = columns(r, "q")
        for k in (1, 2, 16):
            got = f.run_sweeps(3, 0.8, 0.5, mask, tile, k)
            assert got.raster.cells.columns == raster.cells.columns
            assert np.allclose(columns(got.raster, "q"), want, rtol=1e-11)


def test_a_rate_by_column_and_by_function(spark):
    raster = state(spark, "normal")
    f, rate = flood.Flood(raster), F.col("i") / 1000.0
    by_column = columns(f.run_inertial(3, rate).raster, "h")
    assert np.allclose(by_column, columns(f.run_inertial(3, lambda r: hydro.rain(r, f.params, rate)).raster, "h"))


def test_64_steps_take_few_passes(spark, monkeypatch):
    made, true = [], blocked.written
    monkeypatch.setattr(blocked, "written", lambda df, name: made.append(name) or true(df, name))
    f, took = flood.Flood(state(spark, "normal")), {}
    for n in (4, 4, 64):
        made.clear()
        began = time.time()
        f.run_inertial(n).get("h").count()
        took[n] = time.time() - began
        assert len(made) == -(-n // blocked.STEPS)
    assert took[64] <= 8 * took[4]
