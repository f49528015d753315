"""Steps on walkers' cells against loops over all cells in plain Python."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.operators import hydro, particles, sparse
from catchwater.operators.grid import D4, from_matrix
from tests.test_blocked import state as small

P = hydro.Params(rain=1e-2, dt=1e-2)


def read(raster):
    names = [c for c in raster.cells.columns if c != "name"]
    rows = sorted(raster.cells.select(*names).collect(), key=lambda r: r["i"])
    assert [r["i"] for r in rows] == list(range(raster.meta.nx * raster.meta.ny))
    return {n: np.array([r[n] for r in rows]) for n in names}


def neighbours(v, meta):
    """For each cell its neighbours above, left, right and below, -1 for none."""
    out = []
    for i in range(meta.nx * meta.ny):
        r, c = divmod(i, meta.nx)
        coded = meta.mode == "custom" and v["bc"][i] == 9
        ns = meta.mode == "periodic_NS" or (coded and r in (0, meta.ny - 1))
        ew = meta.mode == "periodic_EW" or (coded and r not in (0, meta.ny - 1))
        own = []
        for _, dr, dc in D4:
            a, b = r + dr, c + dc
            a, b = (a % meta.ny if ns else a), (b % meta.nx if ew else b)
            j = a * meta.nx + b if 0 <= a < meta.ny and 0 <= b < meta.nx else -1
            own.append(-1 if j >= 0 and meta.mode == "custom" and v["bc"][j] == 0 else j)
        out.append(own)
    return out


def slopes(v, near, i, dx):
    zh = v["z"] + v["h"]
    return [max(0.0, (zh[i] - zh[j]) / dx) if j >= 0 else 0.0 for j in near[i]]


def live(v, meta, positions):
    return sorted({i for i in positions if meta.mode != "custom" or v["bc"][i] != 0})


def plain_depth(v, meta, positions):
    near, h, q = neighbours(v, meta), v["h"].copy(), v["q"].copy()
    for i in live(v, meta, positions):
        came = 0.0
        for j in set(near[i]) - {-1}:
            s = slopes(v, near, j, meta.dx)
            came += sum(v["q"][j] * x / sum(s) for x, k in zip(s, near[j], strict=True) if k == i and x > 0)
        t, le, r, b = slopes(v, near, i, meta.dx)
        mx, my = max(le, r), max(t, b)
        leaves = meta.dx / P.manning * v["h"][i] ** (5 / 3) * max(np.hypot(mx, my), 1e-4) ** 0.5 if mx > 0 and my > 0 else 0.0
        q[i] = P.rain * meta.dx**2 + came
        h[i] = max(0.0, v["h"][i] + P.dt * (q[i] - leaves) / meta.dx**2)
    return {**v, "h": h, "q": q}


def plain_discharge(v, meta, positions, source):
    near, on = neighbours(v, meta), live(v, meta, positions)
    wx, wy, q, pits = v["wx"].copy(), v["wy"].copy(), v["q"].copy(), []
    for i in on:
        s = slopes(v, near, i, meta.dx)
        t, le, r, b = near[i]
        pits += [i] if sum(s) == 0 else []
        for k, (where, face, sign) in enumerate(((t, wy, -1), (le, wx, -1), (i, wx, 1), (i, wy, 1))):
            if s[k] > 0:
                face[where] = sign * s[k] / sum(s)
    beside = sorted({j for i in on for j in near[i] if j >= 0} - set(on))
    for j in beside:
        t, le, _, _ = near[j]
        out = [(wx, j, 1), (wy, j, 1), *([(wx, le, -1)] if le >= 0 else []), *([(wy, t, -1)] if t >= 0 else [])]
        out = [(w, at) for w, at, sign in out if sign * w[at] > 0]
        total = sum(abs(w[at]) for w, at in out)
        for w, at in out:
            w[at] /= total
    for i in [*on, *beside]:
        t, le, r, b = near[i]
        q[i] = source + sum((max(0.0, wy[t]) * v["q"][t] if t >= 0 else 0.0, max(0.0, wx[le]) * v["q"][le] if le >= 0 else 0.0, max(0.0, -wx[i]) * v["q"][r] if r >= 0 else 0.0, max(0.0, -wy[i]) * v["q"][b] if b >= 0 else 0.0))
    return {**v, "wx": wx, "wy": wy, "q": q}, pits


def walkers(spark, positions):
    return spark.createDataFrame([(k, int(p)) for k, p in enumerate(positions)], "pid long, pos long")


MODES = ["normal", "periodic_EW", "periodic_NS", "custom"]
PLACES = [0, 5, 5, 12, 13 * 5 + 4, 13 * 6 + 4, 13 * 7 + 5, 40, 41, 53, 54, 13 * 16 + 7, 13 * 17 - 1]


def coded(spark, mode):
    """A raster with faces; in custom mode cells of code 9 face each other."""
    raster = small(spark, mode)
    if mode == "custom":
        side = F.col("col").isin(0, raster.meta.nx - 1) & (F.col("row") % 4 == 2)
        bc = F.when((F.col("bc") == 0), 0).when(side, 9).when((F.col("row") % (raster.meta.ny - 1) == 0) | (F.col("col") % (raster.meta.nx - 1) == 0), 3).otherwise(1)
        raster = raster.with_columns(bc=bc.cast("byte"))
    return raster.with_columns(wx=F.col("qx") * 4, wy=F.col("qy") * 4)


@pytest.mark.parametrize("mode", MODES)
def test_depth_step(spark, mode):
    raster = coded(spark, mode)
    before, kept = read(raster), sparse.stored(raster)
    got = sparse.depth_step(kept, walkers(spark, PLACES), P)
    after = read(got.raster())
    want = plain_depth(before, raster.meta, PLACES)
    assert got.changed.count() == len(live(before, raster.meta, PLACES))
    for name in before:
        np.testing.assert_allclose(after[name].astype(float), want[name].astype(float), rtol=1e-12, atol=1e-15, err_msg=name)
    assert [str(r["name"]) for r in got.raster().cells.orderBy("i").collect()] == [f"c{i}" for i in range(17 * 13)]


@pytest.mark.parametrize("mode", MODES)
def test_discharge_step(spark, mode):
    raster = coded(spark, mode)
    before = read(raster)
    after = read(sparse.discharge_step(sparse.stored(raster), walkers(spark, PLACES), F.lit(0.25), 4).raster())
    want, pits = plain_discharge(before, raster.meta, PLACES, 0.25)
    for name in ("q", "wx", "wy", "z"):
        np.testing.assert_allclose(after[name], want[name], rtol=1e-12, atol=1e-15, err_msg=name)
    risen = np.flatnonzero(after["h"] > before["h"])
    assert set(risen) <= set(pits) and (after["h"] >= before["h"]).all() and (after["h"] - before["h"] < 1e-2).all()
    assert mode == "custom" or len(risen) == len(set(pits))


def test_walkers_everywhere_and_nowhere(spark):
    raster = coded(spark, "periodic_EW")
    before, kept = read(raster), sparse.stored(raster)
    same = sparse.depth_step(kept, walkers(spark, [0]).limit(0), P)
    for name, x in read(same.raster()).items():
        assert (x == before[name]).all()
    cells = range(17 * 13)
    dense = plain_depth(before, raster.meta, cells)
    np.testing.assert_allclose(read(sparse.depth_step(same, walkers(spark, cells), P).raster())["h"], dense["h"], rtol=1e-12)


def test_idle_tiles_are_not_read(spark):
    """Steps with walkers at the corner of four tiles go on when the files of all other tiles are spoilt."""
    r = np.random.default_rng(8)
    raster = from_matrix(spark, np.round(r.random((300, 520)) * 64) / 8, 2.0)
    raster = raster.with_columns(h=(F.col("i") % 7) / 8.0, q=(F.col("i") % 11) / 4.0)
    before, kept = read(raster), sparse.stored(raster)
    places = [a * 520 + b for a in (126, 127, 128) for b in (255, 256, 257)]
    for path in glob.glob(f"{kept.base.__dict__['shared_path'].removeprefix('file://')}/tile=*/*.parquet"):
        if int(path.split("tile=")[1].split("/")[0]) not in (2, 3, 7, 8):
            with open(path, "wb") as f:
                f.write(b"spoilt")
    assert "dynamicpruning" in kept.near(walkers(spark, places), 2)[0].cells._jdf.queryExecution().toString()
    got, at = sparse.run(kept, walkers(spark, places), 2, P)
    want = before
    for _ in range(2):
        want = plain_depth(want, raster.meta, places)
        zh, near = want["z"] + want["h"], neighbours(want, raster.meta)
        places = [max([(zh[i] - zh[j], -k, j) for k, j in enumerate(near[i]) if j >= 0 and zh[j] < zh[i]], default=(0, 0, i))[2] for i in places]
    assert sorted(r["pos"] for r in at.collect()) == sorted(places)
    changed = got.changed.collect()
    assert len(changed) >= 9
    for row in changed:
        assert abs(row["h"] - want["h"][row["i"]]) < 1e-12 and abs(row["q"] - want["q"][row["i"]]) < 1e-12


def test_run_from_queries_walkers(spark):
    raster = coded(spark, "normal")
    state, at = sparse.run(sparse.stored(raster), particles.placed(raster, 20, 3), 3, P)
    assert at.count() == 20 and state.changed.count() == state.changed.select("i").distinct().count()
