"""Routing, sums and depressions against plain Python over small rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.operators import accumulate, depressions, erosion, flood, hydro, routing
from catchwater.operators.grid import can_leave, from_matrix
from catchwater.plans.iterate import ancestors, descendants


def steepest(z):
    ny, nx = z.shape
    out = np.arange(ny * nx)
    for r in range(ny):
        for c in range(nx):
            best = 0.0
            for dr, dc in ((-1, 0), (0, -1), (0, 1), (1, 0)):
                if 0 <= r + dr < ny and 0 <= c + dc < nx and z[r, c] - z[r + dr, c + dc] > best:
                    best, out[r * nx + c] = z[r, c] - z[r + dr, c + dc], (r + dr) * nx + c + dc
    return out


def path(rcv, i):
    out = [i]
    while rcv[out[-1]] != out[-1]:
        out.append(int(rcv[out[-1]]))
        assert len(out) <= len(rcv)
    return out


def array(df, name, n):
    out = np.full(n, np.nan)
    for r in df.select("i", name).collect():
        out[r["i"]] = r[name]
    return out


@pytest.fixture(scope="module")
def dem(spark):
    z = np.round(np.random.default_rng(8).random((9, 11)) * 20)  # many ties
    raster = from_matrix(spark, z)
    return z, raster, routing.receivers(raster).cache()


def test_receivers_and_counts(dem):
    z, raster, links = dem
    rcv = steepest(z)
    assert (array(links, "rcv", z.size) == rcv).all()
    q = np.zeros(z.size)
    for i in range(z.size):
        q[path(rcv, i)] += 1
    assert (array(accumulate.drainage_cells(links), "q", z.size) == q).all()
    total = accumulate.accumulate(links, raster.cells.select("i", F.col("z").alias("q")))
    roots = np.flatnonzero(rcv == np.arange(z.size))
    assert np.isclose(array(total, "q", z.size)[roots].sum(), z.sum())


def test_fill_breach_affine(dem):
    z, raster, links = dem
    rcv, flat = steepest(z), z.ravel()
    filled, capped, x = (np.zeros(z.size) for _ in range(3))
    for i in range(z.size):
        p = path(rcv, i)
        filled[i] = max(flat[a] + 0.5 * k for k, a in enumerate(p))
        capped[i] = min(flat[a] + 0.56 * k for k, a in enumerate(p) if a != p[-1] or not k)
        x[i] = sum(0.5**k * flat[a] for k, a in enumerate(p))
    assert np.allclose(array(depressions.fill(raster, links, 0.5), "z", z.size), filled)
    assert np.allclose(array(depressions.breach(raster, links), "z", z.size), capped)
    terms = links.join(raster.cells.select("i", F.lit(0.5).alias("a"), F.col("z").alias("b")), "i")
    assert np.allclose(array(accumulate.affine(terms), "x", z.size), x)


@pytest.mark.parametrize("carve", [True, False])
def test_rerouting_leaves_no_pit_and_no_cycle(dem, carve):
    z, raster, links = dem
    new = depressions.reroute(raster, links, carve)
    rcv = array(new, "rcv", z.size).astype(int)
    edge = {i for i in range(z.size) if i // 11 in (0, 8) or i % 11 in (0, 10)}
    assert all(path(rcv, i)[-1] in edge for i in range(z.size))
    assert routing.pits(raster, new, can_leave(raster.meta)).count() == 0


def test_cycles_are_told(spark):
    ring = spark.createDataFrame([(0, 1), (1, 0)], "i long, p long")
    with pytest.raises(ValueError):
        descendants(ring.withColumn("q", F.lit(1)), depth=5)
    with pytest.raises(ValueError):
        ancestors(ring.withColumn("v", F.lit(1)), {"v": "v"}, {"v": lambda n, f: f["v"]}, depth=5)


def test_multiple_flow_against_a_sorted_pass(dem):
    z, raster, _ = dem
    ny, nx = z.shape
    q, flat = np.ones(z.size), z.ravel()
    for i in np.argsort(-flat, kind="stable"):
        r, c = divmod(int(i), nx)
        near = [(r + a) * nx + c + b for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0)) if 0 <= r + a < ny and 0 <= c + b < nx]
        s = np.array([max(flat[i] - flat[j], 0) for j in near])
        if s.sum():
            q[near] += q[i] * s / s.sum()
    assert np.allclose(array(accumulate.multiple_flow(raster, accumulate.discharge_sources(raster, 1.0)), "q", z.size), q)


def test_draws_do_not_depend_on_partitions(dem):
    z, raster, _ = dem
    a = routing.stochastic_receivers(raster, 3, 2)
    b = routing.stochastic_receivers(raster.with_cells(raster.cells.repartition(7)), 3, 2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where("rep = 0").exceptAll(a.where("rep = 0").limit(0)).count() == z.size


def test_inertial_flow_keeps_mass(spark):
    z = np.add.outer(np.arange(6.0), np.arange(7.0)) * 0.01
    state = flood.Flood(from_matrix(spark, z), hydro.Params(edge_slope=0.0)).set_depth(0.5)
    after = state.run_inertial(2, 0.0)
    assert np.isclose(after.get("h").agg(F.sum("h")).first()[0], 0.5 * z.size)
    more = after.run_inertial(2, 0.0)  # the state before stays as it is
    assert np.isclose(more.get("h").agg(F.sum("h")).first()[0], 0.5 * z.size) and after.get("h").count() == z.size
    with pytest.raises(TypeError):
        state._source("rain")


def test_smoothing_keeps_volume(spark):
    raster = from_matrix(spark, np.random.default_rng(2).random((5, 6))).with_columns(h=(F.col("i") % 3).cast("double"))
    after = hydro.smoothed(raster, outer=3)
    assert np.isclose(after.cells.agg(F.sum("h")).first()[0], 30.0, atol=1e-3)


def test_erosion_follows_the_recurrence(dem):
    z, raster, links = dem
    wet = raster.with_cells(raster.cells.join(accumulate.constant_discharge(raster, links, 1.0), "i"))
    rcv, q, flat = steepest(z), array(wet.cells, "q", z.size), z.ravel()
    got = array(erosion.stream_power(wet, links), "z", z.size)
    for i in range(z.size):
        r, c = divmod(i, 11)
        if r in (0, 8) or c in (0, 10):
            assert got[i] == flat[i]
        else:
            k = 2e-2 * q[i] ** 0.45
            want = flat[i] / (1 + k) if rcv[i] == i else (flat[i] + k * got[rcv[i]]) / (1 + k)
            assert np.isclose(got[i], want)


def test_carving_down_against_a_walk_from_each_minimum(dem):
    z, raster, links = dem
    out = depressions.reroute(raster, links)
    rcv, flat = array(out, "rcv", z.size).astype(int), z.ravel()
    ny, nx = z.shape
    want = flat.copy()
    for i in range(z.size):
        r, c = divmod(i, nx)
        near = [flat[(r + a) * nx + c + b] for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0)) if 0 <= r + a < ny and 0 <= c + b < nx]
        if flat[i] <= min(near) and 0 < r < ny - 1 and 0 < c < nx - 1:
            for k, j in enumerate(path(rcv, i)[1:-1], 1):
                if flat[j] < flat[i] - (k - 1) * 2e-3:
                    break
                want[j] = min(want[j], flat[i] - k * 2e-3)
    assert (want < flat).any()
    assert np.allclose(array(depressions.carve_down(raster, out), "z", z.size), want, atol=1e-12)


def test_the_carving_query_changes_cells(spark, monkeypatch):
    from catchwater.plans import catalogue

    z = np.random.default_rng(5).random((8, 9)) * 10
    raster = from_matrix(spark, z)
    monkeypatch.setattr(catalogue, "r1", lambda *a: raster)
    assert (array(catalogue.carved_down(spark, ""), "z", z.size) < z.ravel() - 1e-3).any()


def test_carving_tells_a_cycle(spark):
    raster = from_matrix(spark, np.array([[9.0, 9.0, 9.0, 9.0], [9.0, 1.0, 5.0, 9.0], [9.0, 9.0, 9.0, 9.0]]))
    with pytest.raises(ValueError):
        depressions.carve_down(raster, spark.createDataFrame([(5, 6), (6, 5)], "i long, rcv long"))
