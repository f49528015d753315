"""Results do not depend on how a raster is cut into tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.operators import accumulate, depressions, grid, routing
from catchwater.operators.grid import from_matrix

NY, NX = 11, 14


@pytest.fixture(scope="module")
def heights():
    return np.round(np.random.default_rng(3).random((NY, NX)) * 30)  # many ties


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=str)


def rounded(df, *names):
    return sorted(tuple(r["i"] if n == "i" else round(r[n], 9) for n in names) for r in df.select(*names).collect())


def raster_of(spark, z, mode):
    if mode != "custom":
        return from_matrix(spark, z, mode=mode)
    bc = np.ones(z.shape, int)
    bc[0], bc[-1], bc[:, 0], bc[:, -1] = 3, 3, 3, 3
    bc[::3, 0] = bc[::3, -1] = bc[0, ::4] = bc[-1, ::4] = 9
    bc[4:6, 5:8] = 0
    return from_matrix(spark, z, boundaries=bc)


def neighbours(z, bc, mode, i, dr, dc):
    """A neighbour's number by the rules of the boundary modes, or none."""
    r, c = divmod(i, NX)
    a, b = r + dr, c + dc
    edge_ew, edge_ns = c in (0, NX - 1) and r not in (0, NY - 1), r in (0, NY - 1)
    if not 0 <= b < NX:
        if mode == "periodic_EW" or (mode == "custom" and bc[r, c] == 9 and edge_ew):
            b %= NX
        else:
            return None
    if not 0 <= a < NY:
        if mode == "periodic_NS" or (mode == "custom" and bc[r, c] == 9 and edge_ns):
            a %= NY
        else:
            return None
    return None if mode == "custom" and bc[a, b] == 0 else a * NX + b


@pytest.mark.parametrize("mode", grid.MODES)
def test_neighbours_over_tile_borders(spark, heights, monkeypatch, mode):
    monkeypatch.setattr(grid, "TILE", 4)
    raster = raster_of(spark, heights, mode)
    bc = np.array(raster.cells.orderBy("i").select("bc").collect()).reshape(NY, NX) if mode == "custom" else None
    got = {r["i"]: r for r in grid.gather(raster, "z").collect()}
    assert len(got) == NY * NX
    for i, r in got.items():
        for d, dr, dc in grid.D4:
            j = neighbours(heights, bc, mode, i, dr, dc)
            assert r[f"i_{d}"] == j and r[f"z_{d}"] == (None if j is None else heights.ravel()[j])
    if mode != "custom":
        for r in grid.gather(raster, "z", eight=True).collect():
            for d, dr, dc in grid.D8:
                assert r[f"i_{d}"] == neighbours(heights, bc, mode, r["i"], dr, dc)


def test_paths_over_tile_borders(spark, heights, monkeypatch):
    raster = from_matrix(spark, heights)
    links = depressions.reroute(raster, routing.receivers(raster)).cache()
    kept = raster.cells.select("i", F.lit(0.25).alias("a"))
    terms = links.join(raster.cells.select("i", F.lit(0.5).alias("a"), F.col("z").alias("b")), "i")

    def all_of():
        meta, rain = raster.meta, accumulate.discharge_sources(raster, 1.0)
        return [
            rows(accumulate.drainage_cells(links, meta), "i", "q"),
            rounded(accumulate.accumulate(links, raster.cells.select("i", F.col("z").alias("q")), meta=meta), "i", "q"),
            rounded(accumulate.ensemble(raster, 1.0, 3, 5), "i", "q"),
            rounded(accumulate.affine(terms, meta=meta), "i", "x"),
            rounded(accumulate.multiple_flow(raster, rain), "i", "q"),
            rounded(accumulate.with_loss(links, rain, kept, meta), "i", "q", "loss"),
            rounded(depressions.fill(raster, links), "i", "z"),
            rounded(depressions.breach(raster, links), "i", "z"),
            rows(depressions.basins(raster, routing.receivers(raster)), "i", "root", "bid"),
            rows(depressions.reroute(raster, routing.receivers(raster)), "i", "rcv"),
            rounded(depressions.carve_down(raster, links), "i", "z"),
        ]

    whole, small, true = all_of(), [], grid.tiled
    for module in (accumulate, depressions):
        monkeypatch.setattr(module, "tiled", lambda meta, size=256: true(meta, 3 * size // 256))
    small = all_of()
    for a, b in zip(whole, small, strict=True):
        assert a == b


def test_without_a_raster_blocks_follow_the_index(spark, monkeypatch):
    from catchwater.plans import iterate

    monkeypatch.setattr(iterate, "BLOCK", 7)
    n = 60
    chain = spark.createDataFrame([(k, k + 1 if k < n - 1 else None, 1) for k in range(n)], "i long, p long, q long")
    assert rows(iterate.descendants(chain), "i", "q") == sorted(((k, k + 1) for k in range(n)), key=str)
    up = iterate.ancestors(chain, {"q": "q"}, {"q": lambda near, far: near["q"] + far["q"]})
    assert rows(up, "i", "q") == sorted(((k, n - k) for k in range(n)), key=str)
    ring = spark.createDataFrame([(k, (k + 9) % 63, 1) for k in range(63)], "i long, p long, q long")
    with pytest.raises(ValueError):
        iterate.descendants(ring, depth=8)


def brute_reroute(z):
    """Carved receivers with plain lists: basins over their lowest saddles, round by round."""
    flat, n = z.ravel(), z.size
    near = lambda i: [j for dr, dc in ((-1, 0), (0, -1), (0, 1), (1, 0)) for j in [neighbours(z, None, "normal", i, dr, dc)] if j is not None]
    rcv = []
    for i in range(n):
        best = max(near(i), key=lambda j: flat[i] - flat[j])
        rcv.append(best if flat[i] > flat[best] else i)
    edge = {i for i in range(n) if i // NX in (0, NY - 1) or i % NX in (0, NX - 1)}
    while True:
        root = []
        for i in range(n):
            j = i
            while rcv[j] != j:
                j = rcv[j]
            root.append(-1 if j in edge else j)
        found = {}
        for i in range(n):
            for j in near(i):
                if root[i] >= 0 and root[i] != root[j]:
                    found[root[i]] = min(found.get(root[i], (np.inf,)), (max(flat[i], flat[j]), min(i, j), max(i, j), i, j))
        if not found:
            return rcv
        chosen = {pit: root[way[4]] for pit, way in found.items()}
        for pit, other in chosen.items():
            if chosen.get(other) == pit and other < pit:
                del found[pit]  # of two that chose each other the larger waits
        new = list(rcv)
        for *_, i, j in found.values():
            path = [i]
            while rcv[path[-1]] != path[-1]:
                path.append(rcv[path[-1]])
            for a, b in zip(path, path[1:], strict=False):
                new[b] = a
            new[i] = j
        rcv = new


def test_carved_links_are_the_brute_force_ones(spark, heights):
    raster = from_matrix(spark, heights)
    got = {r["i"]: r["rcv"] for r in depressions.reroute(raster, routing.receivers(raster)).collect()}
    assert [got[i] for i in range(heights.size)] == brute_reroute(heights)


def test_graphflood_with_lakes_cell_by_cell(spark, heights):
    """Two rounds of routing, lakes, accumulation and Manning depth against plain Python."""
    from catchwater.operators.flood import Flood

    z, h = heights.ravel(), np.zeros(heights.size)
    for _ in range(2):
        surface = z + h
        rcv = brute_reroute(surface.reshape(NY, NX))
        paths = []
        for i in range(len(z)):
            p = [i]
            while rcv[p[-1]] != p[-1]:
                p.append(rcv[p[-1]])
            paths.append(p)
        h = np.array([max(surface[a] + 2e-3 * k for k, a in enumerate(p)) for p in paths]) - surface + h
        q = np.zeros(len(z))
        for p in paths:
            q[p] += 1.0
        slope = np.array([1e-2 if rcv[i] == i else max(z[i] + h[i] - z[rcv[i]] - h[rcv[i]], 1e-4) for i in range(len(z))])
        h = h + np.maximum((q - h ** (5 / 3) / 0.033 * np.sqrt(slope)) * 1e-3, -h)
    got = {r["i"]: r["h"] for r in Flood(from_matrix(spark, heights)).set_depth(0.0).run_graphflood(2, 1.0).get("h").collect()}
    assert np.allclose([got[i] for i in range(len(z))], h, atol=1e-9)


def test_a_cell_takes_one_walker(spark, heights):
    from catchwater.operators import particles

    raster = from_matrix(spark, heights).with_columns(h=F.lit(0.0))
    walkers = particles.placed(raster, 90, 4)
    for step in range(2):
        raster, walkers = particles.collision_step(raster, walkers, 9, step)
        at = walkers.collect()
        assert len(at) == 90 == len({r["pos"] for r in at}) and {r["pid"] for r in at} == set(range(90))
    with pytest.raises(ValueError):
        particles.collision_step(raster, particles.placed(raster, 400, 4), 9)


def test_smoothing_cell_by_cell(spark, heights):
    """Three rounds of red and black steps, floor and volume-keeping shift against numpy."""
    from catchwater.operators import hydro

    h = (np.arange(heights.size) % 7 / 8.0).reshape(NY, NX)
    eta, colour = heights + h, np.add.outer(np.arange(NY), np.arange(NX)) % 2
    for _ in range(3):
        for parity in (0, 1):
            total = np.zeros_like(eta)
            total[1:] += eta[:-1] - eta[1:]
            total[:-1] += eta[1:] - eta[:-1]
            total[:, 1:] += eta[:, :-1] - eta[:, 1:]
            total[:, :-1] += eta[:, 1:] - eta[:, :-1]
            eta = np.where(colour == parity, eta + 0.2 * total, eta)
        eta = np.maximum(eta, heights)
        low, high = -100.0, 100.0
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if np.maximum(0, eta + c - heights).sum() < h.sum() else (low, c)
        eta = np.maximum(heights, eta + low)
    raster = from_matrix(spark, heights).with_columns(h=(F.col("i") % 7) / 8.0)
    got = {r["i"]: r["h"] for r in hydro.smoothed(raster, outer=3).cells.select("i", "h").collect()}
    assert np.allclose([got[i] for i in range(heights.size)], (eta - heights).ravel(), atol=1e-6)


def test_deposition_cell_by_cell(spark, heights):
    """Stream power, its sediment and deposition at ever farther receivers against plain Python."""
    from catchwater.operators import erosion

    raster = from_matrix(spark, heights)
    links = depressions.reroute(raster, routing.receivers(raster)).cache()
    cells = raster.cells.join(accumulate.constant_discharge(raster, links, 1.0), "i")
    rcv = {r["i"]: r["rcv"] for r in links.collect()}
    q = {r["i"]: r["q"] for r in cells.collect()}
    z, n, p = heights.ravel(), heights.size, erosion.Params()
    leave = [i // NX in (0, NY - 1) or i % NX in (0, NX - 1) for i in range(n)]
    new = {}

    def eroded(i):
        if i not in new:
            k = p.kr * p.dt * q[i] ** p.m
            new[i] = z[i] if leave[i] else z[i] / (1 + k) if rcv[i] == i else (z[i] + k * eroded(rcv[i])) / (1 + k)
        return new[i]

    height = np.array([eroded(i) for i in range(n)])
    qs = (z - height) / p.dt
    up = [rcv[i] if rcv[i] != i else None for i in range(n)]
    while any(x is not None for x in up):
        d = [min(p.kd * qs[i] / q[up[i]], qs[i]) if up[i] is not None and up[up[i]] is not None and not leave[i] and qs[i] > 0 else 0.0 for i in range(n)]  # a path's end gets nothing
        gain = np.zeros(n)
        for i in range(n):
            if d[i]:
                gain[up[i]] += d[i]
        height, qs = height + gain * p.dt, qs - np.array(d)
        up = [None if x is None else up[x] for x in up]
    got = {r["i"]: r["z"] for r in erosion.stream_power_transport(raster.with_cells(cells), links).cells.select("i", "z").collect()}
    want = np.array([height[i] for i in range(n)])
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-6)


def test_graphflood_over_random_routings(spark, heights):
    """One round over three draws against plain Python; nothing but the state is left in the shared folder."""
    import hashlib
    import os

    from catchwater.operators.flood import Flood
    from catchwater.operators.hydro import Params
    from catchwater.plans.iterate import shared_dir

    z, n, reps, seed = heights.ravel(), heights.size, 3, (5 << 20) + 0
    raster = from_matrix(spark, heights)
    here = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(here))
    got = {r["i"]: (r["h"], r["q"]) for r in Flood(raster).run_graphflood(1, 1.0, stochastic=reps, seed=5).raster.cells.collect()}
    left = [f for f in set(os.listdir(here)) - before if not f.startswith(".")]
    assert len(left) == 1 and left[0].startswith("state-")
    rcv = brute_reroute(heights)
    paths = []
    for i in range(n):
        p = [i]
        while rcv[p[-1]] != p[-1]:
            p.append(rcv[p[-1]])
        paths.append(p)
    full = np.array([max(z[a] + 2e-3 * k for k, a in enumerate(p)) for p in paths])
    full = z + (full - z)
    drawn = lambda *keys: int(hashlib.md5(",".join(map(str, keys)).encode()).hexdigest()[:13], 16) / (1 << 52)
    q = np.zeros(n)
    for rep in range(reps):
        to = []
        for i in range(n):
            best, where = 0.0, i
            for k, (dr, dc) in enumerate(((-1, 0), (0, -1), (0, 1), (1, 0))):
                j = neighbours(heights, None, "normal", i, dr, dc)
                if j is not None and full[i] > full[j] and (v := drawn(seed, rep, i, k) * (full[i] - full[j]) ** 0.5) > best:
                    best, where = v, j
            to.append(where)
        for at in range(n):
            q[at] += 1 / reps
            while to[at] != at:
                at = to[at]
                q[at] += 1 / reps
    assert np.allclose([got[i][1] for i in range(n)], q)
    p = Params()
    depth = full - z
    slope = np.array([p.edge_slope if rcv[i] == i else max(full[i] - full[rcv[i]], 1e-4) for i in range(n)])
    want = depth + np.maximum((q - depth ** (5 / 3) / p.manning * np.sqrt(slope)) * p.dt, -depth)
    assert np.allclose([got[i][0] for i in range(n)], want)
