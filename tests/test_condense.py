"""Sums over blocks condensed to their borders, against one pass in order of height."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.operators import accumulate, grid
from catchwater.operators.grid import from_matrix
from catchwater.plans import condense


def shares(z):
    """(src, dst, w) of links to lower neighbours by slope."""
    ny, nx = z.shape
    out = []
    for r in range(ny):
        for c in range(nx):
            low = [((r + a) * nx + c + b, z[r, c] - z[r + a, c + b]) for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0)) if 0 <= r + a < ny and 0 <= c + b < nx and z[r + a, c + b] < z[r, c]]
            out += [(r * nx + c, j, float(s / sum(x for _, x in low))) for j, s in low]
    return out


def down(z, links, q):
    q, by = q.copy(), {}
    for a, b, w in links:
        by.setdefault(a, []).append((b, w))
    for i in np.argsort(-z.ravel(), kind="stable"):
        for b, w in by.get(int(i), ()):
            q[b] += q[i] * w
    return q


def array(df, n):
    out = np.full(n, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["i"]])
        out[r["i"]] = r["q"]
    return out


@pytest.mark.parametrize("at_once", [1 << 21, 0])
def test_tiles_of_any_side(spark, at_once):
    """at_once=0: levels of ever larger tiles, down to one that holds all."""
    for seed, side in ((1, 3), (2, 5), (3, 100)):
        r = np.random.default_rng(seed)
        z = r.random((23, 31)) if seed < 3 else np.add.outer(np.arange(23.0) * 2, np.arange(31.0)) + r.random((23, 31)) / 4
        links, q = shares(z), np.where(r.random(z.size) < 0.7, r.random(z.size), 0.0)
        meta = grid.Meta(31, 23)
        graph = spark.createDataFrame(links, "src long, dst long, w double")
        sources = spark.createDataFrame([(i, float(x)) for i, x in enumerate(q)], "i long, q double")
        got = condense.accumulated(graph, sources, lambda level: grid.tiled(meta, side << 3 * level), at_once=at_once)
        assert np.allclose(array(got, z.size), down(z, links, q), rtol=1e-12, atol=0)


def test_long_paths_take_few_passes(spark, monkeypatch):
    """A ramp of 120 tiles: as many tables as for three, and a plan of the same size."""
    made = []
    true = condense.written
    monkeypatch.setattr(condense, "written", lambda df, name: made.append(name) or true(df, name))
    plans = []
    for n in (30, 1200):
        z = np.tile(np.arange(n, 0, -1.0), (2, 1))
        raster = from_matrix(spark, z)
        monkeypatch.setattr(accumulate, "tiled", lambda meta, size=256: grid.tiled(meta, 10 * size // 256))
        df = accumulate.multiple_flow(raster, raster.cells.select("i", F.lit(1.0).alias("q")))
        plans.append(len(df._jdf.queryExecution().optimizedPlan().toString().split("\n")))
        assert (array(df, 2 * n) == np.tile(np.arange(1.0, n + 1), 2)).all()
    assert made == ["condensed"] * 4 and plans[0] == plans[1]


def test_cells_that_only_receive_and_edges_only(spark):
    graph = spark.createDataFrame([(0, 100, 0.5), (0, 7, 0.5), (100, 200, 1.0), (7, 200, 0.25), (300, 301, 1.0)], "src long, dst long, w double")
    sources = spark.createDataFrame([(0, 8.0), (0, 8.0), (5, 1.0)], "i long, q double")
    for block in (10, 1000):
        got = {r["i"]: r["q"] for r in condense.accumulated(graph, sources, lambda level: lambda i: F.floor(i / (block << 6 * level))).collect()}
        assert got == {0: 16.0, 7: 8.0, 100: 8.0, 200: 10.0, 5: 1.0, 300: 0.0, 301: 0.0}
    assert condense.accumulated(graph.limit(0), sources.limit(0)).count() == 0


@pytest.mark.parametrize("ring", [[(0, 1), (1, 0)], [(0, 50), (50, 100), (100, 0)], [(3, 3)]])
def test_cycles_are_told(spark, ring):
    graph = spark.createDataFrame([(a, b, 0.5) for a, b in ring], "src long, dst long, w double")
    for at_once in (0, 100):
        with pytest.raises(Exception, match="the graph has a cycle"):
            condense.accumulated(graph, spark.createDataFrame([(0, 1.0)], "i long, q double"), lambda level: lambda i: F.floor(i / (10 << 6 * level)), at_once=at_once).count()
