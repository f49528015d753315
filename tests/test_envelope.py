"""Values that fall down a forest and are cut off, against walks one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.plans import envelope


@pytest.mark.parametrize("at_once", [None, 0])
def test_against_walks(spark, at_once):
    for seed, size in ((1, 4), (2, 17), (3, 500)):
        r = np.random.default_rng(seed)
        n = 300
        parent = [None if k == 0 or r.random() < 0.03 else int(r.integers(max(0, k - 12), k)) for k in range(n)]
        z = r.random(n) * 0.4 - np.arange(n) * 0.01
        start = r.random(n) < 0.15
        rows = [(k, float(z[k]), parent[k], bool(start[k])) for k in range(n)]
        want = {}
        for s in np.flatnonzero(start):
            v, at = z[s], int(s)
            while parent[at] is not None:
                v, at = v - 0.03, parent[at]
                if parent[at] is None or v > z[at] - 0.03:
                    break
                want[at] = min(want.get(at, np.inf), v)
        cells = spark.createDataFrame(rows, "i long, z double, p long, start boolean")
        got = {x["i"]: x["new"] for x in envelope.lowest(cells, 0.03, lambda i: F.floor(i / size), at_once).collect()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-12)
        assert len(want) > 20


def test_rings_are_told(spark):
    for ring in ([(0, 1), (1, 0)], [(0, 20), (20, 40), (40, 0)]):
        cells = spark.createDataFrame([(a, 1.0, b, True) for a, b in ring], "i long, z double, p long, start boolean")
        with pytest.raises(ValueError):
            envelope.lowest(cells, 0.1, lambda i: F.floor(i / 10))
