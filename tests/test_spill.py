"""The tree of basins by one task and by rounds of tables, on flat and rough ground, with and without a way out."""

import numpy as np
import pytest

from catchwater.operators import depressions, routing
from catchwater.operators.grid import from_matrix


@pytest.mark.parametrize("closed", [False, True])
def test_rounds_and_one_task_give_the_same(spark, closed):
    r = np.random.default_rng(6)
    z = np.round(r.random((11, 14)) * 9)
    codes = np.where(r.random(z.shape) < 0.03, 0, 1).astype(np.int8)
    if not closed:
        codes[0, :4], codes[:, 0] = 3, 9
    raster = from_matrix(spark, z, boundaries=codes)
    links = routing.receivers(raster).persist()
    for carve in (True, False):
        got = [sorted(map(tuple, depressions.reroute(raster, links, carve, at_once=k).collect())) for k in (1 << 20, 0)]
        assert got[0] == got[1] and len(got[0]) == (codes != 0).sum()
        rcv, flat = dict(got[0]), codes.ravel()
        for i in rcv:
            seen = [i]
            while rcv[seen[-1]] != seen[-1]:
                seen.append(rcv[seen[-1]])
                assert len(seen) <= z.size
            assert closed or flat[seen[-1]] == 3 or not np.isin(3, flat)


def test_saddles_are_taken_by_height_and_then_by_cell(spark):
    """Three basins in a row and an outlet: pits jump where their basin was joined, carved ways lead to the root."""
    raster = from_matrix(spark, np.array([[9.0] * 9, [9, 1, 5, 0, 4, 2, 6, 7, 0], [9.0] * 9]))
    links = routing.receivers(raster)
    carved, jumped = (dict(map(tuple, depressions.reroute(raster, links, c).collect())) for c in (True, False))
    assert [carved[i] for i in range(10, 17)] == [11, 12, 13, 14, 15, 16, 17]
    assert (jumped[10], jumped[12], jumped[14]) == (11, 14, 16)  # of two that take each other's saddle, the first goes over
