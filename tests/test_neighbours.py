"""Golden neighbour values and border rules."""

import numpy as np
import pytest

from catchwater.operators.grid import D4, D8, Meta, can_leave, edge_class, edges, from_matrix


def links(spark, shape, mode="normal", eight=False, bc=None):
    raster = from_matrix(spark, np.zeros(shape), mode=mode, boundaries=bc)
    names = [d for d, _, _ in (D8 if eight else D4)]
    out = {}
    for r in edges(raster, eight=eight).collect():
        out.setdefault(r["i"], {})[names[r["k"]]] = r["j"]
    return out


def test_four_neighbours(spark):
    three, four = links(spark, (3, 3)), links(spark, (4, 4))
    assert three[4] == {"t": 1, "l": 3, "r": 5, "b": 7} and three[0] == {"r": 1, "b": 3}
    assert four[5] == {"t": 1, "l": 4, "r": 6, "b": 9}


def test_eight_neighbours(spark):
    got = links(spark, (3, 3), eight=True)
    assert got[4] == {"tl": 0, "t": 1, "tr": 2, "l": 3, "r": 5, "bl": 6, "b": 7, "br": 8}
    assert all(len(got[i]) == 3 for i in (0, 2, 6, 8))


def test_wrapped_axes(spark):
    ew = links(spark, (3, 3), "periodic_EW", True)
    assert ew[3]["l"] == 5 and ew[5]["r"] == 3 and (ew[3]["tl"], ew[3]["bl"]) == (2, 8) and (ew[5]["tr"], ew[5]["br"]) == (0, 6)
    assert "t" not in ew[1]
    ns = links(spark, (3, 3), "periodic_NS", True)
    assert (ns[1]["tl"], ns[1]["tr"]) == (6, 8) and (ns[7]["bl"], ns[7]["br"]) == (0, 2) and "l" not in ns[3]


def test_custom_codes(spark):
    bc = np.ones((3, 4), int)
    bc[1, 1] = 0  # nobody's neighbour
    bc[1, 0] = 9  # wraps east-west
    bc[0, 2] = 9  # wraps north-south
    bc[0, 0] = 9  # a corner: north-south
    got = links(spark, (3, 4), bc=bc)
    assert got[4] == {"t": 0, "l": 7, "b": 8} and got[2]["t"] == 10 and got[0]["t"] == 8 and "l" not in got[0]
    assert 5 not in {j for near in got.values() for j in near.values()}


@pytest.mark.parametrize("mode,n", [("normal", 10), ("periodic_EW", 8), ("periodic_NS", 6)])
def test_where_water_leaves(spark, mode, n):
    raster = from_matrix(spark, np.zeros((3, 4)), mode=mode)
    assert raster.cells.where(can_leave(raster.meta)).count() == n


def test_edge_classes(spark):
    raster = from_matrix(spark, np.zeros((3, 3)))
    assert [r[0] for r in raster.cells.orderBy("i").select(edge_class(raster.meta)).collect()] == [1, 2, 3, 4, 0, 5, 6, 7, 8]


def test_meta_and_whole_rasters(spark):
    assert Meta(3, 3, 1.0, "odd").mode == "normal"
    with pytest.raises(ValueError):
        Meta(0, 3)
    raster = from_matrix(spark, np.zeros((3, 3)))
    raster.validated()
    with pytest.raises(ValueError):
        raster.with_cells(raster.cells.where("i <> 4")).validated()
