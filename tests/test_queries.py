"""Queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"
NAMES = "grid_edges_custom receivers_custom drainage_cells basin_saddles filled_z mfd_weights spl_step inertial_faces face_weights halve_cubic_reflect double_resolution hillshade_multi perlin prefix_sum particle_step walked_depth walked_faces".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in os.listdir(D):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{D}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    from catchwater.plans import catalogue

    got, want = catalogue.QUERIES[name](spark, D).toPandas(), duck.sql(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tuples = lambda df: sorted(map(tuple, df[columns].itertuples(index=False)))
    assert tuples(got) == tuples(want)


def test_every_sql_has_a_query():
    from catchwater.plans import catalogue

    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
