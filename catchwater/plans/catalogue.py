"""The queries over rasters derived from the tables, each with its SQL where SQL expresses it.

R1: events, 100 cells to a row, z = value. R2: orders likewise, z = o_totalprice. R3: embeddings, a row for each vector.
R4: R1 with codes: 3 on the frame (9 on the left and right frame in every fifth row), 0 at inner error events, else 1.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwater.functions.columns import uniform
from catchwater.operators import accumulate, depressions, erosion, flood, hydro, masks, noise, particles, resample, routing, scan, sparse, terrain
from catchwater.operators.grid import D4, D8, Raster, can_leave, edge_class, edges, from_arrays, from_table, is_nodata, tile_ids, with_boundaries
from catchwater.plans.iterate import shared_dir, written
from catchwater.sources import files
from catchwater.streaming import forcing

NX = 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Rasters.


def r1(spark: SparkSession, d: str, mode: str = "normal") -> Raster:
    return from_table(spark.read.parquet(f"{d}/events.parquet").select("event_id", "value"), "event_id", "value", NX, mode=mode)


def r2(spark: SparkSession, d: str) -> Raster:
    return from_table(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", NX)


def r3(spark: SparkSession, d: str) -> Raster:
    table = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return from_arrays(table, "vec_id", "embedding", 64, int(table.agg(F.max("vec_id")).first()[0]) + 1)


def r4(spark: SparkSession, d: str) -> Raster:
    table = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value", "event_type")
    base = r1(spark, d)
    raster = Raster(base.cells.join(table.select(F.col("event_id").alias("i"), "event_type"), "i"), base.meta)
    kind = edge_class(raster.meta)
    bc = F.when(kind.isin(4, 5) & (F.col("row") % 5 == 0), 9).when(kind > 0, 3).when(F.col("event_type") == "error", 0).otherwise(1)
    coded = with_boundaries(raster, bc)
    return coded.with_cells(coded.cells.drop("event_type"))


def wet(raster: Raster) -> Raster:
    """Depth and discharge that depend on the cell's number alone, zero in places."""
    return raster.with_columns(h=(F.col("i") % 7) / 8.0, q=(F.col("i") % 11) / 4.0, qx=((F.col("i") % 5) - 2) / 16.0, qy=((F.col("i") % 3) - 1) / 16.0)


# SQL of rasters.

_C1 = "c AS (SELECT CAST(event_id AS BIGINT) AS i, CAST(event_id // 100 AS BIGINT) AS r, CAST(event_id % 100 AS BIGINT) AS q, CAST(value AS DOUBLE) AS z FROM events), g AS (SELECT max(r) + 1 AS ny, CAST(100 AS BIGINT) AS nx FROM c)"
_KIND = "CASE WHEN r = 0 AND q = 0 THEN 1 WHEN r = 0 AND q = nx - 1 THEN 3 WHEN r = 0 THEN 2 WHEN r = ny - 1 AND q = 0 THEN 6 WHEN r = ny - 1 AND q = nx - 1 THEN 8 WHEN r = ny - 1 THEN 7 WHEN q = 0 THEN 4 WHEN q = nx - 1 THEN 5 ELSE 0 END"
_C4 = (
    "c0 AS (SELECT CAST(event_id AS BIGINT) AS i, CAST(event_id // 100 AS BIGINT) AS r, CAST(event_id % 100 AS BIGINT) AS q, CAST(value AS DOUBLE) AS z, event_type FROM events), "
    f"g AS (SELECT max(r) + 1 AS ny, CAST(100 AS BIGINT) AS nx FROM c0), c1 AS (SELECT i, r, q, z, event_type, {_KIND} AS kind FROM c0, g), "
    "c AS (SELECT i, r, q, z, kind, CASE WHEN kind IN (4, 5) AND r % 5 = 0 THEN 9 WHEN kind > 0 THEN 3 WHEN event_type = 'error' THEN 0 ELSE 1 END AS bc FROM c1)"
)
_LEAVE = {"normal": "(r = 0 OR r = ny - 1 OR q = 0 OR q = nx - 1)", "periodic_EW": "(r = 0 OR r = ny - 1)", "periodic_NS": "(q = 0 OR q = nx - 1)", "custom": "(bc = 3)"}
# Neighbour values by windows, for single steps in normal mode; {v} is any column.
_WIN = "lag({v}) OVER cc AS {v}_t, lag({v}) OVER rr AS {v}_l, lead({v}) OVER rr AS {v}_r, lead({v}) OVER cc AS {v}_b"
_WINDOWS = "WINDOW rr AS (PARTITION BY r ORDER BY q), cc AS (PARTITION BY q ORDER BY r)"


def _edges_sql(mode: str = "normal", eight: bool = False) -> str:
    """CTEs up to e(i, k, j, z, zj)."""
    d = ", ".join(f"({k}, {a}, {b})" for k, (_, a, b) in enumerate(D8 if eight else D4))
    wrap_q = {"periodic_EW": "(q2 + nx) % nx", "custom": "CASE WHEN bc = 9 AND kind IN (4, 5) THEN (q2 + nx) % nx ELSE q2 END"}.get(mode, "q2")
    wrap_r = {"periodic_NS": "(r2 + ny) % ny", "custom": "CASE WHEN bc = 9 AND kind IN (1, 2, 3, 6, 7, 8) THEN (r2 + ny) % ny ELSE r2 END"}.get(mode, "r2")
    more = ", bc, kind" if mode == "custom" else ""
    return (
        f"{_C4 if mode == 'custom' else _C1}, d(k, dr, dc) AS (VALUES {d}), e0 AS (SELECT i, z, k, r + dr AS r2, q + dc AS q2{more} FROM c, d), "
        f"e1 AS (SELECT i, z, k, {wrap_r} AS r3, {wrap_q} AS q3 FROM e0, g), e2 AS (SELECT i, z, k, r3 * nx + q3 AS j FROM e1, g WHERE r3 BETWEEN 0 AND ny - 1 AND q3 BETWEEN 0 AND nx - 1), "
        f"e AS (SELECT e2.i, CAST(k AS BIGINT) AS k, j, e2.z, n.z AS zj FROM e2 JOIN c n ON n.i = j{' WHERE n.bc <> 0' if mode == 'custom' else ''})"
    )


def _receivers_sql(mode: str = "normal", eight: bool = False) -> str:
    own = "SELECT i FROM c WHERE bc <> 0" if mode == "custom" else "SELECT i FROM c"
    return f"{_edges_sql(mode, eight)}, best AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY z - zj DESC, k) AS n FROM e WHERE z > zj) WHERE n = 1), rec AS (SELECT o.i, coalesce(best.j, o.i) AS rcv FROM ({own}) o LEFT JOIN best ON best.i = o.i)"


# Every cell with each of its ancestors a and their distance k.
_PATHS = "paths(i, a, k) AS (SELECT i, i, CAST(0 AS BIGINT) FROM rec UNION ALL SELECT p.i, rec.rcv, p.k + 1 FROM paths p JOIN rec ON rec.i = p.a WHERE rec.rcv <> p.a)"
_BASINS = "roots AS (SELECT p.i, p.a AS root FROM paths p JOIN rec ON rec.i = p.a AND rec.rcv = rec.i), bas AS (SELECT roots.i, root, CASE WHEN {leave} THEN 0 ELSE root + 1 END AS bid FROM roots JOIN c ON c.i = root, g)"


def _recursive(tail: str, mode: str = "normal", more: str = "") -> str:
    return f"WITH RECURSIVE {_receivers_sql(mode)}, {_PATHS}{more} {tail}"


def _uniform_sql(seed: int, index: str) -> str:
    x = f"((CAST({index} AS BIGINT) + {seed}) & 4294967295)"
    x = f"xor(xor({x}, 61), {x} >> 16)"
    x = f"(({x} + ({x} << 3)) & 4294967295)"
    x = f"xor({x}, {x} >> 4)"
    x = f"(({x} * 668265261) & 4294967295)"
    return f"(xor({x}, {x} >> 15) / 4294967295.0e0)"


def _drawn_sql(seed: int, *keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || left(md5(concat_ws(',', '{seed}', {text})), 13) AS BIGINT) / 4503599627370496.0e0)"


# Grid.


def _edge_queries() -> None:
    for name, mode, eight in (("grid_edges_normal", "normal", False), ("grid_edges_pew", "periodic_EW", False), ("grid_edges_pns", "periodic_NS", False), ("grid_edges_custom", "custom", False), ("edges_d8", "normal", True), ("edges_d8_pew", "periodic_EW", True), ("edges_d8_pns", "periodic_NS", True)):

        def run(spark: SparkSession, d: str, mode=mode, eight=eight) -> DataFrame:
            return edges(r4(spark, d) if mode == "custom" else r1(spark, d, mode), eight=eight).select("i", "k", "j")

        QUERIES[name], SQL[name] = run, f"WITH {_edges_sql(mode, eight)} SELECT i, k, j FROM e"
    for name, mode, eight in (("receivers_d4", "normal", False), ("receivers_pew", "periodic_EW", False), ("receivers_pns", "periodic_NS", False), ("receivers_custom", "custom", False), ("receivers_d8", "normal", True)):

        def route(spark: SparkSession, d: str, mode=mode, eight=eight) -> DataFrame:
            return routing.receivers(r4(spark, d) if mode == "custom" else r1(spark, d, mode), eight=eight)

        QUERIES[name], SQL[name] = route, f"WITH {_receivers_sql(mode, eight)} SELECT i, rcv FROM rec"
    for mode in ("normal", "periodic_EW", "periodic_NS", "custom"):

        def leaving(spark: SparkSession, d: str, mode=mode) -> DataFrame:
            raster = r4(spark, d) if mode == "custom" else r1(spark, d, mode)
            return raster.cells.select("i", edge_class(raster.meta).cast("long").alias("edge"), can_leave(raster.meta).cast("long").alias("leaves"), is_nodata(raster.meta).cast("long").alias("nodata"))

        name = f"edge_class_{mode.lower()}"
        QUERIES[name] = leaving
        SQL[name] = f"WITH {_C4 if mode == 'custom' else _C1} SELECT i, CAST({_KIND} AS BIGINT) AS edge, CAST({_LEAVE[mode]} AS BIGINT) AS leaves, CAST({'bc = 0' if mode == 'custom' else 'false'} AS BIGINT) AS nodata FROM c, g"


_edge_queries()


@query(f"WITH {_C1} SELECT i, (((r - 3 + ny) % ny) // 8) * 13 + (((q - 5 + nx) % nx) // 8) + 1 AS tile FROM c, g")
def tiles(spark, d):
    raster = r1(spark, d)
    return raster.cells.select("i", tile_ids(raster.meta, 8, (3, 5)).alias("tile"))


@query(f"WITH {_C1} SELECT r AS \"row\", max(z) AS most, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY r")
def field_rows(spark, d):
    return r1(spark, d).rows("z").select("row", F.array_max("values").alias("most"), F.size("values").cast("long").alias("n"))


# Routing and sums.


@query(f"WITH {_receivers_sql()} SELECT rcv AS i, CAST(count(*) AS BIGINT) AS n FROM rec WHERE rcv <> i GROUP BY rcv")
def donor_counts(spark, d):
    return routing.donors(routing.receivers(r1(spark, d))).select("i", "n")


@query(f"WITH {_receivers_sql()} SELECT CAST(count(*) AS BIGINT) AS n FROM rec JOIN c ON c.i = rec.i, g WHERE rec.rcv = rec.i AND NOT {_LEAVE['normal']}")
def pit_count(spark, d):
    raster = r1(spark, d)
    return routing.pits(raster, routing.receivers(raster), can_leave(raster.meta)).agg(F.count("*").alias("n"))


@query(_recursive("SELECT a AS i, CAST(count(*) AS BIGINT) AS q FROM paths GROUP BY a"))
def drainage_cells(spark, d):
    raster = r1(spark, d)
    return accumulate.drainage_cells(routing.receivers(raster), raster.meta)


@query(_recursive("SELECT a AS i, CAST(count(*) AS BIGINT) AS q FROM paths GROUP BY a", "periodic_EW"))
def drainage_cells_pew(spark, d):
    raster = r1(spark, d, "periodic_EW")
    return accumulate.drainage_cells(routing.receivers(raster), raster.meta)


@query(_recursive("SELECT a AS i, CAST(count(*) * 0.5e0 AS DOUBLE) AS q FROM paths GROUP BY a"))
def drainage_area(spark, d):
    raster = r1(spark, d)
    return accumulate.constant_discharge(raster, routing.receivers(raster), 0.5)


@query(_recursive("SELECT a AS i, round(sum(c.z), 4) AS q FROM paths JOIN c ON c.i = paths.i GROUP BY a"))
def custom_accumulation(spark, d):
    raster = r1(spark, d)
    q = accumulate.accumulate(routing.receivers(raster), raster.cells.select("i", F.col("z").alias("q")), meta=raster.meta)
    return q.select("i", F.round("q", 4).alias("q"))


_DRAW = "draw AS (SELECT rep, i, j, k, " + _drawn_sql(7, "rep", "i", "k") + " * sqrt(z - zj) AS v FROM e, (SELECT unnest(range(4)) AS rep) WHERE z > zj), srec AS (SELECT reps.rep, c.i, coalesce(b.j, c.i) AS rcv FROM c CROSS JOIN (SELECT unnest(range(4)) AS rep) reps LEFT JOIN (SELECT rep, i, j FROM (SELECT rep, i, j, row_number() OVER (PARTITION BY rep, i ORDER BY v DESC, k) AS n FROM draw WHERE v > 0) WHERE n = 1) b ON b.i = c.i AND b.rep = reps.rep)"


@query(f"WITH {_edges_sql()}, {_DRAW} SELECT CAST(rep AS BIGINT) AS rep, i, rcv FROM srec")
def stochastic_receivers(spark, d):
    return routing.stochastic_receivers(r1(spark, d), 7, 4)


@query(
    f"WITH RECURSIVE {_edges_sql()}, {_DRAW}, p(rep, i, a) AS (SELECT rep, i, i FROM srec UNION ALL SELECT p.rep, p.i, s.rcv FROM p JOIN srec s ON s.rep = p.rep AND s.i = p.a WHERE s.rcv <> p.a) "
    "SELECT a AS i, count(*) * 0.25e0 AS q FROM p GROUP BY a"
)
def ensemble_area(spark, d):
    return accumulate.ensemble(r1(spark, d), 1.0, 4, 7)


@query(
    f"WITH RECURSIVE {_edges_sql()}, {_DRAW}, p(rep, i, a) AS (SELECT rep, i, i FROM srec UNION ALL SELECT p.rep, p.i, s.rcv FROM p JOIN srec s ON s.rep = p.rep AND s.i = p.a WHERE s.rcv <> p.a) "
    "SELECT a AS i, round(sum(n * pow(0.5e0, 4 - rep)), 6) AS q FROM (SELECT rep, a, count(*) AS n FROM p GROUP BY rep, a) GROUP BY a"
)
def ensemble_filtered(spark, d):
    return rounded(accumulate.ensemble(r1(spark, d), 1.0, 4, 7, memory=0.5), "q")


@query(f"WITH {_edges_sql()} SELECT c.i, CAST(count(e.i) AS BIGINT) AS n FROM c LEFT JOIN e ON e.i = c.i AND e.zj > e.z GROUP BY c.i")
def mfd_indegree(spark, d):
    return accumulate.indegree(r1(spark, d))


# Shares of the downward slopes, which are added in the order of directions.
_DOWN = "greatest(0, coalesce({v} - {v}_t, 0)) + greatest(0, coalesce({v} - {v}_l, 0)) + greatest(0, coalesce({v} - {v}_r, 0)) + greatest(0, coalesce({v} - {v}_b, 0))"
_SHARES = f"WITH RECURSIVE {_edges_sql()}, t AS (SELECT i, {_DOWN.format(v='z')} AS total FROM (SELECT *, {_WIN.format(v='z')} FROM c {_WINDOWS})), w AS (SELECT e.i, k, j, (z - zj) / total AS w FROM e JOIN t ON t.i = e.i WHERE z > zj)"


@query(f"{_SHARES} SELECT i, k, j, floor(w * 1e6) / 1e6 AS w FROM w")
def mfd_weights(spark, d):
    """Shares cut, not rounded, to six digits: engines round halves of binary fractions differently."""
    return accumulate.slope_weights(r1(spark, d)).select("i", "k", "j", (F.floor(F.col("w") * 1e6) / F.lit(1e6)).alias("w"))


@query(f"{_SHARES}, v(n, i, q) AS (SELECT CAST(0 AS BIGINT), i, CAST(1 AS DOUBLE) FROM c UNION ALL SELECT v.n + 1, w.j, sum(v.q * w.w) FROM v JOIN w ON w.i = v.i GROUP BY v.n + 1, w.j) SELECT i, round(sum(q), 6) AS q FROM v GROUP BY i")
def multiple_flow(spark, d):
    raster = r1(spark, d)
    return rounded(accumulate.multiple_flow(raster, accumulate.discharge_sources(raster, 1.0)), "q")


@query(f"WITH {_edges_sql()} SELECT c.i, round(coalesce(sum(e.z - e.zj), 0), 6) AS total FROM c LEFT JOIN e ON e.i = c.i AND e.z > e.zj GROUP BY c.i")
def slope_sums(spark, d):
    return rounded(terrain.slope_sums(r1(spark, d)), "total")


@query(f"WITH {_C1} SELECT i, coalesce(z - lead(z) OVER (PARTITION BY r ORDER BY q), 0) AS slope FROM c")
def slope_right(spark, d):
    return terrain.slope_towards(r1(spark, d), "r")


@query(_recursive("SELECT paths.i, round(sum(pow(1e0 / 3e0, k) * c.z), 6) AS x FROM paths JOIN c ON c.i = paths.a GROUP BY paths.i"))
def affine_upstream(spark, d):
    raster = r1(spark, d)
    return rounded(accumulate.affine(routing.receivers(raster).join(raster.cells.select("i", F.lit(1.0 / 3.0).alias("a"), F.col("z").alias("b")), "i"), meta=raster.meta), "x")


@query(_recursive("SELECT a AS i, round(sum(pow(0.75e0, k)), 6) AS q, round(0.25e0 * sum(pow(0.75e0, k)), 6) AS loss FROM paths GROUP BY a"))
def accumulation_with_loss(spark, d):
    raster = r1(spark, d)
    kept = raster.cells.select("i", F.lit(0.25).alias("a"))
    return rounded(accumulate.with_loss(routing.receivers(raster), accumulate.discharge_sources(raster, 1.0), kept, raster.meta), "q", "loss")


# Depressions.


def _basin_sql(tail: str) -> str:
    return _recursive(tail, more=", " + _BASINS.format(leave=_LEAVE["normal"]))


@query(_basin_sql("SELECT i, root, CAST(bid AS BIGINT) AS bid FROM bas"))
def basin_labels(spark, d):
    raster = r1(spark, d)
    return depressions.basins(raster, routing.receivers(raster))


@query(_basin_sql("SELECT CAST(bid AS BIGINT) AS bid, CAST(count(*) AS BIGINT) AS n FROM bas GROUP BY bid"))
def basin_sizes(spark, d):
    raster = r1(spark, d)
    return depressions.basins(raster, routing.receivers(raster)).groupBy("bid").agg(F.count("*").alias("n"))


@query(_basin_sql("SELECT bid, saddle, outlet, height FROM (SELECT CAST(a.bid AS BIGINT) AS bid, e.i AS saddle, e.j AS outlet, greatest(e.z, e.zj) AS height, row_number() OVER (PARTITION BY a.bid ORDER BY greatest(e.z, e.zj), least(e.i, e.j), greatest(e.i, e.j)) AS n FROM e JOIN bas a ON a.i = e.i JOIN bas b ON b.i = e.j WHERE a.bid <> 0 AND a.bid <> b.bid) WHERE n = 1"))
def basin_saddles(spark, d):
    raster = r1(spark, d)
    return depressions.saddles(raster, depressions.basins(raster, routing.receivers(raster))).select("bid", "saddle", "outlet", "height")


@query("SELECT CAST(0 AS BIGINT) AS pits, CAST(count(*) AS BIGINT) AS cells FROM events")
def rerouted_by_carving(spark, d):
    return _rerouted(spark, d, True)


@query("SELECT CAST(0 AS BIGINT) AS pits, CAST(count(*) AS BIGINT) AS cells FROM events")
def rerouted_by_jumping(spark, d):
    return _rerouted(spark, d, False)


def _rerouted(spark: SparkSession, d: str, carve: bool) -> DataFrame:
    """Pits left, and cells that drain through roots: all of them, once each, if the links have no cycle."""
    raster = r1(spark, d)
    links = depressions.reroute(raster, routing.receivers(raster), carve)
    q = accumulate.drainage_cells(links)
    ends = links.where("rcv = i").join(raster.cells.select("i", can_leave(raster.meta).alias("leaves")), "i").join(q, "i")
    return ends.agg(F.count_if(~F.col("leaves")).alias("pits"), F.sum("q").alias("cells"))


@query()
def carved_receivers(spark, d):
    raster = r1(spark, d)
    return depressions.reroute(raster, routing.receivers(raster))


@query(_recursive("SELECT paths.i, round(max(c.z + k * 0.125e0), 6) AS z FROM paths JOIN c ON c.i = a GROUP BY paths.i"))
def filled_z(spark, d):
    raster = r1(spark, d)
    return rounded(depressions.fill(raster, routing.receivers(raster), 0.125), "z")


@query(_recursive("SELECT paths.i, round(min(c.z + k * 0.5625e0), 6) AS z FROM paths JOIN c ON c.i = paths.a JOIN rec ON rec.i = paths.a WHERE rec.rcv <> rec.i OR k = 0 GROUP BY paths.i"))
def breached_z(spark, d):
    raster = r1(spark, d)
    return rounded(depressions.breach(raster, routing.receivers(raster), 0.5625), "z")


@query(f"WITH {_C1}, s AS (SELECT i, z, (i % 7) / 8.0e0 - 0.25e0 AS d FROM c) SELECT i, CASE WHEN d < 0 THEN z + d ELSE z END AS z, CASE WHEN d < 0 THEN 0 ELSE round((z + d) - z, 6) END AS h FROM s")
def split_surface(spark, d):
    raster = r1(spark, d).with_columns(zh=F.col("z") + ((F.col("i") % 7) / 8.0 - 0.25))
    return rounded(raster.with_columns(**depressions.split_surface()).cells.select("i", "z", "h"), "h")


@query()
def carved_down(spark, d):
    raster = r1(spark, d)
    return rounded(depressions.carve_down(raster, depressions.reroute(raster, routing.receivers(raster))), "z")


# Water. Depth and discharge come from the cell number, see wet().

_WET = f"{_C1}, w AS (SELECT i, r, q AS col, q, z, (i % 7) / 8.0e0 AS h, (i % 11) / 4.0e0 AS qq, ((i % 5) - 2) / 16.0e0 AS qx, ((i % 3) - 1) / 16.0e0 AS qy, z + (i % 7) / 8.0e0 AS zh FROM c)"
_WETN = f"{_WET}, n AS (SELECT *, {_WIN.format(v='zh')}, {_WIN.format(v='z')}, {_WIN.format(v='h')} FROM w {_WINDOWS}), m AS (SELECT n.*, g.*, greatest(0, coalesce(zh - zh_l, 0), coalesce(zh - zh_r, 0)) AS mx, greatest(0, coalesce(zh - zh_t, 0), coalesce(zh - zh_b, 0)) AS my, {_LEAVE['normal']} AS leaves FROM n, g)"


@query(f"WITH {_WET} SELECT i, round(h + 1e-4, 6) AS h FROM w")
def rain(spark, d):
    return rounded(hydro.rain(wet(r1(spark, d)), hydro.Params(rain=1e-3)).cells.select("i", "h"), "h")


@query(f"WITH {_WETN} SELECT i, CASE WHEN leaves THEN 0.125e0 ELSE h END AS h FROM m")
def outlet_depth(spark, d):
    return hydro.outlet_depth(wet(r1(spark, d)), 0.125).cells.select("i", "h")


@query(f"WITH {_WETN} SELECT i, round(CASE WHEN leaves THEN 0 ELSE sqrt(mx * mx + my * my) END, 6) AS sw FROM m")
def hydraulic_slope(spark, d):
    return rounded(hydro.hydraulic_slope(wet(r1(spark, d))), "sw")


@query(f"WITH {_WETN} SELECT i, round(CASE WHEN leaves THEN 0 ELSE sqrt(mx * mx + my * my) END * h * 1000 * 9.81e0, 3) AS tau FROM m")
def shear_stress(spark, d):
    return hydro.shear_stress(wet(r1(spark, d))).select("i", F.round("tau", 3).alias("tau"))


@query(f"WITH {_WETN} SELECT i, round(CASE WHEN leaves OR sqrt(mx * mx + my * my) <= 0 THEN 0 ELSE pow(h, 5e0 / 3e0) / 0.033e0 * sqrt(sqrt(mx * mx + my * my)) END, 6) AS qo FROM m")
def outflow_capacity(spark, d):
    return rounded(hydro.outflow_capacity(wet(r1(spark, d))), "qo")


@query(
    f"WITH {_receivers_sql()}, w AS (SELECT c.i, z, (c.i % 7) / 8.0e0 AS h, (c.i % 11) / 4.0e0 AS qq, rcv FROM c JOIN rec ON rec.i = c.i), s AS (SELECT w.*, CASE WHEN w.rcv = w.i THEN 1e-2 ELSE greatest((w.z + w.h) - (v.z + v.h), 1e-4) END AS s FROM w JOIN w v ON v.i = w.rcv) "
    "SELECT i, round(h + greatest((qq - pow(h, 5e0 / 3e0) / 0.033e0 * sqrt(s)) * 1e-3, -h), 6) AS h FROM s"
)
def manning_core(spark, d):
    raster = r1(spark, d)
    return rounded(hydro.manning_core(wet(raster), routing.receivers(raster)).cells.select("i", "h"), "h")


_DEPTH = "CASE WHEN leaves THEN 0 ELSE greatest(0, h + (qq - pow(h, 5e0 / 3e0) / 0.033e0 * sqrt(sqrt(mx * mx + my * my))) * 1e-3) END"


@query(f"WITH {_WETN} SELECT i, round({_DEPTH}, 6) AS h FROM m")
def depth_step(spark, d):
    return rounded(hydro.depth_step(wet(r1(spark, d))).cells.select("i", "h"), "h")


@query(f"WITH {_WETN} SELECT i, round(CASE WHEN i % 2 = 0 THEN {_DEPTH} ELSE h END, 6) AS h FROM m")
def depth_step_masked(spark, d):
    return rounded(hydro.depth_step(wet(r1(spark, d)), mask=F.col("i") % 2 == 0).cells.select("i", "h"), "h")


@query(f"WITH {_WETN} SELECT i, round(CASE WHEN leaves THEN h ELSE h + qq * 0.25e0 END, 6) AS h FROM m")
def splat(spark, d):
    return rounded(hydro.splat(wet(r1(spark, d)), 0.25).cells.select("i", "h"), "h")


@query(f"WITH {_WETN}, f AS (SELECT *, mx <= 0 AND my <= 0 AS flat FROM m), t AS (SELECT *, CASE WHEN flat THEN 1e-2 ELSE mx END AS ax, CASE WHEN flat THEN 1e-2 ELSE my END AS ay FROM f) SELECT i, round(CASE WHEN leaves THEN h ELSE 0.75e0 * pow(qq * 0.033e0 / sqrt(sqrt(ax * ax + ay * ay)), 0.6e0) + 0.25e0 * h END, 6) AS h FROM t")
def analytic_depth(spark, d):
    return rounded(hydro.analytic_depth(wet(r1(spark, d)), keep_old=0.25).cells.select("i", "h"), "h")


def _face_sql(n: str, name: str, place: str, size: str) -> str:
    """CTE face columns by the inertial rule, written stage by stage."""
    return (
        f"{name}1 AS (SELECT *, greatest(zh, zh_{n}) - greatest(z, z_{n}) AS deep, CASE WHEN {place} = {size} - 1 THEN 1e-2 WHEN {place} <= 2 THEN -1e-2 ELSE zh_{n} - zh END AS s FROM {'m' if name == 'qy' else 'qy4'}), "
        f"{name}2 AS (SELECT *, CASE WHEN deep > 1e-3 THEN ({name} - 9.81e0 * deep * 0.1e0 * s) / (1 + 9.81e0 * deep * 0.1e0 * (0.033e0 * 0.033e0) * abs({name}) / pow(deep, 10e0 / 3e0)) END AS flow, CASE WHEN deep > 1e-3 THEN deep * sqrt(9.81e0 * deep) END AS fast FROM {name}1), "
        f"{name}3 AS (SELECT *, CASE WHEN abs(flow) > fast THEN CASE WHEN flow >= 0 THEN fast ELSE -fast END ELSE flow END AS cap FROM {name}2), "
        f"{name}4 AS (SELECT * EXCLUDE (deep, s, flow, fast, cap), CASE WHEN r = 0 OR col = 0 OR h_{n} IS NULL THEN {name} WHEN (h <= 0 AND h_{n} <= 0) OR deep <= 1e-3 THEN 0 WHEN cap > 0 AND cap * 0.1e0 > h / 4 THEN h / 5 / 0.1e0 WHEN cap < 0 AND abs(cap) * 0.1e0 > h_{n} / 4 THEN -h_{n} / 5 / 0.1e0 ELSE cap END AS n{name} FROM {name}3)"
    )


_INERTIAL = f"{_WETN}, {_face_sql('t', 'qy', 'r', 'ny')}, {_face_sql('l', 'qx', 'col', 'nx')}"


@query(f"WITH {_INERTIAL} SELECT i, round(nqx, 6) + 0 AS qx, round(nqy, 6) + 0 AS qy FROM qx4")
def inertial_faces(spark, d):
    return rounded(hydro.inertial_faces(wet(r1(spark, d))).cells.select("i", "qx", "qy"), "qx", "qy")


@query(f"WITH {_WET} SELECT i, round(h + 0.1e0 * (coalesce(lead(qy) OVER cc, 0) - qy + coalesce(lead(qx) OVER rr, 0) - qx), 6) AS h FROM w {_WINDOWS}")
def inertial_depth(spark, d):
    return rounded(hydro.inertial_depth(wet(r1(spark, d))).cells.select("i", "h"), "h")


def _inertial_run_sql(steps: int, rate: float) -> str:
    """Rain, faces and depth, `steps` times from a dry raster."""
    out = [_C1, "s0 AS (SELECT i, r, q AS col, z, CAST(0 AS DOUBLE) AS h, CAST(0 AS DOUBLE) AS qx, CAST(0 AS DOUBLE) AS qy FROM c)"]
    for k in range(steps):
        out.append(f"a{k} AS (SELECT i, r, col, z, h + {rate!r}e0 * 0.1e0 AS h, qx, qy FROM s{k})")
        near = _WIN.format(v="h") + ", " + _WIN.format(v="z") + ", lag(z + h) OVER cc AS zh_t, lag(z + h) OVER rr AS zh_l"
        out.append(f"m{k} AS (SELECT a{k}.*, g.*, z + h AS zh, {near} FROM a{k}, g WINDOW rr AS (PARTITION BY r ORDER BY col), cc AS (PARTITION BY col ORDER BY r))")
        y, x = _face_sql("t", "qy", "r", "ny"), _face_sql("l", "qx", "col", "nx")
        for name in ("qy", "qx"):
            for n in "1234":
                y, x = (f.replace(f"{name}{n}", f"{name}{n}_{k}") for f in (y, x))
        out += [y.replace("FROM m)", f"FROM m{k})"), x]
        out.append(
            f"s{k + 1} AS (SELECT i, r, col, z, h + 0.1e0 * (coalesce(lead(nqy) OVER cc, 0) - nqy + coalesce(lead(nqx) OVER rr, 0) - nqx) AS h, nqx AS qx, nqy AS qy FROM qx4_{k} WINDOW rr AS (PARTITION BY r ORDER BY col), cc AS (PARTITION BY col ORDER BY r))"
        )
    return f"WITH {', '.join(out)} SELECT i, round(h, 6) AS h FROM s{steps}"


@query(_inertial_run_sql(3, 1e-2))
def inertial_run(spark, d):
    return rounded(flood.Flood(r1(spark, d)).run_inertial(3, 1e-2).get("h"), "h")


_SW = f"{_WETN}, e AS (SELECT i, unnest([i - 100, i - 1, i + 1, i + 100]) AS j, unnest([zh - zh_t, zh - zh_l, zh - zh_r, zh - zh_b]) AS s, qq FROM m WHERE NOT leaves), ew AS (SELECT i, j, s / sum(s) OVER (PARTITION BY i) AS w, qq FROM e WHERE s > 0), got AS (SELECT j AS i, sum(w * qq) AS more FROM ew GROUP BY j)"


@query(f"WITH {_SW} SELECT m.i, round(0.75e0 * (1 + coalesce(more, 0)) + 0.25e0 * qq, 6) AS q FROM m LEFT JOIN got ON got.i = m.i")
def mfd_diffuse(spark, d):
    return rounded(hydro.diffuse(wet(r1(spark, d)), F.lit(1.0), keep_old=0.25), "q")


@query(f"WITH {_SW} SELECT m.i, round(CASE WHEN m.i % 3 = 0 THEN 0.2e0 * qq + 0.8e0 * (1 + coalesce(more, 0)) ELSE qq END, 6) AS q FROM m LEFT JOIN got ON got.i = m.i")
def sweep_masked(spark, d):
    raster = wet(r1(spark, d)).with_columns(zh=F.col("z") + F.col("h"))
    return rounded(hydro.sweep(raster, F.lit(1.0), 0.8, F.col("i") % 3 == 0), "q")


@query(f"WITH {_SW} SELECT m.i, round(CASE WHEN NOT leaves AND (r + col) % 2 = 1 THEN 0.2e0 * qq + 0.8e0 * (1 + coalesce(more, 0)) ELSE qq END, 6) AS q FROM m LEFT JOIN got ON got.i = m.i")
def sweep_colour(spark, d):
    raster = wet(r1(spark, d)).with_columns(zh=F.col("z") + F.col("h"))
    return rounded(hydro.sweep(raster, F.lit(1.0), 0.8, parity=1), "q")


def _links_sql(name: str, base: str) -> str:
    """CTEs name_n (neighbours of zh), name_w(i, j, w): shares of cells that water cannot leave, slopes added in the order of directions."""
    win = _WINDOWS.replace("PARTITION BY q", "PARTITION BY col").replace("ORDER BY q", "ORDER BY col")
    return (
        f"{name}_n AS (SELECT *, {_WIN.format(v='zh')} FROM {base} {win}), "
        f"{name}_e AS (SELECT i, {_DOWN.format(v='zh')} AS total, unnest([i - 100, i - 1, i + 1, i + 100]) AS j, unnest([zh - zh_t, zh - zh_l, zh - zh_r, zh - zh_b]) AS s FROM {name}_n, g WHERE NOT (r = 0 OR r = ny - 1 OR col = 0 OR col = nx - 1)), "
        f"{name}_w AS (SELECT i, j, s / total AS w FROM {name}_e WHERE s > 0)"
    )


_RATE = "(0.01e0 / 3600)"
_TILE_OF = "(({i} // 100) // 10) * 10 + ({i} % 100) // 10"


def _sweeps_sql(n: int) -> str:
    out = [
        f"{_WETN}, p AS (SELECT *, least(zh_t, zh_l, zh_r, zh_b) AS low FROM m)",
        "b AS (SELECT i, r, col, qq, CASE WHEN NOT leaves AND zh <= low THEN zh + (floor((low - zh) / 1e-3) + 1) * 1e-3 ELSE zh END AS zh FROM p)",
        _links_sql("k", "b"),
        "v0 AS (SELECT i, qq AS q FROM b)",
    ]
    for k in range(n):
        same = f"{_TILE_OF.format(i='l.i')} = {_TILE_OF.format(i='l.j')}"
        out.append(f"u{k} AS (SELECT l.j AS i, sum(CASE WHEN {same} THEN v.q ELSE b.qq END * w) AS more FROM k_w l JOIN v{k} v ON v.i = l.i JOIN b ON b.i = l.i GROUP BY l.j)")
        out.append(f"v{k + 1} AS (SELECT b.i, {_RATE} + coalesce(more, 0) AS q FROM b LEFT JOIN u{k} u ON u.i = b.i)")
    return f"WITH {', '.join(out)} SELECT i, round(q, 6) AS q FROM v{n}"


@query(_sweeps_sql(2))
def sweeps_tiled(spark, d):
    return rounded(flood.Flood(wet(r1(spark, d))).run_sweeps(2, tile=10).get("q"), "q")


@query(f"WITH {_SW}, f AS (SELECT CASE WHEN j = i - 100 OR j = i - 1 THEN j ELSE i END AS i, CASE WHEN j = i - 1 THEN -w WHEN j = i + 1 THEN w END AS wx, CASE WHEN j = i - 100 THEN -w WHEN j = i + 100 THEN w END AS wy FROM ew), s AS (SELECT i, sum(wx) AS wx, sum(wy) AS wy FROM f GROUP BY i) SELECT c.i, round(coalesce(wx, 0), 6) AS wx, round(coalesce(wy, 0), 6) AS wy FROM c LEFT JOIN s ON s.i = c.i")
def face_weights(spark, d):
    return rounded(hydro.face_weights(wet(r1(spark, d))), "wx", "wy")


@query(f"WITH {_WETN}, p AS (SELECT *, least(zh_t, zh_l, zh_r, zh_b) AS low FROM m) SELECT i, round(CASE WHEN NOT leaves AND zh <= low THEN zh + (floor((low - zh) / 0.125e0) + 1) * 0.125e0 ELSE zh END, 6) AS zh FROM p")
def raised_pits(spark, d):
    raster = wet(r1(spark, d)).with_columns(zh=F.col("z") + F.col("h"))
    return rounded(hydro.raised_pits(raster, lift=0.125).cells.select("i", "zh"), "zh")


@query(f"WITH {_WETN} SELECT i, round(CASE WHEN (r + col) % 2 = 0 THEN zh + 0.2e0 * (coalesce(zh_t - zh, 0) + coalesce(zh_l - zh, 0) + coalesce(zh_r - zh, 0) + coalesce(zh_b - zh, 0)) ELSE zh END, 6) AS eta FROM m")
def diffused_surface(spark, d):
    raster = wet(r1(spark, d)).with_columns(eta=F.col("z") + F.col("h"))
    return rounded(hydro.diffused(raster, 0, 0.2).select("i", "eta"), "eta")


@query(f"WITH {_WET} SELECT round(sum(greatest(0, zh - 0.25e0 - z)), 4) AS volume FROM w")
def volume_shifted(spark, d):
    cells = wet(r1(spark, d)).cells.withColumn("eta", F.col("z") + F.col("h"))
    return hydro.volume_shifted(cells, -0.25, 1.0).select(F.round("volume", 4).alias("volume"))


@query(f"WITH {_WET} SELECT max(abs(h - qq)) AS difference FROM w")
def max_difference(spark, d):
    return hydro.max_difference(wet(r1(spark, d)).cells, "h", "q")


@query(f"WITH {_WET} SELECT round(sum(h), 3) AS volume, CAST(count(*) AS BIGINT) AS n FROM w")
def smoothed_volume(spark, d):
    """Smoothing keeps the volume."""
    return hydro.smoothed(wet(r1(spark, d)), outer=2).cells.agg(F.round(F.sum("h"), 3).alias("volume"), F.count("*").alias("n"))


@query()
def smoothed_depth(spark, d):
    """The depth after three rounds."""
    return rounded(hydro.smoothed(wet(r1(spark, d)), outer=3).cells.select("i", "h"), "h")


_FLUX = "coalesce(CASE WHEN zh - zh_{d} >= 0 THEN 1 ELSE -1 END * pow(greatest(h, h_{d}), 5e0 / 3e0) / 0.033e0 * sqrt(abs(zh - zh_{d})), 0)"


@query(
    f"WITH {_WETN}, f AS (SELECT i, r, col, h, leaves, {_FLUX.format(d='r')} AS fx, {_FLUX.format(d='b')} AS fy FROM m), n2 AS (SELECT *, coalesce(lag(fx) OVER rr, 0) - fx + coalesce(lag(fy) OVER cc, 0) - fy AS net FROM f WINDOW rr AS (PARTITION BY r ORDER BY col), cc AS (PARTITION BY col ORDER BY r)) "
    "SELECT i, round(CASE WHEN leaves THEN h ELSE 0.5e0 * h + 0.5e0 * greatest(0, h + 0.01e0 * (net + 1e-4)) END, 6) AS h FROM n2"
)
def flux_diffusion(spark, d):
    return rounded(flood.Flood(wet(r1(spark, d))).run_flux_diffusion(1, 1e-4).get("h"), "h")


def _diffusive_sql(n: int) -> str:
    out = [_WET, "s0 AS (SELECT i, r, col, z, h, qq FROM w)"]
    for k in range(n):
        out += [f"b{k} AS (SELECT *, z + h AS zh FROM s{k})", _links_sql(f"l{k}", f"b{k}"), f"u{k} AS (SELECT l.j AS i, sum(s.qq * w) AS more FROM l{k}_w l JOIN s{k} s ON s.i = l.i GROUP BY l.j)"]
        norm = "greatest(sqrt(pow(greatest(0, coalesce(zh - zh_l, 0), coalesce(zh - zh_r, 0)), 2) + pow(greatest(0, coalesce(zh - zh_t, 0), coalesce(zh - zh_b, 0)), 2)), 1e-6)"
        out.append(f"t{k} AS (SELECT n.*, 0.5e0 * ({_RATE} + coalesce(more, 0)) + 0.5e0 * qq AS q2, {norm} AS norm FROM l{k}_n n LEFT JOIN u{k} u ON u.i = n.i)")
        out.append(f"s{k + 1} AS (SELECT i, r, col, z, CASE WHEN r = 0 OR r = ny - 1 OR col = 0 OR col = nx - 1 THEN 0 ELSE greatest(0, h + (q2 - pow(h, 5e0 / 3e0) / 0.033e0 * sqrt(norm)) * 1e-3) END AS h, q2 AS qq FROM t{k}, g)")
    return f"WITH {', '.join(out)} SELECT i, round(h, 6) AS h FROM s{n}"


@query(_diffusive_sql(2))
def diffusive_run(spark, d):
    return rounded(flood.Flood(wet(r1(spark, d))).run_diffusive(2).get("h"), "h")


@query(f"WITH {_WETN} SELECT i, round(0.5e0 * h + 0.5e0 * 0.25e0 * qq, 6) AS h FROM m")
def additive_depth(spark, d):
    return rounded(hydro.additive_step(wet(r1(spark, d)), 0.25).cells.select("i", "h"), "h")


@query(f"WITH {_WETN} SELECT i, round(CASE WHEN NOT leaves AND zh <= least(zh_t, zh_l, zh_r, zh_b) THEN h + {_drawn_sql(13, 'i')} * 1e-2 ELSE h END, 6) AS h FROM m")
def bumped_minima(spark, d):
    return rounded(hydro.bumped(wet(r1(spark, d)), 13).cells.select("i", "h"), "h")


@query(
    f"WITH {_WETN}, f AS (SELECT *, mx <= 0 AND my <= 0 AS flat, greatest(0, coalesce(z - z_l, 0), coalesce(z - z_r, 0)) AS bx, greatest(0, coalesce(z - z_t, 0), coalesce(z - z_b, 0)) AS by_ FROM m), "
    "t AS (SELECT *, CASE WHEN flat THEN CASE WHEN bx <= 0 AND by_ <= 0 THEN 1e-3 ELSE bx END ELSE mx END AS ax, CASE WHEN flat THEN CASE WHEN bx <= 0 AND by_ <= 0 THEN 1e-3 ELSE by_ END ELSE my END AS ay FROM f) "
    "SELECT i, round(CASE WHEN leaves OR i % 2 = 1 THEN h ELSE 0.75e0 * pow(qq * 0.033e0 / sqrt(sqrt(ax * ax + ay * ay)), 0.6e0) + 0.25e0 * h END, 6) AS h FROM t"
)
def analytic_depth_masked(spark, d):
    return rounded(hydro.analytic_depth(wet(r1(spark, d)), keep_old=0.25, mask=F.col("i") % 2 == 0).cells.select("i", "h"), "h")


_TOWARDS = "coalesce(exp(-abs(z_{d} - z) / 5) * (zh_{d} - zh), 0)"


@query(f"WITH {_WETN} SELECT i, round(CASE WHEN (r + col) % 2 = 1 THEN zh + 0.2e0 * ({' + '.join(_TOWARDS.format(d=x) for x in 'tlrb')}) ELSE zh END, 6) AS eta FROM m")
def diffused_by_slope(spark, d):
    raster = wet(r1(spark, d)).with_columns(eta=F.col("z") + F.col("h"))
    return rounded(hydro.diffused(raster, 1, 0.2, 5.0).select("i", "eta"), "eta")


@query(f"WITH {_edges_sql()}, on_ AS (SELECT i FROM c WHERE i % 7 = 0) SELECT i FROM on_ UNION SELECT e.j AS i FROM e JOIN on_ ON on_.i = e.i WHERE e.z > e.zj")
def spread_mask(spark, d):
    return hydro.spread_mask(r1(spark, d).with_columns(zh=F.col("z")), F.col("i") % 7 == 0)


@query()
def graphflood_run(spark, d):
    """Routing, lakes, accumulation and Manning depth together, two rounds of heavy rain."""
    return rounded(flood.Flood(r1(spark, d)).set_depth(0.0).run_graphflood(2, 1.0).get("h"), "h")


@query()
def graphflood_random(spark, d):
    """One round whose discharge is the mean over four random routings of the filled surface."""
    state = flood.Flood(r1(spark, d)).set_depth(0.0).run_graphflood(1, 1.0, stochastic=4, seed=7)
    return rounded(state.raster.cells.select("i", "h", "q"), "h", "q")


@query()
def lakes_filled(spark, d):
    return rounded(flood.Flood(r1(spark, d)).fill_lakes().get("h"), "h")


# Erosion.


@query(f"WITH {_C1} SELECT i, CASE WHEN {_LEAVE['normal']} THEN z ELSE z + 0.5e0 END AS z FROM c, g")
def uplift(spark, d):
    return erosion.uplift(r1(spark, d), 0.5e-3).cells.select("i", "z")


_SPL = ", acc AS (SELECT a AS i, count(*) AS n FROM paths GROUP BY a), t AS (SELECT c.i, c.z, CASE WHEN {leave} THEN 0 ELSE 2e-2 * pow(n, 0.45e0) END AS kk, CASE WHEN {leave} THEN c.i ELSE rcv END AS rcv FROM c JOIN acc ON acc.i = c.i JOIN rec ON rec.i = c.i, g), x(i, y) AS (SELECT i, z / (1 + kk) FROM t WHERE rcv = i UNION ALL SELECT t.i, (t.z + kk * x.y) / (1 + kk) FROM x JOIN t ON t.rcv = x.i WHERE t.i <> x.i)"


def _eroded(spark: SparkSession, d: str) -> tuple[Raster, DataFrame]:
    raster = r1(spark, d)
    links = written(routing.receivers(raster), "receivers")
    cells = raster.cells.join(accumulate.constant_discharge(raster, links, 1.0), "i")
    return raster.with_cells(cells), links


@query(_recursive("SELECT i, round(y, 6) AS z FROM x", more=_SPL.format(leave=_LEAVE["normal"])))
def spl_step(spark, d):
    raster, links = _eroded(spark, d)
    return rounded(erosion.stream_power(raster, links), "z")


@query(_recursive("SELECT x.i, round((c.z - x.y) * 1e-3, 6) AS qs FROM x JOIN c ON c.i = x.i", more=_SPL.format(leave=_LEAVE["normal"])))
def erosion_source(spark, d):
    raster, links = _eroded(spark, d)
    return rounded(erosion.sediment_source(raster.cells, erosion.stream_power(raster, links), 1.0, 1e3), "qs")


@query()
def spl_transport(spark, d):
    raster, links = _eroded(spark, d)
    return rounded(erosion.stream_power_transport(raster, links).cells.select("i", "z"), "z")


# Resampling, terrain, noise.

_C3 = "c AS (SELECT vec_id * 64 + k - 1 AS i, CAST(vec_id AS BIGINT) AS r, CAST(k - 1 AS BIGINT) AS q, CAST(embedding[k] AS DOUBLE) AS z FROM embeddings, (SELECT unnest(range(1, 65)) AS k)), g AS (SELECT max(r) + 1 AS ny, CAST(64 AS BIGINT) AS nx FROM c)"


def _halve_queries() -> None:
    for method, sql in (("max", "max(z)"), ("min", "min(z)"), ("mean", "avg(z)")):

        def run(spark: SparkSession, d: str, method=method) -> DataFrame:
            return rounded(resample.halve(r3(spark, d), method).cells, "z")

        QUERIES[f"halve_{method}"] = run
        SQL[f"halve_{method}"] = f"WITH {_C3} SELECT (r // 2) * 32 + q // 2 AS i, r // 2 AS \"row\", q // 2 AS col, round({sql}, 6) AS z FROM c GROUP BY r // 2, q // 2"


_halve_queries()


def _resolved_sql(x: str, n: str, boundary: str) -> str:
    return {"clamp": f"least(greatest({x}, 0), {n} - 1)", "wrap": f"((({x}) % {n}) + {n}) % {n}", "reflect": f"least((({x}) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2), 2 * {n} - 2 - (({x}) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2))"}[boundary]


def _cubic_queries() -> None:
    for boundary in resample.BOUNDARIES:

        def run(spark: SparkSession, d: str, boundary=boundary) -> DataFrame:
            return rounded(resample.halve(r3(spark, d), "cubic", boundary).cells, "z")

        name = "halve_cubic" + ("" if boundary == "clamp" else f"_{boundary}")
        QUERIES[name] = run
        SQL[name] = (
            f"WITH {_C3}, k(a, w) AS (VALUES (0, -0.0625e0), (1, 0.5625e0), (2, 0.5625e0), (3, -0.0625e0)), b AS (SELECT DISTINCT r // 2 AS br, q // 2 AS bq FROM c), "
            f"t AS (SELECT br, bq, k.w * l.w AS w, {_resolved_sql('br * 2 - 1 + k.a', 'ny', boundary)} AS r, {_resolved_sql('bq * 2 - 1 + l.a', 'nx', boundary)} AS q FROM b, k, k l, g) "
            "SELECT br * 32 + bq AS i, br AS \"row\", bq AS col, round(sum(c.z * w), 6) AS z FROM t JOIN c ON c.r = t.r AND c.q = t.q GROUP BY br, bq"
        )


_cubic_queries()


@query(
    f"WITH {_C3}, n AS (SELECT *, {_WIN.format(v='z')} FROM c {_WINDOWS}), s AS (SELECT *, (coalesce(z - z_l, 0) + coalesce(z_r - z, 0)) / cnt AS gx, (coalesce(z - z_t, 0) + coalesce(z_b - z, 0)) / cnt AS gy FROM (SELECT *, (CASE WHEN z_t IS NULL THEN 0 ELSE 1 END + CASE WHEN z_l IS NULL THEN 0 ELSE 1 END + CASE WHEN z_r IS NULL THEN 0 ELSE 1 END + CASE WHEN z_b IS NULL THEN 0 ELSE 1 END) AS cnt FROM n)), "
    "u AS (SELECT *, CASE WHEN sqrt(gx * gx + gy * gy) > 1e-8 THEN gx / sqrt(gx * gx + gy * gy) ELSE 0 END AS ux, CASE WHEN sqrt(gx * gx + gy * gy) > 1e-8 THEN gy / sqrt(gx * gx + gy * gy) ELSE 0 END AS uy FROM s), "
    "v AS (SELECT *, (abs(ux) + abs(uy)) / 4 AS st, r * 2 + b AS r2, q * 2 + a AS q2 FROM u, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)) "
    f"SELECT r2 * 128 + q2 AS i, r2 AS \"row\", q2 AS col, round(z + (ux * (a - 0.5e0) + uy * (b - 0.5e0)) * st + ({_uniform_sql(42, '(r2 * 128 + q2)')} * 2 - 1) * 0.05e0 * st, 6) AS z FROM v"
)
def double_resolution(spark, d):
    return rounded(resample.double(r3(spark, d), 0.5, 42).cells, "z")


@query(
    f"WITH {_C3}, t AS (SELECT r2, q2, (q2 + 0.5e0) * 64 / 48 - 0.5e0 AS x, (r2 + 0.5e0) * ny / 300 - 0.5e0 AS y FROM g, (SELECT unnest(range(300)) AS r2), (SELECT unnest(range(48)) AS q2)), "
    f"w AS (SELECT r2, q2, CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END AS w, {_resolved_sql('CAST(floor(y) AS BIGINT) + b', 'ny', 'clamp')} AS r, {_resolved_sql('CAST(floor(x) AS BIGINT) + a', 'nx', 'clamp')} AS q FROM t, g, (VALUES (0), (1)) xa(a), (VALUES (0), (1)) yb(b)) "
    "SELECT CAST(r2 * 48 + q2 AS BIGINT) AS i, CAST(r2 AS BIGINT) AS \"row\", CAST(q2 AS BIGINT) AS col, round(sum(c.z * w), 6) AS z FROM w JOIN c ON c.r = w.r AND c.q = w.q GROUP BY r2, q2"
)
def resize_bilinear(spark, d):
    return rounded(resample.resize_to(r3(spark, d), 48, 300).cells, "z")


def _shade_sql(azimuths: tuple[float, ...]) -> str:
    grad = lambda a, b: f"CASE WHEN z_{a} IS NOT NULL AND z_{b} IS NOT NULL THEN (z_{b} - z_{a}) / 2 WHEN z_{b} IS NOT NULL THEN z_{b} - z WHEN z_{a} IS NOT NULL THEN z - z_{a} ELSE 0 END"
    z = math.radians(45.0)
    light = " + ".join(f"least(1, greatest(0, {math.cos(z)!r}e0 * cos(sl) + {math.sin(z)!r}e0 * sin(sl) * cos({math.radians(a)!r}e0 - asp)))" for a in azimuths)
    return (
        f"WITH {_C1}, n AS (SELECT *, {_WIN.format(v='z')} FROM c {_WINDOWS}), s AS (SELECT i, {grad('l', 'r')} AS gx, {grad('t', 'b')} AS gy FROM n), "
        f"a AS (SELECT i, atan(sqrt(gx * gx + gy * gy)) AS sl, {math.pi / 2!r}e0 - atan2(gy, gx) AS a0 FROM s), p AS (SELECT i, sl, CASE WHEN a0 < 0 THEN a0 + {2 * math.pi!r}e0 ELSE a0 END AS asp FROM a) SELECT i, round(({light}) / {len(azimuths)}, 6) AS shade FROM p"
    )


@query(_shade_sql((315.0,)))
def hillshade(spark, d):
    return rounded(terrain.hillshade(r1(spark, d)), "shade")


@query(_shade_sql(terrain.FOUR))
def hillshade_multi(spark, d):
    return rounded(terrain.hillshade(r1(spark, d), azimuths=terrain.FOUR), "shade")


@query(_shade_sql(terrain.STYLES["multi_smooth"][2]))
def hillshade_styled(spark, d):
    return rounded(terrain.styled(r1(spark, d), "multi_smooth"), "shade")


@query(_shade_sql((315.0,)).replace("SELECT i, round(", "SELECT p.i, round(least(1, greatest(0, (c.z - 10) / (70 + 1e-6))), 6) AS height, round(").replace("FROM p", "FROM p JOIN c ON c.i = p.i"))
def visual_layers(spark, d):
    return rounded(terrain.visual_layers(r1(spark, d), 10.0, 80.0), "height", "shade")


@query(f"WITH {_C1} SELECT i, CAST(floor((z - low) / (high - low) * 255) AS BIGINT) AS value FROM c, (SELECT min(z) AS low, max(z) AS high FROM c)")
def normalised(spark, d):
    return terrain.normalised(r1(spark, d), 255)


@query(f"WITH {_C1} SELECT i, round(CASE WHEN z >= 10 THEN (z - low) / greatest(1e-6, high - low) ELSE -1 END, 6) AS height FROM c, (SELECT min(z) AS low, max(z) AS high FROM c WHERE z >= 10)")
def masked_height(spark, d):
    return rounded(terrain.masked_height(r1(spark, d), 10.0), "height")


@query(f"SELECT CAST(i AS BIGINT) AS i, round(({_drawn_sql(42, 'i')} * 2 - 1) * 2, 6) AS z FROM (SELECT unnest(range(5000)) AS i)")
def white_noise(spark, d):
    return rounded(noise.white(spark, 100, 50, 2.0).cells.select("i", "z"), "z")


@query()
def red_noise(spark, d):
    return rounded(noise.red(spark, 64, 48).cells.select("i", "z"), "z")


def _perlin_sql(nx: int, ny: int, f: float, octaves: int, persistence: float, seed: int) -> str:
    p = "[" + ", ".join(map(str, noise.permutation(seed))) + "]"
    gx, gy = ("[" + ", ".join(f"{float(g[k])}e0" for g in noise.GRADIENTS) + "]" for k in (0, 1))
    parts = []
    for o in range(octaves):
        parts.append(f"SELECT i, {persistence**o!r}e0 AS s, q * ({f * 2**o / nx!r}e0) AS x, r * ({f * 2**o / ny!r}e0) AS y FROM c")
    at = lambda k: f"perm[CAST((({k}) % 256 + 256) % 256 AS BIGINT) + 1]"
    corner = lambda a, b: f"({gx}[({at(f'{at(f'x0 + {a}')} + y0 + {b}')} % 8) + 1] * (x - x0 - {a}) + {gy}[({at(f'{at(f'x0 + {a}')} + y0 + {b}')} % 8) + 1] * (y - y0 - {b}))"
    fade = lambda t: f"({t}) * ({t}) * ({t}) * (({t}) * (({t}) * 6 - 15) + 10)"
    total = sum(persistence**o for o in range(octaves))
    return (
        f"WITH c AS (SELECT i, i // {nx} AS r, i % {nx} AS q FROM (SELECT unnest(range({nx * ny})) AS i)), o AS ({' UNION ALL '.join(parts)}), f AS (SELECT i, s, x, y, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0, {p} AS perm FROM o), "
        f"k AS (SELECT i, s, {corner(0, 0)} AS c00, {corner(1, 0)} AS c10, {corner(0, 1)} AS c01, {corner(1, 1)} AS c11, {fade('x - x0')} AS u, {fade('y - y0')} AS v FROM f), h AS (SELECT i, s, v, c00 + u * (c10 - c00) AS low, c01 + u * (c11 - c01) AS high FROM k) "
        f"SELECT CAST(i AS BIGINT) AS i, round(sum(s * (low + v * (high - low))) / {total!r}e0, 6) AS z FROM h GROUP BY i"
    )


@query(_perlin_sql(64, 32, 4.0, 3, 0.5, 42))
def perlin(spark, d):
    return rounded(noise.perlin(spark, 64, 32, 4.0, 3).cells.select("i", "z"), "z")


# Scans, masks, walkers.


@query("SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(sum(CAST(o_orderkey % 10 AS BIGINT)) OVER (ORDER BY o_orderkey) AS BIGINT) AS total FROM orders")
def prefix_sum(spark, d):
    cells = r2(spark, d).cells.select("i", (F.col("i") % 10).alias("x"))
    return scan.prefix_sum(cells, block=1024).select("i", "total")


@query("SELECT CAST(o_orderkey AS BIGINT) AS i, 0.25e0 * (o_orderkey % 10) + 0.75e0 * o_totalprice AS z FROM orders")
def weighted_mean(spark, d):
    raster = r2(spark, d)
    return scan.zipped(raster, raster.cells.select("i", (F.col("i") % 10).cast("double").alias("o")), "z", "o", 0.25, mean=True).cells.select("i", "z")


@query("SELECT CAST(o_orderkey AS BIGINT) AS i, o_totalprice + 0.25e0 * (o_orderkey % 10) AS z FROM orders")
def weighted_sum(spark, d):
    raster = r2(spark, d)
    return scan.zipped(raster, raster.cells.select("i", (F.col("i") % 10).cast("double").alias("o")), "z", "o", 0.25).cells.select("i", "z")


@query(f"WITH {_C4}, n AS (SELECT *, lag(bc) OVER cc AS t, lag(bc) OVER rr AS l, lead(bc) OVER rr AS x, lead(bc) OVER cc AS b FROM c {_WINDOWS}) SELECT i, CAST(coalesce(t = 0, false) OR coalesce(l = 0, false) OR coalesce(x = 0, false) OR coalesce(b = 0, false) AS BIGINT) AS beside FROM n")
def nodata_adjacent(spark, d):
    raster = r4(spark, d)
    plain = Raster(raster.cells, r1(spark, d).meta)
    return masks.beside_nodata(plain, F.col("bc") == 0).select("i", F.col("beside").cast("long").alias("beside"))


@query(f"WITH {_C4} SELECT i, CAST(CASE WHEN z < 20 THEN 0 ELSE bc END AS BIGINT) AS bc FROM c")
def sea_level(spark, d):
    return masks.below_sea(r4(spark, d), 20.0).cells.select("i", F.col("bc").cast("long").alias("bc"))


_TRIANGLE = ((10.5, 1.5), (80.5, 3.5), (40.5, 60.5))


def _polygon_sql(points, x: str, y: str) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True):
        parts.append(f"CASE WHEN (({y1}e0 > {y}) <> ({y2}e0 > {y})) AND {x} < {x1}e0 + ({y} - {y1}e0) * ({(x2 - x1) / (y2 - y1)!r}e0) THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


@query(f"WITH {_C1} SELECT i FROM c WHERE {_polygon_sql(_TRIANGLE, 'q', 'r')}")
def lasso(spark, d):
    cells = r1(spark, d).cells
    return cells.where(masks.inside_polygon(_TRIANGLE, F.col("col").cast("double"), F.col("row").cast("double"))).select("i")


_STROKE = "kern AS (SELECT dr, dc, exp(-(dr * dr + dc * dc) / 4.5e0) AS w FROM (SELECT unnest(range(-3, 4)) AS dr), (SELECT unnest(range(-3, 4)) AS dc) WHERE dr * dr + dc * dc <= 9), hit AS (SELECT (pr + dr) * 100 + pc + dc AS i, sum(w) / (SELECT sum(w) FROM kern) AS w FROM kern, (VALUES (2, 3), (3, 4)) p(pr, pc), g WHERE pr + dr BETWEEN 0 AND ny - 1 AND pc + dc BETWEEN 0 AND nx - 1 GROUP BY 1)"


@query(f"WITH {_C1}, {_STROKE} SELECT c.i, round(coalesce(w, 0), 6) AS p FROM c LEFT JOIN hit ON hit.i = c.i")
def brush(spark, d):
    raster = r1(spark, d).with_columns(p=F.lit(0.0))
    return rounded(masks.brush(raster, "p", [(2, 3), (3, 4)], 3, 1.0).cells.select("i", "p"), "p")


@query(f"WITH {_C1}, k AS (SELECT count(*) AS n FROM c WHERE {_polygon_sql(_TRIANGLE, 'q', 'r')}) SELECT i, round(CASE WHEN {_polygon_sql(_TRIANGLE, 'q', 'r')} THEN 3e0 / greatest(n, 1) ELSE 0 END, 9) AS p FROM c, k")
def rain_lasso(spark, d):
    raster = r1(spark, d).with_columns(p=F.lit(0.0))
    return masks.lasso_rain(raster, "p", _TRIANGLE, 3.0, additive=False).cells.select("i", F.round("p", 9).alias("p"))


@query(
    f"WITH {_C4}, n AS (SELECT *, lag(bc) OVER cc AS t, lag(bc) OVER rr AS l, lead(bc) OVER rr AS x, lead(bc) OVER cc AS b FROM c {_WINDOWS}) "
    f"SELECT i, CAST(CASE WHEN {_polygon_sql(_TRIANGLE, 'q', 'r')} AND bc <> 0 AND (r = 0 OR r = ny - 1 OR q = 0 OR q = nx - 1 OR coalesce(t = 0, false) OR coalesce(l = 0, false) OR coalesce(x = 0, false) OR coalesce(b = 0, false)) THEN 3 ELSE bc END AS BIGINT) AS bc FROM n, g"
)
def outlet_lasso(spark, d):
    raster = r4(spark, d)
    plain = Raster(raster.cells, r1(spark, d).meta)
    return masks.lasso_outlets(plain, F.col("bc") == 0, _TRIANGLE).cells.select("i", F.col("bc").cast("long").alias("bc"))


_WALK = f"v AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM c, g WHERE NOT {_LEAVE['normal']}), walk AS (SELECT p.pid, v.i AS pos FROM (SELECT pid, CAST(floor({_drawn_sql(5, 'pid')} * (SELECT max(n) FROM v)) AS BIGINT) AS k FROM (SELECT unnest(range(500)) AS pid)) p JOIN v ON v.k = p.k)"


@query(f"WITH {_C1}, {_WALK} SELECT pos, CAST(count(*) AS BIGINT) AS n FROM walk GROUP BY pos")
def particle_histogram(spark, d):
    return particles.histogram(particles.placed(r1(spark, d), 500, 5))


@query(f"WITH {_receivers_sql()}, {_WALK} SELECT CAST(pid AS BIGINT) AS pid, rcv AS pos FROM walk JOIN rec ON rec.i = pos")
def particle_step(spark, d):
    raster = r1(spark, d)
    return particles.moved(particles.placed(raster, 500, 5), particles.next_cells(raster))


@query(f"WITH {_receivers_sql(eight=True)}, {_WALK} SELECT CAST(pid AS BIGINT) AS pid, rcv AS pos FROM walk JOIN rec ON rec.i = pos")
def particle_step_d8(spark, d):
    raster = r1(spark, d)
    return particles.moved(particles.placed(raster, 500, 5), particles.next_cells(raster, eight=True))


def _steepest_sql(value: str) -> str:
    """Cells and the neighbour of the largest positive value, edge by edge."""
    return f"WITH {_edges_sql()}, {_WALK}, x AS (SELECT i, j, k, {value} AS s FROM e), nxt AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC, k) AS n FROM x WHERE s > 0) WHERE n = 1) SELECT CAST(pid AS BIGINT) AS pid, coalesce(nxt.j, walk.pos) AS pos FROM walk LEFT JOIN nxt ON nxt.i = walk.pos"


@query(_steepest_sql("(z + (i % 7) / 8.0e0) - (zj + (j % 7) / 8.0e0)"))
def particle_step_on_water(spark, d):
    raster = wet(r1(spark, d)).with_columns(zh=F.col("z") + F.col("h"))
    return particles.moved(particles.placed(raster, 500, 5), particles.next_cells(raster, "zh"))


@query(_steepest_sql(f"(z - zj) * pow({_drawn_sql(3, 'i', 'k')}, 0.5e0)"))
def particle_step_random(spark, d):
    raster = r1(spark, d)
    return particles.moved(particles.placed(raster, 500, 5), particles.next_cells(raster, seed=3, exponent=0.5))


@query()
def particle_collisions(spark, d):
    raster = r1(spark, d).with_columns(h=F.lit(0.0))
    return particles.collision_step(raster, particles.placed(raster, 500, 5), 9)[1]


@query(f"WITH {_C1} SELECT i, {_uniform_sql(11, 'i')} AS u FROM c")
def seeded_uniform(spark, d):
    return r1(spark, d).cells.select("i", uniform(11, F.col("i")).alias("u"))


# Faces and saved links.

_UXY = f"{_WETN}, o AS (SELECT *, lag(qx) OVER rr AS qx_l, lag(qy) OVER cc AS qy_t FROM w {_WINDOWS}), t AS (SELECT *, greatest(0, qx) + greatest(0, qy) + greatest(0, coalesce(-qx_l, 0)) + greatest(0, coalesce(-qy_t, 0)) AS total FROM o), u AS (SELECT *, lead(total) OVER rr AS total_r, lead(total) OVER cc AS total_b FROM t {_WINDOWS})"


@query(f"WITH {_UXY} SELECT i, round(qx / coalesce(nullif(CASE WHEN qx > 0 THEN total ELSE total_r END, 0), 1), 6) AS wx, round(qy / coalesce(nullif(CASE WHEN qy > 0 THEN total ELSE total_b END, 0), 1), 6) AS wy FROM u")
def renormalised_outflows(spark, d):
    return rounded(hydro.renormalised(wet(r1(spark, d)), "qx", "qy"), "wx", "wy")


def _velocity_sql(steps: int) -> str:
    """Face velocities and upwind fluxes, `steps` times."""
    out = [_WET, "s0 AS (SELECT i, r, q, z, h, qx AS ux, qy AS uy FROM w)"]
    push = "pow(greatest(0, greatest(z + h, z_{d} + h_{d}) - greatest(z, z_{d})), 1.5e0) / 0.033e0 * ((z - z_{d}) + (h * h - h_{d} * h_{d}) / 2)"
    face = "CASE WHEN h_{d} IS NULL OR (h = 0 AND h_{d} = 0) THEN {u} ELSE 0.5e0 * {u} + 0.5e0 * sign(p_{d}) * sqrt(abs(p_{d})) END"
    flux = "CASE WHEN v_{d} IS NULL OR (v = 0 AND v_{d} = 0) THEN 0 ELSE {s} * {u} * CASE WHEN {s} * {u} < 0 THEN v ELSE v_{d} END END"
    for k in range(steps):
        out.append(f"n{k} AS (SELECT *, {_WIN.format(v='z')}, {_WIN.format(v='h')} FROM s{k} {_WINDOWS})")
        out.append(f"p{k} AS (SELECT *, {push.format(d='r')} AS p_r, {push.format(d='b')} AS p_b FROM n{k})")
        out.append(f"f{k} AS (SELECT i, r, q, z, {face.format(d='r', u='ux')} AS ux, {face.format(d='b', u='uy')} AS uy, pow(h, 5e0 / 3e0) AS v FROM p{k})")
        out.append(f"v{k} AS (SELECT *, lag(ux) OVER rr AS ux_l, lag(uy) OVER cc AS uy_t, {_WIN.format(v='v')} FROM f{k} {_WINDOWS})")
        net = " + ".join(flux.format(d=d, u=u, s=s) for d, u, s in (("t", "uy_t", "1"), ("l", "ux_l", "1"), ("r", "ux", "-1"), ("b", "uy", "-1")))
        out.append(f"s{k + 1} AS (SELECT i, r, q, z, pow(greatest(0, v + 1e-3 * ({net} + 1e-2)), 3e0 / 5e0) AS h, ux, uy FROM v{k})")
    return f"WITH {', '.join(out)} SELECT i, round(h, 6) AS h, round(ux, 6) AS ux, round(uy, 6) AS uy FROM s{steps}"


@query(_velocity_sql(2))
def velocity_run(spark, d):
    state = flood.Flood(wet(r1(spark, d)).with_columns(ux=F.col("qx"), uy=F.col("qy"))).run_velocity(2, 1e-2)
    return rounded(state.raster.cells.select("i", "h", "ux", "uy"), "h", "ux", "uy")


_MINIMA = (
    f"WITH {_receivers_sql()}, w AS (SELECT c.i, r, q, z, (c.i % 7) / 8.0e0 AS h, (c.i % 11) / 4.0e0 AS qq, z + (c.i % 7) / 8.0e0 AS zh, rcv, c.i % 13 = 0 AS lm FROM c JOIN rec ON rec.i = c.i), "
    f"n AS (SELECT *, {_WIN.format(v='zh')}, {_WIN.format(v='rcv')} FROM w {_WINDOWS}), "
    "a AS (SELECT *, r > 0 AND r < ny - 1 AND q > 0 AND q < nx - 1 AS inside FROM n, g), b AS (SELECT *, inside AND zh <= least(zh_t, zh_l, zh_r, zh_b) AS pit FROM a), f AS (SELECT *, lm OR pit AS flag FROM b), "
    "s AS (SELECT *, " + ", ".join(f"CASE WHEN flag AND rcv_{d} = i THEN 0 ELSE greatest(0, coalesce(zh - zh_{d}, 0)) END AS s_{d}" for d in "tlrb") + " FROM f), t AS (SELECT *, s_t + s_l + s_r + s_b AS total FROM s), "
    "got AS (SELECT j, sum(x) AS more, max(lead_) AS led FROM ("
    + " UNION ALL ".join(f"SELECT i + ({o}) AS j, qq * s_{d} / total AS x, 0 AS lead_ FROM t WHERE inside AND s_{d} > 0" for d, o in (("t", -100), ("l", -1), ("r", 1), ("b", 100)))
    + " UNION ALL SELECT rcv, qq, 0 FROM t WHERE inside AND total <= 0 UNION ALL SELECT rcv, 0, 1 FROM t WHERE inside AND flag) GROUP BY j), "
    "x AS (SELECT t.*, coalesce(more, 0) + 1e-2 AS qn, coalesce(led, 0) = 1 AS led, CASE WHEN inside THEN pow(h, 5e0 / 3e0) / 0.033e0 * sqrt(greatest(sqrt(pow(greatest(s_l, s_r), 2) + pow(greatest(s_t, s_b), 2)), 1e-4)) ELSE 0 END AS out_ FROM t LEFT JOIN got ON got.j = t.i) "
    "SELECT i, round(qn, 6) AS q, round(greatest(0, h + CASE WHEN pit THEN 5e-3 ELSE 0 END + 1e-3 * (qn - out_)), 6) AS h, flag OR led AS lm FROM x"
)


@query(_MINIMA)
def over_minima(spark, d):
    raster = r1(spark, d)
    state = flood.Flood(wet(raster).with_columns(lm=F.col("i") % 13 == 0), hydro.Params(rain=1e-2)).run_over_minima(routing.receivers(raster))
    return rounded(state.raster.cells.select("i", "q", "h", "lm"), "q", "h")


# Discharge on walkers' cells.


def _walked_sql(steps: int) -> str:
    """Depth steps on walkers' cells, each followed by the walkers' step down the surface."""
    out = [_C1, _WALK, "s0 AS (SELECT i, r, q, z, (i % 7) / 8.0e0 AS h, (i % 11) / 4.0e0 AS qq FROM c)", "w0 AS (SELECT pid, pos FROM walk)"]
    sends = " UNION ALL ".join(f"SELECT i + ({o}) AS j, qq * s_{d} / total AS x FROM a{{k}} WHERE s_{d} > 0" for d, o in (("t", -100), ("l", -1), ("r", 1), ("b", 100)))
    slopes = ", ".join(f"greatest(0, coalesce(z + h - (z_{d} + h_{d}), 0)) AS s_{d}" for d in "tlrb")
    lower = " UNION ALL ".join(f"SELECT i, i + ({o}) AS j, {n} AS k, z + h - (z_{d} + h_{d}) AS s FROM m{{k}}" for n, (d, o) in enumerate((("t", -100), ("l", -1), ("r", 1), ("b", 100))))
    for k in range(steps):
        out.append(f"n{k} AS (SELECT *, {_WIN.format(v='z')}, {_WIN.format(v='h')} FROM s{k} {_WINDOWS}), l{k} AS (SELECT *, {slopes} FROM n{k}), a{k} AS (SELECT *, s_t + s_l + s_r + s_b AS total FROM l{k})")
        out.append(f"g{k} AS (SELECT j, sum(x) AS more FROM ({sends.format(k=k)}) GROUP BY j), o{k} AS (SELECT DISTINCT pos FROM w{k})")
        leaves = "CASE WHEN greatest(s_l, s_r) > 0 AND greatest(s_t, s_b) > 0 THEN pow(h, 5e0 / 3e0) / 0.033e0 * sqrt(greatest(1e-4, sqrt(pow(greatest(s_l, s_r), 2) + pow(greatest(s_t, s_b), 2)))) ELSE 0 END"
        out.append(f"b{k} AS (SELECT a.*, pos IS NOT NULL AS at_, CASE WHEN pos IS NULL THEN qq ELSE 1e-2 + coalesce(more, 0) END AS qn FROM a{k} a LEFT JOIN o{k} ON pos = i LEFT JOIN g{k} ON j = i)")
        out.append(f"s{k + 1} AS (SELECT i, r, q, z, CASE WHEN at_ THEN greatest(0, h + 1e-2 * (qn - {leaves})) ELSE h END AS h, qn AS qq FROM b{k})")
        out.append(f"m{k} AS (SELECT *, {_WIN.format(v='z')}, {_WIN.format(v='h')} FROM s{k + 1} {_WINDOWS})")
        out.append(f"d{k} AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, k) AS n FROM ({lower.format(k=k)}) WHERE s > 0) WHERE n = 1), w{k + 1} AS (SELECT pid, coalesce(j, pos) AS pos FROM w{k} LEFT JOIN d{k} ON i = pos)")
    return f"WITH {', '.join(out)} SELECT i, round(qq, 6) AS q, round(h, 6) AS h, coalesce(n, 0) AS walkers FROM s{steps} LEFT JOIN (SELECT pos, count(*) AS n FROM w{steps} GROUP BY pos) ON pos = i"


@query(_walked_sql(2))
def walked_depth(spark, d):
    raster = r1(spark, d)
    state = sparse.stored(wet(raster))
    state, walkers = sparse.run(state, particles.placed(raster, 500, 5), 2, hydro.Params(rain=1e-2, dt=1e-2))
    held = particles.histogram(walkers).select(F.col("pos").alias("i"), F.col("n").alias("walkers"))
    return rounded(state.raster().cells.select("i", "q", "h").join(held, "i", "left").withColumn("walkers", F.coalesce("walkers", F.lit(0))), "q", "h")


_WALKED_FACES = (
    f"WITH {_C1}, {_WALK}, o AS (SELECT DISTINCT pos FROM walk), w AS (SELECT i, r, q, z, (i % 7) / 8.0e0 AS h, (i % 11) / 4.0e0 AS qq, ((i % 5) - 2) / 16.0e0 AS wx, ((i % 3) - 1) / 16.0e0 AS wy, pos IS NOT NULL AS at_ FROM c LEFT JOIN o ON pos = i), "
    f"n AS (SELECT *, {_WIN.format(v='z')}, {_WIN.format(v='h')}, {_WIN.format(v='at_')} FROM w {_WINDOWS}), "
    "s AS (SELECT *, " + ", ".join(f"CASE WHEN at_ THEN greatest(0, coalesce(z + h - (z_{d} + h_{d}), 0)) ELSE 0 END AS s_{d}" for d in "tlrb") + " FROM n), t AS (SELECT *, s_t + s_l + s_r + s_b AS total FROM s), "
    f"x AS (SELECT *, lead(nullif(s_l, 0) / total) OVER rr AS from_r, lead(nullif(s_t, 0) / total) OVER cc AS from_b FROM t {_WINDOWS}), "
    "f AS (SELECT i, r, q, qq, at_, CASE WHEN at_ AND total = 0 THEN h + 1e-2 * " + _drawn_sql(4, "0", "i") + " ELSE h END AS h, NOT at_ AND (coalesce(at__t, false) OR coalesce(at__l, false) OR coalesce(at__r, false) OR coalesce(at__b, false)) AS beside, coalesce(nullif(s_r, 0) / total, -from_r, wx) AS wx, coalesce(nullif(s_b, 0) / total, -from_b, wy) AS wy FROM x), "
    f"p AS (SELECT *, greatest(0, wx) + greatest(0, wy) + greatest(0, coalesce(-lag(wx) OVER rr, 0)) + greatest(0, coalesce(-lag(wy) OVER cc, 0)) AS out_ FROM f {_WINDOWS}), "
    "y AS (SELECT *, CASE WHEN beside AND out_ > 0 THEN 1 / out_ ELSE 1 END AS f FROM p), "
    f"k AS (SELECT *, {_WIN.format(v='f')}, {_WIN.format(v='qq')}, lag(wx) OVER rr AS wx_l, lag(wy) OVER cc AS wy_t FROM y {_WINDOWS}) "
    "SELECT i, round(h, 6) AS h, round(CASE WHEN at_ OR beside THEN 0.25e0 + coalesce(greatest(0, wy_t) * f_t * qq_t, 0) + coalesce(greatest(0, wx_l) * f_l * qq_l, 0) + coalesce(greatest(0, -wx) * f_r * qq_r, 0) + coalesce(greatest(0, -wy) * f_b * qq_b, 0) ELSE qq END, 6) AS q, "
    "round(wx * CASE WHEN wx > 0 THEN f ELSE coalesce(f_r, 1) END, 6) AS wx, round(wy * CASE WHEN wy > 0 THEN f ELSE coalesce(f_b, 1) END, 6) AS wy FROM k"
)


@query(_WALKED_FACES)
def walked_faces(spark, d):
    raster = r1(spark, d)
    faces = wet(raster).with_columns(wx=F.col("qx"), wy=F.col("qy"))
    state = sparse.discharge_step(sparse.stored(faces), particles.placed(raster, 500, 5), F.lit(0.25), 4)
    return rounded(state.raster().cells.select("i", "h", "q", "wx", "wy"), "h", "q", "wx", "wy")


# Rain gauges.


@query("SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(event_id % 1000 AS BIGINT) AS i, round(sum(value), 6) AS rain, count(*) AS n FROM events GROUP BY 1, 2")
def rain_windows(spark, d):
    gauges = spark.read.parquet(f"{d}/events.parquet").select("ts", F.floor(F.col("event_id") % 1000 / 100).alias("row"), (F.col("event_id") % 100).alias("col"), F.col("value").alias("amount"))
    totals = forcing.rain_totals(gauges, NX)
    return rounded(totals.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "i", "rain", "n"), "rain")


@query(f"WITH {_WET} SELECT i, z AS h, h * 2 AS z FROM w")
def fields_swapped(spark, d):
    return scan.swapped(scan.scaled(wet(r1(spark, d)), "h", 2.0), "z", "h").cells.select("i", "h", "z")


# Files.


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {_C1} SELECT (r - 3) * 61 + q - 20 AS i, r - 3 AS \"row\", q - 20 AS col, z FROM c, g WHERE r >= 3 AND r < ny - 1 AND q >= 20 AND q < 81")
def tiff_window(spark, d):
    """R1 as a deflated GeoTIFF, read back in a window."""
    raster, path = r1(spark, d), _file(spark, "tiff")
    files.write_tiff(raster, path, kind="<f8", packing=8, predictor=3)
    return files.read_raster(spark, path, rows=(3, raster.meta.ny - 1), cols=(20, 81)).cells


@query('SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(o_orderkey // 100 AS BIGINT) AS "row", CAST(o_orderkey % 100 AS BIGINT) AS col, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS z FROM orders')
def npy_round_trip(spark, d):
    """R2 as an array of four-byte numbers, read back by rows."""
    path = _file(spark, "npy")
    files.write_npy(r2(spark, d), path)
    return files.read_arrays(spark, path, partition=8192).drop("path", "band")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """For each cell of R1, where its water goes and how many cells drain through it."""
    raster = r1(spark, d)
    links = written(routing.receivers(raster), "receivers")
    return links.join(accumulate.drainage_cells(links, raster.meta), "i")


QUERIES["flow_and_drainage"] = flagship
SQL["flow_and_drainage"] = _recursive("SELECT rec.i, rec.rcv, n.q FROM rec JOIN (SELECT a, CAST(count(*) AS BIGINT) AS q FROM paths GROUP BY a) n ON n.a = rec.i")
