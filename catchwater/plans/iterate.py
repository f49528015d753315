"""Loops over DataFrames. Each round is a written table in the shared folder, so lineage stays short and nothing that a
lost executor held is needed again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode (tests) and an error on a cluster.

    A cluster's executors each have a disk of their own, so a folder of one machine would lose rows there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="catchwater-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs a reread only."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["shared_path"] = path
    for made in _MADE:
        made.append(out)
    return out


#: Tables that are being made, for those who clear up after a whole computation.
_MADE: list[list[DataFrame]] = []


def settled(build: Callable[[], DataFrame], name: str = "settled") -> DataFrame:
    """What build() gives, as a table; all other tables that were written on the way are deleted."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        out = written(build(), name)
    finally:
        _MADE.pop()
    dropped(*(t for t in made if t is not out))
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that written() made and that no plan reads any more; other frames are left alone."""
    for table in tables:
        path = table.__dict__.get("shared_path") if table is not None else None
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


#: Cells of a block, whose paths one task follows as a whole.
BLOCK = 1 << 16

Block = Callable[[Column], Column]


def by_index(i: Column) -> Column:
    """Blocks of BLOCK cells that follow each other; a raster's tiles (grid.tiled) hold more of each path."""
    return F.floor(i / BLOCK)


def _inside(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows (i, p): cells, parents (-1: none) and each parent's place in the block (-1: none or outside)."""
    i = np.asarray(part["i"], np.int64)
    p = np.asarray(pc.fill_null(part["p"], -1), np.int64)
    order = np.argsort(i, kind="stable")
    place = np.minimum(np.searchsorted(i[order], p), len(i) - 1)
    return i, p, np.where((p >= 0) & (i[order][place] == p), order[place], -1)


def _ends(p: np.ndarray, up: np.ndarray, visit: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Where each cell's path leaves the block (-1: it ends inside), by pointer doubling; visit(cells, their pointers) each round.

    Cells of a cycle keep their parent, so that the doubling between blocks finds the cycle.
    """
    up, last = up.copy(), np.arange(len(p))
    for _ in range(len(p).bit_length() + 1):
        on = np.flatnonzero(up >= 0)
        if not len(on):
            break
        visit(on, up[on])
        last[on], up[on] = last[up[on]], up[up[on]]
    return np.where(up >= 0, p, p[last])


def _number(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(x).cast(kind)


def ancestors(links: DataFrame, values: dict, combine: dict, keys: tuple[str, ...] = (), depth: int = 64, block: Block = by_index) -> DataFrame:
    """A scan along parent links.

    links: keys, i, p (null at the end of a path) and the columns that `values` names, which hold each cell's own value.
    combine: for each value, a function of two dicts (near part of the path, far part) giving the joined part, of columns
    and of numpy arrays alike. Returns keys, i and the values over each cell's whole path to its root.

    One task follows all paths of a block to where they leave it. Only cells that are entered from other blocks go on: at
    most BLOCK of them as one block more, others by pointer doubling, where a round covers twice as many blocks. One join
    brings the rest of each path to its cells.
    """
    on, names = [*keys, "i"], list(values)
    own = links.select(*on, "p", *(F.expr(values[n]).alias(n) if isinstance(values[n], str) else values[n].alias(n) for n in names))
    schema = to_arrow_schema(own.schema)

    def local(part: pa.Table) -> pa.Table:
        i, p, up = _inside(part)
        held = {n: np.asarray(part[n]).copy() for n in names}

        def visit(cells: np.ndarray, far: np.ndarray) -> None:
            joined = {n: combine[n]({m: held[m][cells] for m in names}, {m: held[m][far] for m in names}) for n in names}
            for n in names:
                held[n][cells] = joined[n]

        out = _ends(p, up, visit)
        columns = {"p": pa.array(out, mask=out < 0), "leaves": pa.array((p >= 0) & ((up < 0) | (out == p))), **{n: _number(held[n], schema.field(n).type) for n in names}}
        return pa.table([columns[n] if n in columns else part[n].combine_chunks() for n in told.names], names=told.names)

    told = T.StructType([*own.schema, T.StructField("leaves", T.BooleanType())])
    state, open_, leaving = _round(_solved(own.withColumn("__b", block(F.col("i"))), keys, local, told), "path")
    if not open_:
        return state.select(*on, *names)
    entered = state.where("p is not null").select(*keys, F.col("p").alias("i")).distinct()
    links = state.join(entered, on, "left_semi").drop("leaves")
    far = _at_once(links, keys, local, told) if leaving <= BLOCK else _doubled(links, combine, names, keys, depth)
    far = far.select(*keys, F.col("i").alias("p"), *(F.col(n).alias(f"far_{n}") for n in names))
    near_, far_ = {n: F.col(n) for n in names}, {n: F.col(f"far_{n}") for n in names}
    return state.join(far, [*keys, "p"], "left").select(*on, *(F.when(F.col("p").isNull(), F.col(n)).otherwise(combine[n](near_, far_)).alias(n) for n in names))


def _solved(blocked: DataFrame, keys: tuple[str, ...], local: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """The rows of each block (keys, __b) after `local`."""
    return blocked.groupBy(*keys, "__b").applyInArrow(_without(local, "__b"), schema)


def _at_once(links: DataFrame, keys: tuple[str, ...], local: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """Links between blocks, of which there are at most BLOCK, as one block."""
    state, open_, _ = _round(_solved(links.withColumn("__b", F.lit(0)), keys, local, schema), "between")
    if open_:
        raise ValueError("the links have a cycle")
    return state


def _without(f: Callable[[pa.Table], pa.Table], *names: str) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        return f(part.drop_columns(list(names)))

    return run


def _doubled(links: DataFrame, combine: dict, names: list[str], keys: tuple[str, ...], depth: int) -> DataFrame:
    on = [*keys, "i"]
    state, open_, _ = _round(links.select(*on, "p", *names), "path")
    for _ in range(depth):
        if not open_:
            return state.select(*on, *names)
        far = state.select(*keys, F.col("i").alias("p"), F.col("p").alias("far_p"), *(F.col(n).alias(f"far_{n}") for n in names))
        joined = state.join(far, [*keys, "p"], "left")
        near_, far_ = {n: F.col(n) for n in names}, {n: F.col(f"far_{n}") for n in names}
        step = [F.when(F.col("p").isNull(), F.col(n)).otherwise(combine[n](near_, far_)).alias(n) for n in names]
        before, (state, open_, _) = state, _round(joined.select(*on, F.col("far_p").alias("p"), *step), "path")
        dropped(before)
    raise ValueError("the links have a cycle")


def descendants(links: DataFrame, value: str = "q", keys: tuple[str, ...] = (), depth: int = 64, block: Block = by_index) -> DataFrame:
    """For every i, the sum of `value` over itself and all cells whose path of links (keys, i, p, value) leads through it.

    One task sums all paths of a block. What leaves a block enters others at few cells; those are summed among themselves,
    at most BLOCK of them as one block more, others by doubling (after t rounds one holds what comes over fewer than 2**t
    blocks), and the blocks that are entered sum once more.
    """
    on = [*keys, "i"]
    own = written(links.select(*on, "p", value), "tree")
    names = [*keys, "i", "p", value, "leaves"]
    kind = to_arrow_schema(own.schema).field(value).type

    def local(part: pa.Table) -> pa.Table:
        i, p, up = _inside(part)
        total = np.asarray(part[value]).copy()

        def visit(cells: np.ndarray, far: np.ndarray) -> None:
            np.add.at(total, far, total[cells])

        out = _ends(p, up, visit)
        leaves = (p >= 0) & ((up < 0) | (out == p))
        columns = {value: _number(total, kind), "p": pa.array(out, mask=out < 0), "leaves": pa.array(leaves)}
        return pa.table([columns[n] if n in columns else part[n].combine_chunks() for n in names], names=names)

    schema = T.StructType([*(own.schema[n] for n in on), T.StructField("p", T.LongType()), own.schema[value], T.StructField("leaves", T.BooleanType())])
    blocked = own.withColumn("__b", block(F.col("i")))
    state, open_, leaving = _round(_solved(blocked, keys, local, schema), "sums")
    if not open_:
        dropped(own)
        return state.select(*on, value)
    into = state.where("leaves").groupBy(*keys, F.col("p").alias("i")).agg(F.sum(value).alias(value))
    between = into.join(state.select(*on, "p"), on).select(*on, "p", F.col(value).cast(own.schema[value].dataType).alias(value))
    inflow = _at_once(between, keys, local, schema) if leaving <= BLOCK else _summed(between, value, keys, depth)
    inflow = inflow.select(*on, F.col(value).alias("more"))
    wet = blocked.join(inflow, on, "left").withColumn(value, F.col(value) + F.coalesce("more", F.lit(0))).drop("more")
    return _solved(wet, keys, local, schema).select(*on, value)


def _summed(links: DataFrame, value: str, keys: tuple[str, ...], depth: int) -> DataFrame:
    on = [*keys, "i"]
    state, open_, _ = _round(links.select(*on, "p", value), "tree")
    for _ in range(depth):
        if not open_:
            return state.select(*on, value)
        more = state.where("p is not null").groupBy(*keys, F.col("p").alias("i")).agg(F.sum(value).alias("more"))
        up = state.where("p is not null").select(*keys, F.col("i").alias("p"), F.col("p").alias("up"))
        step = state.join(more, on, "left").join(up, [*keys, "p"], "left")
        before, (state, open_, _) = state, _round(step.select(*on, F.col("up").alias("p"), (F.col(value) + F.coalesce("more", F.lit(0))).alias(value)), "tree")
        dropped(before)
    raise ValueError("the links have a cycle")


def _round(df: DataFrame, name: str) -> tuple[DataFrame, bool, int]:
    """df as a written table, whether any p is left, and how many rows leave their block: counted by the writing job itself."""
    seen = Observation()
    leaving = F.count_if("leaves") if "leaves" in df.columns else F.count(F.lit(None))
    out = written(df.observe(seen, F.count("p").alias("open"), leaving.alias("leaving")), name)
    return out, bool(seen.get["open"]), int(seen.get["leaving"] or 0)
