"""Sums through acyclic graphs whose cells send to several others, by blocks condensed to their borders.

A block (a raster's tile) is linear: what it sends to other blocks is a fixed part, from its own sources, and a map of what
comes in at its entries. One task works a block's edges once, level by level, and leaves the part, the map and the block's
edges as one row. Parts and maps of all blocks are again such a graph, over entries alone, with 4/n of the cells of n x n
tiles; it is solved the same way over blocks of eight times the side or, where its edges fit one block, at once. What comes in
at each entry then fills the blocks, a second and last reading of the edges. So the number of passes grows with the logarithm
of the raster's side and not with its paths, and no pass rewrites the graph.

A map has at most as many rows as entries times border cells that they reach; on land where water gathers these are few.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from catchwater.plans.iterate import BLOCK, Block, written

#: Edges between blocks that one task solves at once.
AT_ONCE = 1 << 21
Blocks = Callable[[int], Block]
_ROW = "b long, e long, f long, m double, cells array<long>, q array<double>, src array<int>, dst array<int>, w array<double>, ends array<int>"


def by_index(level: int) -> Block:
    """Blocks of cells that follow each other, 64 times as many on each level."""
    return lambda i: F.floor(i / (BLOCK << (6 * level)))


def whole(level: int) -> Block:
    return lambda i: F.lit(0).cast("long")


def accumulated(graph: DataFrame, sources: DataFrame, blocks: Blocks = by_index, level: int = 0, at_once: int = AT_ONCE) -> DataFrame:
    """(i, q): sources (i, q) pushed through an acyclic graph (src, dst, w). A cycle is an error."""
    block = blocks(level)
    src, dst = F.col("src"), F.col("dst")
    row = lambda b, i, j, x, inner: F.struct(b.cast("long").alias("b"), i.cast("long").alias("i"), j.cast("long").alias("j"), x.cast("double").alias("x"), inner.alias("inner"))
    none, inner = F.lit(None), block(src) == block(dst)
    rows = graph.select(F.explode(F.array(row(block(src), src, dst, F.col("w"), inner), F.when(~inner, row(block(dst), dst, none, none, F.lit(True))))).alias("r")).where("r is not null").select("r.*")
    rows = rows.union(sources.select(row(block(F.col("i")), F.col("i"), none, F.col("q"), F.lit(True)).alias("r")).select("r.*"))
    seen = Observation()
    condensed_ = rows.groupBy("b").applyInArrow(condensed, _ROW)
    table = written(condensed_.observe(seen, F.count("f").alias("crossing"), F.count("e").alias("edges")), "condensed")
    tiles = table.where("cells is not null").select("b", "cells", "q", "src", "dst", "w", "ends")
    if not seen.get["crossing"]:
        return tiles.select(F.explode(F.arrays_zip("cells", "q")).alias("c")).select(F.col("c.cells").alias("i"), F.col("c.q").alias("q"))
    border = table.where("e is not null").select(F.col("e").alias("src"), F.col("f").alias("dst"), F.col("m").alias("w"))
    given = table.where("e is null and f is not null").groupBy(F.col("f").alias("i")).agg(F.sum("m").alias("q"))
    small = seen.get["edges"] <= at_once
    inflow = accumulated(border, given, whole if small else blocks, 0 if small else level + 1, at_once)
    into = inflow.where("q <> 0").select(block(F.col("i")).cast("long").alias("b"), F.struct("i", "q").alias("x")).groupBy("b").agg(F.collect_list("x").alias("x"))
    joined = tiles.join(into, "b", "left").select("cells", "q", "src", "dst", "w", "ends", F.transform("x", lambda x: x["i"]).alias("into"), F.transform("x", lambda x: x["q"]).alias("more"))
    return joined.mapInArrow(filled, "i long, q double")


def _expanded(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `at` its edges first[at] .. first[at + 1]: (which of `at`, which edge)."""
    n = first[at + 1] - first[at]
    of = np.repeat(np.arange(len(at)), n)
    return of, first[at][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, value, len(keys))


def condensed(part: pa.Table) -> pa.Table:
    """One block, of rows (i, j, x, inner): edges to j with weight x; without j a source x; without x an entry."""
    b = part["b"][0].as_py()
    i, j = np.asarray(part["i"], np.int64), np.asarray(pc.fill_null(part["j"], -1), np.int64)
    x, inner = np.asarray(pc.fill_null(part["x"], 0.0), np.float64), np.asarray(part["inner"])
    edge, entry = np.asarray(part["j"].is_valid()), np.asarray(part["x"].is_null())
    cells = np.unique(np.concatenate([i, j[edge & inner]]))
    n = len(cells)
    place = np.searchsorted(cells, i)
    q = np.bincount(place[~edge & ~entry], x[~edge & ~entry], n)
    order = np.flatnonzero(edge & inner)
    order = order[np.argsort(place[order], kind="stable")]
    a, c, w = place[order], np.searchsorted(cells, j[order]), x[order]
    first = np.searchsorted(a, np.arange(n + 1))
    out = np.flatnonzero(edge & ~inner)
    out = out[np.argsort(place[out], kind="stable")]
    far, share, leaves = j[out], x[out], np.searchsorted(place[out], np.arange(n + 1))
    # Levels: a cell comes after all that send to it.
    level, left = np.full(n, -1), np.bincount(c, minlength=n)
    front, depth = np.flatnonzero(left == 0), 0
    while len(front):
        level[front] = depth
        _, e = _expanded(front, first)
        np.subtract.at(left, c[e], 1)
        front, depth = np.unique(c[e][left[c[e]] == 0]), depth + 1
    if (level < 0).any():
        raise ValueError("the graph has a cycle")
    by_level = np.argsort(level[a], kind="stable")
    ends = np.searchsorted(level[a][by_level], np.arange(depth + 1)).astype(np.int32)
    sa, sc, sw = a[by_level], c[by_level], w[by_level]
    pushed(q, sa, sc, sw, ends)
    own = _summed(far, q[place[out]] * share) if len(out) else (far, share)
    entries = np.unique(place[entry])
    kinds = pa.schema([("b", pa.int64()), ("e", pa.int64()), ("f", pa.int64()), ("m", pa.float64()), ("cells", pa.list_(pa.int64())), ("q", pa.list_(pa.float64())), ("src", pa.list_(pa.int32())), ("dst", pa.list_(pa.int32())), ("w", pa.list_(pa.float64())), ("ends", pa.list_(pa.int32()))])
    packed = [pa.array([v], kinds.field(k).type) for k, v in (("cells", cells), ("q", q), ("src", sa.astype(np.int32)), ("dst", sc.astype(np.int32)), ("w", sw), ("ends", ends))]
    tables = [pa.table([pa.array([b]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), *packed], schema=kinds)]
    e, f, m = _mapped(entries, cells, level, depth, (c, w, first), (far, share, leaves))
    none = pa.nulls(len(own[0]), pa.int64())
    for from_, to, by in ((none, own[0], own[1]), (pa.array(e, pa.int64()), f, m)):
        tables.append(pa.table([pa.array(np.full(len(to), b)), from_, pa.array(to, pa.int64()), pa.array(by, pa.float64()), *(pa.nulls(len(to), kinds.field(k).type) for k in kinds.names[4:])], schema=kinds))
    return pa.concat_tables(tables)


def _mapped(entries: np.ndarray, cells: np.ndarray, level: np.ndarray, depth: int, inner: tuple, outer: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, cell of another block, share): what of the water at each entry comes to which cell outside.

    Water of all entries goes down level by level as (cell, entry, share); cells that are passed are forgotten.
    """
    (to, w, first), (far, share, leaves), k = inner, outer, max(1, len(entries))
    waiting: list[list] = [[] for _ in range(depth)]

    def put(cell: np.ndarray, entry: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(level[cell], kind="stable")
        cell, entry, value = cell[order], entry[order], value[order]
        cut = [*np.flatnonzero(np.diff(level[cell], prepend=-1)), len(cell)]
        for a, b in itertools.pairwise(cut):
            waiting[level[cell[a]]].append((cell[a:b], entry[a:b], value[a:b]))

    put(entries, np.arange(len(entries)), np.ones(len(entries)))
    sent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(depth):
        if not waiting[d]:
            continue
        cell, entry, value = (np.concatenate(v) for v in zip(*waiting[d], strict=True))
        waiting[d] = []
        key, value = _summed(cell * k + entry, value)
        cell, entry = key // k, key % k
        of, e = _expanded(cell, leaves)
        sent.append((entry[of], far[e], value[of] * share[e]))
        of, e = _expanded(cell, first)
        put(to[e], entry[of], value[of] * w[e])
    if not sent:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    entry, f, m = (np.concatenate(v) for v in zip(*sent, strict=True))
    names, f = np.unique(f, return_inverse=True)
    key, m = _summed(entry * max(1, len(names)) + f, m)
    keep = m != 0
    return cells[entries[key[keep] // max(1, len(names))]], names[key[keep] % max(1, len(names))], m[keep]


def pushed(q: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, ends: np.ndarray) -> None:
    """Adds to q what its cells send, level by level."""
    for a, b in itertools.pairwise(ends):
        np.add.at(q, dst[a:b], q[src[a:b]] * w[a:b])


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each block with what came in at its entries added all the way down."""
    for batch in batches:
        for k in range(batch.num_rows):
            cells, q, src, dst, w, ends = (np.asarray(batch.column(c)[k].values) for c in ("cells", "q", "src", "dst", "w", "ends"))
            if batch.column("into")[k].is_valid:
                more = np.zeros(len(cells))
                more[np.searchsorted(cells, np.asarray(batch.column("into")[k].values))] = np.asarray(batch.column("more")[k].values)
                pushed(more, src, dst, w, ends)
                q = q + more
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(q)], ["i", "q"])
