"""The tree by which basins spill into each other, from the graph of their saddles alone.

Each basin takes its lowest saddle; of two that take each other's the one with the smaller number goes over; what is joined
goes on as one basin with the pit that is left, until nothing has a way out any more. Rounds work on the graph of basins,
whose saddles melt to one for each two basins, and never on the raster; once the graph fits one task, that takes all rounds
that are left. Which basin spills where at the end is one tree, however many rounds found it: where basins are carved, the
tree is led to its root (turned where a joined basin left by another way than its parts); where pits jump, each pit goes to
the outlet that its basin had when it was joined.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.plans.iterate import ancestors, by_index, dropped, some, written

#: Saddles that one task orders at once.
AT_ONCE = 1 << 20
_WAY = ("height", "low", "high", "a", "b", "i", "j")


def tree(pairs: DataFrame, carve: bool, turned: Callable[[DataFrame, DataFrame], DataFrame], at_once: int = AT_ONCE, rounds: int = 64) -> DataFrame:
    """(bid, saddle, outlet) for each basin that spills, of saddles (a, b, height, low, high, i, j).

    A saddle leads from cell i of basin a to cell j of basin b; ways are compared by (height, low, high). turned(links, found):
    links (i, rcv) with the path from each `saddle` of found (bid, saddle, outlet) to its root turned, and led to the outlet.
    """
    pairs = written(pairs.select("a", "b", "height", "low", "high", "i", "j"), "pairs")
    if pairs.count() <= at_once:
        out = written(_ordered(pairs.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")), carve).select("bid", F.col("i").alias("saddle"), F.col("j").alias("outlet")), "spills")
        dropped(pairs)
        return out
    # links: of basins; chosen: the saddles that joined basins, with the basin whose pit went.
    links = written(pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct().select("i", F.col("i").alias("rcv")), "links")
    live = written(pairs.select("*", F.col("a").alias("ca"), F.col("b").alias("cb")), "live")
    chosen = []
    for _ in range(rounds):
        small = live.count() <= max(at_once, 1)
        if small:
            found = _ordered(live, carve)
        else:
            best = live.where("ca <> 0").groupBy("ca").agg(F.min(F.struct("height", "low", "high", "a", "b", "i", "j", "cb")).alias("w")).select(F.col("ca").alias("bid"), "w.*")
            best = written(best, "best")
            back = best.select(F.col("cb").alias("bid"), F.col("bid").alias("cb"))
            found = best.join(best.join(back, ["bid", "cb"], "left_semi").where("cb < bid").select("bid"), "bid", "left_anti").select("bid", "a", "b", "i", "j", "cb")
        found = written(found, "found")
        chosen.append(found.select("bid", "a", "b", "i", "j"))
        if carve:
            before, links = links, written(turned(links, found.select("bid", F.col("a").alias("saddle"), F.col("b").alias("outlet"))), "links")
            dropped(before)
        if small:
            break
        comp = _ends(live, found)
        before, live = live, written(_melted(live, comp), "live")
        dropped(before)
        if not some(live):
            break
    else:
        raise ValueError("basins remain after all rounds")
    every = chosen[0]
    for more in chosen[1:]:
        every = every.union(more)
    if not carve:
        return written(every.select("bid", F.col("i").alias("saddle"), F.col("j").alias("outlet")), "spills")
    both = every.select("a", "b", "i", "j").union(every.select("b", "a", "j", "i"))
    led = links.where("rcv <> i").select(F.col("i").alias("a"), F.col("rcv").alias("b"))
    return written(led.join(both.groupBy("a", "b").agg(F.min(F.struct("i", "j")).alias("c")), ["a", "b"]).select(F.col("a").alias("bid"), F.col("c.i").alias("saddle"), F.col("c.j").alias("outlet")), "spills")


def _ends(live: DataFrame, found: DataFrame) -> DataFrame:
    """(i, root): where each joined basin ends, by the joins of one round."""
    names = live.select(F.explode(F.array("ca", "cb")).alias("i")).distinct()
    joins = names.join(found.select(F.col("bid").alias("i"), F.col("cb").alias("p")), "i", "left").withColumn("root", F.coalesce("p", "i"))
    return ancestors(joins, {"root": "root"}, {"root": lambda near, far: far["root"]}, block=by_index)


def _melted(live: DataFrame, comp: DataFrame) -> DataFrame:
    """Saddles between joined basins, the lowest for each two."""
    to = comp.select(F.col("i").alias("ca"), F.col("root").alias("ra"))
    into = comp.select(F.col("i").alias("cb"), F.col("root").alias("rb"))
    between = live.join(to, "ca").join(into, "cb").where("ra <> rb and ra <> 0")
    return between.groupBy(F.col("ra").alias("ca"), F.col("rb").alias("cb")).agg(F.min(F.struct(*_WAY)).alias("w")).select("w.*", "ca", "cb").select("a", "b", "height", "low", "high", "i", "j", "ca", "cb")


def _ordered(live: DataFrame, carve: bool) -> DataFrame:
    """(bid, a, b, i, j, cb): all rounds at once."""

    def run(part: pa.Table) -> pa.Table:
        return joined(part.drop_columns(["one"]), carve)

    return live.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "bid long, a long, b long, i long, j long, cb long")


def joined(part: pa.Table, carve: bool) -> pa.Table:
    """The rounds over a graph (ca, cb, height, low, high, a, b, i, j) in one task; for carving led to the roots."""
    ca, cb, low, high = (np.asarray(part[c], np.int64) for c in ("ca", "cb", "low", "high"))
    ends = [np.asarray(part[c], np.int64) for c in ("a", "b", "i", "j")]
    order = np.lexsort((high, low, np.asarray(part["height"], np.float64)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names, both = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    one, two = both[: len(ca)], both[len(ca) :]
    comp, gone, over = np.arange(len(names)), [], []
    while True:
        of, to = comp[one], comp[two]
        open_ = np.flatnonzero((of != to) & (names[of] != 0))
        if not len(open_):
            break
        best = np.full(len(names), len(order))
        np.minimum.at(best, of[open_], rank[open_])
        own = np.flatnonzero(best < len(order))
        edge = order[best[own]]
        other = np.arange(len(names))
        other[own] = to[edge]
        stays = (other[other[own]] == own) & (names[other[own]] < names[own])
        own, edge = own[~stays], edge[~stays]
        up = np.arange(len(names))
        up[own] = to[edge]
        for _ in range(len(names).bit_length() + 1):
            up = up[up]
        if (up[up] != up).any():
            raise ValueError("saddles lead round in a ring")
        comp = up[comp]
        gone.append(own)
        over.append(edge)
    if not gone:
        return pa.table({k: pa.array([], pa.int64()) for k in ("bid", "a", "b", "i", "j", "cb")})
    own, edge = np.concatenate(gone), np.concatenate(over)
    if not carve:
        return pa.table([pa.array(x) for x in (names[own], *(e[edge] for e in ends), names[two[edge]])], names=["bid", "a", "b", "i", "j", "cb"])
    beside: list[list[tuple[int, int]]] = [[] for _ in range(len(names))]
    for e in edge.tolist():
        beside[one[e]].append((int(two[e]), e))
        beside[two[e]].append((int(one[e]), e))
    queue, rows = deque(np.flatnonzero(comp == np.arange(len(names))).tolist()), []
    seen = np.zeros(len(names), bool)
    seen[list(queue)] = True
    while queue:
        at = queue.popleft()
        for child, e in beside[at]:
            if not seen[child]:
                seen[child] = True
                queue.append(child)
                rows.append((child, e, one[e] == child, at))
    child, e, ahead, to = (np.array(x) for x in zip(*rows, strict=True))
    a, b, i, j = (x[e] for x in ends)
    turn = lambda x, y: np.where(ahead, x, y)
    return pa.table([pa.array(x) for x in (names[child], turn(a, b), turn(b, a), turn(i, j), turn(j, i), names[to])], names=["bid", "a", "b", "i", "j", "cb"])
