"""Embedding near-dedup: navigable small-world graphs per shard, beams widened by recall audits, exact cosine, components.

Vectors that are equal form a class with one representative. Representatives are dealt to shards by a hash; a task builds
the hierarchical graph of its shard, audits it, and writes it to the shared folder. Representatives are also packed into
slices, also written there. Tasks get pairs of numbers, of a shard and a slice, in order of shards; they open both from the
shared folder, a graph once for the pairs that follow each other, so no vector is shuffled to meet a graph. Shards and slices
are bounded in vectors and in bytes. Each query of the slice goes down the graph with the shard's beam, and is compared with
the few points that the graph has lost: those that a search for themselves does not find. A beam that ends inside the similarity range has met a dense group: from there, links are followed from point to
point while they stay in range of those queries, and all points so reached are compared with them. The audit compares the
first members with brute force over the shard and doubles the beam until enough of them find every partner, those with few
partners and those with many each for themselves. Candidates are verified by cosine in double precision; where single
precision with its error bound already decides, that is not repeated.

A task returns one row a query and one a member that has links: how many vectors, and the smallest id among them or of the
members they unite, never the pairs; components() unites these. A link that only one of its ends found so joins both;
n_links is the greater of the links found from a vector and those found towards it. Copies of a very common vector learn what
their representative has in several tasks.

Null, zero and non-finite vectors and vectors with null components link with nothing, nor does a null id. Vectors of
different lengths never link. Equal vectors link whatever their number. Rows that share an id count as one vector whose
links unite; n_links counts rows. Long vectors are read whole. Other columns are not used. An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import components, dropped, in_folders, opened, qualified, released, written

#: Cosine from which vectors are linked; vectors in a shard, shards at least; links of a vertex on the ground and above.
THRESHOLD, SHARD, SHARDS, GROUND, ABOVE = 0.95, 50_000, 6, 32, 16
#: Vectors in a slice, slices at least; how far under the threshold a dense group is followed.
SLICE, SLICES, MARGIN = 100_000, 4, 0.05
#: Bytes of vectors in a shard and in a slice at most; pairs of both that a task takes; copies of a vector in a task.
SHARD_BYTES, SLICE_BYTES, PAIRS, HOT = 256 << 20, 128 << 20, 8, 100_000
#: Queries that go through a graph together: what they meet in a step stays in a core's cache, however large the shard is.
TOGETHER = 128
#: Beam while building and at the start of the search; audited queries; the share of them that has to find every partner;
#: from how many partners a query has many.
BUILD, BEAM, AUDITED, RECALL, MANY = 48, 48, 2048, 0.995, 16
_NONE = np.float32(-np.inf)


def _diverse(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (-1: none), up to m that are nearer to the row's point than to those chosen before, nearest first; then the nearest others."""
    order = np.argsort(-sim, 1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    b, w = cand.shape
    near = x[cand]
    gram = near @ near.transpose(0, 2, 1)
    real, kept, nearest, n = sim > _NONE, np.zeros((b, w), bool), np.full((b, w), _NONE), np.zeros(b, np.int64)
    for k in range(w):
        take = real[:, k] & (nearest[:, k] < sim[:, k]) & (n < m)
        kept[:, k] = take
        n += take
        at = np.flatnonzero(take)
        nearest[at] = np.maximum(nearest[at], gram[at, k])
    place = np.argsort(np.where(kept, 0, np.where(real, 1, 2)) * w + np.arange(w), 1)[:, :m]
    out = np.where(np.take_along_axis(real, place, 1), np.take_along_axis(cand, place, 1), -1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


class Graph:
    """A hierarchical navigable small-world graph of unit vectors, built in batches; point 0 is on the highest layer."""

    BATCH = 256

    def __init__(self, x: np.ndarray, seed: int = 3):
        n = len(x)
        level = np.floor(-np.log(1 - np.random.Generator(np.random.PCG64(seed)).random(n)) / np.log(ABOVE)).astype(np.int64)
        self.order = np.argsort(-level, kind="stable")
        self.x, level = np.ascontiguousarray(x[self.order], np.float32), level[self.order]
        self.layers: list[np.ndarray] = []  # from the top down; the first points are a layer's members
        for layer in range(int(level[0]) if n else 0, -1, -1):
            members = int((level >= layer).sum())
            links = np.full((members, ABOVE if layer else GROUND), -1, np.int32)
            for at in range(0, members, self.BATCH):
                self._insert(links, at, min(at + self.BATCH, members))
            self.layers.append(links)
        self.apart = self._lost()

    def _lost(self) -> np.ndarray:
        """Points that a search for themselves does not find, since links to them were given up: queries meet all of these."""
        lost, entry = [np.zeros(0, np.int64)], self._entry(self.x)
        for at in range(0, len(self.x), TOGETHER):
            own = np.arange(at, min(at + TOGETHER, len(self.x)))
            ids, _ = self._search(self.layers[-1], self.x[own], entry[own], BUILD)
            lost.append(own[(ids != own[:, None]).all(1)])
        return np.concatenate(lost)

    def _insert(self, links: np.ndarray, at: int, end: int) -> None:
        new = np.arange(at, end)
        gram = self.x[new] @ self.x[new].T
        gram[np.arange(len(new)), np.arange(len(new))] = _NONE
        gram[np.triu_indices(len(new))] = _NONE  # links lead back to earlier points; the other direction follows
        w = min(len(new), 24)
        near = np.argpartition(-gram, w - 1, 1)[:, :w]
        cand, sim = new[near], np.take_along_axis(gram, near, 1)
        if at:
            entry = self._entry(self.x[new])
            found, its = self._search(links, self.x[new], np.where(entry < at, entry, 0), BUILD)
            cand, sim = np.concatenate([found, cand], 1), np.concatenate([its, sim], 1)
        m = links.shape[1] // 2
        links[new, :m] = _diverse(self.x, np.maximum(cand, 0), sim, m)
        a, b = np.repeat(new, m), links[new, :m].ravel()
        a, b = a[b >= 0], b[b >= 0].astype(np.int64)
        while len(b):  # links back, GROUND for each target at a time
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            place = np.arange(len(b)) - np.searchsorted(b, b)
            now = place < links.shape[1]
            self._link(links, a[now], b[now], place[now])
            a, b = a[~now], b[~now]

    def _link(self, links: np.ndarray, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> None:
        target, row = np.unique(b, return_inverse=True)
        for lo in range(0, len(target), 1024):
            hi = min(lo + 1024, len(target))
            own = (row >= lo) & (row < hi)
            extra = np.full((hi - lo, int(place[own].max()) + 1), -1, np.int64)
            extra[row[own] - lo, place[own]] = a[own]
            cand = np.concatenate([links[target[lo:hi]], extra], 1)
            cand = np.where((cand == target[lo:hi, None]), -1, cand)
            free = (cand >= 0).sum(1) <= links.shape[1]
            easy = np.flatnonzero(free)
            packed = np.take_along_axis(cand[easy], np.argsort(cand[easy] < 0, 1, kind="stable"), 1)[:, : links.shape[1]]
            links[target[lo:hi][easy], : packed.shape[1]] = packed
            hard = np.flatnonzero(~free)
            if len(hard):
                c = cand[hard]
                sim = np.einsum("bwd,bd->bw", self.x[np.maximum(c, 0)], self.x[target[lo:hi][hard]])
                links[target[lo:hi][hard]] = _diverse(self.x, np.maximum(c, 0), np.where(c >= 0, sim, _NONE), links.shape[1])

    def _entry(self, q: np.ndarray) -> np.ndarray:
        entry = np.zeros(len(q), np.int64)
        for links in self.layers[: -1 if len(self.layers) and self.layers[-1].shape[1] == GROUND else None]:
            found, _ = self._search(links, q, entry, 4, 1)
            entry = found[:, 0]
        return entry

    def _search(self, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beam's points and similarities for each query, nearest first; the queries advance together."""
        n, size, wide = len(q), len(links), expand * links.shape[1]
        ids, sims, done = np.full((n, beam), -1, np.int32), np.full((n, beam), _NONE), np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", self.x[entry], q)
        kind = np.uint8 if wide < 255 else np.uint16
        seen = np.zeros(n * size, kind)  # for each query and point 0, or from 1 the place at which the point was met
        seen[np.arange(n) * size + entry] = wide + 1
        places, live = np.arange(1, wide + 1, dtype=kind), np.arange(n)
        while len(live):
            todo = np.where(done[live], _NONE, sims[live])
            pick = np.argpartition(-todo, min(expand, beam - 1), 1)[:, :expand]
            open_ = todo.take(pick + np.arange(len(live))[:, None] * beam) > _NONE
            some = open_.any(1)
            live, pick, open_ = live[some], pick[some], open_[some]
            if not len(live):
                break
            at = live[:, None] * beam + pick
            done.reshape(-1)[at[open_]] = True
            near = np.where(open_[:, :, None], links.take(np.where(open_, ids.take(at), 0), 0), -1).reshape(len(live), wide)
            at = (live * size)[:, None] + near
            fresh = np.flatnonzero((near >= 0) & (seen.take(at, mode="clip") == 0))
            at, own = at.take(fresh), places.take(fresh % wide)
            seen[at] = own
            fresh = fresh[seen.take(at) == own]  # a point that two expanded ones share comes once
            sim = np.full(near.shape, _NONE)
            point, own = near.take(fresh), live.take(fresh // wide)
            for lo in range(0, len(fresh), 2048):
                part = slice(lo, lo + 2048)
                sim.reshape(-1)[fresh[part]] = np.einsum("kd,kd->k", self.x.take(point[part], 0), q.take(own[part], 0))
            every = np.concatenate([sims[live], sim], 1)
            top = np.argpartition(-every, beam - 1, 1)[:, :beam]
            top += np.arange(len(live))[:, None] * every.shape[1]
            sims[live] = every.take(top)
            ids[live] = np.concatenate([ids[live], near], 1).take(top)
            done[live] = np.concatenate([done[live], sim == _NONE], 1).take(top)  # those met before are never expanded
        ids[sims == _NONE] = -1
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1).astype(np.int64), np.take_along_axis(sims, order, 1)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, order=self.order, x=self.x, apart=self.apart, **{f"layer{k}": links for k, links in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Graph:
        self, held = cls.__new__(cls), np.load(io.BytesIO(raw))
        self.order, self.x, self.apart = held["order"], held["x"], held["apart"]
        self.layers = [held[f"layer{k}"] for k in range(len(held.files) - 3)]
        return self

    def _reached(self, q: np.ndarray, start: np.ndarray, threshold: float) -> np.ndarray:
        """Points that links reach from `start` through points in range of one of the queries."""
        looked, inside, front = np.zeros(len(self.x), bool), np.zeros(len(self.x), bool), start
        looked[start] = inside[start] = True
        while len(front):
            near = np.zeros(len(self.x), bool)
            found = self.layers[-1][front].ravel()
            near[found[found >= 0]] = True
            near &= ~looked
            looked |= near
            near = np.flatnonzero(near)
            front = np.concatenate([at[(self.x[at] @ q.T >= threshold - MARGIN).any(1)] for at in np.split(near, range(8192, len(near), 8192))])
            inside[front] = True
        return np.flatnonzero(inside)

    def near(self, q: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks (query, point, similarity in single precision) of pairs of about the threshold or more."""
        q = np.ascontiguousarray(q, np.float32)
        if not len(q) or not len(self.x):
            return
        entry, dense, starts, joined = self._entry(q), [], [], np.ones(len(self.x), bool)
        joined[self.apart] = False
        step = max(16, min(TOGETHER, (32 << 20) // len(self.x)))
        for at in range(0, len(q), step):
            own = np.arange(at, min(at + step, len(q)))
            ids, sims = self._search(self.layers[-1], q[own], entry[own], beam)
            full = sims[:, -1] >= threshold - MARGIN
            r, c = np.nonzero((sims >= threshold) & ~full[:, None] & joined[ids])
            yield own[r], self.order[ids[r, c]], sims[r, c]
            sim = q[own] @ self.x[self.apart].T
            r, c = np.nonzero(sim >= threshold)
            if len(r):
                yield own[r], self.order[self.apart[c]], sim[r, c]
            dense.append(own[full])
            starts.append(ids[full])
        dense, starts = np.concatenate(dense), np.concatenate(starts)
        together = np.argsort(starts[:, 0], kind="stable")
        for at in range(0, len(together), 256):
            own = together[at : at + 256]
            some = self._reached(q[dense[own]], np.unique(starts[own]), threshold)
            some = some[joined[some]]
            for lo in range(0, len(own), 32):
                part = dense[own[lo : lo + 32]]
                sim = q[part] @ self.x[some].T
                r, c = np.nonzero(sim >= threshold)
                yield part[r], self.order[some[c]], sim[r, c]

    def within(self, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs of about the threshold's similarity or more."""
        found = [(r, c) for r, c, _ in self.near(q, threshold, beam)]
        r, c = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return r, c

    def audited(self, q: np.ndarray, threshold: float, beam: int = BEAM, own: np.ndarray | None = None) -> int:
        """A beam with which enough queries find all their true partners, both of those with few and with many.

        own: each query's own point, which is no partner, or -1. Partners within rounding of the threshold do not count.
        """
        q, x = q.astype(np.float32), self.x[np.argsort(self.order)]
        own = np.full(len(q), -1) if own is None else own

        def true(at: np.ndarray) -> np.ndarray:
            near = q[at] @ x.T >= threshold + 1e-5
            near[np.flatnonzero(own[at] >= 0), own[at][own[at] >= 0]] = False
            return near

        parts = [np.arange(lo, min(lo + 256, len(q))) for lo in range(0, len(q), 256)]
        partners = np.concatenate([true(at).sum(1) for at in parts]) if parts else np.zeros(0, np.int64)
        for group in (partners > 0) & (partners < MANY), partners >= MANY:
            some = np.flatnonzero(group)
            while len(some) and beam < len(x):
                whole = 0
                for lo in range(0, len(some), 256):
                    at = some[lo : lo + 256]
                    missed = true(at)
                    missed[self.within(q[at], threshold, beam)] = False
                    whole += int((~missed.any(1)).sum())
                if whole >= RECALL * len(some):
                    break
                beam *= 2
        return beam


def _united(root: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """root (each member's smallest united one) after the members c of each query r are united; r comes in runs."""
    if not len(r):
        return root
    first = np.flatnonzero(np.diff(r, prepend=-1))
    size = np.diff(np.append(first, len(r)))
    while True:
        own = root[c]
        least = np.minimum.reduceat(own, first)
        if (np.maximum.reduceat(own, first) == least).all():
            return root
        new = root.copy()
        np.minimum.at(new, own, np.repeat(least, size))
        while (new[new] != new).any():
            new = new[new]
        root = new[root]


def _unit(raw: bytes, d: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float64).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _packed(own: pa.Table, place: str) -> tuple[int, int, np.ndarray, np.ndarray, bytes]:
    """Length, shard or slice, ids, copies and vectors of a group, in the order of a hash of their ids."""
    own = own.sort_by([("mixed", "ascending"), ("vec_id", "ascending")]).combine_chunks()
    x = np.asarray(own["embedding"].combine_chunks().flatten(), np.float64)
    return own["dim"][0].as_py(), own[place][0].as_py(), np.asarray(own["vec_id"], np.int64), np.asarray(own["copies"], np.int64), x.tobytes()


def _shard(own: pa.Table, threshold: float) -> pa.Table:
    """A shard as one row: its graph, the beam that its audit asks for, its members."""
    d, place, ids, copies, raw = _packed(own, "shard")
    x = _unit(raw, d)
    graph = Graph(x)
    beam = graph.audited(x[:AUDITED], threshold, own=np.arange(min(len(x), AUDITED)))
    released()
    return pa.table({"dim": [d], "shard": [place], "beam": [beam], "ids": [ids.tobytes()], "copies": [copies.tobytes()], "vectors": pa.array([raw], pa.binary()), "graph": pa.array([graph.packed()], pa.binary())})


def _slice(own: pa.Table) -> pa.Table:
    d, place, ids, copies, raw = _packed(own, "slice")
    return pa.table({"dim": [d], "slice": [place], "q_ids": [ids.tobytes()], "q_copies": [copies.tobytes()], "q_vectors": pa.array([raw], pa.binary())})


class Shard:
    """A shard's row, ready for queries."""

    def __init__(self, row: pa.Table):
        self.d, self.beam = row["dim"][0].as_py(), row["beam"][0].as_py()
        self.graph, self.x = Graph.unpacked(row["graph"][0].as_py()), _unit(row["vectors"][0].as_py(), self.d)
        self.ids, self.weight = (np.frombuffer(row[k][0].as_py(), np.int64) for k in ("ids", "copies"))


def _links(shard: Shard, slices: pa.Table, threshold: float) -> pa.Table:
    """The rows of one shard and one slice."""
    kinds = pa.schema([("vec_id", pa.int64()), ("n_links", pa.int64()), ("n_back", pa.int64()), ("reach", pa.int64())])
    long, d, graph, beam, x, ids, weight = np.int64, shard.d, shard.graph, shard.beam, shard.x, shard.ids, shard.weight
    qid, copies = (np.frombuffer(slices[k][0].as_py(), long) for k in ("q_ids", "q_copies"))
    raw, out = slices["q_vectors"][0].as_py(), []
    root, back = np.arange(len(ids)), np.zeros(len(ids), long)
    slack = 1.2e-7 * (d + 8)  # what single precision may be off

    def rows(i: np.ndarray, n: np.ndarray, m: np.ndarray, reach: np.ndarray) -> pa.Table:
        return pa.table([pa.array(v.astype(long)) for v in (i, n, m, reach)], schema=kinds)

    for lo in range(0, len(qid), 4096):
        q, own, many = _unit(raw[lo * d * 8 : (lo + 4096) * d * 8], d), qid[lo : lo + 4096], copies[lo : lo + 4096]
        n, least = np.zeros(len(q), long), np.full(len(q), np.iinfo(long).max)
        for r, c, sim in graph.near(q, threshold - slack, beam):
            close = np.flatnonzero(sim < threshold + slack)
            good = own[r] != ids[c]
            good[close] &= np.einsum("kd,kd->k", q[r[close]], x[c[close]]) >= threshold
            r, c = r[good], c[good]
            n += np.bincount(r, weight[c], len(q)).astype(long)
            np.minimum.at(least, r, ids[c])
            root = _united(root, r, c)
            back += np.bincount(c, many[r], len(ids)).astype(long)
        some = np.flatnonzero(n)
        out.append(rows(own[some], n[some], np.zeros(len(some)), least[some]))
    some = np.flatnonzero(back)  # a member that a query found is united with the others of that query
    out.append(rows(ids[some], np.zeros(len(some)), back[some], ids[root[some]]))
    released()
    return pa.concat_tables(out)


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, shards: int = SHARDS, slice_: int = SLICE, slices: int = SLICES, hot: int = HOT) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    v = F.col("embedding")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & (norm > 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0).cast("float")).alias("embedding")).withColumn("usable", usable)
    classes = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = written(classes.withColumns({"dim": F.size("embedding").cast("long"), "mixed": F.xxhash64("vec_id")}), "vectors")
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum("dim") * 8, F.lit(0))).first()
    shards, slices = max(shards, -(-n // shard), -(-size // SHARD_BYTES)), max(slices, -(-n // slice_), -(-size // SLICE_BYTES))
    dealt = lambda seed, parts: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts))
    graphs = classes.withColumn("shard", dealt(1, shards)).groupBy("dim", "shard").applyInArrow(lambda own: _shard(own, threshold), "dim long, shard long, beam long, ids binary, copies binary, vectors binary, graph binary")
    packs = classes.withColumn("slice", dealt(2, slices)).groupBy("dim", "slice").applyInArrow(_slice, "dim long, slice long, q_ids binary, q_copies binary, q_vectors binary")
    graphs = in_folders(graphs.withColumns({"__dim": F.col("dim"), "__at": F.col("shard")}), "graphs", "__dim", "__at")
    packs = in_folders(packs.withColumns({"__dim": F.col("dim"), "__at": F.col("slice")}), "slices", "__dim", "__at")
    from_graphs, from_packs = qualified(graphs), qualified(packs)
    numbers = graphs.select("dim", "shard").join(packs.select("dim", "slice"), "dim")  # three numbers for each piece of work
    numbers = numbers.repartitionByRange(max(min(shards * slices, 64), -(-shards * slices // PAIRS)), "dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice")

    def linked_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shard_ = None, None
        for batch in batches:
            for d, s, q in zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "slice")), strict=True):
                if place != (d, s):
                    place, shard_ = (d, s), None  # the one before goes first
                    shard_ = Shard(opened(from_graphs, f"__dim={d}/__at={s}"))
                yield from _links(shard_, opened(from_packs, f"__dim={d}/__at={q}"), threshold).to_batches()

    found = written(numbers.mapInArrow(linked_in, "vec_id long, n_links long, n_back long, reach long"), "links")
    dropped(graphs, packs)
    groups = components(found.select("vec_id", "reach"), "vec_id", "reach")
    per = found.groupBy("vec_id").agg(F.greatest(F.sum("n_links"), F.sum("n_back")).alias("links")).join(groups, F.col("vec_id") == F.col("id"), "left").drop("id")
    common = classes.where(F.col("copies") > hot).groupBy(F.xxhash64("embedding").alias("print")).agg(F.max(F.ceil(F.col("copies") / hot)).alias("parts"))
    common = written(common, "common")  # one row of two numbers for each `hot` rows at most
    spread = lambda df: df.withColumn("print", F.xxhash64("embedding")).join(common, "print", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    known = spread(classes.select("embedding", F.col("vec_id").alias("rep"), "copies").join(per.withColumnRenamed("vec_id", "rep"), "rep", "left"))
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("print", "parts")
    own = spread(rows.where("usable")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")))
    linked = own.join(known, ["embedding", "part"]).select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
