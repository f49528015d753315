"""Conversation structure repair: least edits that make turns follow (s?(ua)+)?, by bucket-queue shortest paths.

A conversation's turns are rows of a graph with four states: nothing said, after the system's turn, after the user's, after the
assistant's. Arcs are edits with small whole costs (keep 0, change the role 3, delete 4, insert an empty turn 3; an undeleted
truncated row 3 more), so Dial's buckets, one a distance, serve as queue: from the end of the rows backwards they record each
node's distance to the goal. The walk from the first node then takes, of the tight arcs (those that lose no distance), the one
whose letter is least in ASCII; that is the audit. From a state only one role is legal next, so the audit alone tells what the
repaired turns are.

Rows are counted by content first (copies of one row cost one row from there on), sorted over the whole cluster by conversation
and turn, and read by each task as a stream in chunks of bounded rows and bytes. A conversation that lies inside a chunk is done
at once. A longer one, or one that the borders of partitions cut, leaves its chunks with the least costs from each state to
each, four bucket runs a chunk; these small matrices give every chunk's distances to the goal, and one more stream of the
chunks in order walks and hashes. So no group is held as a whole; only the hash of a repaired conversation, and the audit,
which are each one value, are made by one task.

A row's first fault counts: blank (nothing but ASCII white space; null too), duplicate (role and text seen before in its
conversation), truncated (the last character that is no such space is none of .!?). Null roles and texts count as one space.
Turns stand by number, those without one first, equal ones by role and then by the MD5 of role and text; repeated rows stay
together. A null conversation id is one conversation. Conversations whose rows are all marked absent are returned with zeros.
Other columns are not used, whatever their names. Very long texts are chunks of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwater.llm.common import dropped, written

#: Rows and bytes of text in a chunk.
ROWS, BYTES = 4096, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: By state, the state after the one role that may be inserted or changed to, and that role.
AFTER, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: By initial, the states it may be kept in, each with the state after.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: What is still to insert after the last row: by state, the cost to the goal.
GOAL = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SPACE = " \t\n\v\f\r"

Row = tuple[str, bool]  # initial, truncated


def _arcs(row: Row) -> tuple[list[list[tuple[int, int]]], ...]:
    """For each state after the row, the (state before, cost) of arcs into it."""
    initial, late = row
    into: list[list[tuple[int, int]]] = [[(q, DELETE)] for q in range(4)]
    more = TRUNCATED if late else 0
    for q in range(4):
        into[AFTER[q]].append((q, REROLE + more))
        if (to := KEPT.get(initial, {}).get(q)) is not None:
            into[to].append((q, more))
    return into


ARCS = {(i, late): _arcs((i, late)) for i in ("s", "u", "a", "") for late in (False, True)}
INSERTS = [[q for q in range(4) if AFTER[q] == to] for to in range(4)]


def distances(rows: list[Row], ends: Iterable[int]) -> list[int]:
    """The least cost from node 4 k + q (before row k, in state q) to the end, where being in state q costs ends[q] (FAR: not allowed).

    Dial's queue: bucket d holds nodes that were reached at cost d; settled ones are passed over.
    """
    n = len(rows)
    out, base = [FAR] * (4 * n + 4), min(ends)
    buckets: list[list[int]] = [[] for _ in range(16)]

    def push(d: int, node: int) -> None:
        while d >= len(buckets):
            buckets.extend([] for _ in range(len(buckets)))
        buckets[d].append(node)

    for q, d in enumerate(ends):
        if d < FAR:
            push(d - base, 4 * n + q)
    arcs, at, left = [ARCS[r if r[0] in "sua" else ("", r[1])] for r in rows], 0, len(out)
    while at < len(buckets) and left:
        for node in buckets[at]:
            if out[node] < FAR:
                continue
            out[node], left = at + base, left - 1
            k, q = node >> 2, node & 3
            if k < n:  # turns are inserted before a row
                for p in INSERTS[q]:
                    if out[4 * k + p] == FAR:
                        push(at + INSERT, 4 * k + p)
            if k:
                for p, cost in arcs[k - 1][q]:
                    if out[4 * k - 4 + p] == FAR:
                        push(at + cost, 4 * k - 4 + p)
        buckets[at] = []
        at += 1
    return out


def walked(rows: list[Row], dist: list[int], state: int) -> tuple[list[str], int]:
    """For each row the inserts before it and its own edit, as letters, along tight arcs, the least letter first; the state at the end."""
    out = []
    for k, (initial, late) in enumerate(rows):
        letters, more = "", TRUNCATED if late else 0
        while True:
            here = dist[4 * k + state]
            if here == DELETE + dist[4 * k + 4 + state]:
                letters += "D"
                break
            if here == INSERT + dist[4 * k + AFTER[state]]:
                letters, state = letters + "I", AFTER[state]
                continue
            to = KEPT.get(initial, {}).get(state)
            if to is not None and here == more + dist[4 * k + 4 + to]:
                letters, state = letters + "K", to
            else:
                letters, state = letters + "R", AFTER[state]
            break
        out.append(letters)
    return out, state


class Repair:
    """One conversation, fed chunk by chunk in order: counts, audit and the hash of what is left."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.state, self.audit, self.hash, self.begun = 0, [], hashlib.sha256(), False
        self.initial: str | None = None
        self.turns: list[int | None] = [None, None, 0]  # least, most, distinct

    def take(self, chunk: list[dict], ends: Iterable[int] = GOAL) -> None:
        """chunk: rows with turn, role, text, n (copies), first (the content's first row)."""
        open_, late = [], []
        for r in chunk:
            fault = fault_of(r)
            self.counts["blank"] += r["n"] if fault == "blank" else 0
            self.counts["duplicate"] += {"blank": 0, "duplicate": r["n"]}.get(fault, r["n"] - 1)
            self.counts["truncated"] += fault == "truncated"
            initial = r["role"][:1]
            self.counts["illegal"] += (self.initial is not None and self.initial + initial not in LEGAL) + (r["n"] - 1) * (initial + initial not in LEGAL)
            self.initial = initial
            if r["turn"] is not None:
                least, most, distinct = self.turns
                self.turns = [r["turn"] if least is None else least, r["turn"], distinct + (r["turn"] != most)]
            late.append(fault)
            if fault in ("", "truncated"):
                open_.append((initial, fault == "truncated"))
        letters, end = walked(open_, distances(open_, ends), self.state)
        letters = iter(letters)
        for r, fault in zip(chunk, late, strict=True):
            if fault in ("", "truncated"):
                for x in next(letters):
                    self._edit(x, r, fault)
            self._deleted(r["n"] - (fault in ("", "truncated")))
        assert self.state == end

    def _deleted(self, n: int) -> None:
        self.audit.append("D" * n)
        self.counts["cost"] += DELETE * n

    def _edit(self, x: str, r: dict, fault: str) -> None:
        if x == "D":
            return self._deleted(1)
        self.audit.append(x)
        more = TRUNCATED if fault == "truncated" and x != "I" else 0
        self.counts["cost"] += more + {"I": INSERT, "R": REROLE, "K": 0}[x]
        role = r["role"] if x == "K" else ROLE[self.state]
        self.state = KEPT[role[0]][self.state] if x == "K" else AFTER[self.state]
        self.hash.update((("\n" if self.begun else "") + role + ":" + ("" if x == "I" else r["text"])).encode())
        self.begun = True

    def result(self) -> dict:
        while self.state in (1, 2):
            self._edit("I", {}, "")
        least, most, distinct = self.turns
        if distinct:
            self.counts["gaps"] = most - least + 1 - distinct
        return self.counts | {"audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def fault_of(r: dict) -> str:
    told = r["text"].rstrip(SPACE)
    if not told:
        return "blank"
    if not r["first"]:
        return "duplicate"
    return "" if told[-1] in ".!?" else "truncated"


def matrix(chunk: list[dict]) -> list[int]:
    """The least cost from each state before the chunk to each after it, row by row."""
    rows = [(r["role"][:1], f == "truncated") for r in chunk if (f := fault_of(r)) in ("", "truncated")]
    to = [distances(rows, [0 if q == e else FAR for q in range(4)]) for e in range(4)]
    return [to[e][q] for q in range(4) for e in range(4)]


def faults_ready(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) counted by content: conv_id, turn, role, text, n, first, key, present."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, "present")
    rows = rows.groupBy("conv_id", "turn", "role", "text", "present").agg(F.count("*").alias("n"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary")))
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = rows.where("present").groupBy(F.col("conv_id").alias("conv"), F.col("key").alias("content")).agg(F.min(place).alias("least"))
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("key") == F.col("content")) & (place == F.col("least")) & F.col("present")
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "present", "n", "key", F.col("least").isNotNull().alias("first"))


def repaired(turns: DataFrame, present: Column | None = None, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text); present: which rows are there (all if not given)."""
    turns = turns.select("conv_id", "turn", "role", "text", (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    order = ["conv_id", "turn", "role", "key"]
    sorted_ = faults_ready(turns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    names = ["conv_id", "turn", "role", "text", "n", "first", "present", "part"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, number, edge, part = [], 0, 0, True, 0

        def out(more: bool) -> pa.RecordBatch:
            """more: the conversation may have rows besides the chunk."""
            conv, here = chunk[0]["conv_id"], [r for r in chunk if r["present"]]
            row = dict.fromkeys(columns, None) | {"conv_id": conv, "part": part, "number": number}
            if more:
                row |= {"costs": matrix(here), "held": here}
            else:
                one = Repair()
                one.take(here)
                row |= one.result()
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in batches:
            for r in batch.select(names).to_pylist():
                other = bool(chunk) and r["conv_id"] != chunk[0]["conv_id"]
                if chunk and (other or len(chunk) >= rows or held + len(r["text"]) > size):
                    yield out(edge or not other)
                    chunk, held, number, edge = [], 0, number + 1, not other
                part = r["part"]
                chunk.append(r)
                held += len(r["text"])
        if chunk:
            yield out(True)

    piece = "part int, number int, costs array<long>, held array<struct<turn: long, role: string, text: string, n: long, first: boolean>>"
    columns = [c.split()[0] for c in RESULT.split(", ")] + ["part", "number", "costs", "held"]
    inner = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("first", pa.bool_())])
    counted = [(c, pa.int64()) for c in ("conv_id", *COUNTS)] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    kinds = pa.schema([*counted, ("part", pa.int32()), ("number", pa.int32()), ("costs", pa.list_(pa.int64())), ("held", pa.list_(inner))])
    table = written(sorted_.mapInArrow(chunks, f"{RESULT}, {piece}"), "chunks")
    done, open_ = table.where("costs is null"), table.where("costs is not null")
    goal = open_.select("conv_id", "part", "number", "costs").groupBy("conv_id").applyInArrow(_to_goal, "conv_id long, part int, number int, ends array<long>")
    joined = open_.alias("o").join(goal.alias("g"), F.expr("o.conv_id <=> g.conv_id and o.part = g.part and o.number = g.number")).select("o.conv_id", "o.part", "o.number", "held", "ends")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if now is not None and r["conv_id"] != conv:
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv} | now.result()], pa.schema(counted))
                    now = None
                now, conv = now or Repair(), r["conv_id"]
                now.take(r["held"], r["ends"])
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv} | now.result()], pa.schema(counted))

    followed = joined.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(follow, RESULT)
    out = written(done.select(*followed.columns).union(followed), "repaired")
    dropped(table)
    return out


def _to_goal(part: pa.Table) -> pa.Table:
    """For each chunk of one conversation the least cost to the goal from each state after it; chunks are small matrices."""
    order = np.lexsort((np.asarray(part["number"]), np.asarray(part["part"])))
    costs = np.asarray(part["costs"].combine_chunks().flatten()).reshape(-1, 4, 4)[order]
    ends, now = np.empty((len(order), 4), np.int64), np.array(GOAL, np.int64)
    for k in range(len(order) - 1, -1, -1):
        ends[k] = now
        now = np.minimum((costs[k] + now).min(1), FAR)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * 4), pa.array(ends.ravel()))
    return pa.table([part["conv_id"].take(pa.array(order)), part["part"].take(pa.array(order)), part["number"].take(pa.array(order)), lists], names=["conv_id", "part", "number", "ends"])


def damaged(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text, present) damaged by a hash of conversation and turn: dropped, emptied, cut of its sentence marks, repeated, said by the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
