"""Ranked lexical search: compressed postings per shard, a heap merge through them document by document, a global merge.

A task cuts its documents into shards of some megabytes of text, sorts each by doc_id and writes a row for each term of the
shard: how many documents hold it, and its postings, gaps of places and counts as variable-length bytes. No text is shuffled.
A query set goes over all shards in blocks of items: the postings of the block's terms meet in one task for each shard and
block. There a heap of cursors, one a term and keyed by the last document of its current run of postings, says up to which
document all runs are known; those documents are scored as a whole, and the best go to a bounded heap keyed by score, then
by doc_id. The shards' best meet in a window that keeps the first of each item before the shuffle too.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. With N
documents that hold a term, L terms in all, n of one document, df documents of a term and tf of it in the document, a term
weighs w = floor(1000 ln((2N+2)/(2df+1))) and gives w * (10^9 tf div (1000 tf + 20 m)), m = 50 + (50 n N) div L.

Null and empty texts have no terms; an item without terms has no rows. Items that share an id are one item with the terms of
all of their texts; a null item_id is an item. Documents that share an id are ranked each for itself; those without an id come
last among equal scores. A very long text is a shard of its own. Columns besides ids and texts are not used. An empty table on
either side gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwater.llm.common import dropped, joined, slices, written

#: Bytes of text in a shard, items in a block, postings that a cursor holds at a time, results of an item.
SHARD, ITEMS, RUN, TOP = 16 << 20, 256, 2048, 50
#: A term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Index:
    """postings: shard, term, df, posts; shards: shard, ids, lengths (terms with repeats), in ascending order of ids, null last; both in one table."""

    postings: DataFrame
    shards: DataFrame
    table: DataFrame

    def dropped(self) -> None:
        dropped(self.table)


def terms(text: Column) -> Column:
    """The terms of a text with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(TERM), F.lit(0))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, the lowest first and the last without its high bit, and each number's first byte (one more at the end)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        low = (values[on] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[at[:-1][on] + k] = low | ((size[on] > k + 1).astype(np.uint8) << 7)
    return out, at


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers that packed() made bytes of."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size, out = ends - starts + 1, np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[on] |= (data[starts[on] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _counted(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's texts in order: distinct terms, then for each term and document its place among terms and documents and the count; terms a text."""
    data, first = joined(text)
    data = _LOWER[data]
    held = _TERM[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    n = np.diff(np.searchsorted(starts, first))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[held]))])
    coded = found.dictionary_encode()
    rank = np.argsort(np.asarray(pc.sort_indices(coded.dictionary)), kind="stable") if len(coded.dictionary) else np.zeros(0, np.int64)
    key = rank[np.asarray(coded.indices)] * len(text) + np.repeat(np.arange(len(text)), n)
    key.sort()
    new = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(np.append(new, len(key)))
    return coded.dictionary.take(pc.sort_indices(coded.dictionary)), key[new] // max(1, len(text)), key[new] % max(1, len(text)), tf, n


def _posts(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_terms: int) -> pa.Array:
    """Each term's postings as one binary value: gap and count of each document in turn."""
    first = np.searchsorted(term, np.arange(n_terms))
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first] + 1
    data, at = packed(np.stack([gap, tf], 1).ravel())
    return pa.Array.from_buffers(pa.large_binary(), n_terms, [None, pa.py_buffer(np.append(at[2 * first], at[-1]).astype(np.int64)), pa.py_buffer(data)])


def index(docs: DataFrame, shard_bytes: int = SHARD) -> Index:
    """The index of documents (doc_id, text), written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, 0
        for batch, text in slices(batches, "text", shard_bytes):
            own = pc.sum(pc.binary_length(text)).as_py() or 0
            if held and size + own > shard_bytes:
                yield from shard(held, done)
                held, size, done = [], 0, done + 1
            held.append((batch, text))
            size += own
        if held:
            yield from shard(held, done)

    def shard(held: list, k: int) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([b.column("doc_id") for b, _ in held])
        number = (held[0][0].column("part")[0].as_py() << 32) | k
        order = pc.sort_indices(ids)  # null last
        ids = ids.take(order)
        found, term, doc, tf, n = _counted(pa.concat_arrays([t for _, t in held]).take(order))
        lists = lambda x, kind: pa.array([x], pa.list_(kind))
        names = ["shard", "term", "df", "posts", "ids", "lengths"]
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.string()), pa.array([0]), pa.nulls(1, pa.binary()), lists(ids.to_pylist(), pa.int64()), lists(n.tolist(), pa.int64())], names)
        posts, df = _posts(term, doc, tf, len(found)), np.bincount(term, minlength=len(found))
        for a in range(0, len(found), 10_000):
            m = min(10_000, len(found) - a)
            none = pa.nulls(m, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), found.slice(a, m).cast(pa.string()), pa.array(df[a : a + m]), posts.slice(a, m).cast(pa.binary()), none, none], names)

    table = written(rows.mapInArrow(build, "shard long, term string, df long, posts binary, ids array<long>, lengths array<long>"), "index")
    return Index(table.where("term is not null").select("shard", "term", "df", "posts"), table.where("term is null").select("shard", "ids", "lengths"), table)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a posting gives for each unit of its term's weight; n: the terms of its document."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))


def best(cursors: list[tuple[np.ndarray, np.ndarray]], top: int = TOP, run: int = RUN) -> list[tuple[int, int]]:
    """The `top` highest (score, document) with a score above 0 of the sums over cursors (ascending documents, gains), equal scores by document.

    The heap of cursors gives the least last document of their current runs: up to there every posting is at hand.
    """
    ahead = [(int(d[min(run, len(d)) - 1]), k) for k, (d, _) in enumerate(cursors) if len(d)]
    heapq.heapify(ahead)
    at, ends = [0] * len(cursors), [min(run, len(d)) for d, _ in cursors]
    found: list[tuple[int, int]] = []
    while ahead:
        upto = ahead[0][0]
        docs, gains = [], []
        for _, k in ahead:
            d, g = cursors[k]
            b = at[k] + int(np.searchsorted(d[at[k] : ends[k]], upto, "right"))
            docs.append(d[at[k] : b])
            gains.append(g[at[k] : b])
            at[k] = b
        while ahead and ahead[0][0] == upto:  # these cursors go on to their next run
            k = ahead[0][1]
            ends[k] = min(at[k] + run, len(cursors[k][0]))
            if at[k] < ends[k]:
                heapq.heapreplace(ahead, (int(cursors[k][0][ends[k] - 1]), k))
            else:
                heapq.heappop(ahead)
        doc, gain = np.concatenate(docs), np.concatenate(gains)
        low = int(doc.min())
        score = np.zeros(upto - low + 1, np.int64)
        np.add.at(score, doc - low, gain)
        floor = found[0][0] if len(found) == top else 0
        seen = np.flatnonzero(score > floor)  # an equal score of a later document never enters
        if len(seen) > top:
            seen = seen[np.lexsort((seen, -score[seen]))[:top]]
        for x in seen.tolist():
            item = (int(score[x]), -(low + x))
            if len(found) < top:
                heapq.heappush(found, item)
            elif item > found[0]:
                heapq.heapreplace(found, item)
    return [(s, -d) for s, d in sorted(found, reverse=True)]


def search(index: Index, items: DataFrame, top: int = TOP, block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of items (item_id, text)."""
    asked = items.select("item_id", F.explode(terms(F.col("text").cast("string"))).alias("term")).distinct()
    # An item's block by a hash of its id, as many blocks as keep them small whatever the number of items.
    blocks = max(1, -(-items.select("item_id").distinct().count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    asked = written(asked.groupBy("block", "term").agg(F.collect_list(F.struct("item_id")).alias("items")), "asked")
    held = written(index.postings.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    df = held.groupBy("term").agg(F.sum("df").alias("all_df"))
    lengths = index.shards.select(F.explode("lengths").alias("n"))
    docs, total = lengths.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = asked.join(df, "term")
    sides = held.drop("df").join(known, "term").select("shard", "block", "term", "posts", "items", "all_df")
    shards = index.shards.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def rank(shard: pa.Table, postings: pa.Table) -> pa.Table:
        kinds = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        if not len(shard) or not len(postings):
            return kinds.empty_table()
        ids, n = shard["ids"].combine_chunks().flatten(), np.asarray(shard["lengths"].combine_chunks().flatten())
        cursors: dict[int | None, list] = {}
        for posts, wanted, df_ in zip(postings["posts"], postings["items"].to_pylist(), postings["all_df"].to_pylist(), strict=True):
            pairs = unpacked(np.frombuffer(posts.as_buffer(), np.uint8))
            doc, w = np.cumsum(pairs[0::2]) - 1, weight(docs, df_)
            gain = w * impacts(pairs[1::2], n[doc], docs, total)
            for item in wanted:
                cursors.setdefault(item["item_id"], []).append((doc, gain))
        out = [(item, d, s) for item, own in cursors.items() for s, d in best(own, top)]
        item, doc, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(item, pa.int64()), ids.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())], schema=kinds)

    near = shards.groupBy("shard", "block").cogroup(sides.groupBy("shard", "block")).applyInArrow(rank, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
    out = written(ranked, "ranked")
    dropped(asked, held)
    return out

