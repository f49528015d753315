"""Best-fit packing with several permitted sequence lengths.

Every whole text gets its ids by the tokenizer of the token files, and an end id. packed() does all in the task that reads
the texts and gives the pieces with their ids; tokenised(), best_fit() and sequences() do it in steps over the cluster. Items (documents, cut into
pieces of ids where they are longer than the longest permitted length) are dealt to shards, as they come or by a hash; a shard
holds about `shard` ids and is packed by one task. Longest first, an item goes to the open bin whose free room fits it best; a bitmap
over free rooms finds it. If no open bin has room, a bin of the size with the least cost per id that it can be expected to
hold is opened: a size costs its length plus `overhead`, and what can still come into it is bounded by the lengths not
placed yet that fit beside the item. At the end each bin shrinks to the smallest permitted length that holds its contents.
sequences() then gives the packed bins with their ids.

Every piece is placed once and no bin overflows. A null or empty text is an item of one id (its end). A text of any length
is cut into as many pieces as it needs. Ties go by doc_id, then item, then piece; of open bins with equal room the one that
came to it last is taken. Rows with one id and text are separate items. Null ids come last. Other columns are not used. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchwater.llm.common import slices, written

#: Permitted sequence lengths, cost of a sequence beside its length, ids in a shard.
SIZES, OVERHEAD, SHARD = (512, 1024, 2048, 4096), 32, 8_000_000


def tokenised(docs: DataFrame, path: str, end_id: int = 0, keep: bool = True) -> DataFrame:
    """(item, doc_id, n, ids) of docs (doc_id, text): n ids, the end id included, as 32-bit integers; written once.

    keep=False leaves the ids out: for a plan of the bins the lengths are enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catchwater.llm.token_files import tokenizer

        cached, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch, text in slices(batches, "text"):
            if keep:
                ids, first = cached.encode(text)
                raw, at = ids.astype("<u4").tobytes(), (4 * first).tolist()
                own = [raw[a:b] + end for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [pa.array(np.diff(first) + 1, pa.int64()), pa.array(own, pa.binary())]
            else:
                columns = [pa.array(cached.count(text) + 1, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "ids"][: 2 + keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long" + ", ids binary" * keep)
    return written(rows.withColumn("item", F.monotonically_increasing_id()), "tokenised")


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each item and the size of each bin; lengths come longest first and fit the largest size."""
    sizes = sorted(sizes)
    lengths = list(lengths)
    rest = np.concatenate([np.cumsum(np.asarray(lengths, np.int64)[::-1])[::-1], [0]])  # tokens from an item on
    smaller = np.searchsorted(-np.asarray(lengths, np.int64), -np.arange(sizes[-1] + 1), side="left")  # first item of at most that length
    free: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    bits, room, capacity, bins, offsets = 0, [], [], [], []
    for k, n in enumerate(lengths):
        fits = bits >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                bits ^= 1 << r
        else:
            best = None
            for c in sizes:
                if c >= n:
                    more = rest[max(k + 1, int(smaller[c - n]))] if c > n else 0
                    price = (c + overhead) / (n + min(c - n, int(more)))
                    if best is None or price < best[0]:
                        best = price, c
            b, r = len(room), best[1]
            room.append(r)
            capacity.append(r)
        bins.append(b)
        offsets.append(capacity[b] - r)
        room[b] = r = r - n
        if r:
            if not free[r]:
                bits |= 1 << r
            free[r].append(b)
    used = [c - r for c, r in zip(capacity, room, strict=True)]
    return bins, offsets, np.asarray(sizes)[np.searchsorted(sizes, used)].tolist() if used else []


def best_fit(items: DataFrame, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """One row per piece of an item (item, doc_id, n): item, doc_id, piece, shard, bin, bin_size, bin_offset, n_tokens.

    Bins are numbered within a shard.
    """
    longest = max(sizes)
    items = items.select("item", "doc_id", F.greatest(F.lit(1), "n").alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    shards = max(16, int(total // shard))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / longest).cast("int") - 1)))
    items = items.withColumn("n_tokens", F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int"))
    items = items.select("item", "doc_id", "piece", "n_tokens", F.pmod(F.xxhash64("item", "doc_id", "piece"), F.lit(shards)).cast("int").alias("shard"))

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("item", "ascending"), ("piece", "ascending")])
        bins, offsets, widths = pack(own["n_tokens"].to_pylist(), sizes, overhead)
        bin_size = np.asarray(widths, np.int32)[bins]
        return pa.table([own["item"], own["doc_id"], own["piece"], own["shard"], pa.array(bins, pa.int64()), pa.array(bin_size), pa.array(offsets, pa.int32()), own["n_tokens"]], names=out.names)

    kinds = [("item", T.LongType()), ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("shard", T.IntegerType()), ("bin", T.LongType()), ("bin_size", T.IntegerType()), ("bin_offset", T.IntegerType()), ("n_tokens", T.IntegerType())]
    out = T.StructType([T.StructField(n, t) for n, t in kinds])
    return items.groupBy("shard").applyInArrow(run, out)


def packed(docs: DataFrame, path: str, end_id: int = 0, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """The packed pieces of docs (doc_id, text) with their ids, nothing shuffled: each task tokenises its texts and packs a shard as soon as it has `shard` ids.

    A row is a piece: item, doc_id, piece, shard, bin, bin_size, bin_offset, n_tokens, ids (n_tokens of them, 32 bits each); a
    bin's pieces laid at their offsets are a sequence. Item and shard hold the partition's number in their upper half.
    """
    longest, names = max(sizes), ["item", "doc_id", "piece", "shard", "bin", "bin_size", "bin_offset", "n_tokens", "ids"]

    def laid(held: list, number: int) -> Iterator[pa.RecordBatch]:
        doc = pa.concat_arrays([d for d, *_ in held])
        item = np.concatenate([k for _, k, *_ in held])
        data = [raw for *_, own in held for raw in own]
        n = np.fromiter((len(raw) // 4 for raw in data), np.int64, len(data))
        count = -(-n // longest)
        of = np.repeat(np.arange(len(data)), count)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(longest, n[of] - piece * longest)
        own = pa.table([pa.array(of), doc.take(pa.array(of)), pa.array(piece), pa.array(size)], names=["of", "doc_id", "piece", "n"])
        own = own.sort_by([("n", "descending"), ("doc_id", "ascending"), ("of", "ascending"), ("piece", "ascending")]).combine_chunks()
        of, piece, size = (np.asarray(own[c]) for c in ("of", "piece", "n"))
        bins, offsets, widths = pack(size.tolist(), sizes, overhead)
        wide = np.asarray(widths, np.int32)[bins]
        for a in range(0, len(of), 2000):
            cut = slice(a, a + 2000)
            m = len(of[cut])
            ids = [data[o][4 * longest * p : 4 * longest * p + 4 * s] for o, p, s in zip(of[cut].tolist(), piece[cut].tolist(), size[cut].tolist(), strict=True)]
            columns = [pa.array(item[of[cut]]), own["doc_id"].chunk(0).slice(a, m), pa.array(piece[cut].astype(np.int32)), pa.array(np.full(m, number)), pa.array(bins[cut], pa.int64()), pa.array(wide[cut]), pa.array(offsets[cut], pa.int32()), pa.array(size[cut].astype(np.int32)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catchwater.llm.token_files import tokenizer

        cached, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        held, size, seen, shards, part = [], 0, 0, 0, 0
        for batch, text in slices(batches, "text"):
            ids, first = cached.encode(text)
            raw, at = ids.astype("<u4").tobytes(), (4 * first).tolist()
            part = batch.column("part")[0].as_py() << 32
            held.append((batch.column("doc_id"), part + seen + np.arange(len(text)), [raw[a:b] + end for a, b in zip(at[:-1], at[1:], strict=True)]))
            seen, size = seen + len(text), size + len(ids) + len(text)
            if size >= shard:
                yield from laid(held, part + shards)
                held, size, shards = [], 0, shards + 1
        if held:
            yield from laid(held, part + shards)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "item long, doc_id long, piece int, shard long, bin long, bin_size int, bin_offset int, n_tokens int, ids binary")


def sequences(items: DataFrame, placed: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """The packed bins: shard, bin, bin_size, doc_ids and starts (a piece each, in order), ids (n_tokens of them, 32 bits each).

    items: tokenised(); placed: best_fit() of them with the same sizes.
    """
    longest = max(sizes)
    cut = F.expr(f"substring(ids, cast(piece as int) * {4 * longest} + 1, n_tokens * 4)")
    parts = placed.join(items.select("item", "ids"), "item").select("shard", "bin", "bin_size", F.struct("bin_offset", "doc_id", cut.alias("ids")).alias("part"))
    bins = parts.groupBy("shard", "bin", "bin_size").agg(F.array_sort(F.collect_list("part")).alias("own"))  # at most `longest` pieces
    return bins.select(
        "shard", "bin", "bin_size", F.transform("own", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("own", lambda x: x["bin_offset"]).alias("starts"),
        F.aggregate("own", F.lit(b""), lambda got, x: F.concat(got, x["ids"])).alias("ids"),
    )
