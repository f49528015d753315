"""Substring dedup: removes passages that also stand in a document with a smaller id, by super-k-mers.

A window is `window` consecutive words of one text. Its minimiser is the rarest among its runs of `mer` words, by hashed
counts over all texts, then by hash: common runs, which would draw a share of the whole corpus to one bucket, never are.
Consecutive windows with one minimiser travel as one string of words, a super-k-mer, to the bucket of that minimiser, so
each word is sent about three times instead of `window` times. A task packs what it sends to a bucket into one compressed
blob and sends a string once however many of its documents hold it: documents but the smallest lose the string's windows
at once. In a bucket, sorting the windows of all strings counts each exactly (hashes sort, bytes decide), and every
document that holds a window which a smaller one holds is told its word range. Ranges then meet the texts by document.

A window is removed from a document if it starts in a document with a smaller doc_id, judged on the input; a word goes if
a removed window covers it. A document without id counts as larger than all others. Rows that share a doc_id and a text
share their fate, neither is smaller. Texts with fewer words than a window lose nothing; null and empty texts have no
words and stay null or empty. A text of any length is read whole. Of documents that tie in id all or none lose a window.
Other columns pass through; clashing ones (kept, n_words, n_removed) are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchwater.llm.common import joined, mix, pieces, slices, span_hashes, words

#: Words in a window and in a minimiser; bytes of text that a task packs at once; bytes of text to a bucket.
WINDOW, MER, PACK, BUCKET = 13, 2, 3 << 20, 1 << 20
_LAST = np.iinfo(np.int64).max


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return mix(out)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    out, width = x, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def _sliding_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    return _runs(hashes, n)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte spans one after another, about a megabyte of them at a time."""
    ends = np.cumsum(sizes)
    out, k, at = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8), 0, 0
    while k < len(ends):
        upto = max(k + 1, int(np.searchsorted(ends, at + (1 << 20), side="right")))
        stop, n = int(ends[upto - 1]), sizes[k:upto]
        out[at:stop] = data[np.arange(at, stop) + np.repeat(starts[k:upto] - (ends[k:upto] - n), n)]
        k, at = upto, stop
    return out


def _normal(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words one space apart (a space after each) with their starts and ends, and each text's first word."""
    data, firsts = joined(text)
    starts, ends, first = words(data, firsts)
    size = ends - starts + 1
    out = _gathered(data, starts, size).copy()
    stop = np.cumsum(size)
    out[stop - 1] = 32
    return out, stop - size, stop - 1, first


def super_kmers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, window: int, mer: int, level: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, first word, windows, minimiser) of each super-k-mer of the texts."""
    total = len(starts) - window + 1
    empty = np.zeros(0, np.int64)
    if total <= 0:
        return empty, empty, empty, empty.astype(np.uint64)
    order = _runs(span_hashes(data, starts, ends), mer)
    if level is not None:
        order = level[order >> np.uint64(48)] << np.uint64(56) | order >> np.uint64(8)
    least = _sliding_min(order, window - mer + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    good = np.flatnonzero(doc[:total] == doc[window - 1 :])
    if not len(good):
        return empty, empty, empty, empty.astype(np.uint64)
    value, own = least[good], doc[good]
    cut = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (own[1:] != own[:-1])]))
    return own[cut], good[cut], np.diff(np.concatenate([cut, [len(good)]])), value[cut]


def _same(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the spans `one` and `other` (places in starts) hold the same bytes."""
    equal = sizes[one] == sizes[other]
    k = np.flatnonzero(equal)
    for at in range(0, len(k), 20_000):
        part = k[at : at + 20_000]
        n = sizes[one[part]]
        differ = _gathered(data, starts[one[part]], n) != _gathered(data, starts[other[part]], n)
        equal[part] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n) if len(n) and n.min() > 0 else True
    return equal


def groups(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each span, the place of the span with the same bytes that has the smallest rank (the earliest of equals).

    Spans sort by hash, length and rank; runs of equal hash and length are then compared byte by byte. Spans that differ
    under one hash, should that happen, are told apart by their bytes.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    sizes = ends - starts
    hashes = span_hashes(data, starts, ends)
    order = np.lexsort((rank, hashes))
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    rest = np.flatnonzero(~new)
    ok = _same(data, starts, sizes, order[rest], head[rest])
    out = np.empty(n, np.int64)
    out[order] = head
    if not ok.all():
        raw = data.tobytes()
        for h in np.unique(hashes[order[rest[~ok]]]):
            by: dict[bytes, int] = {}
            for k in order[np.searchsorted(hashes[order], h) : np.searchsorted(hashes[order], h, "right")].tolist():
                out[k] = by.setdefault(raw[starts[k] : ends[k]], k)
    return out


#: Texts, and characters of each, from which the dictionary of the compressor is made at most; its size; the level.
TAUGHT, SHOWN, DICTIONARY, LEVEL = 2000, 2000, 1 << 16, 9


def dictionary(docs: DataFrame, total: int) -> bytes:
    """A dictionary for blobs, from a bounded sample of texts: it changes their size only. Empty where there is too little.

    With many buckets a blob holds few strings; with it, it is about as well compressed as a long one.
    """
    every = max(1, total // (TAUGHT * SHOWN))
    some = docs.where(F.pmod(F.xxhash64("d", "t"), F.lit(every)) == 0).select(F.substring("text", 1, SHOWN).alias("text")).limit(TAUGHT)
    samples = [" ".join(r["text"].split()).encode() for r in some.where("text is not null").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, [x for x in samples if len(x) > 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class Blobs:
    """Compressed arrays."""

    def __init__(self, taught: bytes):
        known = zstandard.ZstdCompressionDict(taught) if taught else None
        if known:
            known.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(dict_data=known) if known else zstandard.ZstdCompressor(level=LEVEL)
        self.opener = zstandard.ZstdDecompressor(dict_data=known)

    def packed(self, *arrays: np.ndarray) -> bytes:
        raw = b"".join(np.int64(len(a)).tobytes() + a.tobytes() for a in arrays)
        return self.packer.compress(np.int64(len(raw)).tobytes() + raw)

    def arrays(self, blob: bytes, *kinds: type) -> list[np.ndarray]:
        raw, at, out = self.opener.decompress(blob), 8, []
        for kind in kinds:
            n = int(np.frombuffer(raw, np.int64, 1, at)[0])
            out.append(np.frombuffer(raw, kind, n, at + 8))
            at += 8 + out[-1].nbytes
        return out


def _ranges(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Rows (key, ranges): all ranges of a document as one array start, count, start, count, ..."""
    order = np.lexsort((start, key))
    key, flat = key[order], np.stack([start[order], count[order]], 1).astype(np.int32).ravel()
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.concatenate([cut, [len(key)]]).astype(np.int32) * 2
    return key[cut], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def commonness(docs: DataFrame, mer: int) -> np.ndarray:
    """How common the runs of `mer` words under each 16-bit hash are in all texts, on a scale of quarter powers of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, np.int64)
        for batch in pieces(batches, "text"):
            data, firsts = joined(batch.column("text"))
            starts, ends, _ = words(data, firsts)
            sums += np.bincount((_runs(span_hashes(data, starts, ends), mer) >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        slot = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sums[slot])], ["slot", "n"])

    out = np.zeros(1 << 16)
    for r in docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        out[r["slot"]] = r["n"]
    return np.minimum(4 * np.log2(out + 1), 255).astype(np.uint64)


def _packed(docs: DataFrame, buckets: int, window: int, mer: int, pack: int, taught: bytes) -> DataFrame:
    """Rows (bucket, blob) and, for what a task can tell by itself, (bucket, document, text hash, ranges)."""
    level = commonness(docs, mer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Blobs(taught)
        for batch in pieces(batches, "text", pack):
            doc_id, print_ = np.asarray(batch.column("d")), np.asarray(batch.column("t"))
            data, starts, ends, first = _normal(batch.column("text"))
            own, word, count, value = super_kmers(data, starts, ends, first, window, mer, level)
            value = mix(value)
            if not len(own):
                continue
            a, b = starts[word], ends[word + count + window - 2]
            key = np.unique(np.stack([doc_id, print_], 1), axis=0, return_inverse=True)[1].ravel()  # documents by id
            head = groups(data, a, b, key[own])
            lost = np.flatnonzero(doc_id[own] > doc_id[own[head]])  # a smaller document of this task has the same string
            offset = word - first[own]
            if len(lost):
                k, listed = _ranges(own[lost], offset[lost], count[lost])
                yield pa.RecordBatch.from_arrays([pa.array((print_[k] % buckets).astype(np.int32)), pa.nulls(len(k), pa.binary()), pa.array(doc_id[k]), pa.array(print_[k]), listed], names)
            sent = np.flatnonzero(doc_id[own] == doc_id[own[head]])
            bucket = (value[sent] % np.uint64(buckets)).astype(np.int32)
            sent = sent[np.lexsort((value[sent], bucket))]
            bucket = (value[sent] % np.uint64(buckets)).astype(np.int32)
            size = b[sent] - a[sent] + 1  # with the space after it
            cut = np.flatnonzero(np.diff(np.concatenate([[-1], bucket, [-1]])))
            blobs = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                k = sent[lo:hi]
                blobs.append(store.packed(doc_id[own[k]], print_[own[k]].astype(np.uint32), offset[k].astype(np.int32), count[k].astype(np.int32), _gathered(data, a[k], size[lo:hi])))
            n = len(blobs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut[:-1]]), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], names
            )

    names = ["bucket", "blob", "d", "t", "ranges"]
    return docs.mapInArrow(run, "bucket int, blob binary, d long, t long, ranges array<int>")


def _bucket(parts: pa.Table, window: int, taught: bytes) -> pa.Table:
    """The word ranges that documents of one bucket lose; ranges that tasks found pass through."""
    told = parts.filter(pc.is_null(parts["blob"])).select(["d", "t", "ranges"])
    parts = parts.filter(pc.is_valid(parts["blob"]))
    if not len(parts):
        return told
    store = Blobs(taught)
    read = [store.arrays(x, np.int64, np.uint32, np.int32, np.int32, np.uint8) for x in parts["blob"].to_pylist()]
    doc_id, print_, offset, count, data = (np.concatenate(x) for x in zip(*read, strict=True))
    print_ = print_.astype(np.int64)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    word = np.concatenate([[0], np.cumsum(count + window - 1)])[:-1]  # first word of each string
    total = int(count.sum())
    of = np.repeat(np.arange(len(count)), count)
    step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at = word[of] + step
    head = groups(data, starts[at], ends[at + window - 1], doc_id[of])
    lost = np.flatnonzero(doc_id[of] > doc_id[of[head]])
    run = np.flatnonzero(np.concatenate([[True], (np.diff(lost) != 1) | (np.diff(of[lost]) != 0)])) if len(lost) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([run, [len(lost)]]))
    k = lost[run]
    own = np.unique(np.stack([doc_id[of[k]], print_[of[k]]], 1), axis=0, return_inverse=True)[1].ravel() if len(k) else np.zeros(0, np.int64)
    place, listed = _ranges(own, offset[of[k]] + step[k], size)
    some = np.unique(own, return_index=True)[1]
    found = pa.table([pa.array(doc_id[of[k]][some]), pa.array(print_[of[k]][some]), listed.cast(told.schema.field("ranges").type)], schema=told.schema)
    return pa.concat_tables([told, found])


def dedup(docs: DataFrame, window: int = WINDOW, mer: int = MER, pack: int = PACK, bucket_bytes: int = BUCKET, text: str = "text", into: str = "kept") -> DataFrame:
    """docs with n_words, n_removed and `into`, the words kept, joined by one space, of each whole text.

    Documents are told apart by doc_id and text. Costs a scan for the size of the texts, a shuffle of packed strings and a
    shuffle of the texts.
    """
    docs = docs.drop(*({into, "n_words", "n_removed"} - {text}))
    keyed = docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn("__t", F.pmod(F.xxhash64(text), F.lit(1 << 32)))  # 32 bits tell rows of one id apart
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, int(total // bucket_bytes))
    plain = keyed.select(F.col("__d").alias("d"), F.col("__t").alias("t"), F.col(text).alias("text"))
    taught = dictionary(plain, total)
    packed = _packed(plain, buckets, window, mer, pack, taught)

    def own(parts: pa.Table) -> pa.Table:
        return _bucket(parts, window, taught)

    found = packed.groupBy("bucket").applyInArrow(own, "d long, t long, ranges array<int>")
    ranges = found.groupBy("d", "t").agg(F.flatten(F.collect_list("ranges")).alias("__r"))
    joined_ = keyed.join(ranges, (F.col("__d") == F.col("d")) & (F.col("__t") == F.col("t")), "left").drop("d", "t", "__d", "__t")
    fields = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*fields, *([] if into == text else [docs.schema[text]]), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(into, T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            data, starts, ends, first = _normal(texts)
            n = np.diff(first)
            listed = batch.column("__r").combine_chunks() if isinstance(batch.column("__r"), pa.ChunkedArray) else batch.column("__r")
            size = np.asarray(pc.fill_null(pc.list_value_length(listed), 0), np.int64) // 2
            pairs = np.asarray(listed.flatten(), np.int64).reshape(-1, 2)
            doc = np.repeat(np.arange(len(size)), size)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, first[doc] + pairs[:, 0], 1)
            np.add.at(change, first[doc] + pairs[:, 0] + pairs[:, 1] + window - 1, -1)
            stay = np.cumsum(change)[:-1] == 0
            own = np.repeat(np.arange(len(n)), n)
            left = np.bincount(own[stay], minlength=len(n))
            kept = _gathered(data, starts[stay], ends[stay] - starts[stay] + 1)
            spans = np.bincount(own[stay], (ends - starts + 1)[stay], len(n)).astype(np.int64)
            stop = np.cumsum(spans)
            raw = kept.tobytes()
            out = pa.array([raw[b - s : b - 1].decode() if s else "" for s, b in zip(spans.tolist(), stop.tolist(), strict=True)], pa.string())
            columns = [batch.column(f.name) for f in fields] + ([] if into == text else [batch.column(text)])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), out], schema.names)

    return joined_.mapInArrow(cut, schema)
