"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, exact verification on full n-gram sets.

Band and row counts come from banding(): two documents of similarity t share a band with probability
1 - (1 - t**rows)**bands. Of the counts that reach the target recall at the threshold, those with the fewest hashes are
taken that let few pairs of half the threshold's similarity meet.

1. signatures(): per document, the fingerprint of its n-gram set and one hash for each band.
2. Documents with one and the same n-gram set form a class; its smallest doc_id stands for it from here on.
3. Class representatives that share a band hash form a bucket. Buckets with the same members are taken once. A bucket is
   cut into chunks and its pairs into blocks of two chunks, so that no task holds more than two chunks.
4. A block compares all its pairs on their full n-gram sets. A pair counts in the first band that it shares, so once
   over all blocks. A block returns one row for each member that has a link: how many documents it is linked with and
   the smallest member that it reaches, never its pairs.
5. components() unites the reached members.

Words are runs of non-space bytes, unchanged. A text of fewer words than n has one n-gram, all its words. Null and empty
texts have none and no link. A document without doc_id has no link. Rows that share a doc_id count as one document whose
links unite. Repeated rows are copies of each other. A text of any length is one set, made whole in one task. Of documents
that tie for a class the smallest doc_id stands for it. Other columns are not used. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchwater.llm.common import components, joined, mix, pieces, shingles, span_hashes, words, written

#: Words in an n-gram, similarity from which two documents are linked, recall aimed at, members of a chunk.
WORDS, THRESHOLD, RECALL, CHUNK = 5, 0.8, 0.999, 512


def banding(threshold: float = THRESHOLD, recall: float = RECALL, stray: float = 0.2) -> tuple[int, int]:
    """(bands, rows): the fewest bands that reach the recall at the threshold, by the fewest rows with which pairs of half that similarity meet with a chance of `stray` at most."""
    for rows in range(1, 65):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= stray:
            break
    return bands, rows


def _sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of each text, in order, and each text's first."""
    data, firsts = joined(text)
    starts, ends, first = words(data, firsts)
    return shingles(span_hashes(data, starts, ends), first, n)


def signatures(docs: DataFrame, n: int = WORDS, bands: int = 0, rows: int = 0) -> DataFrame:
    """(doc_id, t, n, f1, f2, bands): a hash of the text, size and fingerprint of its n-gram set, a hash for each band."""
    if not bands:
        bands, rows = banding()
    odd = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            grams, first = _sets(batch.column("text"), n)
            some = np.flatnonzero(np.diff(first))
            size, prints = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), np.uint64)
            one, two = mix(grams), mix(grams ^ np.uint64(0xD1B54A32D192ED03))
            for d in some:
                own = slice(first[d], first[d + 1])
                order = np.argsort(grams[own])
                sorted_ = grams[own][order]
                new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
                size[d] = new.sum()
                prints[0, d], prints[1, d] = one[own][order][new].sum(), two[own][order][new].sum()
            banded = np.zeros((batch.num_rows, bands), np.uint64)
            if len(some):
                at = first[some]
                for b in range(bands):
                    h = np.full(len(some), b, np.uint64)
                    for r in range(rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(grams * odd[b * rows + r], at))
                    banded[some, b] = h
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands, pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.array(banded.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(size), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), listed],
                ["doc_id", "t", "n", "f1", "f2", "bands"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, t long, n long, f1 long, f2 long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text): t tells the texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def ngram_sets(docs: DataFrame, n: int = WORDS, text: str = "text", into: str = "grams") -> DataFrame:
    """docs with the sorted set of n-gram hashes of each text in place of the text."""
    kept = [f for f in docs.schema if f.name not in (text, into)]
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            grams, first = _sets(batch.column(text), n)
            own = [np.unique(grams[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            ends = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own)))], schema.names)

    return docs.mapInArrow(run, schema)


def shared(values: np.ndarray, member: np.ndarray, m: int) -> np.ndarray:
    """How many values each two of m members have in common; every member has a value once at most."""
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    common = np.bincount(group)[group] > 1 if len(values) else new
    group, member = group[common], member[common]
    _, group = np.unique(group, return_inverse=True)
    out = np.zeros((m, m), np.float32)
    width = max(1, (4 << 20) // max(m, 1))
    for at in range(0, int(group.max()) + 1 if len(group) else 0, width):
        a, b = np.searchsorted(group, [at, at + width])
        part = np.zeros((m, min(width, int(group[b - 1]) - at + 1)), np.float32)
        part[member[a:b], group[a:b] - at] = 1
        out += part @ part.T
    return out


def smallest_reached(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member (by place) that each of m members reaches over the links i-j."""
    root = np.arange(m)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (before == root).all():
            break
    return root


def verified(block: pa.Table, threshold: float) -> pa.Table:
    """The members of one block that have a link: n_links counts documents, reach is the smallest member in reach."""
    block = block.sort_by([("doc_id", "ascending"), ("t", "ascending")]).combine_chunks()
    rep, kind = np.asarray(block["doc_id"]), np.asarray(block["t"])
    again = np.concatenate([[False], (rep[1:] == rep[:-1]) & (kind[1:] == kind[:-1])])
    if again.any():  # repeated rows
        block = block.filter(pa.array(~again)).combine_chunks()
        rep, kind = rep[~again], kind[~again]
    weight = np.asarray(block["copies"])
    chunk, m = np.asarray(block["chunk"]), len(rep)
    band, (low, high) = block["band"][0].as_py(), (block["low"][0].as_py(), block["high"][0].as_py())
    sets, prints = block["grams"].combine_chunks(), np.asarray(block["bands"].combine_chunks().flatten()).reshape(m, -1)
    offsets = np.asarray(sets.offsets)
    size = np.diff(offsets)
    both = shared(np.asarray(sets.flatten()), np.repeat(np.arange(m), size), m)
    links, found = np.zeros(m, np.int64), []
    for at in range(0, m, 64):  # a few rows of the pair matrix at a time
        common = both[at : at + 64].astype(np.int64)
        i, j = np.nonzero(common >= threshold * (size[at : at + 64, None] + size[None, :] - common) - 1e-9)
        common, i = common[i, j], i + at
        good = (i < j) & (rep[i] != rep[j]) & (common > 0)
        if low != high:
            good &= chunk[i] != chunk[j]
        i, j = i[good], j[good]
        first = np.argmax(prints[i] == prints[j], 1) == band
        i, j = i[first], j[first]
        links += np.bincount(i, weight[j], m).astype(np.int64) + np.bincount(j, weight[i], m).astype(np.int64)
        found.append(np.stack([i, j]).astype(np.int32))
    i, j = np.concatenate(found, 1)
    some = np.flatnonzero(links)
    reach = rep[smallest_reached(m, i, j)]
    return pa.table({"doc_id": rep[some], "t": kind[some], "n_links": links[some], "reach": reach[some]})


def join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, copy_of, class_id, n_links.

    copy_of: the smallest doc_id with the same n-gram set. n_links: other rows whose set has a Jaccard similarity of at
    least the threshold with this one's, copies included. class_id: the smallest doc_id that links reach, itself
    included; a row without links has its own id.
    """
    bands, rows = banding(threshold, recall)
    signed = written(signatures(docs, n, bands, rows), "signatures")
    some = signed.where("n > 0 and doc_id is not null")
    classes = some.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "t")).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes.select("f1", "f2", "n", F.col("least.doc_id").alias("rep"), "least.t", "copies", "bands"), "classes")
    spread = written(classes.select("rep", "t", F.posexplode("bands").alias("band", "h")), "bands")
    buckets = spread.groupBy("band", "h").agg(
        F.count("*").alias("members"), F.sum(F.xxhash64("rep", "t").cast("decimal(20,0)")).cast("string").alias("s1"), F.bit_xor(F.xxhash64("rep", "t", F.lit(3))).alias("s2")
    )
    once = buckets.where("members > 1").groupBy("members", "s1", "s2").agg(F.min(F.struct("band", "h")).alias("first"))
    once = once.select("members", "first.band", "first.h")
    parts = F.ceil(F.col("members") / chunk).cast("int")
    members = spread.join(once, ["band", "h"]).withColumn("parts", parts).withColumn("chunk", F.pmod(F.xxhash64("rep", "t", F.lit(9)), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = written(members.select("rep", "t", "band", "h", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")), "members")
    # What a text needs for its blocks goes to the text before its set is made, so that sets are shuffled once, to blocks.
    wanted = members.groupBy("rep", "t").agg(F.collect_list(F.struct("band", "h", "chunk", "low", "high")).alias("blocks"))
    wanted = wanted.join(classes.select("rep", "t", "copies", "bands"), ["rep", "t"]).withColumnRenamed("rep", "doc_id")
    texts = _keyed(docs).join(wanted.hint("merge"), ["doc_id", "t"])
    blocks = ngram_sets(texts, n).withColumn("b", F.explode("blocks")).select("doc_id", "t", "copies", "bands", "grams", "b.*")

    def check(block: pa.Table) -> pa.Table:
        return verified(block, threshold)

    links = written(blocks.groupBy("band", "h", "low", "high").applyInArrow(check, "doc_id long, t long, n_links long, reach long"), "links")
    several = some.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n")).alias("a"), F.max(F.struct("f1", "f2", "n")).alias("b")).where("a <> b").select("doc_id")
    united = some.join(several, "doc_id").join(classes, ["f1", "f2", "n"]).select("doc_id", F.col("rep").alias("reach"))
    reached = components(links.select("doc_id", "reach").union(united), "doc_id", "reach")
    per = links.groupBy(F.col("doc_id").alias("rep"), "t").agg(F.sum("n_links").alias("links"))
    known = classes.select("f1", "f2", "n", "rep", "t", "copies").join(per, ["rep", "t"], "left").join(reached, F.col("rep") == reached["id"], "left")
    known = known.select("f1", "f2", "n", "rep", "copies", "links", "component")
    linked = some.select("doc_id", "f1", "f2", "n").join(known, ["f1", "f2", "n"]).select(
        "doc_id", F.col("rep").alias("copy_of"), F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")
    )
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.union(alone)
