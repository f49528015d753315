"""Helpers that the operators of this subpackage share: the shared folder, bounded batches, word and hash arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwater.plans.iterate import dropped, shared_dir, written  # noqa: F401

#: Bytes of text that a task works on at once; a longer text is a piece of its own.
PIECE = 2 << 20


def released() -> None:
    """Gives freed memory back to the system: a worker process lives on and would hold it through the stages to come."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_folders(df: DataFrame, name: str, *places: str) -> DataFrame:
    """df as a table in the shared folder with a folder for each value of the columns `places`, for opened()."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*places).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["shared_path"] = path
    return out


def qualified(table: DataFrame) -> str:
    """The place of a table that in_folders() made, as tasks name it; s3a is s3 to them."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.__dict__["shared_path"])
    uri = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    kind, rest = uri.split(":", 1)
    return f"{'s3' if kind == 's3a' else kind}:{rest if rest.startswith('//') else '//' + rest}"


def opened(place: str, folder: str) -> pa.Table:
    """The rows in one folder of a table, read by a task from the store that all share."""
    from pyarrow import fs, parquet

    store, path = fs.FileSystem.from_uri(place)
    return parquet.read_table(f"{path}/{folder}", filesystem=store, partitioning=None)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The rows of batches in record batches of about `size` bytes of text, each with its texts, null ones as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(text), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, upto - at), text.slice(at, upto - at)
            at = upto
    released()


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """slices() for those who need no null texts: record batches whose texts are filled."""
    for batch, text in slices(batches, column, size):
        yield batch.set_column(batch.schema.get_field_index(column), pa.field(column, pa.large_string()), text)


_FIRM = np.zeros(256, bool)
_FIRM[0x21:0x7F] = True
#: White space besides ASCII's, in UTF-8.
_WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


#: ASCII letters and ASCII marks that are no white space, letter or digit.
_LETTER, _MARK = np.zeros(256, bool), _FIRM.copy()
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def parts(text: pa.Array, whole: tuple[str, ...] = (), fine: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct parts, each part's place among them, each text's first part and one more).

    A text is cut before each single space between two characters that are no white space: there a pre-tokeniser of the
    form " ?word" always cuts. fine: also between a letter and a mark, both ASCII, and before each single newline between
    such characters, where the pre-tokeniser of GPT-2 always cuts. A text that holds a string of `whole` is one part.
    """
    text = pa.concat_arrays([text.cast(pa.large_string())])  # offsets from 0
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    raw = text.buffers()[2]
    base, stop = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw, np.uint8)[base:stop] if raw is not None else np.zeros(0, np.uint8)
    firm = _FIRM.copy()
    if len(text) and not pc.any(pc.match_substring_regex(text, _WIDE_SPACE)).as_py():
        firm[0x80:] = True
    space = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10) if fine else data[1:-1] == 32) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    cut = space[firm[data[space - 1]] & firm[data[space + 1]]]
    marks = np.flatnonzero(_MARK[data[1:]] & _LETTER[data[:-1]]) + 1 if fine and len(data) > 2 else cut[:0]
    begin = offsets[:-1] - base
    size = np.diff(offsets)
    edge = np.zeros(len(data) + 1, bool)
    edge[begin] = True
    cut = np.concatenate([cut[~edge[cut] & ~edge[cut + 1]], marks[~edge[marks]]])  # inside one text
    for token in whole:
        held = np.asarray(pc.match_substring(text, token))
        if held.any():
            cut = cut[~held[np.searchsorted(begin, cut, side="right") - 1]]
    at = np.concatenate([cut, begin[size > 0]])
    at = np.sort(at, kind="stable")  # sorted runs; a cut is never a text's first byte
    ends = np.concatenate([at, [stop - base]]).astype(np.int64)
    words_ = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.ascontiguousarray(ends + base)), raw]) if len(at) else pa.array([], pa.large_string())
    coded = words_.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices, np.int64), np.searchsorted(at, np.concatenate([begin, [stop - base]]))


def gathered_ids(own: list[bytes], place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, each text's first id and one more), from the ids of each distinct part."""
    size = np.fromiter(map(len, own), np.int64, len(own)) // 4
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(own), "<u4")))
    ids = np.asarray(listed.take(pa.array(place)).flatten()) if len(place) else np.zeros(0, np.uint32)
    ends = np.concatenate([[0], np.cumsum(size[place])])
    return ids, ends[first]


def joined(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array with a newline after each, and each text's first byte (one more at the end)."""
    n = np.asarray(pc.binary_length(text), dtype=np.int64)
    data = ("\n".join(text.to_pylist()) + "\n").encode() if len(text) else b""
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(n + 1)])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64 and of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the data; equal spans hash alike wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every run of non-space bytes, and the first word of each text (one more at the end)."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, firsts)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text, and each text's first run (one more at the end).

    A text of 1 to n - 1 words has one run, all its words.
    """
    total = len(hashes)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + padded[k : k + total]
    count = np.diff(first)
    keep = np.zeros(total + 1, np.int32)
    full, short = count >= n, (count > 0) & (count < n)
    np.add.at(keep, first[:-1][full], 1)
    np.add.at(keep, first[1:][full] - n + 1, -1)
    keep = np.cumsum(keep)[:-1] > 0
    for d in np.flatnonzero(short):
        a, b = first[d], first[d + 1]
        h = np.uint64(b - a)
        with np.errstate(over="ignore"):
            for x in hashes[a:b]:
                h = h * np.uint64(_BASE) + x
        out[a], keep[a] = h, True
    return mix(out[keep]), np.concatenate([[0], np.cumsum(np.where(full, count - n + 1, short))])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that links reach, for every id that has a link.

    Each round hooks every vertex to its smallest neighbour, follows those pointers to their end by doubling and
    contracts the edges, so vertices at least halve; rounds grow with the logarithm of a component's size. Every
    round is written to the shared folder, and the tables of the round before are deleted. Only counts come to the driver.
    """
    edges = written(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges"
    )
    label = None
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p"), F.lit(True).alias("moved"))
        parent = written(parent, "parent")
        while True:  # doubling: p <- p[p]
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            before, parent = parent, written(parent.select("id", "p").join(up, "p").select("id", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parent")
            dropped(before)
            if not parent.where("moved").limit(1).count():
                break
        old, hooked = label, parent.select("id", "p")
        if label is None:
            label = written(hooked.withColumnRenamed("p", "component"), "label")
        else:
            label = written(label.join(hooked.select(F.col("id").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "label")
        pa_, pb_ = parent.select(F.col("id").alias("a"), F.col("p").alias("ra")), parent.select(F.col("id").alias("b"), F.col("p").alias("rb"))
        before, edges = edges, written(edges.join(pa_, "a").join(pb_, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        dropped(before, parent, old)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0) if label is None else label
