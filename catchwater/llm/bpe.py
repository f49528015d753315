"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

encode() adds the ids of each whole text, decode() the bytes of each id list. Both run as Arrow batches on the
executors; nothing but the vocabulary is held. The queue keeps, for every merge rank, the positions of a linked list
whose pair has that rank; a two-level bitmap finds the smallest rank that has any by find-first-set, and an entry whose
pair has changed meanwhile is skipped when met. A piece of m bytes costs O(m) merges, however long it is.

Nulls, empty texts: no ids. Null ids: empty bytes. A text of any length, without a space too, is merged as a whole; of equal
ranks the leftmost pair goes first. Rows are kept as they are, repeated or not; other columns pass through, and a column
that has the output's name (ids, decoded) is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchwater.llm.common import pieces

#: Distinct pieces of text whose ids a task remembers, and the longest such piece.
REMEMBERED, LONGEST = 1_000_000, 64
#: White space beside a space: there a match may cross a space, so the text is split by the pattern alone.
_ODD_SPACE = regex.compile(r"\s | \s|^ | $").search


class RankQueue:
    """Positions by rank; pop() gives the positions of the smallest rank that has any."""

    def __init__(self, ranks: int):
        self.width = max(8, int(ranks**0.5) + 1)
        self.top, self.low, self.buckets = 0, [0] * (self.width + 1), {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            bucket.append(position)
        else:
            self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """Sets the bucket of a rank that has none."""
        self.buckets[rank] = positions
        hi, lo = divmod(rank, self.width)
        self.low[hi] |= 1 << lo
        self.top |= 1 << hi

    def pop(self) -> tuple[int, list[int]] | None:
        if not self.top:
            return None
        hi = (self.top & -self.top).bit_length() - 1
        word = self.low[hi]
        first = word & -word
        self.low[hi] = word ^ first
        if word == first:
            self.top ^= 1 << hi
        rank = hi * self.width + first.bit_length() - 1
        return rank, self.buckets.pop(rank)


class PairRanks(dict):
    """Rank of the token that two tokens make, -1 if none; looked up once for each pair."""

    def __init__(self, ranks: dict[bytes, int], tokens: list[bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, key: int) -> int:
        a, b = divmod(key, len(self.tokens))
        self[key] = rank = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank


class Codec:
    """A rank file, its pattern and the pieces seen so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.findall = regex.compile(pattern).findall
        self.pairs, self.seen = PairRanks(self.ranks, self.tokens), {}
        self.byte_ids = np.array([self.ranks[bytes((x,))] for x in range(256)])
        self.byte_pairs = np.array([[self.ranks.get(bytes((x, y)), -1) for y in range(256)] for x in range(256)], np.int32)

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part as 32-bit integers; all parts share one queue, and no link leads from one to the next."""
        if not parts:
            return []
        size, pairs, queue = len(self.tokens), self.pairs, RankQueue(len(self.tokens))
        raw = np.frombuffer(b"".join(parts), np.uint8)
        n, ends = len(raw), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        first = np.full(n, -1, np.int32)
        first[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        first[ends - 1] = -1
        link = np.arange(1, n + 1)
        link[ends - 1] = -1
        back = np.arange(-1, n - 1)
        back[ends[:-1]] = -1
        token, rank, after, before = self.byte_ids[raw].tolist(), first.tolist(), link.tolist(), back.tolist()
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        for r, positions in zip(first[order[np.concatenate([[0], cuts])]].tolist() if len(order) else [], np.split(order, cuts), strict=False):
            queue.fill(r, positions.tolist())
        while item := queue.pop():
            r, positions = item
            positions.sort()
            for k, p in enumerate(positions):
                if rank[p] != r:
                    continue  # stale
                q = after[p]
                after[p] = nxt = after[q]
                token[p], token[q], rank[q], rank[p], least = r, -1, -1, -1, r
                if nxt >= 0:
                    before[nxt] = p
                    if (new := pairs[r * size + token[nxt]]) >= 0:
                        rank[p] = new
                        queue.push(new, p)
                        least = min(least, new)
                left = before[p]
                if left >= 0:
                    rank[left] = new = pairs[token[left] * size + r]
                    if new >= 0:
                        queue.push(new, left)
                        least = min(least, new)
                if least < r:  # a smaller rank has come up: it goes first
                    if k + 1 < len(positions):
                        queue.fill(r, positions[k + 1 :])
                    break
        left = np.array(token, np.int32)
        cuts = np.concatenate([[0], np.cumsum(left >= 0)])[np.concatenate([[0], ends])].tolist()
        packed = left[left >= 0].tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def split(self, text: str) -> list[str]:
        """Parts of the text that no match of the pattern crosses: it is cut before each single space between words."""
        if "\0" in text or _ODD_SPACE(text):
            return self.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(text) for text in texts]
        seen = self.seen
        if len(seen) > REMEMBERED:  # the earlier half has the commoner pieces
            seen = self.seen = dict(islice(seen.items(), REMEMBERED // 2))
        chunks = set(chain.from_iterable(split)).difference(seen)
        inside = {chunk: self.findall(chunk) for chunk in chunks}
        fresh = {piece: piece.encode() for piece in set(chain.from_iterable(inside.values())).difference(seen)}
        ids = {piece: self.ranks[raw].to_bytes(4, "little") for piece, raw in fresh.items() if raw in self.ranks}
        parts = [piece for piece in fresh if piece not in ids]
        ids.update(zip(parts, self.merged([fresh[p] for p in parts]), strict=True))
        seen.update(ids)
        seen.update((chunk, b"".join(map(seen.__getitem__, own))) for chunk, own in inside.items() if len(own) != 1)
        out = [np.frombuffer(b"".join(map(seen.__getitem__, own)), "<i4") for own in split]
        for piece in [x for x in (*inside, *ids) if len(x) > LONGEST]:
            seen.pop(piece, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with `into`, the ids of each whole text; `text` itself is not returned. ranks: the path of a rank file.

    With `decoded`, the ids are decoded at once and that column holds their bytes: one pass of Python instead of two.
    """
    docs = docs.drop(*({into, decoded or into} - {text}))
    kept = [f for f in docs.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in pieces(batches, text):
            ids = c.encode(batch.column(text).to_pylist())
            more = [pa.array([c.decode(x.tolist()) for x in ids], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [_lists(ids), *more], schema.names)

    more = [T.StructField(decoded, T.BinaryType())] if decoded else []
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.IntegerType())), *more])
    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with `into`, the bytes that each id list stands for. An id outside the vocabulary is an error."""
    if ids != into:
        docs = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = pa.array([c.decode(x or []) for x in part.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], [*part.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(into, T.BinaryType())]))


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document: doc_id, number of ids, SHA-256 of the decimal ids joined by commas and of the decoded bytes."""
    out = encode(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
