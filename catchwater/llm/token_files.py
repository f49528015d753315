"""Token files: ids of whole texts, in ascending document order, in blocks of an adaptive context-mixing range coder.

write() tokenises, orders by doc_id, and writes rows (file, block, n_ids, runs, data); read() gives the documents back with the
place of their first id. A block is independent: it starts from an empty model and carries the CRC-32 of its ids.

Coder. The ids of a block are dealt to lanes, each a run of the block with a range coder of its own; all lanes advance
together, one id a step, and share one model, which only knows earlier steps, so that numpy codes all lanes at once.
Order 2 (hash of the two ids before) and order 1 (the id before) each predict an id with a confidence; the chances that
the predictions hold, given their confidences and the order-0 frequency of the predicted id, are mixed in the logistic
domain by weights learned on the way, for all contexts at once every few steps. An arithmetic-coding step tells which
prediction held; if none did, a second step codes the id by order-0 frequencies. All model arithmetic is in integers, so any machine reads what another wrote.

A block holds BLOCK ids at most: a long document goes on in the next blocks of its file and is joined when read. Null and
empty texts: the end id alone. Null ids come first. Rows that share a doc_id come in the order of a hash of their texts.
A text that names a special token of the tokenizer gets that token's id, as the library has it. Extra columns are not
stored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchwater.llm.common import gathered_ids, parts, pieces, released, written

#: Ids in a block, lanes in a block at most, ids in a lane at least; bytes of text in a file.
BLOCK, LANES, LANE, FILE = 1 << 20, 4096, 256, 32 << 20
MAGIC = b"CWT2"
REMEMBERED, LONGEST = 300_000, 64
_U = np.uint64
_P = np.arange(4096)
#: Logit of a 12-bit chance in 8-bit fixed point, and its inverse over -2047 .. 2047.
STRETCH = np.round(np.log((_P + 0.5) / (4095.5 - _P)) * 256).astype(np.int64)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, 4095).astype(np.int64)


class Chance:
    """Adaptive 12-bit chances by context."""

    def __init__(self, contexts: int):
        self.hit, self.all = np.full(contexts, 2, np.int64), np.full(contexts, 4, np.int64)

    def __call__(self) -> np.ndarray:
        return STRETCH[self.hit * 4095 // self.all]

    def learn(self, hit: np.ndarray, n: np.ndarray) -> None:
        self.all += 4 * n
        self.hit += 4 * hit
        if self.all.max() > 1 << 18:
            big = self.all > 1 << 17
            self.all[big] >>= 1
            self.hit[big] >>= 1
        np.maximum(self.hit, 1, out=self.hit)


class Mixer:
    """A logistic mix of three chances."""

    def __init__(self):
        self.weight = np.full(3, 26_000, np.int64)

    def __call__(self, inputs: np.ndarray) -> np.ndarray:
        self.inputs = inputs
        self.chance = SQUASH[np.clip((self.weight @ inputs) >> 16, -2047, 2047) + 2047]
        return self.chance

    def learn(self, hit: np.ndarray, n: np.ndarray) -> None:
        self.weight += (self.inputs @ (hit * 4096 - n * self.chance)) * 6 // max(int(n.sum()), 1) >> 5


#: A context: how sure order 2 is and how frequent its id, the same of order 1, and whether they agree.
CONTEXTS = 1 << 11
SURE2, OFTEN2, SURE1, OFTEN1, AGREE = (np.arange(CONTEXTS) >> k & m for k, m in ((0, 7), (3, 3), (5, 7), (8, 3), (10, 1)))
#: The contexts of the chances that are mixed, for order 2 and for order 1.
INPUTS = (SURE2 + 8 * AGREE, SURE1 + 8 * AGREE, OFTEN2 + 4 * AGREE), (SURE1 + 8 * (SURE2 > 0), OFTEN1, SURE2)
#: What a prediction's sureness gains by a miss and by a hit.
GAIN = np.array([-((k + 1) >> 1) for k in range(8)] + [1] * 7 + [0], np.int32)


class Model:
    """The predictions of orders 0 to 2, shared by the lanes of a block.

    A prediction is one number: id, frequency class, sureness. What is coded depends on its context alone, so chances are
    mixed once for all contexts; they and the weights learn every EPOCH steps (more often at first), predictions each step.
    """

    BITS, EPOCH = 18, 16

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary, self.lanes = vocabulary, lanes
        self.one, self.two = np.zeros(vocabulary, np.int32), np.zeros(1 << self.BITS, np.int32)
        self.count, self.ids = np.zeros(vocabulary, np.int64), np.arange(vocabulary, dtype=np.int32) << 5
        self.bits = max(19, vocabulary.bit_length() + 2)
        self.p1, self.u1, self.u2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.chances = tuple(tuple(Chance(16) for _ in own) for own in INPUTS)
        self.mixers = Mixer(), Mixer()
        self.seen: list[np.ndarray] = []
        self.told: list[np.ndarray] = []
        self.steps = 0
        self._mixed()

    def _mixed(self) -> None:
        self.size = 1 + self.count * ((1 << self.bits) - self.vocabulary) // max(int(self.count.sum()), 1)
        self.size[self.count.argmax()] += (1 << self.bits) - int(self.size.sum())
        self.start, self._slots = np.cumsum(self.size) - self.size, None
        often = (self.count > 8).view(np.int8) + (self.count > 64).view(np.int8) + (self.count > 512).view(np.int8)
        self.fresh = self.ids | (often.astype(np.int32) << 3)
        chance2, chance1 = (mix(np.stack([c()[at] for c, at in zip(chances, own, strict=True)])) for mix, chances, own in zip(self.mixers, self.chances, INPUTS, strict=True))
        first = chance2 * 15 + 8
        second = first + np.where(AGREE > 0, 0, (65535 - first) * chance1 // 4200 + 1)
        #: Ends of the first and second share of 1 << 16 by context; start and size of the share by context and outcome.
        self.ends = (first << 32 | second).astype(_U)
        self.share = np.stack([first, first << 32 | second - first, second << 32 | 65536 - second, np.zeros_like(first)], 1).ravel().astype(_U)

    def slots(self) -> np.ndarray:
        """The id at each of the 1 << bits places of order 0."""
        if self._slots is None:
            self._slots = (self.ids >> 5).repeat(self.size)
        return self._slots

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids that orders 2 and 1 predict, and four times the context, for each lane."""
        self.h2 = ((self.u1 + self.u2) >> np.uint32(32 - self.BITS)).astype(np.int64)
        self.e2, self.e1 = self.two.take(self.h2), self.one.take(self.p1)
        self.c2, self.c1 = self.e2 >> 5, self.e1 >> 5
        at = (self.e1 & 31) << 5
        at |= self.e2 & 31
        at |= (self.c1 == self.c2) * np.int32(1 << 10)
        self.at = at.astype(np.int64)
        self.at <<= 2
        return self.c2, self.c1, self.at

    def learn(self, x: np.ndarray, told: np.ndarray) -> None:
        """x: the ids that came; told: four times the context and the outcome (order 2, order 1, neither)."""
        new, short = self.fresh.take(x), x.astype(np.int32)
        for table, at, e, c in ((self.two, self.h2, self.e2, self.c2), (self.one, self.p1, self.e1, self.c1)):
            key = e & 7
            key |= (short == c) * np.int32(8)
            e += GAIN.take(key)
            table[at] = np.where(key, e, new)
        self.u2 = self.u1 * np.uint32(0x9E3779B1)
        self.p1 = x
        self.u1 = x.astype(np.uint32) * np.uint32(0x2545F491)
        self.seen.append(x)
        self.told.append(told)
        self.steps += 1
        if not self.steps % self.EPOCH or self.steps in (1, 2, 4, 8):
            self._learned()
            self._mixed()

    def _learned(self) -> None:
        self.count += np.bincount(np.concatenate(self.seen), minlength=self.vocabulary)
        hit2, hit1, none, _ = np.bincount(np.concatenate(self.told), minlength=4 * CONTEXTS).reshape(CONTEXTS, 4).T
        self.seen, self.told = [], []
        missed = np.where(AGREE > 0, 0, hit1 + none)
        for mix, chances, own, hit, all_ in zip(self.mixers, self.chances, INPUTS, (hit2, hit1), (hit2 + hit1 + none, missed), strict=True):
            mix.learn(hit, all_)
            for chance, at in zip(chances, own, strict=True):
                chance.learn(*(np.bincount(at, w, 16).astype(np.int64) for w in (hit, all_)))  # sums are exact


_WORD, _LEAST, _LOW = _U(32), _U(1 << 31), _U((1 << 31) - 1)


class Encoder:
    """Range coders, one for each lane, with windows of 63 bits that put out 32-bit words; carries are added at the end."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 1 << 63, _U)
        self.lanes, self.words = [], []

    def put(self, share: np.ndarray) -> None:
        """start << 32 | size of each lane, of 1 << 16."""
        unit = self.range >> _U(16)
        self.low += (share >> _WORD) * unit
        self.range = (share & _U(0xFFFFFFFF)) * unit
        self._shift((self.range < _LEAST).nonzero()[0])

    def put_some(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        unit = self.range[lanes] >> _U(bits)
        self.low[lanes] += start.astype(_U) * unit
        unit *= size.astype(_U)
        self.range[lanes] = unit
        self._shift(lanes[unit < _LEAST])

    def _shift(self, lanes: np.ndarray) -> None:
        low = self.low[lanes]
        self.lanes.append(lanes)
        self.words.append(low >> _U(31))
        self.low[lanes] = (low & _LOW) << _WORD
        self.range[lanes] <<= _WORD

    def finish(self) -> tuple[np.ndarray, bytes]:
        every = np.arange(len(self.low))
        for _ in range(2):
            self._shift(every)
        lane = np.concatenate(self.lanes).astype(np.uint16)
        order = np.argsort(lane, kind="stable")
        words = np.concatenate(self.words)[order]
        while True:
            over = np.flatnonzero(words >> _WORD)
            if not len(over):
                break
            words[over] &= _U(0xFFFFFFFF)
            words[over - 1] += _U(1)
        return np.bincount(lane, minlength=len(every)), words.astype("<u4").tobytes()


class Decoder:
    def __init__(self, counts: np.ndarray, words: np.ndarray):
        words = np.concatenate([words, np.zeros(8, "<u4")]).astype(_U)
        self.words = (words[:-1] & _U(1)) << _U(31) | words[1:] >> _U(1)  # windows end one bit before a word does
        first = np.cumsum(counts) - counts
        self.code, self.range = words[first] << _U(31) | words[first + 1] >> _U(1), np.full(len(counts), 1 << 63, _U)
        self.at, self.most = first + 1, len(self.words) - 1

    def outcome(self, ends: np.ndarray) -> np.ndarray:
        """Which of three shares each lane's code falls into."""
        self.unit = self.range >> _U(16)
        return (self.code >= (ends >> _WORD) * self.unit).view(np.int8) + (self.code >= (ends & _U(0xFFFFFFFF)) * self.unit).view(np.int8)

    def take(self, share: np.ndarray) -> None:
        self.code -= (share >> _WORD) * self.unit
        self.range = (share & _U(0xFFFFFFFF)) * self.unit
        self._shift((self.range < _LEAST).nonzero()[0])

    def take_some(self, lanes: np.ndarray, model: Model) -> np.ndarray:
        """The ids that the lanes hold by order 0."""
        unit, code = self.range[lanes] >> _U(model.bits), self.code[lanes]
        x = model.slots().take((code // unit).astype(np.int64), mode="clip")
        self.code[lanes] = code - model.start[x].astype(_U) * unit
        unit *= model.size[x].astype(_U)
        self.range[lanes] = unit
        self._shift(lanes[unit < _LEAST])
        return x

    def _shift(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        self.code[lanes] = self.code[lanes] << _WORD | self.words.take(at, mode="clip")
        self.at[lanes] = at + 1
        self.range[lanes] <<= _WORD


def compress(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block: magic, ids, lanes, vocabulary and CRC-32, the words of each lane, the words."""
    n = len(ids)
    lanes = int(np.clip(n // LANE, 1, LANES))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, coder = Model(vocabulary, lanes), Encoder(lanes)
    for x in grid:
        c2, c1, told = model.predict()
        short = x.astype(np.int32)
        hit2, hit1 = short == c2, short == c1
        hit1 |= hit2
        told += 2 - hit1.view(np.int8) - hit2.view(np.int8)
        coder.put(model.share.take(told))
        rest = (~hit1).nonzero()[0]
        if len(rest):
            some = x[rest]
            coder.put_some(rest, model.start[some], model.size[some], model.bits)
        model.learn(x, told)
    counts, words = coder.finish()
    head = np.array([n, lanes, vocabulary, zlib.crc32(ids.astype("<u4").tobytes())], "<u4")
    return MAGIC + head.tobytes() + counts.astype("<u4").tobytes() + words


def decompress(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is not one or its checksum fails."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    try:
        return _decompressed(block)
    except IndexError as e:  # a damaged block may ask for words past its end
        raise ValueError("a token block is damaged") from e


def _decompressed(block: bytes) -> np.ndarray:
    n, lanes, vocabulary, crc = np.frombuffer(block, "<u4", 4, 4).tolist()
    counts = np.frombuffer(block, "<u4", lanes, 20).astype(np.int64)
    steps = -(-n // lanes)
    model, coder = Model(vocabulary, lanes), Decoder(counts, np.frombuffer(block, "<u4", -1, 20 + 4 * lanes))
    grid = np.zeros((steps, lanes), np.int64)
    for x in grid:
        c2, c1, told = model.predict()
        outcome = coder.outcome(model.ends.take(told >> 2))
        told += outcome
        coder.take(model.share.take(told))
        x[:] = np.where(outcome, c1, c2)
        rest = (outcome == 2).nonzero()[0]
        if len(rest):
            x[rest] = coder.take_some(rest, model)
        model.learn(x, told)
    ids = grid.T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a token block is damaged")
    return ids


class Cached:
    """A tokenizer, with the ids of the parts of texts that came before.

    encode: from texts to their ids. sizes: bytes that each id stands for. added: strings that the tokenizer takes out of
    a text before anything else; a text with one of them stays whole. fine: texts are cut as GPT-2's pre-tokeniser does.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], sizes: np.ndarray, added: tuple[str, ...] = (), fine: bool = False):
        self.many, self.sizes, self.added, self.fine, self.seen = encode, sizes, added, fine, {}
        self.vocabulary = len(sizes)

    def fresh(self, new: list[str]) -> list[bytes]:
        """Ids of parts not seen yet: words, spaced apart, go through the tokenizer side by side, since it cuts there anyway."""
        out: list[bytes] = [b""] * len(new)
        lead = " \n" if self.fine else " "
        word = [len(x) > 1 and x[0] in lead and not x[1].isspace() and not x[-1].isspace() for x in new]
        for token in self.added:
            word = [w and token not in x for w, x in zip(word, new, strict=True)]
        plain, odd = [k for k, w in enumerate(word) if w], [k for k, w in enumerate(word) if not w]
        for k, ids in zip(odd, self.many([new[k] for k in odd]), strict=True):
            out[k] = np.array(ids, "<u4").tobytes()
        groups = [plain[at : at + 200] for at in range(0, len(plain), 200)]
        ids = np.fromiter(chain.from_iterable(self.many(["".join([new[k] for k in own]) for own in groups])), "<u4")
        ends = np.cumsum(np.fromiter((len(new[k].encode()) for k in plain), np.int64, len(plain)))
        at = [0, *(4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()]
        packed = ids.tobytes()
        for k, lo, hi in zip(plain, at[:-1], at[1:], strict=True):
            out[k] = packed[lo:hi]
        return out

    def encoded(self, text: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(ids of each distinct part, each part's place among them, each text's first part and one more)."""
        distinct, place, first = parts(text, self.added, self.fine)
        if len(self.seen) > REMEMBERED:  # the earlier half has the commoner parts
            self.seen = dict(islice(self.seen.items(), REMEMBERED // 2))
        seen = self.seen
        own = list(map(seen.get, distinct))
        new = [k for k, x in enumerate(own) if x is None]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for k, ids in zip(some, self.fresh([distinct[k] for k in some]), strict=True):
                own[k] = ids
                if len(distinct[k]) <= LONGEST:
                    seen[distinct[k]] = ids
        return own, place, first

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each text's first id and one more)."""
        return gathered_ids(*self.encoded(text))

    def count(self, text: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        own, place, first = self.encoded(text)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        return np.diff(np.concatenate([[0], np.cumsum(size[place])])[first])


@lru_cache(2)
def tokenizer(path: str) -> Cached:
    """A byte-level tokenizer of the tokenizers library (a file .json)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    added = library.get_added_tokens_decoder()
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made["pre_tokenizer"] or {}
    fine = made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    sizes = np.zeros(max([*library.get_vocab().values(), -1]) + 1, np.int64)
    for token, k in library.get_vocab().items():
        sizes[k] = len(token)  # a character of a byte-level token stands for a byte
    return Cached(lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)], sizes, tuple(t.content for t in added.values()), fine)


@lru_cache(2)
def rank_tokenizer(path: str, pattern: str) -> Cached:
    """A tokenizer of the tiktoken library by a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        sizes[k] = len(token)
    return Cached(lambda texts: [library.encode_ordinary(x) for x in texts], sizes)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, block: int = BLOCK, file_bytes: int = FILE) -> None:
    """Writes the texts of docs (doc_id, text) as token files under path; every text ends with end_id.

    A block holds at most `block` ids; a document that does not fit into one goes on in the next.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(12, int(total // file_bytes))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cached, file, place = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        vocabulary = max(cached.vocabulary, end_id + 1)
        runs: list[dict] = []
        held: list[np.ndarray] = []
        size, doc, end = 0, 0, np.array([end_id], "<u4")

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([place]), pa.array([len(ids)]), pa.array([runs], kind), pa.array([compress(ids, vocabulary)], pa.binary())], ["file", "block", "n_ids", "runs", "data"])

        for batch in pieces(batches, "text"):
            ids, first = cached.encode(batch.column("text"))
            for name, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own, at = np.concatenate([ids[a:b], end]), 0
                while at < len(own):
                    part = own[at : at + block - size]
                    runs.append({"doc_id": name, "doc": doc, "at": at, "n": len(part), "last": at + len(part) == len(own)})
                    held.append(part)
                    at += len(part)
                    size += len(part)
                    if size == block:
                        yield row()
                        place, size, runs, held = place + 1, 0, [], []
                doc += 1
        if held:
            yield row()

    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("last", pa.bool_())]))
    schema = "file long, block long, n_ids long, runs array<struct<doc_id: long, doc: long, at: long, n: long, last: boolean>>, data binary"
    ordered.mapInArrow(run, schema).write.parquet(path)


def _runs(spark: SparkSession, path: str, columns: str, values: Callable[[list[np.ndarray], list[bool]], list[pa.Array]]) -> DataFrame:
    """(doc_id, file, doc, at, last, start, n, columns): the runs of documents in blocks; start counts the ids of all before.

    values gives the columns of a block's runs; it is told which are a whole document. The sum over files runs in one task
    over a row for each file of FILE bytes; that over blocks runs file by file.
    """
    blocks = spark.read.parquet(path)
    index = blocks.select("file", "block", "n_ids")
    files = index.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("file").orderBy("block")) - F.col("n_ids")
    offsets = index.withColumn("inside", inside).join(files, "file").select("file", "block", (F.col("before") + F.col("inside")).alias("base"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decompress(batch.column("data")[k].as_py())
                told = batch.column("runs")[k].values
                n = len(told)
                doc_id, doc, at, size, last = (told.field(x) for x in ("doc_id", "doc", "at", "n", "last"))
                ends = np.cumsum(np.asarray(size))
                starts = ends - np.asarray(size)
                own = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                alone = [b and not a for a, b in zip(at.to_pylist(), last.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("file")[k].as_py()] * n), pa.array([batch.column("block")[k].as_py()] * n), doc_id, doc, at, last, pa.array(starts), size, *values(own, alone)],
                    ["file", "block", "doc_id", "doc", "at", "last", "inside", "n", *names],
                )
        released()

    found = blocks.select("file", "block", "runs", "data").mapInArrow(run, f"file long, block long, doc_id long, doc long, at long, last boolean, inside long, n long, {columns}")
    found = written(found, "runs")  # blocks are decoded once
    return found.join(offsets, ["file", "block"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "block")


def _documents(runs: DataFrame, whole: Column, joined: Column, into: str) -> DataFrame:
    """(doc_id, start, n_tokens, into): whole over a document's only run, joined over `own`, the ids of several in order."""
    alone = F.col("last") & (F.col("at") == 0)
    once = runs.where(alone).select("doc_id", "start", F.col("n").alias("n_tokens"), whole.alias(into))
    more = runs.where(~alone).groupBy("file", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"]).alias("own")
    )
    return once.union(more.select("doc_id", "start", "n_tokens", joined.alias(into)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents (doc_id, start, n_tokens, ids) of token files; start counts the ids of all documents before."""
    runs = _runs(spark, path, "ids array<long>", lambda own, alone: [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))])
    return _documents(runs, F.col("ids"), F.flatten("own"), "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Documents (doc_id, start, n_tokens, ids_crc32) of token files, from their decoded ids."""

    def values(own: list[np.ndarray], alone: list[bool]) -> list[pa.Array]:
        crc = [zlib.crc32(x.tobytes()) if a else None for x, a in zip(own, alone, strict=True)]
        return [pa.array(crc, pa.int64()), pa.array([None if a else x.tobytes() for x, a in zip(own, alone, strict=True)], pa.binary())]

    runs = _runs(spark, path, "crc long, ids binary", values)
    return _documents(runs, F.col("crc"), F.crc32(F.aggregate("own", F.lit(b""), lambda got, x: F.concat(got, x))), "ids_crc32")
