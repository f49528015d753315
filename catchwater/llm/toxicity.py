"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

fit() counts, on a sample of labelled texts, how many toxic and other documents hold each character n-gram (binary, per
document), keeps all whose shares differ clearly, scales each by its log-count ratio and fits a logistic regression over
the scaled features until its gradient is small. N-grams are told apart by 44 bits of a hash: among millions of them a
shared value is a rare chance. score() adds, for every whole text, the probability and a decision.

Labelled rows: rows with a null id, label or no text partner are ignored; of repeated ids the larger label counts. At
most `sample` labelled rows are used (a bound on what the fit holds; chosen by a hash of the id). With no labelled row of
one kind, every text gets the share of toxic labels (0 without labels). Null and empty texts have no n-gram and get the
model's intercept; a text of any length is read whole, and equal texts get equal scores. Rows pass unchanged, null texts
too, repeated or not; other columns stay, clashing ones (score, predicted) are replaced. An empty table gives no rows, and
a fit on one is the fit without labels. N-grams whose shares tie at the bound are all kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchwater.llm.common import dropped, mix, pieces, slices, written

#: Characters in an n-gram; bits of an n-gram's hash and of a document's place beside it; bits of the table of features.
SIZES, BITS, PLACE, TABLE = (4, 5, 6), 44, 20, 22
#: By how many standard errors a feature's shares must differ.
CLEAR = 3.5
#: Weight of the squared weights in the loss, and the length of the gradient at which the fit ends.
DECAY, GRADIENT = 1e-4, 1e-6
#: Bytes of text worked on at once and in a row of features; counted n-grams that a task holds; tasks of a gradient.
TEXT, ROW, HELD, PARTS = 1 << 19, 1 << 15, 1_000_000, 6
#: Labelled rows that the fit uses at most.
SAMPLE = 20_000


def sampled_labels(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, y) of at most `sample` labelled documents, taken by a hash of the id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = rows.count()
    if n > sample:  # six standard deviations under the bound, so that the limit, which only guards it, takes no part
        share = max(sample - 6 * sample**0.5, 0.0) / n
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample)
    return rows


class Features:
    """Sorted n-grams, with a table that turns most others away at once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.marks = keys, np.zeros(1 << TABLE, bool)
        self.marks[keys >> (BITS - TABLE)] = True

    def among(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where key has a feature, and that feature's place."""
        at = np.flatnonzero(self.marks[key >> np.uint64(BITS - TABLE)])
        own = key[at].astype(np.int64)
        place = np.searchsorted(self.keys, own)
        good = self.keys[np.minimum(place, len(self.keys) - 1)] == own if len(self.keys) else np.zeros(0, bool)
        return at[good], place[good]


def grams(text: pa.Array, features: Features | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, n-gram), each pair once, by n-gram, of the lower-case texts; with `features`, (document's place, feature's place)."""
    if len(text) > 1 << PLACE:
        raise ValueError("too many texts at once")
    padded = [f" {x.lower()} " for x in text.to_pylist()]
    chars = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).copy()
    chars[(chars >= 9) & (chars <= 13)] = 32
    doc = np.repeat(np.arange(len(padded), dtype=np.uint64), [len(x) for x in padded])
    value, found = mix(chars.astype(np.uint64)), []
    rolled = value.copy()
    for n in range(2, max(SIZES) + 1):
        if len(value) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 :]
        if n in SIZES:
            key = (rolled * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
            own, last = doc[: len(key)], doc[n - 1 :]
            if features is None:
                good = own == last
                found.append((key[good] << np.uint64(PLACE)) | own[good])
            else:
                at, place = features.among(key)
                good = own[at] == last[at]
                found.append((place[good].astype(np.uint64) << np.uint64(PLACE)) | own[at[good]])
    pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    pairs = pairs[np.diff(pairs, prepend=~pairs[:1]) != 0]
    return (pairs & np.uint64((1 << PLACE) - 1)).astype(np.int64), (pairs >> np.uint64(PLACE)).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, toxic documents, others), each n-gram once."""
    key, p, q = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    return key[first], np.add.reduceat(p[order], first) if len(key) else p, np.add.reduceat(q[order], first) if len(key) else q


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
        """docs with score (0 to 1) and predicted (1 from the threshold on); `text` stays."""
        docs = docs.drop("score", "predicted")
        keys, weights, intercept = self.keys, self.weights, self.intercept

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Features(keys)
            for batch, texts in slices(batches, text, TEXT):
                doc, place = grams(texts, features)
                z = intercept + np.bincount(doc, weights[place], batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, "score"])

        out = docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("score", T.DoubleType())]))
        return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, gradient: float = GRADIENT, memory: int = 20) -> np.ndarray:
    """Where loss (value and gradient) of a convex function is least: L-BFGS until the gradient is short.

    It also ends where rounding hides any further descent.
    """
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    while np.linalg.norm(g) > gradient:
        d, back = -g, []
        for s, y, r in reversed(past):
            back.append(r * (s @ d))
            d = d - back[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g))
        for (s, y, r), a in zip(past, reversed(back), strict=True):
            d = d + s * (a - r * (y @ d))
        step, down = 1.0, g @ d
        while True:
            new, h = loss(x + step * d)
            if new <= value + 1e-4 * step * down + 1e-15 * abs(value):
                break
            step /= 2
            if step < 1e-10:
                if not past:
                    return x
                past, step = [], 0.0  # once more, straight down the gradient
                break
        if step:
            s, y = step * d, h - g
            if s @ y > 0:
                past = [*past, (s, y, 1 / (s @ y))][-memory:]
            x, value, g = x + s, new, h
    return x


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text) as `label` of labels (doc_id, label) marks them."""
    chosen = F.broadcast(sampled_labels(labels, label, sample))  # at most `sample` rows of 12 bytes
    rows = written(docs.select("doc_id", "text").join(chosen, "doc_id").select("y", "text").repartition(12), "labelled")
    try:
        return _fit(rows)
    finally:
        dropped(rows)


def _fit(rows: DataFrame) -> Model:
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        share = min(max(pos / max(pos + neg, 1), 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [(np.zeros(0, np.int64),) * 3], 0

        def rows_of(key: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (key, p, q)], ["g", "p", "q"])

        for batch in pieces(batches, "text", TEXT):
            doc, key = grams(batch.column("text"))
            if not len(key):
                continue
            y = np.asarray(batch.column("y"), np.int64)[doc]
            first = np.flatnonzero(np.diff(key, prepend=-1) != 0)
            parts.append((key[first], np.add.reduceat((y == 1).astype(np.int64), first), np.add.reduceat((y == 0).astype(np.int64), first)))
            size += len(first)
            if size > HELD:
                parts = [_summed(parts)]
                size = len(parts[0][0])
                if size > HELD // 2:
                    yield from rows_of(*parts[0])
                    parts, size = [(np.zeros(0, np.int64),) * 3], 0
        yield from rows_of(*_summed(parts))

    counted = rows.mapInArrow(count, "g long, p long, q long").groupBy("g").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    share = (F.col("p") + F.col("q") + 1) / (pos + neg + 2)
    z = (F.col("p") / pos - F.col("q") / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    best = counted.where((F.abs(z) >= CLEAR) & (F.col("p") + F.col("q") >= 3)).toArrow()  # three numbers a feature
    if not best.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(pos / neg)))
    keys, p, q = (np.asarray(best[c], np.int64) for c in ("g", "p", "q"))
    order = np.argsort(keys)
    keys, p, q = keys[order], p[order], q[order]
    ratio = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(keys)
        for batch in pieces(batches, "text", ROW):
            doc, place = grams(batch.column("text"), features)
            parts = np.asarray(batch.column("y"), np.float64), doc.astype(np.int32), place.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["y", "doc", "place"])

    own = rows.mapInArrow(held, "y binary, doc binary, place binary").repartition(PARTS).persist()  # read in every round; what a lost executor held is made again
    try:
        at = minimum(lambda x: _loss(own, x, ratio, pos + neg), np.zeros(len(keys) + 1))
    finally:
        own.unpersist(True)
    return Model(keys, at[:-1] * ratio, float(at[-1]))


def _loss(own: DataFrame, x: np.ndarray, ratio: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Mean logistic loss with decay at weights and intercept x, and its gradient; partitions sum their rows."""
    weight, intercept = x[:-1] * ratio, x[-1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slope, lean = 0.0, np.zeros(len(weight)), 0.0
        for batch in batches:
            for k in range(batch.num_rows):
                y, doc, place = (np.frombuffer(c[k].as_buffer(), kind) for c, kind in zip(batch.columns, (np.float64, np.int32, np.int32), strict=True))
                z = intercept + np.bincount(doc, weight[place], len(y))
                g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
                total += float((np.logaddexp(0, z) - y * z).sum())
                slope += np.bincount(place, g[doc], len(weight))
                lean += float(g.sum())
        yield pa.RecordBatch.from_arrays([pa.array([np.array([total, lean, *slope]).tobytes()], pa.binary())], ["part"])

    total = sum(np.frombuffer(r["part"]) for r in own.mapInArrow(sums, "part binary").collect())  # PARTS parts of a number a feature
    w = x[:-1]
    return total[0] / n + DECAY / 2 * float(w @ w), np.append(total[2:] * ratio / n + DECAY * w, total[1] / n)
