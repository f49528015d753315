"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every whole text becomes a vector of statistics (statistics()); a random Fourier map approximates a Gaussian kernel over
the standardised vectors; ridge weights solve normal equations that partitions sum; pooled adjacent violators over score
bins turn the raw score into a share of good documents.

Labelled rows: rows with a null id, label or no text partner are ignored; of repeated ids the larger label counts; at
most `sample` rows are used (a bound, chosen by a hash of the id). Without labels of both kinds every text gets the share
of good labels (0.5 without labels). Null and empty texts have the statistics of the empty text and a score like any
other; a text of any length is described whole, and equal texts get equal scores. Rows pass unchanged, null texts too,
repeated or not; other columns stay, clashing ones (score, predicted) are replaced. An empty table gives no rows, and a
fit on one is the fit without labels. Raw scores that tie share a bin of the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchwater.llm.common import dropped, joined, mix, pieces, shingles, slices, span_hashes, words, written
from catchwater.llm.toxicity import sampled_labels

#: Labelled rows used at most, random features, kernel width in standard deviations times root of the dimension, ridge, bins.
SAMPLE, FEATURES, WIDTH, RIDGE, BINS = 20_000, 256, 1.0, 1e-3, 400

_CLASS = np.zeros(256, np.int64)  # 0 other
_CLASS[[0x20, *range(9, 14)]] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[[ord(c) for c in "|/\\_=+<>[]{}~^`@"]] = 6
_CLASS[[ord(c) for c in "!#$%&*"]] = 7
_CLASS[128:] = 8


def statistics(text: pa.Array) -> np.ndarray:
    """One row of statistics for each text; each is bounded or grows with the logarithm of the length."""
    data, firsts = joined(text)
    n = len(firsts) - 1
    doc = np.repeat(np.arange(n), np.diff(firsts))
    size = np.maximum(np.diff(firsts) - 1, 0)
    kinds = np.bincount(doc * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    share = kinds / np.maximum(size, 1)[:, None]
    shape = np.bincount(doc * 256 + data, minlength=256 * n).reshape(n, 256) / np.maximum(size + 1, 1)[:, None]
    entropy = -(shape * np.log(np.maximum(shape, 1e-12))).sum(1)
    starts, ends, first = words(data, firsts)
    count = np.diff(first)
    at = np.repeat(np.arange(n), count)
    some = np.maximum(count, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(at, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(at, length * length, n) / some - mean * mean, 0))
    hashes = span_hashes(data, starts, ends)

    def distinct(values: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The share of each text's values that are its first of their kind."""
        keyed = np.unique(mix(values + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64((1 << 20) - 1) | (own.astype(np.uint64) & np.uint64((1 << 20) - 1)))
        return np.bincount((keyed & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=n) / np.maximum(np.bincount(own, minlength=n), 1)

    run, run_first = shingles(hashes, first, 5)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
    marks = np.isin(data[ends - 1], np.frombuffer(b"!#$%&*|", np.uint8)) if len(ends) else np.zeros(0)
    lines = np.bincount(doc, data == 10, n)
    columns = [
        np.log1p(size), np.log1p(count), mean.clip(0, 40), spread.clip(0, 40), entropy, *share.T,
        distinct(hashes, at), distinct(run, np.repeat(np.arange(n), np.diff(run_first))),
        np.bincount(at, same, n) / some, np.bincount(at, marks, n) / some, np.log1p(some / lines.clip(1)),
        kinds[:, 3] / np.maximum(kinds[:, 2] + kinds[:, 3], 1), np.bincount(at, length <= 3, n) / some, np.bincount(at, length >= 14, n) / some,
    ]
    return np.stack(columns, 1)


def described(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """docs with the statistics of each whole text in place of the text."""
    docs = docs.drop(into) if into != text else docs
    kept = [f for f in docs.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            x = statistics(batch.column(text))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32())
            own = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [own], [f.name for f in kept] + [into])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.ArrayType(T.DoubleType()))]))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    mapped: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.mapped + self.phase)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values).clip(0, 1) if len(self.weights) else np.full(len(x), self.values[0])

    def score(self, docs: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
        """docs with score (0 to 1) and predicted (1 from the threshold on); `text` stays."""
        docs, model = docs.drop("score", "predicted"), self
        schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, text):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.calibrated(statistics(texts)))], schema.names)

        return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def pooled(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to the means by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean, strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, k2 = blocks.pop()
            w1, m1, k1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.concatenate([np.full(int(k), m) for _, m, k in blocks]) if blocks else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, features: int = FEATURES, seed: int = 11) -> Model:
    """The model of docs (doc_id, text) as `label` of labels (doc_id, label) marks them."""
    chosen = F.broadcast(sampled_labels(labels, label, sample))  # at most `sample` rows of 12 bytes
    rows = written(described(docs.select("doc_id", "text").join(chosen, "doc_id").select("y", "text")).repartition(12), "statistics")
    try:
        return _fit(rows, features, seed)
    finally:
        dropped(rows)


def _fit(rows: DataFrame, features: int, seed: int) -> Model:
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    none = np.zeros(0)
    if not pos or not neg:
        return Model(none, none, none, none, none, none, np.array([pos / (pos + neg) if pos + neg else 0.5]))
    d = len(statistics(pa.array([""]))[0])
    moments = rows.select([F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(d)] + [F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(d)]).first()
    mean, scale = np.array([moments[f"m{k}"] for k in range(d)]), np.array([max(moments[f"s{k}"], 1e-6) for k in range(d)])
    random = np.random.Generator(np.random.PCG64(seed))
    model = Model(mean, scale, random.normal(size=(d, features)) / (WIDTH * np.sqrt(d)), random.uniform(0, 2 * np.pi, features), none, none, none)
    m = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column("stats")))
                total[:, :m] += z.T @ z
                total[:, m] += z.T @ np.asarray(batch.column("y"), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    total = sum(np.frombuffer(r["part"]).reshape(m, m + 1) for r in rows.mapInArrow(sums, "part binary").collect())  # 12 parts of m * (m + 1) numbers
    model.weights = np.linalg.solve(total[:, :m] + RIDGE * (pos + neg) / features * np.eye(m), total[:, m])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.clip(np.floor((model.raw(_matrix(batch.column("stats"))) + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["bin", "y"])

    bins = rows.mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("good")).orderBy("bin").collect()
    model.knots = (np.array([r["bin"] for r in bins]) + 0.5) * 2 / BINS - 0.5
    model.values = pooled(np.array([float(r["n"]) for r in bins]), np.array([r["good"] for r in bins]))
    return model
