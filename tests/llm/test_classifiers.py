import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catchwater.llm import quality, toxicity
from tests.llm import cases


def corpus(seed: int = 0, n: int = 400):
    r, rows, labels = random.Random(seed), [], []
    for i in range(n):
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        words = [r.choice(cases.WORDS) for _ in range(r.randrange(20, 90))]
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), "grubl" + r.choice(["er", "ing", "o"]))
        if not good:
            words = [w + r.choice(["###", "|", "%%"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    model = toxicity.fit(docs, marks.where("doc_id % 5 <> 0"))
    truth = {i: t for i, _, t in labels}
    out = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in model.score(docs).where("doc_id % 5 = 0").collect()]
    assert np.mean([t == p for t, _, p in out]) > 0.97 and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in out)


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus(1)
    docs, marks = frames(spark, rows, labels)
    model = quality.fit(docs, marks.where("doc_id % 5 <> 0"), features=64)
    truth = {i: q for i, q, _ in labels}
    out = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in model.score(docs).where("doc_id % 5 = 0").collect()]
    assert np.mean([t == p for t, _, p in out]) > 0.95 and all(0 <= s <= 1 and p == (s >= 0.3) for _, s, p in out)


def test_edges(spark):
    rows, labels = corpus(2, 150)
    docs, marks = frames(spark, rows, labels + [(None, 1, 1), (3, None, None), (3, 0, 0), (99_999, 1, 1)])
    odd = cases.frame(spark)
    for kind in (toxicity, quality):
        model = kind.fit(docs, marks)
        out = model.score(odd)
        assert out.columns.count("score") == out.columns.count("predicted") == 1 and "lang" in out.columns
        found = out.collect()
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(i), str(t)) for i, t, *_ in cases.rows())
        assert sum(r["text"] is None for r in found) == sum(t is None for _, t, *_ in cases.rows())
        assert all(0 <= r["score"] <= 1 for r in found)
        assert model.score(odd.limit(0)).count() == 0
        for few, share in ((marks.where("false"), {0.0, 0.5}), (marks.where("toxic = 1 and quality = 1"), {1.0})):
            scores = {round(r["score"], 6) for r in kind.fit(docs, few).score(docs.limit(3)).collect()}
            assert scores <= share
        kind.fit(docs.limit(0), marks).score(docs.limit(2)).collect()


def test_the_sample_is_a_bound(spark):
    marks = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    rows = toxicity.sampled_labels(marks, "toxic", 700)
    assert 500 < rows.count() <= 700
    assert rows.collect() and sorted(map(tuple, rows.collect())) == sorted(map(tuple, toxicity.sampled_labels(marks.repartition(7), "toxic", 700).collect()))


def test_pooling():
    assert quality.pooled(np.array([1.0, 1, 2, 1]), np.array([0.0, 1.0, 0.25, 2.0])).tolist() == [0, 0.5, 0.5, 0.5, 2][:1] + [0.5] * 2 + [2.0]
    assert quality.pooled(np.zeros(0), np.zeros(0)).tolist() == []


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array(["", " ", "a", "A" * 100_000, "é\n" * 50], pa.large_string()))
    assert np.isfinite(x).all() and len(x) == 5


def test_grams_come_once():
    doc, key = toxicity.grams(pa.array(["abcabcabc", "", "ABC abc"]))
    assert len(set(zip(doc.tolist(), key.tolist(), strict=True))) == len(doc) and 1 not in doc.tolist()


def test_toxicity_is_fitted_to_its_optimum(spark, monkeypatch):
    """The weights of the model leave a short gradient over the rows it was fitted on, and no feature is left out."""
    rows, labels = corpus(7)
    docs, marks = frames(spark, rows, labels)
    seen, true = [], toxicity.minimum

    def watched(loss, x, *more):
        at = true(loss, x, *more)
        seen.append((len(at) - 1, np.linalg.norm(loss(at)[1])))
        return at

    monkeypatch.setattr(toxicity, "minimum", watched)
    model = toxicity.fit(docs, marks)
    assert seen and seen[0][1] <= toxicity.GRADIENT

    grams, y = {}, {i: t for i, _, t in labels}
    for i, t in rows:
        for g in {f" {t.lower()} "[a : a + n] for n in toxicity.SIZES for a in range(len(t) + 3 - n)}:
            grams.setdefault(g, set()).add(i)
    pos, neg, clear = sum(y.values()), len(y) - sum(y.values()), 0
    for own in grams.values():
        p = sum(y[i] for i in own)
        q = len(own) - p
        s = (p + q + 1) / (pos + neg + 2)
        clear += p + q >= 3 and abs(p / pos - q / neg) / (s * (1 - s) * (1 / pos + 1 / neg)) ** 0.5 >= toxicity.CLEAR
    assert len(model.keys) == len(model.weights) == seen[0][0] == clear


def test_minimum_of_a_steep_valley():
    scale = np.logspace(0, 6, 30)
    at = toxicity.minimum(lambda x: (float(scale @ (x - 1) ** 2) / 2, scale * (x - 1)), np.zeros(30))
    assert np.allclose(at, 1, atol=1e-5)


def brute_toxicity(rows, y):
    """The same model with dictionaries and a dense Newton fit: (score of a text)."""
    own = {i: {f" {t.lower()} "[a : a + n] for n in toxicity.SIZES for a in range(len(t) + 3 - n)} for i, t in rows}
    pos = sum(y.values())
    neg = len(y) - pos
    count = {}
    for i, grams in own.items():
        for g in grams:
            p, q = count.get(g, (0, 0))
            count[g] = p + y[i], q + 1 - y[i]
    kept = []
    for g, (p, q) in count.items():
        s = (p + q + 1) / (pos + neg + 2)
        if p + q >= 3 and abs(p / pos - q / neg) / (s * (1 - s) * (1 / pos + 1 / neg)) ** 0.5 >= toxicity.CLEAR:
            kept.append(g)
    ratio = np.array([np.log((count[g][0] + 1) / (pos + 2)) - np.log((count[g][1] + 1) / (neg + 2)) for g in kept])
    row = lambda grams: np.array([*(r if g in grams else 0.0 for g, r in zip(kept, ratio, strict=True)), 1.0])
    x, t, w = np.array([row(own[i]) for i, _ in rows]), np.array([float(y[i]) for i, _ in rows]), np.zeros(len(kept) + 1)
    decay = np.append(np.full(len(kept), toxicity.DECAY), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(t) + np.diag(decay + 1e-12), x.T @ (p - t) / len(t) + decay * w)
    return lambda text: 1 / (1 + np.exp(-row({f" {text.lower()} "[a : a + n] for n in toxicity.SIZES for a in range(len(text) + 3 - n)}) @ w))


def test_toxicity_against_plain_counting(spark):
    rows, labels = corpus(11, 90)
    docs, marks = frames(spark, rows, labels)
    score = brute_toxicity(rows, {i: t for i, _, t in labels})
    for r in toxicity.fit(docs, marks).score(docs).collect():
        assert abs(r["score"] - score(r["text"])) < 2e-3


def test_quality_against_a_dense_fit(spark):
    """The whole model in numpy, without partitions: standardised statistics, features, ridge, bins, pooling."""
    rows, labels = corpus(12, 200)
    docs, marks = frames(spark, rows, labels)
    y = np.array([float(q) for _, q, _ in labels])
    x = quality.statistics(pa.array([t for _, t in rows]))
    mean, scale, d, features = x.mean(0), np.maximum(x.std(0), 1e-6), x.shape[1], 48
    random_ = np.random.Generator(np.random.PCG64(11))
    mapped, phase = random_.normal(size=(d, features)) / (quality.WIDTH * np.sqrt(d)), random_.uniform(0, 2 * np.pi, features)
    z = np.c_[np.sqrt(2 / features) * np.cos(np.clip((x - mean) / scale, -6, 6) @ mapped + phase), np.ones(len(x))]
    raw = z @ np.linalg.solve(z.T @ z + quality.RIDGE * len(y) / features * np.eye(features + 1), z.T @ y)
    bins = np.clip(np.floor((raw + 0.5) * quality.BINS / 2), 0, quality.BINS - 1).astype(int)
    used = np.unique(bins)
    good = [y[bins == b].mean() for b in used]
    weight = [(bins == b).sum() for b in used]
    level = [max(min(np.dot(weight[a : b + 1], good[a : b + 1]) / sum(weight[a : b + 1]) for b in range(k, len(used))) for a in range(k + 1)) for k in range(len(used))]  # the min-max form of isotonic regression
    want = np.interp(raw, (used + 0.5) * 2 / quality.BINS - 0.5, level).clip(0, 1)
    got = {r["doc_id"]: r["score"] for r in quality.fit(docs, marks, features=features).score(docs).collect()}
    assert np.allclose([got[i] for i, _ in rows], want, atol=1e-6)


def test_the_queries_learn_from_four_fifths(spark, tmp_path):
    import zlib

    from catchwater.llm import queries

    rows, labels = corpus(13, 250)
    docs, marks = frames(spark, rows + [(900, None), (901, "")], labels)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    seen = {r["doc_id"] for r in marks.where(~queries.held_out()).collect()}
    assert seen == {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5}
    for query, kind, label in ((queries.op8_quality_classifier, quality, "quality"), (queries.op9_toxicity, toxicity, "toxic")):
        got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in query(spark, str(tmp_path)).collect()}
        model = kind.fit(docs, marks.where(F.col("doc_id").isin(sorted(seen))), label)
        for r in model.score(docs).collect():
            held, score, predicted = got.pop(r["doc_id"])
            assert held == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and abs(score - r["score"]) < 1e-6 and predicted == r["predicted"]
        assert not got
