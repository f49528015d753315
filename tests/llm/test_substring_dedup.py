import random
import re

import numpy as np

from catchwater.llm import substring_dedup
from tests.llm import cases


def brute(rows, window):
    """(doc_id, words, removed, kept) by a table of all windows."""
    big, least, split = 2**63 - 1, {}, []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        i = big if i is None else i
        split.append((i, w))
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def collected(df):
    return sorted((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


def test_edges(spark):
    docs = cases.frame(spark)
    out = substring_dedup.dedup(docs, bucket_bytes=1 << 16)
    assert set(out.columns) == set(docs.columns)
    assert collected(out) == brute([r[:2] for r in cases.rows()], 13)
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_small_alphabets_and_packs(spark):
    """Few words, so that windows repeat in and across documents, over many packs and buckets."""
    r = random.Random(4)
    for window, mer in ((13, 2), (5, 3), (4, 1)):
        rows = [(r.randrange(60), " ".join(r.choice("ab cd éé f".split()) for _ in range(r.randrange(40)))) for _ in range(80)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        out = substring_dedup.dedup(df, window, mer, pack=300, bucket_bytes=100)
        assert collected(out) == brute(rows, window)


def test_hash_collisions_do_not_join_spans(monkeypatch):
    monkeypatch.setattr(substring_dedup, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    data = np.frombuffer(b"aa bb aa cc bb aa", np.uint8)
    starts = np.array([0, 3, 6, 9, 12, 15])
    head = substring_dedup.groups(data, starts, starts + 2, np.array([5, 4, 3, 2, 1, 0]))
    assert head.tolist() == [5, 4, 5, 3, 4, 5]
