import math
import random
import re

import duckdb
import numpy as np

from catchwater.llm import lexical_search, queries
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top=50):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for item, own in asked.items():
        found = []
        for i, t in held:
            score = 0
            for x in own:
                if tf := t.count(x):
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * n) // total)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if none else i, -s))
    return out


def got(df):
    return [tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()]


def sort(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(seed, n):
    r = random.Random(seed)
    words = ["Alpha", "alpha", "BETA2", "Ünder", "ünder", "日本", "x_y", "end.", "-", "İ", "the", "the", "the", "q" * 50]
    return [(k * 3 - 30, " ".join(r.choice(words + [f"w{r.randrange(60)}"]) for _ in range(r.randrange(40)))) for k in range(n)]


ITEMS = [(1, "alpha the the w3 w5, ÜNDER!"), (2, "w1 w2 w3 w4 BETA2 unknown"), (2, "w59"), (3, ""), (4, None), (None, "日本 x"), (5, "nothing-of-it"), (6, "the")]


def test_against_brute_force(spark):
    docs = corpus(1, 400) + [(None, "w3 alpha"), (None, None), (5, "w3 alpha"), (6, "w3 alpha"), (6, "w3 alpha")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, term string, shard long").repartition(3)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, block int")
    want = sort(brute(docs, ITEMS))
    assert sort(got(lexical_search.search(lexical_search.index(df), items))) == want
    index = lexical_search.index(df, shard_bytes=500)
    assert index.shards.count() > 10
    assert sort(got(lexical_search.search(index, items, block=1))) == want
    for few in (1, 7):
        assert sort(got(lexical_search.search(index, items, top=few))) == sort(brute(docs, ITEMS, few))
    assert lexical_search.search(index, items.limit(0)).count() == 0
    assert lexical_search.search(lexical_search.index(df.limit(0)), items).count() == 0
    index.dropped()


def test_many_cases(spark):
    items = [(1, "bami word zero"), (2, "naïve it s 1234")]
    docs = [r[:2] for r in cases.rows()]
    found = lexical_search.search(lexical_search.index(cases.frame(spark)), spark.createDataFrame(items, "item_id long, text string"))
    assert sort(got(found)) == sort(brute(docs, items))


def test_numbers_come_back():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 300, 1000), r.integers(0, 2**62, 50), [0, 127, 128, 2**14 - 1, 2**14]])
    data, at = lexical_search.packed(x)
    assert (lexical_search.unpacked(data) == x).all() and at[-1] == len(data)
    assert len(lexical_search.unpacked(lexical_search.packed(x[:0])[0])) == 0


def test_runs_of_any_length_give_the_same():
    r = np.random.default_rng(2)
    cursors = [(np.sort(r.choice(5000, n, replace=False)), r.integers(0, 4, n)) for n in (1, 40, 3000, 700, 0, 5000)]
    total = np.zeros(5000, np.int64)
    for d, g in cursors:
        total[d] += g
    want = sorted(((int(s), d) for d, s in enumerate(total) if s > 0), key=lambda x: (-x[0], x[1]))[:50]
    assert lexical_search.best(cursors) == lexical_search.best(cursors, run=7) == lexical_search.best(cursors, run=1) == want


def test_the_query_and_its_sql(spark, tmp_path):
    docs = spark.createDataFrame(corpus(7, 300), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sort(got(queries.op12_lexical_search(spark, str(tmp_path))))
    assert found == sort(brute(corpus(7, 300), ITEMS))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sort(db.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLE_SQL['op12_lexical_search']})").fetchall()) == found
