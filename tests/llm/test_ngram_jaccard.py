import random
import re

from catchwater.llm import ngram_jaccard
from tests.llm import cases


def brute(rows, n=5, threshold=0.8):
    """(doc_id, links, component) of documents with ids of their own, by all pairs of n-gram sets."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    parent, links = {i: i for i, _ in rows}, [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y or len(x & y) < threshold * len(x | y):
                continue
            links[a] += 1
            links[b] += 1
            lo, hi = sorted((find(i), find(j)))
            parent[hi] = lo
    return sorted((i, links[k], find(i)) for k, (i, _) in enumerate(sets) if i is not None)


def collected(df):
    return sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in df.collect() if r["doc_id"] is not None)


def test_banding_reaches_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9)):
        bands, rows = ngram_jaccard.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall > 1 - (1 - threshold**rows) ** (bands - 1)


def test_edges(spark):
    rows = [r for r in cases.rows() if r[0] != 18]  # one id with two texts: its links unite
    out = ngram_jaccard.join(cases.frame(spark, rows))
    assert collected(out) == brute([r[:2] for r in rows])
    assert all(r["class_id"] is None and r["n_links"] == 0 for r in out.collect() if r["doc_id"] is None)
    assert out.count() == len(rows)
    assert ngram_jaccard.join(cases.frame(spark, [])).count() == 0
    united = {r["class_id"] for r in ngram_jaccard.join(cases.frame(spark)).collect() if r["doc_id"] == 18}
    assert united == {3}


def test_a_large_group_over_several_blocks(spark):
    """Near copies of one text, some linked and some not, in chunks far smaller than the group."""
    r, base = random.Random(9), cases.text(1, 300).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = r.choice(["x", "y", "z"])
        rows.append((i * 3 + 1, " ".join(w)))
    rows += [(1000 + k, rows[k][1]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = collected(ngram_jaccard.join(df, chunk=16)), brute(rows)
    assert [g[::2] for g in got] == [w[::2] for w in want]
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
