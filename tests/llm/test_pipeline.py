import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from catchwater.llm.common import components, written  # noqa: E402
from tests.llm import cases  # noqa: E402
from tests.llm.test_classifiers import corpus  # noqa: E402
from tests.llm.test_ngram_jaccard import brute as jaccard_brute  # noqa: E402
from tests.llm.test_substring_dedup import brute as substring_brute  # noqa: E402


#: Extra columns with the names that operators use.
CLASH = ("score", "predicted", "kept", "n_words", "n_removed", "grams", "bands", "bin", "piece", "item", "t", "d", "ranges", "class_id")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus(5, 300)
    passage = cases.text(77, 30)
    rows = [(i, t + (" " + passage if i % 40 == 7 else "")) for i, t in rows] + [(1000, rows[11][1]), (1001, rows[12][1] + " more"), (13, rows[13][1]), (1002, None), (1003, "")]
    rows += [(1004, cases.text(91, 12_000) + " " + passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASH) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, sf), "stage")
        before, after = docs.collect(), out.collect()
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and all(r[c] == c for r in after for c in CLASH)
            assert {r["doc_id"]: r["text"] for r in after if r["text"] is None or r["text"] == ""} == {r["doc_id"]: r["text"] for r in before if (r["text"] is None or r["text"] == "") and r["doc_id"] in {x["doc_id"] for x in after}}
        if name in ("toxicity", "quality classifier"):
            assert 0 < len(after) < len(before) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if name == "n-gram Jaccard join":
            one = {(r["doc_id"], r["text"]) for r in before}
            want = {i for i, _, c in jaccard_brute(sorted(one, key=str)) if i == c}
            assert sorted(r["doc_id"] for r in after) == sorted(want)
        if name == "substring dedup":
            want = {i: (n, kept) for i, _, n, kept in substring_brute([(r["doc_id"], r["text"]) for r in before], 13)}
            texts = {r["doc_id"]: r["text"] for r in before}
            assert any(n for n, _ in want.values())
            for r in after:
                n, kept = want[r["doc_id"]]
                assert r["text"] == (kept if n else texts[r["doc_id"]]) and (r["text"] is None or r["n_chars"] == len(r["text"]))
        seen[name], docs = len(after), out
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert pipeline.run(spark, sf).count() == seen[pipeline.STAGES[-1][0]]


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_components_of_chains_and_stars(spark):
    import random

    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(80)] + [(7, 7), (None, 3)]
    parent = {v: v for e in edges for v in e if None not in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if v in got} and {v for v in parent if v != 7} == set(got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names
