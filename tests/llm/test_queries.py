"""The digest columns of queries, by the contracts' words."""

import base64
import hashlib

import pytest

from tests.llm import cases
from tests.llm.test_ngram_jaccard import brute as jaccard_brute
from tests.llm.test_substring_dedup import brute as substring_brute

P = pytest.importorskip("public_tokenizers")

from catchwater.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    cases.frame(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    return path


ROWS = [r for r in cases.rows() if r[0] is not None and r[0] != 18]


def hexed(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def test_op2(spark, sf):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in ROWS:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hexed(",".join(map(str, ids)).encode()), hexed((t or "").encode())))
    out = queries.op2_byte_bpe(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted(want)


def test_op6(spark, sf):
    want = [(i, n, gone, hexed(kept.encode())) for i, n, gone, kept in substring_brute([r[:2] for r in ROWS], 13)]
    out = queries.op6_substring_dedup(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == sorted(want)


def test_op10(spark, sf):
    out = queries.op10_ngram_jaccard_join(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in out) == jaccard_brute([r[:2] for r in ROWS])


def test_a_dictionary_changes_no_result(spark):
    """Enough text for the compressor's dictionary, against the table of all windows."""
    from catchwater.llm import substring_dedup

    shared = [cases.text(1000 + k, 40) for k in range(30)]
    rows = [(k, cases.text(k, 150) + " " + shared[k % 30] + " " + cases.text(k + 5000, 30)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.selectExpr("doc_id as d", "xxhash64(text) as t", "text")
    assert len(substring_dedup.dictionary(keyed, 1)) > 1000
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(docs, bucket_bytes=1 << 14).collect())
    assert got == substring_brute(rows, 13) and any(n for _, _, n, _ in got)
