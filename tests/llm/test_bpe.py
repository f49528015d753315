import base64
import random

import pytest

from tests.llm import cases

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from catchwater.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_bytes_and_repeats(reference):
    r, codec = random.Random(0), bpe.Codec(PATH, P.PATTERN)
    texts = ["".join(r.choice("aabbc  \n\t.,'sé日1🎉 ") for _ in range(r.randrange(200))) for _ in range(400)] + ["a" * 9000, "ab" * 4000, "é" * 3000, " " * 500, "\0 a \0"]
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert [codec.decode(x.tolist()).decode() for x in ids] == texts


def test_rank_queue_gives_smallest_rank_first():
    r, queue, held = random.Random(1), bpe.RankQueue(50_000), {}
    for p in range(3000):
        rank = r.randrange(50_000)
        queue.push(rank, p)
        held.setdefault(rank, []).append(p)
    found = []
    while item := queue.pop():
        found.append(item)
    assert found == sorted(held.items())


def test_edges(spark, reference):
    docs = cases.frame(spark)
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert "text" not in out.columns and out.columns.count("ids") == out.columns.count("decoded") == 1
    got = sorted((r["doc_id"] or -1, tuple(r["ids"]), bytes(r["decoded"])) for r in out.collect())
    want = sorted((i or -1, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in cases.rows())
    assert got == want
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
    digest = {r["decoded_sha256"] for r in bpe.digest(docs, PATH, P.PATTERN).collect()}
    assert len(digest) == len({t or "" for _, t, *_ in cases.rows()})
