import zlib

import numpy as np
import pytest

from tests.llm import cases

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from catchwater.llm import token_files  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.zipf(1.4, n) % 50_257, np.zeros(n, int), np.arange(n) % 7):
        block = token_files.compress(np.asarray(ids, np.int64), 50_257)
        assert (token_files.decompress(block) == ids).all()
        assert block == token_files.compress(np.asarray(ids, np.int64), 50_257)


def test_repetition_is_predicted():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 40), 500)
    assert len(token_files.compress(ids, 50_257)) < len(ids) * 0.7


def test_damage_is_found():
    block = token_files.compress(np.arange(3000) % 91, 50_257)
    for at in (2, 17, len(block) // 2):
        broken = bytearray(block)
        broken[at] ^= 0x40
        with pytest.raises(ValueError):
            token_files.decompress(bytes(broken))


def expected(spark, rows):
    """(start, doc_id, n_tokens, crc32) of each row by the library itself, as it encodes without further settings."""
    tokenizer, want, at = tokenizers.Tokenizer.from_file(PATH), [], 0
    marks = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t, *_ in rows], "text string").selectExpr("text", "xxhash64(coalesce(text, '')) h").collect()}
    for i, t, *_ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], marks[r[1]])):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((at, -1 if i is None else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return want, at


def test_files(spark, tmp_path):
    more = [(40 + k, t, *["clash"] * (len(cases.SCHEMA) - 2)) for k, t in enumerate(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", " <| endoftext |> "])]
    rows = cases.rows() + more
    docs, path = cases.frame(spark, rows), f"file://{tmp_path}/tokens"
    token_files.write(docs, path, PATH, block=3000)
    assert spark.read.parquet(path).selectExpr("max(n_ids)").first()[0] <= 3000
    got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digest(spark, path).collect())
    want, at = expected(spark, rows)
    assert got == want
    whole = token_files.read(spark, path).collect()
    assert sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in whole) == want
    assert next(tuple(r["ids"]) for r in whole if r["doc_id"] == 40) == (64, 220, 50256, 275, 0)
    token_files.write(docs.limit(0), path + "-none", PATH)
    assert token_files.digest(spark, path + "-none").count() == 0


def test_the_query(spark, tmp_path):
    from catchwater.llm import queries

    cases.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_token_files(spark, str(tmp_path)).collect()
    assert sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == expected(spark, cases.rows())[0]


def test_parts_are_cut_where_the_tokenizer_cuts():
    import random

    import pyarrow as pa

    r, library = random.Random(1), tokenizers.Tokenizer.from_file(PATH)
    texts = ["".join(r.choice("aabbc  \n\t.,'sé日1🎉\u00a0\u3000\x1c\x85") for _ in range(r.randrange(120))) for _ in range(1500)] + ["", " ", "a " * 5000, "a <|endoftext|> b"]
    for codec in (token_files.tokenizer(PATH), token_files.rank_tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)):
        for some in (texts[:-1], texts[700:760], texts[-4:-3]):
            ids, first = codec.encode(pa.array(some, pa.large_string()))
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    ids, _ = token_files.tokenizer(PATH).encode(pa.array(texts[-1:]))
    assert ids.tolist() == [64, 220, 50256, 275]


def test_the_library_gets_each_word_once_whatever_marks_follow(monkeypatch):
    import pyarrow as pa

    token_files.tokenizer.cache_clear()
    codec = token_files.tokenizer(PATH)
    fresh, new = codec.fresh, []
    monkeypatch.setattr(codec, "fresh", lambda some: new.extend(some) or fresh(some))
    text = " word" + " word, word. word! word; (word) word's word.\nword.\n\nword" * 3
    ids, _ = codec.encode(pa.array([text], pa.large_string()))
    token_files.tokenizer.cache_clear()
    assert ids.tolist() == tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert new.count(" word") == 1 and not {" word,", " word.", " word!", " word;"} & set(new)


def test_chances_are_mixed_a_few_times_for_many_ids(monkeypatch):
    calls, mix = [], token_files.Mixer.__call__
    monkeypatch.setattr(token_files.Mixer, "__call__", lambda self, inputs: calls.append(inputs.shape) or mix(self, inputs))
    ids = np.random.default_rng(1).zipf(1.3, 1 << 17) % 50_257
    block = token_files.compress(ids, 50_257)
    assert len(calls) < (1 << 17) // 2000
    assert (token_files.decompress(block) == ids).all() and len(block) < 2 * len(ids)
