import random

import numpy as np
import pytest

from catchwater.llm import packing
from tests.llm import cases


def brute(lengths, sizes, overhead):
    """The same rule with plain lists: (bin of each item, size of each bin).

    The tightest open bin (of equal ones that which came to its room last), else a new one of the size of the least price.
    """
    bins, out = [], []  # [size, used, when it came to its room]
    for k, n in enumerate(lengths):
        fit = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= n]
        if fit:
            b = min(fit, key=lambda b: (bins[b][0] - bins[b][1], -bins[b][2]))
        else:
            price = lambda c: (c + overhead) / (n + min(c - n, sum(x for x in lengths[k + 1 :] if x <= c - n)))
            bins.append([min((c for c in sizes if c >= n), key=price), 0, 0])
            b = len(bins) - 1
        out.append(b)
        bins[b][1] += n
        bins[b][2] = k
    return out, [min(c for c in sizes if c >= used) for _, used, _ in bins]


def test_pack_against_plain_lists():
    r = random.Random(2)
    for _ in range(60):
        sizes = sorted(r.sample(range(10, 200), 3))
        lengths = sorted((r.randrange(1, sizes[-1] + 1) for _ in range(r.randrange(60))), reverse=True)
        bins, offsets, widths = packing.pack(lengths, sizes, 5)
        used = {}
        for b, o, n in sorted(zip(bins, offsets, lengths, strict=True)):
            assert o == used.get(b, 0)
            used[b] = o + n
        assert [min(c for c in sizes if c >= used[b]) for b in range(len(widths))] == widths
        assert (bins, widths) == brute(lengths, sizes, 5)


def unspaced():
    r = random.Random(4)
    return ["".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(30_000)), "日本語の文章" * 3000]


def packed(spark, rows):
    """The pieces, the bins with their ids, and each row's ids by the tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    items = packing.tokenised(cases.frame(spark, rows), path)
    placed = packing.best_fit(items)
    encoder = Tokenizer.from_file(path)
    ids = [(i, encoder.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows]
    return placed.collect(), packing.sequences(items, placed).collect(), ids, items


def test_bins_hold_the_ids_of_whole_texts(spark):
    """Every id of every text stands once in a bin, in runs of at most the longest size; each shard's bins are the brute force's."""
    rows = cases.rows() + [(100 + k, t, *["clash"] * (len(cases.SCHEMA) - 2)) for k, t in enumerate(unspaced())]
    out, bins, ids, items = packed(spark, rows)
    wanted = sorted((str(i), tuple(own[k : k + 4096])) for i, own in ids for k in range(0, len(own), 4096))
    found = []
    for b in bins:
        own = np.frombuffer(b["ids"], "<u4").tolist()
        assert len(own) <= b["bin_size"] == min(c for c in packing.SIZES if c >= len(own)) and b["starts"][0] == 0
        for i, lo, hi in zip(b["doc_ids"], b["starts"], [*b["starts"][1:], len(own)], strict=True):
            found.append((str(i), tuple(own[lo:hi])))
    assert sorted(found) == wanted
    for shard in {r["shard"] for r in out}:
        own = sorted((r for r in out if r["shard"] == shard), key=lambda r: (-r["n_tokens"], r["doc_id"] is None, r["doc_id"] or 0, r["item"], r["piece"]))
        want, widths = brute([r["n_tokens"] for r in own], packing.SIZES, packing.OVERHEAD)
        assert [r["bin"] for r in own] == want and all(r["bin_size"] == widths[r["bin"]] for r in own)
    none = items.limit(0)
    assert packing.best_fit(none).count() == 0 == packing.sequences(none, packing.best_fit(none)).count()


def test_the_query(spark, tmp_path):
    from catchwater.llm import queries

    rows = cases.rows()
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_best_fit_packing(spark, str(tmp_path)).collect()
    _, _, ids, _ = packed(spark, rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((str(i), min(4096, len(own) - k)) for i, own in ids for k in range(0, len(own), 4096))


def test_packed_pieces_hold_all_ids(spark):
    """Every id of every document once, in bins that don't overflow and whose size is the least that holds them."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, sizes = P.path("byte_bpe_50k.json"), (64, 256, 1024)
    plain = Tokenizer.from_file(path)
    docs = cases.frame(spark)
    for shard in (2000, packing.SHARD):
        rows = packing.packed(docs, path, sizes=sizes, shard=shard).collect()
        items, bins = {}, {}
        for r in rows:
            ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert len(ids) == r["n_tokens"] > 0
            items.setdefault((r["item"], r["doc_id"]), {})[r["piece"]] = ids
            bins.setdefault((r["shard"], r["bin"], r["bin_size"]), []).append((r["bin_offset"], r["n_tokens"]))
        got = sorted(((i is None, i or 0), sum((p[k] for k in range(len(p))), [])) for (_, i), p in items.items())
        assert got == sorted(((i is None, i or 0), [*plain.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in cases.rows())
        assert len({b[:2] for b in bins}) == len(bins)
        for (_, _, size), own in bins.items():
            ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
            assert [o for o, _ in sorted(own)] == ends[:-1] and size == min(c for c in sizes if c >= ends[-1])
        assert len({r["shard"] for r in rows}) >= (3 if shard == 2000 else 1)
    assert packing.packed(docs.limit(0), path).count() == 0
