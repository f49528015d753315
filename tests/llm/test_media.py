import hashlib

import numpy as np
import pytest

from catchwater.llm import media, webp
from tests.llm import cases


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (6, 4), (19, 40), (131, 130)])
def test_every_transform_round_trips(shape):
    rng = np.random.default_rng(sum(shape))
    grey = (rng.integers(97, 110, shape).astype(np.uint32) << 8) | np.uint32(0xFF000000)
    wild = rng.integers(0, 2**32, shape, dtype=np.uint32)
    rows = np.tile(grey[:1], (shape[0], 1))
    for pixels in (grey, wild, rows, np.zeros(shape, np.uint32)):
        for how in ({}, {"copies": True}, {"cache_bits": 4}, {"copies": True, "cache_bits": 11}, {"green": True}, {"cross": 0xFF10F020}, {"green": True, "cross": 0x00FE2010, "predictor": 13, "copies": True, "cache_bits": 3}):
            assert (webp.decode(webp.encode(pixels, **how)) == pixels).all()
    for mode in range(14):
        assert (webp.decode(webp.encode(wild[:40, :40], predictor=mode)) == wild[:40, :40]).all()
    for n in (1, 2, 3, 4, 5, 16, 17, 200):
        few = rng.integers(0, 2**32, n, dtype=np.uint32)[rng.integers(0, n, shape)]
        assert (webp.decode(webp.encode(few, palette=True)) == few).all()
    many = [webp.encode(x, **how) for x in (grey, wild, rows, few) for how in ({}, {"predictor": -1, "copies": True}, {"cache_bits": 7, "copies": True, "cross": 0xFF10F020}, {"predictor": 11, "green": True, "cache_bits": 2})]
    assert all((a == b).all() for a, b in zip(webp.decode_many(many), [x for x in (grey, wild, rows, few) for _ in range(4)], strict=True))


def test_a_picture_written_by_hand():
    """One red pixel: five simple codes of one symbol each, bit by bit from the format's text."""
    out = webp.Writer()
    for value, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        out.put(value, n)
    for symbol in (0, 255, 0, 255, 0):  # green, red, blue, alpha, distance
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.put(value, n)
    body = out.bytes()
    body += b"\0" * (len(body) & 1)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(data).tolist() == [[0xFFFF0000]]


def slow_predictor(c, modes, block):
    """Channels from differences, a pixel at a time, as the format's text says it."""
    out = c.astype(int).copy()
    for y in range(c.shape[0]):
        for x in range(c.shape[1]):
            if not y:
                guess = out[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif not x:
                guess = out[y - 1, 0]
            else:
                right = out[y - 1, x + 1] if x + 1 < c.shape[1] else out[y, 0]
                guess = webp._predicted(int(modes[y >> block, x >> block]), *(v[None] for v in (out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right)))[0]
            out[y, x] = (c[y, x] + guess) & 255
    return out


def test_fronts_undo_the_predictor_as_single_pixels_do():
    rng = np.random.default_rng(9)
    images = [(rng.integers(0, 256, (h, w, 4)), rng.integers(0, 16, (9, 9)), 3) for h, w in ((1, 1), (1, 7), (9, 1), (20, 31), (33, 12))]
    for got, (c, m, b) in zip(webp._unpredicted(images), images, strict=True):
        assert (got == slow_predictor(c, m, b)).all()
    c, m, b = images[3]
    assert (webp._differences(slow_predictor(c, m, b), m, b) == c).all()


def test_lanes_read_as_single_pixels_do():
    rng = np.random.default_rng(3)
    pixels = np.repeat(rng.integers(0, 2**32, 40, dtype=np.uint32), 5)[rng.integers(0, 200, (30, 50))]
    for how in ({}, {"cache_bits": 5}, {"copies": True, "cache_bits": 3}, {"copies": True}):
        data = webp.encode(pixels, **how)
        bits, wide, height, _, transforms = webp._opened(data)
        head = webp._head(bits, wide, height, True)
        assert not transforms and (webp._pixel_by_pixel(bits, wide, height, *head) == webp.decode(data)).all()


def test_prefix_codes_are_complete_and_shortest():
    import heapq

    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 60, 280):
        counts = rng.integers(0, 50, n) + (np.arange(n) == 0) + (np.arange(n) == 1)
        lengths, heap = webp.code_lengths(counts), sorted(counts[counts > 0].tolist())
        total = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        assert (counts * lengths).sum() == total and sum(2.0 ** -lengths[lengths > 0]) == 1
    assert webp.code_lengths(2 ** np.arange(30), 11).max() <= 11


def test_damage_is_found():
    data = webp.encode(np.arange(400, dtype=np.uint32).reshape(20, 20))
    for broken in (b"", data[:20], b"RIFX" + data[4:], data[:12] + b"VP8 " + data[16:], data[: len(data) // 2]):
        with pytest.raises(webp.Damaged):
            webp.decode(broken)


def test_edges(spark):
    docs = cases.frame(spark)
    out = media.load(media.store(docs)).collect()
    got = sorted((r["doc_id"] or -1, r["n_bytes"], bytes(r["pixels"])) for r in out)
    want = sorted((i or -1, len((t or "").encode()), media.padded((t or "").encode())) for i, t, *_ in cases.rows())
    assert got == want
    digest = media.digest(media.store(docs)).collect()
    by = {}
    for r in digest:
        assert r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= max(576, r["n_bytes"])
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["tail_crc32"]))
    assert all(len(v) == 1 for v in by.values())
    assert {r["payload_sha256"] for r in digest} == {hashlib.sha256(p).hexdigest() for _, _, p in want}
    assert media.digest(media.store(docs.limit(0))).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_pictures_of_documents_need_every_transform():
    import collections

    import pyarrow.parquet as pq

    seen = collections.Counter()
    texts = [(t or "").encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += [b"=" * 3000, b"ab" * 900, b"line of text\n" * 400]
    media_ = [media.stored(media.padded(t)) for t in texts]
    for m, t, x in zip(media_, texts, media.loaded_many(media_), strict=True):
        assert x.tobytes() == media.padded(t)
        for f in media.files_of(m):
            seen.update(webp.transforms_of(f))
    assert min(seen[k] for k in ("predictor", "cross", "green", "cache")) > len(texts) / 10 and seen["palette"] > 0


def test_small_inner_images_are_written_once(monkeypatch):
    calls, write = [], webp._write_image
    monkeypatch.setattr(webp, "_write_image", lambda out, pixels, top, *more: calls.append(top) or write(out, pixels, top, *more))
    pixels = np.random.default_rng(2).integers(0, 2**32, (9, 192), dtype=np.uint32)
    for how in ({"cross": 0xFF0301FE}, {"predictor": 5}):
        first = webp.encode(pixels, **how)
        assert all(webp.encode(pixels, **how) == first for _ in range(4)) and (webp.decode(first) == pixels).all()
    assert calls.count(False) <= 2 and calls.count(True) == 10


def test_small_batches_are_read_together(monkeypatch):
    import pyarrow as pa

    calls, read = [], webp.decode_many
    monkeypatch.setattr(webp, "decode_many", lambda files: calls.append(len(files)) or read(files))
    payloads = [media.padded(bytes([k]) * (50 * k)) for k in range(12)]
    batches = [pa.record_batch({"media": pa.array([media.stored(p) for p in payloads[k : k + 3]], pa.binary())}) for k in (0, 3, 6, 9)]
    got = [x.tobytes() for _, own in media._together(iter([*batches, batches[0].slice(0, 0)])) for x in own]
    assert got == payloads and calls == [12]
    assert list(media._together(iter([]))) == []


def test_lengths_and_differences_are_those_of_the_plain_way():
    rng = np.random.default_rng(5)
    for n, share in ((19, 0.5), (280, 0.02), (280, 0.3), (792, 0.005), (792, 0.9), (600, 0.01)):
        lengths = np.where(rng.random(n) < share, rng.integers(1, 12, n), 0)
        lengths[rng.integers(n)] = 3
        symbols, extra, back = *webp._length_symbols(lengths.nonzero()[0], lengths), []
        for a, b in zip(symbols.tolist(), extra.tolist(), strict=True):
            back += [a] if a < 16 else [0] * (b + (3 if a == 17 else 11))
            assert not b or (a == 17 and b < 8) or (a == 18 and b < 128)
        assert back == lengths.tolist()
    for shape in ((1, 1), (1, 40), (40, 1), (16, 192), (70, 65)):
        c = rng.integers(0, 256, (*shape, 4)).astype(np.int16)
        modes, left = webp.best_modes(c, 5)
        assert (left == webp._differences(c, modes, 5)).all()


def test_the_query(spark, tmp_path):
    import zlib

    from catchwater.llm import queries

    cases.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_lossless_webp(spark, str(tmp_path)).collect()
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out)
    want = []
    for i, t, *_ in cases.rows():
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((i or -1, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert got == sorted(want) and all(r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"] for r in out)


def words(rng, shape):
    """Pixels of text-like bytes."""
    letters = np.frombuffer(b"etaoin shrdlu,cmfwyp.vbgk", np.uint8)
    return media.pixels_of(letters[np.minimum(rng.geometric(0.12, (shape[0], media.ROW)), 25) - 1])[:, : shape[1]]


def test_pictures_written_together_are_those_written_alone():
    rng = np.random.default_rng(6)
    for wide in (192, 33, 1):
        images = [words(rng, (int(h), wide)) for h in rng.integers(1, 17, 70)]
        images += [np.full((3, wide), 0xFF616161, np.uint32), words(rng, (1, wide)), images[0], np.tile(images[1][:1], (16, 1))]
        images += [rng.integers(0, 2**32, (16, wide), dtype=np.uint32) | np.uint32(0xFF000000), rng.integers(0, 2**32, (4, wide), dtype=np.uint32)]
        images += [np.where(rng.random((2, wide)) < 0.5, np.uint32(0xFF000000), np.uint32(0xFF0000FF)), np.full((32, wide), 0xFF000000, np.uint32)]
        for form in media.FORMS:
            assert webp.encode_many(images, **form) == [webp.encode(x, **form) for x in images]
    tall = [words(rng, (40, 50)), words(rng, (3, 50))]
    for form in ({}, {"predictor": 5}, {"copies": True}, {"predictor": -1}, {"cache_bits": 11}, {"cache_bits": 10, "cross": 0xFF10F020}):
        for some in (tall, tall[1:] * 3, [tall[1], tall[1][:, :9]], []):
            assert webp.encode_many(some, **form) == [webp.encode(x, **form) for x in some]


def test_prefix_codes_of_lanes_are_read_as_one_by_one():
    """Codes as other writers tell them: simple ones, repeated lengths, a limit of told lengths, codes cut off by it."""
    rng, told, alphabets = np.random.default_rng(11), [], []
    of = np.array([4] * 13 + [5] * 6)
    codes = webp.canonical(of)
    for turn in range(300):
        out, n = webp.Writer(), int(rng.choice([40, 256, 280, 536, 792]))
        if turn % 5 == 0:
            two, full = int(rng.integers(2)), int(rng.integers(2))
            for value, bits in ((1, 1), (two, 1), (full, 1), (int(rng.integers(40)) if full else 1, 8 if full else 1), (int(rng.integers(40)), 8 * two)):
                out.put(value & ((1 << bits) - 1), bits)
        else:
            counts = rng.integers(0, 100, n) * (rng.random(n) < rng.choice([0.05, 0.5, 1.0]))
            counts[rng.integers(n)] += 1
            lengths = np.full(256, 8) if turn % 7 == 1 and n == 256 else webp.code_lengths(counts)
            symbols, at = [], 0
            while at < n:
                run = 1
                while at + run < n and lengths[at + run] == lengths[at]:
                    run += 1
                value, before = int(lengths[at]), next((int(x) for x in lengths[:at][::-1] if x), 8)
                if value == 0 and run >= 3:
                    run = min(run, 138)
                    symbols.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
                elif value and value == before and run >= 3:
                    run = min(run, 6)
                    symbols.append((16, run - 3, 2))
                else:
                    run = 1
                    symbols.append((value, 0, 0))
                at += run
            short = turn % 3 == 0  # trailing zeros are left out
            while short and symbols[-1][0] in (0, 17, 18):
                symbols.pop()
            symbols += [(0, 0, 0)] * (len(symbols) == 1)
            out.put(0, 1)
            out.put(15, 4)
            for k in webp.CODE_LENGTH_ORDER:
                out.put(int(of[k]), 3)
            for value, bits in ((1, 1), (4, 3), (len(symbols) - 2, 10)) if short else ((0, 1),):
                out.put(value, bits)
            for s, extra, bits in symbols:
                out.put(int(codes[s]), int(of[s]))
                out.put(extra, bits)
        told.append(out.bytes())
        alphabets.append(n)
    raw, start = b"", []
    for x in told:
        start.append(len(raw) * 8)
        raw += x + b"\xa5" * (4 + len(x) % 3)
    bytes_ = np.frombuffer(raw + bytes(16), np.uint8).astype(np.int64)

    def look(p):
        return sum(bytes_[(p >> 3) + k] << 8 * k for k in range(6)) >> (p & 7)

    want, good, ends = [], [], []
    for k, x in enumerate(told):
        bits = webp.Bits(raw[start[k] // 8 :])
        try:
            want.append(webp._read_prefix(bits, alphabets[k]).table.tolist())
            good.append(k)
            ends.append(start[k] + bits.at)
        except webp.Damaged:
            with pytest.raises(webp.Damaged):
                webp._read_prefixes(look, np.array([start[k]]), np.array([alphabets[k]]))
    pos = np.array(start)[good]
    table, first, mask = webp._read_prefixes(look, pos, np.array(alphabets)[good])
    assert len(good) > 250 and pos.tolist() == ends
    assert [table[a : a + m + 1].tolist() for a, m in zip(first, mask, strict=True)] == want


def test_pictures_of_a_batch_share_their_work(monkeypatch):
    """Neither writing nor reading takes the codes of common pictures one at a time."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    payloads = [media.padded(words(rng, (int(h), 192)).view(np.uint8).reshape(-1, 4)[:, 2::-1].tobytes()) for h in rng.integers(2, 17, 200)]
    writes, reads, write, read = [], [], webp._write_image, webp._read_prefix
    monkeypatch.setattr(webp, "_write_image", lambda out, pixels, top, *more: writes.append(top) or write(out, pixels, top, *more))
    monkeypatch.setattr(webp, "_read_prefix", lambda bits, alphabet, *more: reads.append(alphabet) or read(bits, alphabet, *more))
    batch = pa.record_batch({"doc_id": pa.array(range(200)), "text": pa.array([p.decode() for p in payloads])})
    stored = [m for own, texts in media.slices([batch], "text") for m in media.stored_many([x.encode() for x in texts.to_pylist()])]
    assert writes.count(True) == 0
    reads.clear()
    assert [x.tobytes() for x in media.loaded_many(stored)] == payloads
    assert not [n for n in reads if n > 280]  # a picture's own codes with a cache; small inner images have none
