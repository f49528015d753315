"""Media columns of lossless WebP: payloads are stored as pictures, read back and described.

A payload is padded with bytes 255 to whole rows of ROW samples (one row at least); three samples are the red, green and
blue channel of a pixel. Long payloads become several pictures of HIGH rows, one file after another. A picture of few
colours gets a palette where that is shorter, a very repetitive one back-references; the others take one of FORMS by a
checksum of their content, as pictures from different writers would, so that a column needs every part of the format:
predictor by block, cross-colour, subtract-green, colour cache. Equal payloads are always stored alike. Reading decodes
the prefix codes, copies, cache hits and transforms of a batch of pictures together and gives the samples back.

Null and empty texts are one row of padding. A text of any length is stored whole. Repeated rows are stored each for
itself. Other columns pass through; clashing ones (media, n_bytes, pixels, feature) are replaced. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from catchwater.llm import webp
from catchwater.llm.common import released, slices

#: Samples in a row, rows of a picture at most, deflated share under which copies are searched, stored bytes read together.
ROW, HIGH, REPETITIVE, TOGETHER = 576, 16, 0.12, 4 << 20
#: Forms of pictures, as arguments of webp.encode().
FORMS = ({"cache_bits": 8}, {"green": True, "cross": 0xFF04FC02}, {"predictor": -1}, {"predictor": -1, "green": True, "cache_bits": 6}, {"cross": 0xFF02FE04, "cache_bits": 9})


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % ROW or (0 if payload else ROW))


def pixels_of(samples: np.ndarray) -> np.ndarray:
    """Rows of pixels of rows of samples."""
    c = samples.reshape(-1, ROW // 3, 3).astype(np.uint32)
    return c[..., 0] << np.uint32(16) | c[..., 1] << np.uint32(8) | c[..., 2] | np.uint32(0xFF000000)


def _indexed(colours: int, pixels: int) -> bool:
    """Whether a palette makes a picture shorter."""
    return colours <= 256 and 24 * colours + pixels * max(colours - 1, 1).bit_length() < 12 * pixels


def _colours(pixels: np.ndarray) -> int:
    x = np.sort(pixels, None)
    return 1 + int(np.count_nonzero(x[1:] != x[:-1]))


def stored_many(payloads: list[bytes]) -> list[bytes]:
    """The pictures of each padded payload. Pictures of one form are written together."""
    files: list[list[bytes]] = [[] for _ in payloads]
    waiting: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in FORMS]
    limit = HIGH * ROW

    def written(form: int) -> None:
        own, waiting[form] = waiting[form], []
        for (k, place, _), file in zip(own, webp.encode_many([x for _, _, x in own], **FORMS[form]), strict=True):
            files[k][place] = file

    for k, payload in enumerate(payloads):
        for at in range(0, len(payload), limit):
            part = payload[at : at + limit]
            pixels = pixels_of(np.frombuffer(part, np.uint8))
            colours = _colours(pixels[:3])
            if len(pixels) > 3 and _indexed(colours, pixels.size):  # no picture with more colours than its top is shorter
                colours = _colours(pixels)
            if _indexed(colours, pixels.size):
                files[k].append(webp.encode(pixels, palette=True, copies=colours > 1 and pixels.size > 4 * colours))
            elif len(zlib.compress(part, 1)) < REPETITIVE * len(part):
                files[k].append(webp.encode(pixels, copies=True, cache_bits=4))
            else:
                form = zlib.crc32(part) % len(FORMS)
                waiting[form].append((k, len(files[k]), pixels))
                files[k].append(b"")
                if len(waiting[form]) == webp.TOGETHER:
                    written(form)
    for form, own in enumerate(waiting):
        if own:
            written(form)
    return [b"".join(own) for own in files]


def stored(payload: bytes) -> bytes:
    """The pictures of a padded payload."""
    return stored_many([payload])[0]


def files_of(media: bytes) -> list[bytes]:
    """The files that stand one after another in a media value."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def loaded_many(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each media value as rows of bytes."""
    files = [files_of(x) for x in media]
    read = iter(webp.decode_many([f for own in files for f in own]))
    out = []
    for own in files:
        pixels = np.concatenate([next(read) for _ in own])
        out.append(np.stack([pixels >> np.uint32(16), pixels >> np.uint32(8), pixels], 2).astype(np.uint8).reshape(len(pixels), ROW))
    return out


def loaded(media: bytes) -> np.ndarray:
    return loaded_many([media])[0]


def _gathered(batches: Iterator[pa.RecordBatch], media: str) -> Iterator[pa.RecordBatch]:
    """Batches in a row as one, up to about TOGETHER stored bytes: pictures read side by side share their steps."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(media).nbytes
        if size >= TOGETHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if sum(map(len, held)):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _together(batches: Iterator[pa.RecordBatch], media: str = "media") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows of batches with the samples of their media, about TOGETHER stored bytes at a time, small batches together."""
    for batch in _gathered(batches, media):
        size = np.cumsum([len(x.as_buffer()) for x in batch.column(media)]) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, side="right")))
            part = batch.slice(at, upto - at)
            yield part, loaded_many(part.column(media).to_pylist())
            at = upto
    released()


def described(samples: np.ndarray) -> str:
    """Height, mean and spread of the samples and the mean step to the right and down, in whole numbers and thousandths."""
    x = samples.astype(np.int64)
    n, total = x.size, int(x.sum())
    right, down = int(np.abs(np.diff(x, axis=1)).sum()), int(np.abs(np.diff(x, axis=0)).sum())
    spread = (n * int((x * x).sum()) - total * total) * 1000 // (n * n)
    return f"rows={len(x)};mean={total * 1000 // n};variance={spread};right={right * 1000 // n};down={down * 1000 // n}"


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media, the pictures of each whole text, in place of the text."""
    docs = docs.drop(*({"n_bytes", "media"} - {text}))
    kept = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            raw = [x.encode() for x in texts.to_pylist()]
            media = stored_many([padded(x) for x in raw])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def load(rows: DataFrame, media: str = "media", into: str = "pixels") -> DataFrame:
    """rows with `into`, the samples of each media value as bytes, row by row, and feature, their description."""
    rows = rows.drop(*({into, "feature"} - {media}))
    schema = T.StructType([*rows.schema, T.StructField(into, T.BinaryType()), T.StructField("feature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, read in _together(batches, media):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in read], pa.binary()), pa.array([described(x) for x in read])], schema.names)

    return rows.mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    """Per stored document: sizes and hashes of what is read back and of the stored form, and the feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, read in _together(batches):
            out = []
            for media, samples in zip(part.column("media").to_pylist(), read, strict=True):
                raw = samples.tobytes()
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), described(samples)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(list(x)) for x in zip(*out, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return rows.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
