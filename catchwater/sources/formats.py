"""How .npy arrays and TIFF files lie in their bytes: layouts found from a few ranges, blocks decoded one by one.

A layout lists a file's blocks (strips or tiles; an array is one strip a row-run) with their places, so that any block, and of
plain blocks any rows, can be read by whoever needs them. TIFF: classic and BigTIFF, either byte order, any number of bands
(interleaved or in planes), strips or tiles, plain, LZW or deflated, with or without a predictor. Arrays: C and Fortran order.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

# The tags of GeoTIFF files that tell place and reference system, with their field types, and the missing value.
PIXEL_SCALE, NODATA_TAG = 33550, 42113
GEO_TAGS = {33922: 12, 34264: 12, 34735: 3, 34736: 12, 34737: 2, 42113: 2}
_FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 12: "d", 11: "f", 16: "Q"}

#: Bytes from a place on.
Ranged = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Layout:
    """kind: numpy's name of a sample; wide, tall: a block's shape; across: blocks side by side; planes: blocks hold one band each.

    turned: the file holds columns, not rows (Fortran order), so that rows and columns change places.
    """

    nx: int
    ny: int
    bands: int
    kind: str
    packing: int
    predictor: int
    wide: int
    tall: int
    planes: bool
    turned: bool = False
    missing: float | None = None
    dx: float = 1.0
    geo: str = ""

    @property
    def held(self) -> tuple[int, int]:
        """Columns and rows as the file holds them."""
        return (self.ny, self.nx) if self.turned else (self.nx, self.ny)

    @property
    def across(self) -> int:
        return -(-self.held[0] // self.wide)

    @property
    def samples(self) -> int:
        """Samples of a pixel inside a block."""
        return 1 if self.planes else self.bands

    def place(self, k: int) -> tuple[int, int, int]:
        """The first band, row and column of block k, as the file holds them."""
        a_plane = self.across * -(-self.held[1] // self.tall)
        return k // a_plane, k % a_plane // self.across * self.tall, k % self.across * self.wide

    @property
    def row_bytes(self) -> int:
        return self.wide * self.samples * np.dtype(self.kind).itemsize

    @property
    def by_rows(self) -> bool:
        """Whether rows of a block can be read without those before."""
        return self.packing == 1


def lzw_decoded(data: bytes) -> bytes:
    """The bytes of an LZW strip: codes of 9 to 12 bits, highest bit first, wider one code early."""
    out, held, bits, width, table, before = bytearray(), 0, 0, 9, None, b""
    start = [bytes((k,)) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(start), 9, b""
            continue
        if table is None or code > len(table) or (code == len(table) and not before):
            raise ValueError("a damaged LZW strip")
        now = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + now[:1])
            width = max(9, min(12, (len(table) + 1).bit_length()))
        out += now
        before = now
    return bytes(out)


def _tags(read: Ranged) -> tuple[str, dict[int, tuple]]:
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    wide = magic == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if wide else struct.unpack(order + "I", head[4:8])[0]
    count, entry, room, number = (8, 20, 8, "Q") if wide else (2, 12, 4, "I")
    n = struct.unpack(order + ("Q" if wide else "H"), read(at, count))[0]
    table, tags = read(at + count, entry * n), {}
    for k in range(n):
        row = table[entry * k : entry * (k + 1)]
        tag, kind, many = struct.unpack(order + "HH" + number, row[: entry - room])
        if kind not in _FIELDS:
            continue
        form = order + _FIELDS[kind] * many
        size = struct.calcsize(form)
        raw = row[entry - room :][:size] if size <= room else read(struct.unpack(order + number, row[entry - room :])[0], size)
        tags[tag] = struct.unpack(form, raw)
    return order, tags


def tiff_layout(read: Ranged) -> tuple[Layout, np.ndarray, np.ndarray]:
    """The layout, and each block's first byte and size."""
    order, tags = _tags(read)
    packing, predictor, bands = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(277, (1,))[0]
    bits, sort = set(tags.get(258, (1,))), set(tags.get(339, (1,)))
    if packing not in (1, 5, 8, 32946) or predictor not in (1, 2, 3) or len(bits) > 1 or len(sort) > 1 or not bits <= {8, 16, 32, 64} or not sort <= {1, 2, 3}:
        raise ValueError("only TIFF files of whole bytes, plain, LZW or deflated, are read")
    width, height = tags[256][0], tags[257][0]
    wide, tall = (tags[322][0], tags[323][0]) if 322 in tags else (width, min(height, tags.get(278, (height,))[0]))
    starts, sizes = (tags[324], tags[325]) if 322 in tags else (tags[273], tags[279])
    geo = {str(t): b"".join(tags[t]).decode("latin-1") if kind == 2 else list(tags[t]) for t, kind in GEO_TAGS.items() if t in tags}
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[sort.pop()] + str(bits.pop() // 8))
    missing = None
    try:
        missing = float(b"".join(tags[NODATA_TAG]).rstrip(b"\0 ")) if NODATA_TAG in tags else None
    except ValueError:
        pass
    if missing is not None and kind.kind == "f":
        missing = float(kind.type(missing))
    dx = float(tags[PIXEL_SCALE][0]) if PIXEL_SCALE in tags else 1.0
    layout = Layout(width, height, bands, kind.str, packing, predictor, wide, tall, bands == 1 or tags.get(284, (1,))[0] == 2, False, missing, dx, json.dumps(geo, sort_keys=True) if geo else "")
    return layout, np.array(starts, np.int64), np.array(sizes, np.int64)


def npy_layout(read: Ranged) -> tuple[Layout, np.ndarray, np.ndarray]:
    told = io.BytesIO(read(0, 65_536 + 12))
    version = np.lib.format.read_magic(told)
    shape, turned, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(told)
    if len(shape) != 2 or kind.hasobject or kind.kind not in "fiub":
        raise ValueError("only arrays of numbers with two axes are read")
    ny, nx = shape
    wide, tall = (ny, nx) if turned else (nx, ny)
    return Layout(nx, ny, 1, kind.str, 1, 1, wide, tall, True, turned), np.array([told.tell()]), np.array([nx * ny * kind.itemsize])


def layout_of(read: Ranged) -> tuple[Layout, np.ndarray, np.ndarray]:
    return npy_layout(read) if read(0, 6) == b"\x93NUMPY" else tiff_layout(read)


def decoded(layout: Layout, raw: bytes) -> np.ndarray:
    """The (rows, columns, samples) of a block, or of whole rows of a plain one."""
    raw = raw if layout.packing == 1 else lzw_decoded(raw) if layout.packing == 5 else zlib.decompress(raw)
    kind, n, size = np.dtype(layout.kind), layout.samples, np.dtype(layout.kind).itemsize
    raw = memoryview(raw)[: len(raw) // layout.row_bytes * layout.row_bytes]
    if layout.predictor == 2:
        if kind.kind == "f":
            raise ValueError("predictor 2 needs whole numbers")
        return np.cumsum(np.frombuffer(raw, kind).reshape(-1, layout.wide, n), 1, dtype=kind)
    if layout.predictor == 3:
        lanes = np.frombuffer(raw, np.uint8).reshape(-1, layout.wide * size, n)
        planes = np.cumsum(lanes, 1, dtype=np.uint8).reshape(-1, size, layout.wide * n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(-1, layout.wide, n)
    return np.frombuffer(raw, kind).reshape(-1, layout.wide, n)


def cleaned(layout: Layout, z: np.ndarray) -> np.ndarray:
    """Missing values as NaN, in double precision."""
    out = z.astype(np.float64)
    if layout.missing is not None:
        out[out == layout.missing] = np.nan
    return out


def tiff_band(data: bytes) -> np.ndarray:
    """The first band of a TIFF; missing values become NaN."""
    layout, starts, sizes = tiff_layout(lambda at, n: data[at : at + n])
    out = np.zeros((layout.ny, layout.nx), np.dtype(layout.kind))
    for k, (start, n) in enumerate(zip(starts, sizes, strict=True)):
        band, r, c = layout.place(k)
        if band == 0:
            part = decoded(layout, data[start : start + n])[: layout.ny - r, : layout.nx - c, 0]
            out[r : r + len(part), c : c + part.shape[1]] = part
    return out if layout.missing is None else cleaned(layout, out)


def tiff_place(data: bytes) -> tuple[float, str]:
    """Pixel size (1 if not told) and, as JSON, the tags of place, reference system and missing value."""
    layout, _, _ = tiff_layout(lambda at, n: data[at : at + n])
    return layout.dx, layout.geo


def pieces(layout: Layout, starts: np.ndarray, sizes: np.ndarray, window: tuple[int, int, int, int], bands: tuple[int, int], target: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(block, first byte, bytes, first row, last row + 1 inside the block) of what the window (rows, columns) and the bands need.

    A plain block is cut at rows into pieces of about `target` bytes; only those rows of it are read that the window holds.
    """
    r0, r1, c0, c1 = window if not layout.turned else (*window[2:], *window[:2])
    nx, ny = layout.held
    for k, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        band, r, c = layout.place(k)
        if not (r < r1 and r + layout.tall > r0 and c < c1 and c + layout.wide > c0) or (layout.planes and not bands[0] <= band < bands[1]) or not size:
            continue
        low, high = max(0, r0 - r), min(layout.tall, ny - r, r1 - r)
        if not layout.by_rows:
            yield k, start, size, 0, min(layout.tall, ny - r)
            continue
        step = max(1, target // layout.row_bytes)
        for a in range(low, high, step):
            b = min(high, a + step)
            yield k, start + a * layout.row_bytes, (b - a) * layout.row_bytes, a, b


# Writing.


def tiff_frame(nx: int, ny: int, rows: int, sizes: list[int], kind: str = "<f4", packing: int = 1, predictor: int = 1, dx: float = 1.0, geo: str = "") -> tuple[bytes, list[int], bytes]:
    """What comes before the strips of `rows` rows, where each strip begins, and what comes after; BigTIFF where 4 GB don't do."""
    big = 16 + sum(sizes) + 16 * len(sizes) + 4096 + len(geo) > 0xFFFFFFFF
    first = 16 if big else 8
    starts = [first + int(x) for x in np.cumsum([0, *sizes])]
    at, offset = starts.pop(), 16 if big else 4
    entries = [(256, 4, [nx]), (257, 4, [ny]), (258, 3, [8 * np.dtype(kind).itemsize]), (259, 3, [packing]), (262, 3, [1]), (273, offset, starts), (277, 3, [1]), (278, 4, [min(rows, ny)]), (279, offset, sizes), (317, 3, [predictor]), (339, 3, [3]), (PIXEL_SCALE, 12, [dx, dx, 0.0])]
    for tag, value in json.loads(geo or "{}").items():
        entries.append((int(tag), GEO_TAGS[int(tag)], value))
    entries.sort()
    number, room, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    table, more = struct.pack("<Q" if big else "<H", len(entries)), b""
    free = at + len(table) + entry * len(entries) + room
    for tag, field, value in entries:
        raw = value.encode("latin-1") if field == 2 else struct.pack("<" + _FIELDS[field] * len(value), *value)
        table += struct.pack("<HH" + number, tag, field, len(value))
        if len(raw) <= room:
            table += raw.ljust(room, b"\0")
        else:
            table += struct.pack("<" + number, free + len(more))
            more += raw + b"\0" * (len(raw) & 1)
    head = b"II" + (struct.pack("<HHHQ", 43, 8, 0, at) if big else struct.pack("<HI", 42, at))
    return head, starts, table + b"\0" * room + more


def strip_bytes(z: np.ndarray, kind: str = "<f4", packing: int = 1, predictor: int = 1) -> bytes:
    """A strip's bytes; predictor 3 is for numbers with a fraction."""
    if predictor == 3:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(np.ascontiguousarray(z, np.dtype(kind).newbyteorder(">")).tobytes(), np.uint8).reshape(z.shape[0], -1, size).transpose(0, 2, 1).reshape(z.shape[0], -1)
        raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    else:
        raw = np.ascontiguousarray(z, kind).tobytes()
    return raw if packing == 1 else zlib.compress(raw)


def npy_frame(nx: int, ny: int, kind: str = "<f4") -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": (ny, nx)})
    return out.getvalue()


def joined_adler(first: int, second: int, n: int) -> int:
    """The Adler-32 of two byte strings from theirs and the length of the second."""
    base, a, b = 65521, first & 0xFFFF, second & 0xFFFF
    return ((first >> 16) + (second >> 16) + n * (a - 1)) % base << 16 | (a + b - 1) % base


def png_part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_lines(z: np.ndarray, bits: int) -> tuple[bytes, int, int]:
    """Rows as a chunk of the picture's stream, with the Adler-32 and the length of what it holds; chunks of bands follow each other."""
    lines = np.nan_to_num(z).astype(">u2" if bits == 16 else np.uint8)
    raw = np.concatenate([np.zeros((len(z), 1), np.uint8), np.ascontiguousarray(lines).view(np.uint8).reshape(len(z), -1)], 1).tobytes()
    packer = zlib.compressobj(wbits=-15)
    return png_part(b"IDAT", packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)), zlib.adler32(raw), len(raw)


def png_frame(nx: int, ny: int, bits: int, sums: list[tuple[int, int]]) -> tuple[bytes, bytes]:
    """What comes before and after the bands' chunks, whose (Adler-32, length) are given in order."""
    total = 1
    for adler, n in sums:
        total = joined_adler(total, adler, n)
    head = b"\x89PNG\r\n\x1a\n" + png_part(b"IHDR", struct.pack(">IIBBBBB", nx, ny, bits, 0, 0, 0, 0)) + png_part(b"IDAT", b"\x78\x9c")
    return head, png_part(b"IDAT", b"\x03\x00" + struct.pack(">I", total)) + png_part(b"IEND", b"")

