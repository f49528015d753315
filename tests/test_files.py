"""GeoTIFF files as others write them, and what is written again."""

import json
import struct
import zlib

import numpy as np
import pytest

from catchwater import cli
from catchwater.operators import noise
from catchwater.operators.grid import from_matrix
from catchwater.sources import files


def lzw(data: bytes) -> bytes:
    """Codes by the TIFF text: the writer turns to wider codes once entry 511, 1023 or 2047 is in its table."""
    out, held, bits = bytearray(), 0, 0
    table, width, now = {bytes((k,)): k for k in range(256)}, 9, b""

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    size = 258
    for k in range(len(data)):
        c = data[k : k + 1]
        if now + c in table:
            now += c
            continue
        put(table[now])
        table[now + c] = size
        size += 1
        if size in (512, 1024, 2048):
            width += 1
        if size == 4094:
            put(256)
            table, width, size = {bytes((k,)): k for k in range(256)}, 9, 258
        now = c
    put(table[now])
    size += 1
    if size in (512, 1024, 2048):
        width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def tiff(z, packing, predictor, order="<", tile=0, missing=None):
    """A TIFF of an array, written from the format's text; with place, reference system and missing value."""
    kind = z.dtype.newbyteorder(order)
    size, (ny, nx) = kind.itemsize, z.shape
    wide, tall = (tile, tile) if tile else (nx, 3)
    parts = []
    for r in range(0, ny, tall):
        for c in range(0, nx, wide):
            part = z[r : r + tall, c : c + wide]
            if tile:
                part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1])))
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1)
            raw = part.astype(kind).tobytes()
            if predictor == 3:
                planes = np.frombuffer(part.astype(z.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(len(part), -1, size).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], 1).astype(np.uint8).tobytes()
            parts.append(raw if packing == 1 else lzw(raw) if packing == 5 else zlib.compress(raw))
    starts = np.cumsum([8] + [len(p) for p in parts])
    entries = [(256, 3, [nx]), (257, 3, [ny]), (258, 3, [8 * size]), (259, 3, [packing]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [{"f": 3, "u": 1, "i": 2}[z.dtype.kind]]), (33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0, 0, 0, 100.0, 200.0, 0]), (34735, 3, [1, 1, 0, 1, 2048, 0, 1, 4326])]
    entries += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, starts[:-1].tolist()), (325, 4, [len(p) for p in parts])] if tile else [(273, 4, starts[:-1].tolist()), (278, 3, [tall]), (279, 4, [len(p) for p in parts])]
    if missing is not None:
        entries.append((42113, 2, list(f"{missing}\0".encode())))
    at = int(starts[-1])
    free, table, more = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, field, value in sorted(entries):
        raw = struct.pack(order + {2: "B", 3: "H", 4: "I", 12: "d"}[field] * len(value), *value)
        table += struct.pack(order + "HHI", tag, field, len(value)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", free + len(more)))
        more += raw if len(raw) > 4 else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(parts) + struct.pack(order + "H", len(entries)) + table + struct.pack(order + "I", 0) + more


@pytest.mark.parametrize("order", ["<", ">"])
def test_packings_and_predictors(order):
    rng = np.random.default_rng(1)
    for kind in (np.float32, np.float64, np.uint16, np.int32):
        z = np.round(np.cumsum(rng.normal(size=(40, 70)), 1) * 50 + 3000).astype(kind)
        for packing in (1, 5, 8):
            for predictor in (1, 3) if z.dtype.kind == "f" else (1, 2):
                for tile in (0, 16):
                    assert (files.tiff_band(tiff(z, packing, predictor, order, tile)) == z).all()
    with pytest.raises(ValueError):
        files.tiff_band(b"no TIFF file")


def test_place_and_missing_value_are_kept(spark, tmp_path):
    z = np.arange(24, dtype=np.float32).reshape(4, 6)
    z[1, 2] = -9999
    (tmp_path / "a.tif").write_bytes(tiff(z, 5, 3, missing=-9999))
    raster = files.read_raster(spark, f"{tmp_path}/a.tif")
    assert (raster.meta.nx, raster.meta.ny, raster.meta.dx) == (6, 4, 2.0) and np.isnan(raster.matrix("z")[1, 2])
    for command, shape, dx in (("upscale", (8, 12), 1.0), ("downscale", (2, 3), 4.0)):
        assert cli.main([command, f"{tmp_path}/a.tif", f"{tmp_path}/{command}.tif"], spark) == 0
        data = (tmp_path / f"{command}.tif").read_bytes()
        assert files.tiff_band(data).shape == shape and files.tiff_place(data)[0] == dx
        told = json.loads(files.tiff_place(data)[1])
        assert told["33922"] == [0, 0, 0, 100.0, 200.0, 0] and told["34735"][-1] == 4326 and told["42113"].startswith("-9999")
    files.write_tiff(raster, f"{tmp_path}/b.tif")
    assert np.array_equal(files.tiff_band((tmp_path / "b.tif").read_bytes()), np.where(z == -9999, np.nan, z), equal_nan=True)


def test_writers_go_band_by_band(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BAND", 3)
    z = np.random.default_rng(2).random((8, 5))
    raster = from_matrix(spark, z)
    assert files.write_npy(raster, f"{tmp_path}/a.npy") == (np.float32(z.min()), np.float32(z.max()))
    assert (np.load(f"{tmp_path}/a.npy") == z.astype(np.float32)).all()
    files.write_tiff(raster, f"{tmp_path}/a.tif")
    assert (files.tiff_band((tmp_path / "a.tif").read_bytes()) == z.astype(np.float32)).all()
    files.write_png(raster, f"{tmp_path}/a.png")
    data, at, body = (tmp_path / "a.png").read_bytes(), 8, b""
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        body += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(8, 6)[:, 1:]
    assert (lines == np.floor((z - z.min()) / (z.max() - z.min()) * 255)).all()


def test_red_noise_is_the_whole_transform(spark, monkeypatch):
    monkeypatch.setattr(noise, "BAND", 4)
    for nx, ny in ((12, 9), (7, 10), (64, 48)):
        white = noise.white(spark, nx, ny, 1.0, 5).matrix("z")
        k = np.hypot(np.fft.fftfreq(ny)[:, None], np.fft.fftfreq(nx)[None, :])  # cycles a cell on both axes
        spectrum = np.fft.fft2(white) / np.where(k == 0, 1, k)
        spectrum[0, 0] = 0
        want = np.fft.ifft2(spectrum).real
        want -= want.mean()
        got = noise.red(spark, nx, ny, 2.0, 5).matrix("z")
        assert np.allclose(got, want * 2.0 / np.abs(want).max())
        x, e = np.zeros((ny, nx)), noise.white(spark, nx, ny, 1.0, 5).matrix("z")
        for c in range(nx):
            x[:, c] = (0.8 * x[:, c - 1] if c else 0) + 0.6 * e[:, c]
        y = 0.6 * x
        for r in range(1, ny):
            y[r] += 0.8 * y[r - 1]
        assert np.allclose(noise.autoregressive(spark, nx, ny, 1.0, 0.8, 5).matrix("z"), y)
