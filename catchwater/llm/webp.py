"""Media columns: lossless WebP. decode_many() reads any lossless still images into pixel arrays; encode() writes one.

The decoder follows the public format: prefix codes (simple and normal, with the code-length code), prefix-code groups
chosen by an entropy image, LZ77 back-references with the two-dimensional distance map, the colour cache, and the
inverses of the four transforms (predictor, cross-colour, subtract-green, colour indexing with packed pixels).

Many images are read side by side, each in a lane: a step reads the next symbol of every lane by arrays. Copies and cache
hits are first kept as pointers to earlier pixels, which doubling then follows to a pixel with a colour of its own: a
cache hit points to the last pixel before it that fell into its slot. The predictor is undone along slanted fronts over
all rows of all images at once. Images with several prefix-code groups, and the small images inside of others, go symbol
by symbol. Pixels are uint32 ARGB arrays of shape (height, width).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

# Fixed values of the format: order of code-length codes, and the near distances as (x, y).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, GREEN, INDEX = 0, 1, 2, 3
GREENS, LENGTHS, DISTANCES = 256, 24, 40
_ORDER, _EXTRA = np.array(CODE_LENGTH_ORDER), np.array([0] * 16 + [2, 3, 7])
LIMIT = 1 << 14
#: Bits of the side of a block with its own predictor and factors; images written together at most: 16 bits hold image and slot.
BLOCK, TOGETHER = 5, 64


class Damaged(ValueError):
    """The bytes are not a whole lossless WebP image."""


class Bits:
    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data[:64], "little"), len(data) * 8, 0
        self.data, self.base = data, 0

    def read(self, n: int) -> int:
        self.at += n
        if self.at > self.size:
            raise Damaged("the image ends early")
        return self.peek(n, self.at - n)

    def peek(self, n: int, at: int | None = None) -> int:
        at = self.at if at is None else at
        if at - self.base > 448:
            self.base = at & ~7
            self.value = int.from_bytes(self.data[self.base >> 3 : (self.base >> 3) + 64], "little")
        return (self.value >> (at - self.base)) & ((1 << n) - 1)


    def repeated(self, first: int) -> bool:
        """Whether the bits from `first` on come once more; if so, they are passed."""
        n = self.at - first
        if self.at + n > self.size:
            return False
        held = int.from_bytes(self.data[first >> 3 : (self.at + n + 7) >> 3], "little") >> (first & 7)
        same = not (held ^ held >> n) & ((1 << n) - 1)
        self.at += n if same else 0
        return same


_REVERSED = np.array([int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)])
#: Of codes of n bits: how many of 15 bits one stands for, and the mask of its bits.
_ROOM, _MASK = np.array([1 << 15 - n for n in range(16)]), np.array([(1 << n) - 1 for n in range(16)])
#: Where the next n bits, read as a number, stand among the codes of n bits in order.
_PLACES = [_REVERSED[: 1 << n] >> (15 - n) for n in range(16)]


def canonical(lengths: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    """The canonical codes of the lengths, bits reversed: the first bit of a code is its lowest. used: where there is one."""
    used = lengths.nonzero()[0] if used is None else used
    order = used[lengths[used].argsort(kind="stable")]
    n = lengths[order]
    room = _ROOM[n]
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = _REVERSED[(room.cumsum() - room) & 0x7FFF] & _MASK[n]
    return codes


class Prefix:
    """A prefix code as a table by the next `bits` bits: symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if not len(used):
            raise Damaged("an empty prefix code")
        self.single = int(used[0]) if len(used) == 1 else None
        if self.single is not None:
            self.bits, self.table = 0, np.array([self.single << 4], np.int32)
        else:
            n = lengths[used]
            if _ROOM[n].sum() != 1 << 15:
                raise Damaged("a prefix code is not complete")
            order = n.argsort(kind="stable")
            n = n[order]
            self.bits = int(n[-1])
            self.table = (used[order] << 4 | n).repeat(_ROOM[n] >> (15 - self.bits))[_PLACES[self.bits]].astype(np.int32)
        self._list, self.lengths = None, None

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        if self._list is None:
            self._list = self.table.tolist()
        e = self._list[bits.peek(self.bits)]
        bits.at += e & 15
        if bits.at > bits.size:
            raise Damaged("the image ends early")
        return e >> 4


@lru_cache(4096)
def _simple(*symbols: int) -> Prefix:
    """The code of one or two symbols."""
    lengths = np.zeros(max(symbols) + 1, np.int64)
    lengths[list(symbols)] = 1
    return Prefix(lengths)


def _read_prefix(bits: Bits, alphabet: int, known: Prefix | None = None) -> Prefix:
    """The next prefix code; `known` itself if it is the same."""
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise Damaged("a symbol is out of range")
        return _simple(*symbols)
    of = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        of[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = Prefix(of)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before, out = 0, 8, [0] * alphabet
    table, mask, start = code.table.tolist(), len(code.table) - 1, bits.at
    held, have, used = 0, 0, 0  # bits of this code at hand, how many, and how many are used up
    while at < alphabet and left:
        left -= 1
        if have - used < 32:
            first = start + used
            held = int.from_bytes(bits.data[first >> 3 : (first >> 3) + 64], "little") >> (first & 7)
            start, used, have = first, 0, 504
        e = table[held & mask]
        s, n = e >> 4, e & 15
        held >>= n
        used += n
        if s < 16:
            out[at] = s
            before = s or before
            at += 1
            continue
        more = (2, 3, 7)[s - 16]
        n = (3, 3, 11)[s - 16] + (held & ((1 << more) - 1))
        held >>= more
        used += more
        if at + n > alphabet:
            raise Damaged("code lengths run over")
        if s == 16:
            out[at : at + n] = [before] * n
        at += n
    bits.at = start + used
    if bits.at > bits.size:
        raise Damaged("the image ends early")
    if known is not None and known.lengths == out:
        return known
    code = Prefix(np.array(out))
    code.lengths = out
    return code


def _extra(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _greens(cache_bits: int) -> int:
    """Symbols of the first code."""
    return GREENS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)


def _before_codes(bits: Bits, width: int, height: int, top: bool) -> tuple[int, np.ndarray | None, int]:
    """Cache bits, the entropy image and its block."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Damaged("the colour cache is too large")
    chosen, block = None, 0
    if top and bits.read(1):
        block = bits.read(3) + 2
        chosen = (_image(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block) >> 8) & 0xFFFF
    return cache_bits, chosen, block


def _codes(bits: Bits, cache_bits: int, groups: int) -> list[list[Prefix]]:
    """The five prefix codes of each group."""
    alphabets = (_greens(cache_bits), 256, 256, 256, DISTANCES)
    codes = []
    for _ in range(groups):
        own: list[Prefix] = []
        for k, n in enumerate(alphabets):
            if k == 2 and bits.repeated(first):
                own.append(own[1])  # the bits of red's code once more
                continue
            first = bits.at
            own.append(_read_prefix(bits, n, own[1] if k == 2 else None))
        codes.append(own)
    return codes


def _head(bits: Bits, width: int, height: int, top: bool) -> tuple[int, np.ndarray | None, int, list[list[Prefix]]]:
    """Cache bits, the entropy image and its block, and the prefix codes of an image."""
    cache_bits, chosen, block = _before_codes(bits, width, height, top)
    return cache_bits, chosen, block, _codes(bits, cache_bits, 1 if chosen is None else int(chosen.max()) + 1)


def _image(bits: Bits, width: int, height: int) -> np.ndarray:
    """The pixels of an image inside another one."""
    return _pixel_by_pixel(bits, width, height, *_head(bits, width, height, False))


def _pixel_by_pixel(bits: Bits, width: int, height: int, cache_bits: int, chosen: np.ndarray | None, block: int, codes: list[list[Prefix]]) -> np.ndarray:
    """The pixels that prefix codes, back-references and the colour cache stand for; transforms come later."""
    n = width * height
    green, red, blue, alpha, _ = codes[0]
    if chosen is None and None not in (green.single, red.single, blue.single, alpha.single) and green.single < GREENS:
        return np.full((height, width), alpha.single << 24 | red.single << 16 | green.single << 8 | blue.single, np.uint32)
    out, cache, at, cached = [0] * n, [0] * (1 << cache_bits), 0, 0
    shift = 32 - cache_bits
    while at < n:
        group = codes[chosen[(at // width) >> block, (at % width) >> block]] if chosen is not None else codes[0]
        s = group[0].read(bits)
        if s < GREENS:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < GREENS + LENGTHS:
            length = _extra(bits, s - GREENS)
            code = _extra(bits, group[4].read(bits))
            if code > 120:
                back = code - 120
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > n:
                raise Damaged("a back-reference leaves the image")
            if back >= length:
                out[at : at + length] = out[at - back : at - back + length]
            else:
                unit = out[at - back : at]
                out[at : at + length] = (unit * (length // back + 1))[:length]
            at += length
        else:
            if cache_bits:
                while cached < at:
                    cache[(0x1E35A7BD * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                    cached += 1
            out[at] = cache[s - GREENS - LENGTHS]
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


_NEAR = np.array(NEAR)


def _slot(colour: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """The place of colours in caches of so many bits."""
    return ((colour.astype(np.uint64) * np.uint64(0x1E35A7BD)) & np.uint64(0xFFFFFFFF)) >> (32 - np.asarray(bits)).astype(np.uint64)


class _Lane:
    """An image to be read: its bits from the prefix codes on, size and cache bits."""

    def __init__(self, bits: Bits, width: int, height: int, cache_bits: int):
        self.bits, self.width, self.height, self.cache_bits = bits, width, height, cache_bits


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tables of Prefix for rows of code lengths, one after another; where each starts, and the mask of its bits."""
    row, used = lengths.nonzero()
    n, count = lengths[row, used], np.bincount(row, minlength=len(lengths))
    if not count.all():
        raise Damaged("an empty prefix code")
    if (np.bincount(row, _ROOM[n], len(lengths))[count > 1] != 1 << 15).any():
        raise Damaged("a prefix code is not complete")
    order = (row << 4 | n).argsort(kind="stable")
    row, used, n = row[order], used[order], np.where(count[row] == 1, 0, n)[order]
    deep = np.where(count == 1, 0, lengths.max(1))
    flat = (used << 4 | n).repeat(_ROOM[n] >> 15 - deep[row])
    size = 1 << deep
    start = size.cumsum() - size
    first, bits = start.repeat(size), deep.repeat(size)
    return flat[first + (_REVERSED[np.arange(len(flat)) - first] >> 15 - bits)].astype(np.int32), start, size - 1


#: Lanes whose tables are made together.
_LANES = 256
_LEAST, _MORE = np.array([3, 3, 11]), np.array([2, 3, 7])


def _all_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_tables(lengths[lo : lo + _LANES]) for lo in range(0, len(lengths), _LANES)]
    base = np.cumsum([0] + [len(t) for t, _, _ in parts])
    return np.concatenate([t for t, _, _ in parts]), np.concatenate([s + b for (_, s, _), b in zip(parts, base)]), np.concatenate([m for _, _, m in parts])


def _read_prefixes(look: Callable[[np.ndarray], np.ndarray], pos: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_all_tables() of the next prefix code of each lane, as _read_prefix reads one; pos, each lane's bit, is moved on."""
    wide = int(alphabet.max())
    out = np.zeros(len(pos) * wide + 1, np.int64)  # the last place takes what no lane writes
    x = look(pos)
    some = (x & 1).nonzero()[0]
    if len(some):
        two, full, s = x[some] >> 1 & 1, x[some] >> 2 & 1, x[some] >> 3
        a, n = s & np.where(full, 255, 1), np.where(full, 8, 1)
        b = np.where(two, s >> n & 255, a)
        if (np.maximum(a, b) >= alphabet[some]).any():
            raise Damaged("a symbol is out of range")
        out[some * wide + a] = out[some * wide + b] = 1
        pos[some] += 3 + n + 8 * two
    on = (~x & 1).nonzero()[0]
    if len(on):
        told, p = 4 + (x[on] >> 1 & 15), pos[on] + 5
        of = np.zeros((len(on), 19), np.int64)
        of[:, _ORDER] = np.concatenate([look(p)[:, None] >> 3 * np.arange(10) & 7, look(p + 30)[:, None] >> 3 * np.arange(9) & 7], 1) * (np.arange(19) < told[:, None])
        p += 3 * told
        x = look(p)
        given, n = (x & 1) > 0, 2 + 2 * (x >> 1 & 7)
        limit = alphabet[on]
        left = np.where(given, 2 + (look(p + 4) & (1 << n) - 1), limit)
        p += np.where(given, 4 + n, 1)
        table, start, mask = _all_tables(of)
        at, before, base = np.zeros_like(p), np.full_like(p, 8), on * wide
        while len(on):
            for _ in range(8):
                x = look(p)
                e = table.take(start + (x & mask)).astype(np.int64)
                s, n = e >> 4, e & 15
                live = (at < limit) & (left > 0)
                own = live & (s < 16)
                out[np.where(own, base + at, len(out) - 1)] = s
                step, p = live.astype(np.int64), p + n * live
                runs = (live & (s > 15)).nonzero()[0]
                if len(runs):
                    t = s[runs] - 16
                    step[runs] = _LEAST[t] + (x[runs] >> n[runs] & (1 << _MORE[t]) - 1)
                    p[runs] += _MORE[t]
                    if (at[runs] + step[runs] > limit[runs]).any():
                        raise Damaged("code lengths run over")
                    for k in runs[t == 0].tolist():
                        out[base[k] + at[k] : base[k] + at[k] + step[k]] = before[k]
                before = np.where(own & (s > 0), s, before)
                left = left - live
                at = at + step
            pos[on] = p
            more = (at < limit) & (left > 0)
            on, p, at, before, base, left, limit, start, mask = (v[more] for v in (on, p, at, before, base, left, limit, start, mask))
    return _all_tables(out[:-1].reshape(-1, wide))


def _read_lanes(lanes: list[_Lane]) -> list[np.ndarray]:
    """The pixels of all lanes; transforms come later."""
    sizes = np.array([x.width * x.height for x in lanes])
    base = np.cumsum(sizes + 1) - sizes - 1  # one more pixel for what lanes read after their end
    chunks, start, at = [], np.zeros(len(lanes), np.int64), 0
    for k, x in enumerate(lanes):
        first = x.bits.at >> 5
        raw = x.bits.data[first * 4 :]
        raw += b"\0" * (-len(raw) % 4)
        start[k] = at * 8 + x.bits.at - first * 32
        chunks.append(raw)
        at += len(raw)
    words = np.frombuffer(b"".join(chunks) + b"\0" * 64, "<u4").astype(np.uint64)
    words = (words[:-1] | words[1:] << np.uint64(32)).view(np.int64)  # shifts may bring in ones at the top: no code is that long
    end = start + np.array([x.bits.size - x.bits.at for x in lanes])
    width = np.array([x.width for x in lanes])
    total = int((sizes + 1).sum())
    colour, source = np.zeros(total, np.uint32), np.full(total, -1, np.int64)  # source: -1 own colour; -2 - slot: cache hit; else an earlier pixel
    copies: list[tuple[np.ndarray, ...]] = []
    on, pos, done = np.arange(len(lanes)), start.copy(), np.zeros(len(lanes), np.int64)

    def look(p: np.ndarray) -> np.ndarray:
        return words.take(p >> 5, mode="clip") >> (p & 31)

    alphabets = (np.array([_greens(x.cache_bits) for x in lanes]), *(np.full(len(lanes), n) for n in (256, 256, 256, DISTANCES)))
    tables, starts, masks = zip(*(_read_prefixes(look, pos, n) for n in alphabets), strict=True)

    def symbol(c: int, lane: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = tables[c][starts[c][lane] + (x & masks[c][lane])]
        return e >> 4, e & 15

    def extra(s: np.ndarray, lane: np.ndarray) -> np.ndarray:
        n = np.maximum((s - 2) >> 1, 0)
        more = look(pos[lane]) & ((1 << n) - 1)
        pos[lane] += n
        return np.where(s < 4, s, ((2 + (s & 1)) << n) + more) + 1

    while len(on):
        group = [(tables[c], starts[c][on], masks[c][on]) for c in range(4)]
        plain = None if group[3][2].any() else (tables[3][group[3][1]] >> 4).astype(np.uint32) << np.uint32(24)  # one alpha for each lane
        p, d, n_, b_ = pos[on], done[on], sizes[on], base[on]
        for _ in range(16):
            x = look(p)
            t, o, m = group[0]
            e = t.take(o + (x & m))
            green, n = e >> 4, e & 15
            literal = green < GREENS
            x = x >> n
            t, o, m = group[1]
            e = t.take(o + (x & m))
            red, n2 = e >> 4, n + (e & 15)
            q = p + n2
            x = look(q)
            t, o, m = group[2]
            e = t.take(o + (x & m))
            blue, n3 = e >> 4, e & 15
            after = q + n3
            if plain is None:
                x = x >> n3
                t, o, m = group[3]
                e = t.take(o + (x & m))
                alpha, after = (e >> 4).astype(np.uint32) << np.uint32(24), after + (e & 15)
            else:
                alpha = plain
            value = alpha | (red << 16 | green << 8 | blue).astype(np.uint32)
            place, live = b_ + d, d < n_
            colour[place] = value
            p = np.where(live, np.where(literal, after, p + n), p)
            step = live.astype(np.int64)
            other = np.flatnonzero(live & ~literal)
            if not len(other):
                d = d + step
                continue
            hit = green[other] >= GREENS + LENGTHS
            some = other[hit]
            source[place[some]] = -2 - (green[some].astype(np.int64) - GREENS - LENGTHS)
            some = other[~hit]
            if len(some):
                lane = on[some]
                pos[lane] = p[some]
                length = extra(green[some].astype(np.int64) - GREENS, lane)
                code, n = symbol(4, lane, look(pos[lane]))
                pos[lane] += n
                far = extra(code.astype(np.int64), lane)
                near = np.minimum(far, 120) - 1
                back = np.where(far > 120, far - 120, np.maximum(1, _NEAR[near, 0] + _NEAR[near, 1] * width[lane]))
                p[some] = pos[lane]
                if ((back > d[some]) | (d[some] + length > n_[some])).any():
                    raise Damaged("a back-reference leaves the image")
                copies.append((place[some], length, back))
                step[some] = length
            d = d + step
        pos[on], done[on] = p, d
        on = on[d < n_]
    if (pos > end).any():
        raise Damaged("the image ends early")
    if copies:
        place, length, back = (np.concatenate(z) for z in zip(*copies, strict=True))
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        source[np.repeat(place, length) + inside] = np.repeat(place - back, length) + inside
    _followed(colour, source, lanes, base, sizes)
    return [colour[b : b + n].reshape(x.height, x.width) for x, b, n in zip(lanes, base.tolist(), sizes.tolist(), strict=True)]


def _roots(source: np.ndarray) -> np.ndarray:
    """Where pointers to earlier pixels end."""
    some, up = np.flatnonzero(source >= 0), np.arange(len(source))
    up[some] = source[some]
    while True:
        new = up[up[some]]
        if (new == up[some]).all():
            return up
        up[some] = new


def _followed(colour: np.ndarray, source: np.ndarray, lanes: list[_Lane], base: np.ndarray, sizes: np.ndarray) -> None:
    """Gives copied pixels and cache hits their colours."""
    pointing = source != -1
    if not pointing.any():
        return
    root = _roots(source)
    if (source < -1).any():
        cached = np.repeat(np.array([x.cache_bits for x in lanes]) * np.logical_or.reduceat(source < -1, base), sizes + 1)
        cached[base + sizes] = 0
        some = np.flatnonzero(cached)
        own, at = root[some], np.repeat(np.arange(len(lanes)), sizes + 1)[some]
        slot = np.where(source[own] < -1, -2 - source[own], _slot(colour[own], cached[some]).astype(np.int64))
        key = ((at & 31) << 11 | slot).astype(np.uint16)  # 32 lanes are sorted at a time, by 16 bits
        cuts = [*np.searchsorted(at, np.arange(0, len(lanes), 32)).tolist(), len(at)]
        before = np.full(len(source), -1)
        for lo, hi in zip(cuts, cuts[1:]):
            order = np.argsort(key[lo:hi], kind="stable")
            k, where = key[lo:hi][order], some[lo:hi][order]
            before[where[1:]] = np.where(k[1:] == k[:-1], where[:-1], -1)
        hits = np.flatnonzero(source < -1)
        colour[hits] = 0  # a slot that nothing has fallen into yet
        source[hits] = before[hits]
        root = _roots(source)
    some = np.flatnonzero(pointing)
    colour[some] = colour[root[some]]


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4).astype(np.int32)  # blue, green, red, alpha


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels & 255, np.uint8).view("<u4")[..., 0]


def _predicted(mode: int, left: np.ndarray, up: np.ndarray, up_left: np.ndarray, up_right: np.ndarray) -> np.ndarray:
    """The predictions of pixels' four channels by one mode."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255], left.dtype), left.shape)
    if mode < 5:
        return (left, up, up_right, up_left)[mode - 1]
    if mode == 5:
        return (((left + up_right) >> 1) + up) >> 1
    if mode < 10:
        a, b = ((left, up_left), (left, up), (up_left, up), (up, up_right))[mode - 6]
        return (a + b) >> 1
    if mode == 10:
        return (((left + up_left) >> 1) + ((up + up_right) >> 1)) >> 1
    if mode == 11:
        far = np.abs(up - up_left) - np.abs(left - up_left)
        return np.where((far[..., 0] + far[..., 1] + far[..., 2] + far[..., 3] < 0)[..., None], left, up)
    if mode == 12:
        return np.clip(left + up - up_left, 0, 255)
    mean = (left + up) >> 1
    half = mean - up_left
    return np.clip(mean + np.where(half < 0, -(-half // 2), half // 2), 0, 255)


def _effective(modes: np.ndarray, block: int, height: int, width: int) -> np.ndarray:
    """The mode of each pixel: the first row looks left, the first column up, the first pixel is against black."""
    out = modes[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block].astype(np.int8)
    out[:, 0], out[0], out[0, 0] = 2, 1, 0
    return out


def _around(c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, upper, upper left and upper right channels of each pixel; what is outside is not used but for the upper right
    of the last column, which is the first pixel of its own row."""
    left, up = np.roll(c, 1, 1), np.roll(c, 1, 0)
    up_right = np.roll(up, -1, 1)
    up_right[:, -1] = c[:, 0]
    return left, up, np.roll(up, 1, 1), up_right


def _differences(c: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """What the predictor leaves of channels."""
    near, mode, out = _around(c), _effective(modes, block, *c.shape[:2]), c.copy()
    for m in np.unique(mode).tolist():
        on = mode == m
        out[on] = (c[on] - _predicted(m, *(x[on] for x in near))) & 255
    return out


def best_modes(c: np.ndarray, block: int, candidates: Sequence[int] = (0, 1, 2, 7, 11, 12)) -> tuple[np.ndarray, np.ndarray]:
    """For each block of pixels, the mode that leaves the least differences; and the differences that these modes leave."""
    height, width = c.shape[:2]
    near, rows, cols = _around(c), np.arange(0, height, 1 << block), np.arange(0, width, 1 << block)
    cost, left = [], []
    for m in candidates:
        d = (c - _predicted(m, *near)) & 255
        left.append(d)
        d = np.minimum(d, 256 - d)
        cost.append(np.add.reduceat(np.add.reduceat(d[..., 0].astype(np.int64) + d[..., 1] + d[..., 2], rows, 0), cols, 1))
    best, out = np.argmin(np.stack(cost), 0), np.empty_like(c)
    for y, own in zip(rows.tolist(), best.tolist(), strict=True):
        for x, k in zip(cols.tolist(), own, strict=True):
            out[y : y + (1 << block), x : x + (1 << block)] = left[k][y : y + (1 << block), x : x + (1 << block)]
    out[0, 1:] = (c[0, 1:] - c[0, :-1]) & 255
    out[1:, 0] = (c[1:, 0] - c[:-1, 0]) & 255
    out[0, 0] = (c[0, 0] - np.array([0, 0, 0, 255], c.dtype)) & 255
    return np.asarray(list(candidates))[best], out


def _unpredicted(images: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """Channels from differences, for many images (channels, modes, block): pixel (y, x) comes in front x + 2 y."""
    if not images:
        return []
    sizes = [c.shape[0] * c.shape[1] for c, _, _ in images]
    flat = np.concatenate([c.reshape(-1, 4) for c, _, _ in images]).astype(np.int16)
    mode = np.concatenate([_effective(m, b, *c.shape[:2]).ravel() for c, m, b in images])
    first = np.cumsum(sizes) - sizes
    y = np.concatenate([np.arange(c.shape[0]) for c, _, _ in images])
    wide = np.repeat([c.shape[1] for c, _, _ in images], [c.shape[0] for c, _, _ in images])
    begin = np.repeat(first, [c.shape[0] for c, _, _ in images]) + y * wide
    order = np.argsort(y, kind="stable")
    y, wide, begin = y[order], wide[order], begin[order]
    for t in range(int((2 * y + wide).max())):
        lo, hi = np.searchsorted(y, [(t - int(wide.max())) // 2, t // 2 + 1])
        x = t - 2 * y[lo:hi]
        on = np.flatnonzero((x >= 0) & (x < wide[lo:hi]))
        x, w, at = x[on], wide[lo:hi][on], begin[lo:hi][on]
        at = at + x
        own = mode[at]
        for m in np.unique(own).tolist():
            some = np.flatnonzero(own == m)
            a, b = at[some], w[some]
            if m == 0:
                guess = np.array([0, 0, 0, 255], np.int16)
            elif m == 1:
                guess = flat[a - 1]
            elif m == 2:
                guess = flat[a - b]
            else:
                guess = _predicted(m, flat[a - 1], flat[a - b], flat[a - b - 1], flat[np.where(x[some] == b - 1, a - x[some], a - b + 1)])
            flat[a] = (flat[a] + guess) & 255
    return [flat[k : k + n].reshape(c.shape) for k, n, (c, _, _) in zip(first.tolist(), sizes, images, strict=True)]


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross(channels: np.ndarray, factors: np.ndarray, block: int, sign: int) -> np.ndarray:
    height, width, _ = channels.shape
    f = _signed(_channels(factors))[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    out = channels.copy()
    green = _signed(channels[..., 1])
    red = (channels[..., 2] + sign * ((f[..., 0] * green) >> 5)) & 255
    out[..., 2] = red
    source = _signed(red if sign > 0 else channels[..., 2])
    out[..., 0] = (channels[..., 0] + sign * (((f[..., 1] * green) >> 5) + ((f[..., 2] * source) >> 5))) & 255
    return out


def _opened(data: bytes) -> tuple[Bits, int, int, int, list[tuple]]:
    """The bits after the transforms, width before and after them, height, whether there is alpha, and the transforms."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
        if at + 8 > len(data):
            raise Damaged("no lossless image")
    bits = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if bits.read(8) != 0x2F:
        raise Damaged("no lossless image")
    width, height, alpha, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise Damaged("an unknown version")
    transforms, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (t[0] for t in transforms):
            raise Damaged("a transform comes twice")
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            side = lambda n, b=block: (n + (1 << b) - 1) >> b
            transforms.append((kind, block, _image(bits, side(wide), side(height))))
        elif kind == INDEX:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_image(bits, n, 1)), 1)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, pack, _pixels(table)[0], wide))
            wide = (wide + (1 << pack) - 1) >> pack
        else:
            transforms.append((kind,))
    return bits, wide, height, alpha, transforms


def decode_many(files: Sequence[bytes]) -> list[np.ndarray]:
    """The pixels of lossless WebP files: uint32 ARGB of shape (height, width). Damaged if one is none."""
    lanes, place, out, steps = [], [], [np.zeros((0, 0), np.uint32)] * len(files), []
    for k, data in enumerate(files):
        bits, wide, height, alpha, transforms = _opened(data)
        cache_bits, chosen, block = _before_codes(bits, wide, height, True)
        steps.append((alpha, transforms))
        if chosen is None:
            lanes.append(_Lane(bits, wide, height, cache_bits))
            place.append(k)
        else:
            out[k] = _pixel_by_pixel(bits, wide, height, cache_bits, chosen, block, _codes(bits, cache_bits, int(chosen.max()) + 1))
    if lanes:
        for k, pixels in zip(place, _read_lanes(lanes), strict=True):
            out[k] = pixels
    for turn in range(4):  # the last transform is undone first; predictors of all images together
        now = [(k, t[1][-1 - turn]) for k, t in enumerate(steps) if len(t[1]) > turn]
        guessed = [k for k, t in now if t[0] == PREDICTOR]
        for k, t in now:
            if t[0] != PREDICTOR:
                out[k] = _inverted(out[k], t)
        images = [(_channels(out[k]), (t[2] >> 8) & 15, t[1]) for k, t in now if t[0] == PREDICTOR]
        for k, c in zip(guessed, _unpredicted(images), strict=True):
            out[k] = _pixels(c)
    return [x if alpha else x | np.uint32(0xFF000000) for x, (alpha, _) in zip(out, steps, strict=True)]


def _inverted(pixels: np.ndarray, transform: tuple) -> np.ndarray:
    """Pixels before a transform other than the predictor."""
    kind, *rest = transform
    if kind == CROSS:
        return _pixels(_cross(_channels(pixels), rest[1], rest[0], 1))
    if kind == GREEN:
        c = _channels(pixels)
        c[..., 0] += c[..., 1]
        c[..., 2] += c[..., 1]
        return _pixels(c)
    pack, table, full = rest
    index = (pixels >> 8) & 255
    each = 8 >> pack
    index = ((index[:, :, None] >> (np.arange(1 << pack, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(len(pixels), -1)[:, :full]
    return np.concatenate([table, np.zeros(256, np.uint32)])[index]


def decode(data: bytes) -> np.ndarray:
    return decode_many([data])[0]


def transforms_of(data: bytes) -> set[str]:
    """What an image needs of a decoder: its transforms, the colour cache, back-references are not told apart from literals here."""
    bits, wide, height, _, transforms = _opened(data)
    cache_bits, *_ = _head(bits, wide, height, True)
    return {("predictor", "cross", "green", "palette")[t[0]] for t in transforms} | ({"cache"} if cache_bits else set())


# Writing.


def _laid_out(value: np.ndarray, at: np.ndarray) -> bytes:
    """The values' bits at the bits `at`, which rise."""
    shifted, word = value.astype(np.uint64) << (at & 31).astype(np.uint64), at >> 5
    n = int(word[-1]) + 2
    low = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)  # bits never meet: sums are exact
    high = np.bincount(word + 1, (shifted >> np.uint64(32)).astype(np.float64), n)
    return (low + high).astype("<u4").tobytes()


class Writer:
    """Bits, lowest first, as (value, length) pairs that are laid out at once."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self._v: list[int] = []
        self._n: list[int] = []

    def put(self, value: int, n: int) -> None:
        self._v.append(value)
        self._n.append(n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flush()
        self.values.append(values)
        self.sizes.append(sizes)

    def flush(self) -> None:
        self.values.append(np.array(self._v, np.int64))
        self.sizes.append(np.array(self._n, np.int64))
        self._v, self._n = [], []

    def bytes(self) -> bytes:
        self.flush()
        value, size = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(size)
        return _laid_out(value, ends - size)[: (int(ends[-1]) + 7) // 8] if len(ends) else b""


def code_lengths(counts: np.ndarray, limit: int = 15, used: np.ndarray | None = None) -> np.ndarray:
    """Lengths of a complete prefix code for the counts, none over the limit: counts are flattened until it holds."""
    lengths, used = np.zeros(len(counts), np.int64), counts.nonzero()[0] if used is None else used
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    used = used[counts[used].argsort(kind="stable")]
    weight = counts[used].tolist()
    while True:
        # Leaves and sums, each in order of weight; a last one of each that is never taken.
        last = sum(weight) + 1
        leaf, inner, i, j = [*weight, last], [last] * n, 0, 0
        parent = [0] * (2 * n - 1)
        for k in range(n - 1):
            a, b = leaf[i], inner[j]
            if a <= b:
                parent[i], i, first = k, i + 1, a
            else:
                parent[n + j], j, first = k, j + 1, b
            a, b = leaf[i], inner[j] if j < k else last
            if a <= b:
                parent[i], i = k, i + 1
            else:
                parent[n + j], j, a = k, j + 1, b
            inner[k] = first + a
        depth = [0] * (n - 1)
        for k in range(n - 3, -1, -1):
            depth[k] = depth[parent[n + k]] + 1
        deep = [depth[k] + 1 for k in parent[:n]]
        if max(deep) <= limit:
            lengths[used] = deep
            return lengths
        weight = [(w >> 1) + 1 for w in weight]


def _length_symbols(used: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that tell code lengths, and the value of the bits after each: runs of 3 to 138 zeros are one symbol."""
    n = len(used)
    gap = np.empty(n + 1, np.int64)  # zeros before each length, and after the last
    gap[0], gap[n] = used[0], len(lengths) - 1 - used[-1]
    gap[1:n] = np.diff(used) - 1
    full, rest = gap // 138, gap % 138
    run = rest > 2
    size = full + np.where(run, 1, rest) + 1
    ends = size.cumsum()
    sym, extra = np.zeros(int(ends[-1]), np.int64), np.zeros(int(ends[-1]), np.int64)
    sym[ends[:-1] - 1] = lengths[used]
    for k in full.nonzero()[0].tolist():
        at = int(ends[k] - size[k])
        sym[at : at + int(full[k])], extra[at : at + int(full[k])] = 18, 127
    at, part = (ends - 2)[run], rest[run]
    sym[at] = 17 + (part > 10)
    extra[at] = part - np.where(part > 10, 11, 3)
    return sym[:-1], extra[:-1]


class _Code:
    """A prefix code for counts: lengths, codes (none for a lone symbol) and how many bits each symbol takes."""

    def __init__(self, counts: np.ndarray, limit: int = 15):
        self.used = counts.nonzero()[0]
        self.lengths = code_lengths(counts, limit, self.used)
        if len(self.used) > 1:
            self.codes, self.bits = canonical(self.lengths, self.used), self.lengths
        else:
            self.codes = self.bits = np.zeros(len(counts), np.int64)
        self._told: tuple | None = None

    def write(self, out: Writer) -> None:
        used, lengths = self.used, self.lengths
        if self._told:
            head, values, sizes = self._told
            for value, n in head:
                out.put(value, n)
            out.many(values, sizes)
            return
        if len(used) <= 2 and (not len(used) or used[-1] < 256):
            used = used.tolist() or [0]
            out.put(1 | len(used) - 1 << 1 | 4 | used[0] << 3 | (used[1] << 11 if len(used) > 1 else 0), 3 + 8 * len(used))
            return
        sym, extra = _length_symbols(used, lengths)
        own = _Code(np.bincount(sym, minlength=19), 7)
        order = own.lengths[_ORDER].tolist()
        last = max(4, max(k for k in range(19) if order[k]) + 1)
        packed = sum(n << 3 * k for k, n in enumerate(order[:last]))
        head = [(last - 4 << 1, 5), *((packed >> k & ((1 << 30) - 1), min(30, 3 * last - k)) for k in range(0, 3 * last, 30)), (0, 1)]
        size = own.bits[sym]
        self._told = head, own.codes[sym] | extra << size, size + _EXTRA[sym]
        self.write(out)


def _symbol(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, how many) of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    top = value.bit_length() - 1
    second = (value >> (top - 1)) & 1
    return 2 * top + second, value & ((1 << (top - 1)) - 1), top - 1


def _copies(flat: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """(at, length, distance) of back-references, greedily, from a table of the last place of each four pixels."""
    seen: dict[bytes, int] = {}
    raw, out, at, n = flat.astype("<u4").tobytes(), [], 0, len(flat)
    values = flat.tolist()
    while at + least <= n:
        key = raw[4 * at : 4 * (at + least)]
        before = seen.get(key)
        seen[key] = at
        if before is None:
            at += 1
            continue
        k = least
        while at + k < n and k < 4096 and values[before + k] == values[at + k]:
            k += 1
        out.append((at, k, at - before))
        at += k
    return out


def _hits(flat: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot, and whether the last pixel before it in that slot has its colour."""
    slot = _slot(flat, cache_bits).astype(np.int64)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    hit = np.zeros(len(flat), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
    return slot, hit


def _symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, how many) of lengths or distances."""
    got = [_symbol(v) for v in values.tolist()]
    return tuple(np.array(x, np.int64) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3


def _write_image(out: Writer, pixels: np.ndarray, top: bool, copies: bool = False, cache_bits: int = 0) -> None:
    flat = pixels.ravel().astype(np.uint32)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)
    c = _channels(flat)
    found = _copies(flat) if copies else []
    start, length, back = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    token = np.ones(len(flat), bool)  # pixels at which a symbol stands
    for a, n, _ in found:
        token[a + 1 : a + n] = False
    at = token.nonzero()[0] if found else slice(None)
    first = c[at, 1].astype(np.int64)
    copied, cached = np.zeros(len(first), bool), np.zeros(len(first), bool)
    if found:
        copied = np.isin(at, start)
    if cache_bits:
        slot, hit = _hits(flat, cache_bits)
        cached = hit[at] & ~copied
        first[cached] = GREENS + LENGTHS + slot[at][cached]
    (s, more, n), (t, far, m) = _symbols(length), _symbols(back + 120)
    if found:
        first[copied] = GREENS + s
    plain = ~copied & ~cached if copies or cache_bits else slice(None)
    columns = [first, *(c[at, k][plain].astype(np.int64) for k in (2, 0, 3))]
    greens = GREENS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    counts = [np.bincount(x, minlength=n) for x, n in zip((*columns, t), (greens, 256, 256, 256, DISTANCES), strict=True)]
    both = _Code(counts[1] + counts[2], 11)  # red and blue share a code: their values are much alike
    codes = [_Code(counts[0], 11), both, both, _Code(counts[3], 11), _Code(counts[4])]
    for x in codes:
        x.write(out)
    if not found:  # two symbols take 30 bits at most and go as one value
        pairs, sizes = np.zeros((len(first), 2), np.int64), np.zeros((len(first), 2), np.int64)
        pairs[:, 0], sizes[:, 0] = codes[0].codes[first], codes[0].bits[first]
        if len(codes[1].used) > 1:
            red, blue = columns[1], columns[2]
            pairs[plain, 0] |= codes[1].codes[red] << sizes[plain, 0]
            sizes[plain, 0] += codes[1].bits[red]
            pairs[plain, 1], sizes[plain, 1] = codes[2].codes[blue], codes[2].bits[blue]
        if len(codes[3].used) > 1:
            pairs[plain, 1] |= codes[3].codes[columns[3]] << sizes[plain, 1]
            sizes[plain, 1] += codes[3].bits[columns[3]]
        if any(len(x.used) > 1 for x in codes):
            out.many(pairs.ravel(), sizes.ravel())
        return
    values, widths = np.zeros((len(first), 4), np.int64), np.zeros((len(first), 4), np.int64)
    values[:, 0], widths[:, 0] = codes[0].codes[first], codes[0].bits[first]
    for k in (1, 2, 3):
        if len(codes[k].used) > 1:
            values[plain, k], widths[plain, k] = codes[k].codes[columns[k]], codes[k].bits[columns[k]]
    if found:
        values[copied, 1], widths[copied, 1] = more, n
        values[copied, 2], widths[copied, 2] = codes[4].codes[t], codes[4].bits[t]
        values[copied, 3], widths[copied, 3] = far, m
    if any(len(x.used) > 1 for x in codes):
        out.many(values.ravel(), widths.ravel())


def _bits_of(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of an image inside of another one."""
    out = Writer()
    _write_image(out, image, False)
    out.flush()
    return np.concatenate(out.values), np.concatenate(out.sizes)


@lru_cache(4096)
def _known_bits(raw: bytes, height: int) -> tuple[np.ndarray, np.ndarray]:
    return _bits_of(np.frombuffer(raw, np.uint32).reshape(height, -1))


def _inner(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_bits_of(); the same few small images come again and again."""
    return _known_bits(image.tobytes(), len(image)) if image.size <= 64 else _bits_of(image)


def encode(pixels: np.ndarray, predictor: int | None = None, cross: int | None = None, green: bool = False, palette: bool = False, copies: bool = False, cache_bits: int = 0) -> bytes:
    """A lossless WebP file of uint32 ARGB pixels of shape (height, width), each at most 16384.

    predictor: a mode 0 to 13 for the whole image, or -1 for the best of each block; cross: an ARGB word of the three
    factors; palette needs at most 256 colours; copies and cache_bits turn on back-references and the colour cache.
    """
    height, width = pixels.shape
    if not 0 < height <= LIMIT or not 0 < width <= LIMIT:
        raise ValueError("an image has 1 to 16384 rows and columns")
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    block = BLOCK
    side = lambda n: (n + (1 << block) - 1) >> block
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        n = len(colours)
        out.put(1, 1)
        out.put(INDEX, 2)
        out.put(n - 1, 8)
        table = _channels(colours[None, :])
        _write_image(out, _pixels(np.diff(table, axis=1, prepend=0)), False)
        pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        index = index.reshape(height, width)
        index = np.pad(index, ((0, 0), (0, -width % (1 << pack)))).reshape(height, -1, 1 << pack)
        packed = (index << (np.arange(1 << pack) * (8 >> pack))).sum(2)
        pixels = (packed.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
        width = pixels.shape[1]
    if green:
        out.put(1, 1)
        out.put(GREEN, 2)
        c = _channels(pixels)
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
        pixels = _pixels(c)
    if cross is not None:
        out.put(1, 1)
        out.put(CROSS, 2)
        out.put(block - 2, 3)
        factors = np.full((side(height), side(width)), cross, np.uint32)
        out.many(*_inner(factors))
        pixels = _pixels(_cross(_channels(pixels), factors, block, -1))
    if predictor is not None:
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(block - 2, 3)
        c = _channels(pixels).astype(np.int16)
        modes, left = best_modes(c, block) if predictor < 0 else (np.full((side(height), side(width)), predictor), None)
        out.many(*_inner((modes.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)))
        pixels = _pixels(_differences(c, modes, block) if left is None else left)
    out.put(0, 1)
    _write_image(out, pixels, True, copies, cache_bits)
    return _file(out.bytes())


def _file(body: bytes) -> bytes:
    size = len(body)
    body += b"\0" * (size & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body


# Writing many images of one width and form together.


def _best_together(c: np.ndarray, height: np.ndarray, block: int, candidates: Sequence[int] = (0, 1, 2, 7, 11, 12)) -> tuple[np.ndarray, np.ndarray]:
    """best_modes() of images that stand below each other in c, none higher than a block: a row of modes for each."""
    first, cols = np.cumsum(height) - height, np.arange(0, c.shape[1], 1 << block)
    above = np.arange(len(c)) - 1
    above[first] = first + height - 1
    up = c[above]
    up_right = np.roll(up, -1, 1)
    up_right[:, -1] = c[:, 0]
    near, cost, left = (np.roll(c, 1, 1), up, np.roll(up, 1, 1), up_right), [], []
    for m in candidates:
        d = (c - _predicted(m, *near)) & 255
        left.append(d)
        d = np.minimum(d, 256 - d)
        cost.append(np.add.reduceat(np.add.reduceat(d[..., 0] + d[..., 1] + d[..., 2], first, 0, np.int64), cols, 1))
    best, out = np.argmin(np.stack(cost), 0), np.empty_like(c)
    for y, n, own in zip(first.tolist(), height.tolist(), best.tolist(), strict=True):
        for x, k in zip(cols.tolist(), own, strict=True):
            out[y : y + n, x : x + (1 << block)] = left[k][y : y + n, x : x + (1 << block)]
    below = np.ones(len(c), bool)
    below[first] = False
    below = below.nonzero()[0]
    out[first, 1:] = (c[first, 1:] - c[first, :-1]) & 255
    out[below, 0] = (c[below, 0] - c[below - 1, 0]) & 255
    out[first, 0] = (c[first, 0] - np.array([0, 0, 0, 255], c.dtype)) & 255
    return np.asarray(list(candidates))[best], out


class _Codes:
    """Prefix codes for rows of counts, as _Code makes each: codes and bits by row and symbol."""

    def __init__(self, counts: np.ndarray, limit: int):
        self.lengths = np.stack([code_lengths(x, limit) for x in counts])
        self.row, self.used = self.lengths.nonzero()
        self.n = np.bincount(self.row, minlength=len(counts))
        self.codes, self.bits = np.zeros_like(self.lengths), np.where(self.n[:, None] > 1, self.lengths, 0)
        many = self.n[self.row] > 1
        row, used = self.row[many], self.used[many]
        n = self.lengths[row, used]
        order = (row << 4 | n).argsort(kind="stable")
        row, used, n = row[order], used[order], n[order]
        room = _ROOM[n]  # a code's rooms fill all of 15 bits, so each row starts anew
        self.codes[row, used] = _REVERSED[(room.cumsum() - room) & 0x7FFF] & _MASK[n]

    def told(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row, what _Code.write() writes of a code of more than two symbols, as values and sizes."""
        rows, alphabet = self.lengths.shape
        last = (self.n + 1).cumsum() - 1  # after the symbols of each row, its end
        at = np.arange(len(self.row)) + self.row
        used, length = np.full(len(self.row) + rows, alphabet), np.zeros(len(self.row) + rows, np.int64)
        used[at], length[at] = self.used, self.lengths[self.row, self.used]
        gap = np.diff(used, prepend=-1) - 1
        gap[last[:-1] + 1] = used[last[:-1] + 1]
        full, rest = gap // 138, gap % 138
        run = rest > 2
        size = full + np.where(run, 1, rest) + 1
        ends = size.cumsum()
        sym, extra, keep = np.zeros(int(ends[-1]), np.int64), np.zeros(int(ends[-1]), np.int64), np.ones(int(ends[-1]), bool)
        sym[ends - 1] = length
        at = np.repeat(ends - size - full.cumsum() + full, full) + np.arange(int(full.sum()))
        sym[at], extra[at] = 18, 127
        at, part = (ends - 2)[run], rest[run]
        sym[at] = 17 + (part > 10)
        extra[at] = part - np.where(part > 10, 11, 3)
        keep[ends[last] - 1] = False
        row = np.repeat(np.repeat(np.arange(rows), self.n + 1), size)[keep]
        sym, extra = sym[keep], extra[keep]
        own = _Codes(np.bincount(row * 19 + sym, minlength=rows * 19).reshape(rows, 19), 7)
        order = own.lengths[:, _ORDER]
        told = np.maximum(4, 19 - (order[:, ::-1] > 0).argmax(1))
        packed = (order << 3 * np.arange(19)).sum(1)
        head = np.stack([told - 4 << 1, packed & ((1 << 30) - 1), packed >> 30, np.zeros_like(told)], 1)
        heads = np.stack([np.full_like(told, 5), np.minimum(30, 3 * told), np.maximum(0, 3 * told - 30), np.ones_like(told)], 1)
        bits = own.bits[row, sym]
        values, sizes = own.codes[row, sym] | extra << bits, bits + _EXTRA[sym]
        ends = np.bincount(row, minlength=rows).cumsum().tolist()
        return [(np.concatenate([head[k], values[a:b]]), np.concatenate([heads[k], sizes[a:b]])) for k, (a, b) in enumerate(zip([0, *ends], ends))]


def _encode_together(images: list[np.ndarray], form: dict) -> list[bytes]:
    """encode() of up to TOGETHER images of one width, none higher than a block, by one form without copies and palettes."""
    cross, bits, n = form.get("cross"), form.get("cache_bits", 0), len(images)
    height, width = np.array([len(x) for x in images]), images[0].shape[1]
    pixels, one = np.concatenate(images), (1, (width + (1 << BLOCK) - 1) >> BLOCK)
    modes = None
    ahead: list[tuple[np.ndarray, np.ndarray]] = []  # the same for all images, after their heights
    put = lambda *pairs: ahead.append(tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
    if form.get("green"):
        put((1 | GREEN << 1, 3))
        c = _channels(pixels)
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
        pixels = _pixels(c)
    if cross is not None:
        put((1 | CROSS << 1 | BLOCK - 2 << 3, 6))
        ahead.append(_inner(np.full(one, cross, np.uint32)))
        pixels = _pixels(_cross(_channels(pixels), np.full((1, 1), cross, np.uint32), 30, -1))
    if "predictor" in form:
        put((1 | PREDICTOR << 1 | BLOCK - 2 << 3, 6))
        modes, left = _best_together(_channels(pixels).astype(np.int16), height, BLOCK)
        modes, pixels = (modes.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), _pixels(left)
    rest = np.array([bits << 2 | 2 if bits else 0]), np.array([7 if bits else 3])
    flat, ends = np.ascontiguousarray(pixels, "<u4").ravel(), np.cumsum(height * width)
    lane, c = np.repeat(np.arange(n), height * width), flat.view(np.uint8).reshape(-1, 4)
    greens, first, plain, own = GREENS + LENGTHS + ((1 << bits) if bits else 0), c[:, 1].astype(np.int64), slice(None), lane
    if bits:
        slot = _slot(flat, bits).astype(np.int64)
        key = (lane << bits | slot).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        hit = np.zeros(len(flat), bool)
        key, colour = key[order], flat[order]
        hit[order[1:]] = (key[1:] == key[:-1]) & (colour[1:] == colour[:-1])
        first[hit] = GREENS + LENGTHS + slot[hit]
        plain = (~hit).nonzero()[0]
        own = lane[plain]
    blue, red, alpha = (c[plain, k].astype(np.int64) for k in (0, 2, 3))
    counted = lambda where, values, size: np.bincount(where * size + values, minlength=n * size).reshape(n, size)
    of_greens, of_both, of_alpha = counted(lane, first, greens), counted(own, red, 256) + counted(own, blue, 256), counted(own, alpha, 256)
    usual = ((of_greens > 0).sum(1) > 2) & ((of_both > 0).sum(1) > 2) & ((of_alpha > 0).sum(1) == 1)
    if not usual.all():  # codes of few symbols are written otherwise
        strong = iter(_encode_together([x for x, u in zip(images, usual, strict=True) if u], form) if usual.any() else ())
        return [next(strong) if u else encode(x, **form) for x, u in zip(images, usual.tolist(), strict=True)]
    green, both = _Codes(of_greens, 11), _Codes(of_both, 11)
    values, sizes = np.zeros((len(flat), 2), np.int64), np.zeros((len(flat), 2), np.int64)
    values[:, 0], sizes[:, 0] = green.codes[lane, first], green.bits[lane, first]
    values[plain, 0] |= both.codes[own, red] << sizes[plain, 0]
    sizes[plain, 0] += both.bits[own, red]
    values[plain, 1], sizes[plain, 1] = both.codes[own, blue], both.bits[own, blue]
    lone = of_alpha.argmax(1)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    count, start = [], 0
    for k, (a, b, end) in enumerate(zip(green.told(), both.told(), ends.tolist(), strict=True)):
        top = np.array([0x2F | width - 1 << 8, int(height[k]) - 1 | 1 << 14]), np.array([22, 18])
        alone = np.array([5 | int(lone[k]) << 3, 5]), np.array([11, 11])  # alpha's lone symbol; no distances
        lines = values[start:end].ravel(), sizes[start:end].ravel()
        mine = [top, *ahead, *((_inner(modes[k : k + 1]),) if modes is not None else ()), rest, a, b, b, alone, lines]
        count.append(sum(len(x) for x, _ in mine))
        parts += mine
        start = end
    value, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends, upto = size.cumsum(), np.cumsum(count)
    length = np.diff(ends[upto - 1], prepend=0)  # bits of each image, which starts at a word of its own
    word = (length + 31 >> 5).cumsum() - (length + 31 >> 5)
    body = _laid_out(value, ends - size + np.repeat(word * 32 - ends[upto - 1] + length, count))
    return [_file(body[4 * a : 4 * a + (m + 7 >> 3)]) for a, m in zip(word.tolist(), length.tolist(), strict=True)]


def encode_many(images: Sequence[np.ndarray], **form) -> list[bytes]:
    """encode() of each image by the same arguments; images of one width and at most a block's height are written together."""
    together = set(form) <= {"predictor", "cross", "green", "cache_bits"} and form.get("predictor", -1) == -1 and form.get("cache_bits", 0) <= 10
    if not together or len({x.shape[1] for x in images}) != 1 or not all(0 < len(x) <= 1 << BLOCK for x in images) or not 0 < images[0].shape[1] <= LIMIT:
        return [encode(x, **form) for x in images]
    return [x for lo in range(0, len(images), TOGETHER) for x in _encode_together(list(images[lo : lo + TOGETHER]), form)]
