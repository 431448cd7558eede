"""Lossless WebP (VP8L): a complete decoder and an encoder, in numpy.

Decoding an image that has one group of prefix codes takes no step for each pixel: for every bit position at once it is
known where the symbol that would start there ends, so one walk along these ends finds the symbols. Their values, the
distances and the colours are then taken for all of them together. Back-references are copied in turn; in an image with
colour-cache codes they and the codes are pointers to an earlier pixel (a code to the last one with its hash) that are followed
by doubling. Images with several groups
are read symbol by symbol. The transforms are undone whole, except predictors that need their left neighbour.

Pixels are 32-bit numbers, alpha, red, green, blue from the highest byte on. Damaged data raise ValueError.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: the order in which lengths of the code-length code are stored, and the factor of the cache's hash.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
BLACK = 0xFF000000
#: Near neighbours as x, y to the left and up: the nearest first, of equal ones the smaller |x|, the left one before the right one.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
LENGTHS, DISTANCES, MOST_LENGTH = 24, 40, 4096

_reversed: dict[int, np.ndarray] = {}


def _mirror(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse order."""
    if bits not in _reversed:
        out = np.zeros(1, np.int32)
        for _ in range(bits):
            out = np.concatenate((out * 2, out * 2 + 1))
        _reversed[bits] = out
    return _reversed[bits]


def prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix code, number of extra bits and extra bits of numbers from 1 on."""
    if not len(value) or value.max() < len(_few_prefixes[0]):
        return tuple(x[value] for x in _few_prefixes)
    return _prefixes(value)


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    few = v < 4
    extra = np.where(few, 0, high - 1)
    code = np.where(few, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1))
    return code, extra, np.where(few, 0, v & ((1 << extra) - 1))


#: Those of numbers up to the longest copy, looked up.
_few_prefixes = _prefixes(np.maximum(np.arange(MOST_LENGTH + 1), 1))
_code = np.arange(DISTANCES)
EXTRA = np.where(_code < 4, 0, (_code - 2) >> 1)
OFFSET = np.where(_code < 4, _code, (2 + (_code & 1)) << EXTRA) + 1
#: By symbol of the green alphabet: what a length takes besides its code; lengths are told apart by 4096 more.
_length_step = np.zeros(256 + LENGTHS + (1 << 11), np.int32)
_length_step[256 : 256 + LENGTHS] = EXTRA[:LENGTHS] + 4096


class Code:
    """A prefix code: a table by the next `bits` bits of the stream; symbols of a code with one symbol take no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used, size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        elif len(used) == 1:
            size = np.zeros(1, np.int64)
        else:
            size = lengths[used].astype(np.int64)
        self.bits = int(size.max())
        order = np.argsort(size, kind="stable")
        room = 1 << (self.bits - size[order])
        if room.sum() != 1 << self.bits:
            raise ValueError("a prefix code isn't complete")
        at = np.repeat(order, room).take(_mirror(self.bits), mode="clip")
        self.symbol, self.size = used.astype(np.int32).take(at, mode="clip"), size.astype(np.int32).take(at, mode="clip")
        self.mask = (1 << self.bits) - 1


@lru_cache(maxsize=1024)
def _simple(symbols: tuple[int, ...]) -> Code:
    lengths = np.zeros(max(symbols) + 1, np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        return (int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return out

    def symbol(self, code: Code) -> int:
        i = self.peek(code.bits)
        self.at += int(code.size[i])
        return int(code.symbol[i])


def _small_table(lengths: list[int]) -> tuple[list[tuple[int, int]], int]:
    """What `Code` holds, as a list of (bits taken, symbol) by the next bits, and their mask."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [(0, used[0][1] if used else 0)], 0
    bits = used[-1][0]
    table = [u for u in used for _ in range(1 << (bits - u[0]))]
    if len(table) != 1 << bits:
        raise ValueError("a prefix code isn't complete")
    return [table[i] for i in _mirror(bits).tolist()], (1 << bits) - 1


def _read_code(bits: _Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = (bits.read(8 if wide else 1),)
        return _simple((*symbols, bits.read(8)) if two else symbols)
    own = [0] * len(LENGTH_ORDER)
    for i in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[i] = bits.read(3)
    table, mask = _small_table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, last, at = [], 8, bits.at & 7
    base = bits.at - at
    # at most `alphabet` lengths of 14 bits each
    w = int.from_bytes(bits.data[base >> 3 : (base >> 3) + 2 * alphabet + 8], "little") >> at
    while len(lengths) < alphabet and left:
        left -= 1
        n, s = table[w & mask]
        w >>= n
        at += n
        if s < 16:
            lengths.append(s)
            last = s or last
            continue
        n = (2, 3, 7)[s - 16]
        lengths += [last if s == 16 else 0] * ((11 if s == 18 else 3) + (w & ((1 << n) - 1)))
        w >>= n
        at += n
    bits.at = base + at
    if len(lengths) > alphabet or bits.at > 8 * len(bits.data):
        raise ValueError("code lengths run over")
    return Code(np.array(lengths + [0] * (alphabet - len(lengths)), np.int64))


_count = np.arange(1 << 16, dtype=np.int32)


def _numbers(n: int) -> np.ndarray:
    global _count
    if len(_count) < n:
        _count = np.arange(n, dtype=np.int32)
    return _count[:n]


@lru_cache(maxsize=64)
def _near(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in NEAR])


def _distance(code: np.ndarray, width: int) -> np.ndarray:
    far = code - len(NEAR)
    if len(far) and far.min() < 1:
        return np.where(far > 0, far, _near(width)[np.minimum(code, len(NEAR)) - 1])
    return far


def _walk(ahead: np.ndarray, first: int, end: int, n: int, step: np.ndarray, codes: list[Code]) -> tuple[np.ndarray, np.ndarray]:
    """Where the symbols start, at most n, and where they end: the end of what starts at every bit position, and a walk along these ends."""
    green, red, blue, alpha, far = codes
    others = [c for c in (red, blue, alpha) if c.bits]
    after = np.empty(end + 128, np.int32)  # beyond the end every position leads to itself
    after[end:] = np.arange(end, end + 128)
    own = after[:end]
    np.take(step, ahead[:end] & green.mask, out=own, mode="clip")
    at = np.flatnonzero(own >= 4096)
    own += _numbers(end)
    if len(at):
        q = own[at] - 4096
        own[at] = q + (far.size + EXTRA[far.symbol])[ahead[q] & far.mask]
    if others:
        at = np.flatnonzero(green.symbol[ahead[:end] & green.mask] < 256)
        q = own[at]
        for c in others:
            q = q + c.size[ahead[q] & c.mask]
        own[at] = q
    # eight symbols at a time, and then those between
    two = after.take(after, mode="clip")
    four = two.take(two, mode="clip")
    walk, found, p = memoryview(four.take(four, mode="clip")), [], first
    while p < end:
        found.append(p)
        p = walk[p]
    pos = np.empty((len(found), 8), np.int64)
    pos[:, 0] = found
    pos[:, 4] = four[pos[:, 0]]
    pos[:, 2::4] = two[pos[:, ::4]]
    pos[:, 1::2] = after[pos[:, ::2]]
    pos = pos.reshape(-1)
    pos = pos[: np.searchsorted(pos, end)][:n]
    return pos, after[pos]


def _pixels(bits: _Bits, width: int, height: int, cache: int, codes: list[Code]) -> np.ndarray:
    """All pixels of an image with one group of codes."""
    n = width * height
    green, red, blue, alpha, far = codes
    base = bits.at >> 3
    # no symbol takes more than 75 bits
    data = bits.data[base : base + 10 * n + 16]
    padded = data + bytes(36 - len(data) % 4)
    word = np.empty((len(padded) // 4 - 1, 4), np.uint32)
    for k in range(4):
        word[:, k] = np.frombuffer(padded, "<u4", len(word), k)
    ahead = np.empty((word.size, 8), np.uint32)
    for k in range(8):
        np.right_shift(word.reshape(-1), np.uint32(k), out=ahead[:, k])
    ahead = ahead.reshape(-1).view(np.int32)  # the next 25 bits from every bit on
    end = 8 * len(data)
    first = bits.at & 7
    if all(c.bits == 0 for c in (green, red, blue, alpha)) and green.symbol[0] < 256:
        return np.full(n, int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(green.symbol[0]) << 8 | int(blue.symbol[0]), np.uint32)

    others = [c for c in (red, blue, alpha) if c.bits]
    if not green.bits and not others:
        raise ValueError("symbols without bits")
    pos, ends = _walk(ahead, first, end, n, green.size + _length_step[green.symbol], codes)
    w = ahead[pos]
    i = (w & green.mask).astype(np.int64)
    symbol, size = green.symbol[i], green.size[i]
    copy = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTHS))
    count = np.ones(len(pos), np.int64)
    c = symbol[copy] - 256
    count[copy] = OFFSET[c] + ((w[copy] >> size[copy]) & ((1 << EXTRA[c]) - 1))
    start = np.cumsum(count) - count
    have = int(np.searchsorted(start, n))
    if have == len(pos) and (start[-1] + count[-1] if have else 0) < n:
        raise ValueError("the image ends early")
    pos, symbol, size, count, start = (x[:have] for x in (pos, symbol, size, count, start))
    copy, c = copy[: np.searchsorted(copy, have)], c[: np.searchsorted(copy, have)]
    count[-1] = min(count[-1], n - start[-1])
    literal = np.flatnonzero(symbol < 256)

    if not others and len(literal) + len(copy) == have:
        # only green changes: its bytes are copied, and then made pixels
        samples = np.zeros(n, np.uint8)
        samples[start[literal]] = symbol[literal]
        if len(copy):
            samples = bytearray(samples)
            _copy(samples, start[copy], count[copy], _distances(ahead, pos[copy] + size[copy] + EXTRA[c], far, start[copy], width))
        bits.at = 8 * base + int(ends[have - 1])
        return np.frombuffer(samples, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(blue.symbol[0]))
    out = np.zeros(n, np.uint32)
    q = pos[literal] + size[literal]
    value = symbol[literal].astype(np.uint32) << np.uint32(8)
    for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
        if not code.bits:
            value |= np.uint32(int(code.symbol[0]) << shift)
            continue
        i = ahead[q] & code.mask
        value |= code.symbol[i].astype(np.uint32) << np.uint32(shift)
        q = q + code.size[i]
    out[start[literal]] = value
    cached = np.flatnonzero(symbol >= 256 + LENGTHS)
    to, source = np.empty(0, np.int64), None
    if len(cached):
        source = np.arange(n)
    if len(copy):
        dist = _distances(ahead, pos[copy] + size[copy] + EXTRA[c], far, start[copy], width)
        m = count[copy]
        if source is None:
            _copy(memoryview(out), start[copy], m, dist)
        else:
            to = np.repeat(start[copy] - np.cumsum(m) + m, m) + np.arange(m.sum())
            source[to] = to - np.repeat(dist, m)
    if source is not None:  # a cache code before any pixel with its hash: transparent black
        _point_cached(source, out, start[cached], symbol[cached] - 256 - LENGTHS, cache, to)
        _follow(source, np.concatenate((to, start[cached])))
        out = np.where(source < 0, np.uint32(0), out[source])
    bits.at = 8 * base + int(ends[have - 1])
    return out


def _distances(ahead: np.ndarray, at: np.ndarray, far: Code, start: np.ndarray, width: int) -> np.ndarray:
    """How far back the copies at `start` reach, whose distances are told from the bits `at` on."""
    i = ahead[at] & far.mask
    s = far.symbol[i]
    dist = _distance(OFFSET[s] + (ahead[at + far.size[i]] & ((1 << EXTRA[s]) - 1)), width)
    if (dist > start).any():
        raise ValueError("a copy from before the image")
    return dist


def _copy(pixels: np.ndarray | memoryview | bytearray, start: np.ndarray, length: np.ndarray, back: np.ndarray) -> None:
    """Copies earlier pixels, one copy after the other; one that runs into itself repeats what it has."""
    for a, m, d in zip(start.tolist(), length.tolist(), back.tolist(), strict=True):
        while m > d:
            pixels[a : a + d] = pixels[a - d : a]
            a, m, d = a + d, m - d, 2 * d
        pixels[a : a + m] = pixels[a - d : a - d + m]


def _follow(source: np.ndarray, at: np.ndarray) -> None:
    """Follows pointers to earlier pixels to their ends."""
    now = source[at]
    while True:
        new = np.where(now < 0, now, source[now])
        moved = np.flatnonzero(new != now)
        if not len(moved):
            return
        # those at their ends stay there
        at, now = at[moved], new[moved]
        source[at] = now


def _point_cached(source: np.ndarray, out: np.ndarray, at: np.ndarray, slot: np.ndarray, cache: int, copied: np.ndarray) -> None:
    """Points each cache code to the last pixel before it whose hash is the code. Hashes of copies are those of what they copy; a code is its own hash."""
    own = source.copy()
    _follow(own, copied)
    hashes = (out * np.uint32(HASH) >> np.uint32(32 - cache)).astype(np.int64)
    hashes[at] = slot
    hashes = hashes[own]
    order = np.lexsort((np.arange(len(hashes)), hashes))
    before = np.empty(len(hashes), np.int64)
    before[order[1:]] = np.where(hashes[order[1:]] == hashes[order[:-1]], order[:-1], -1)
    before[order[0]] = -1
    source[at] = before[at]


def _pixels_by_group(bits: _Bits, width: int, height: int, cache: int, groups: list[list[Code]], of: np.ndarray, tile: int) -> np.ndarray:
    """All pixels of an image whose tiles name their group of codes, symbol by symbol."""
    n = width * height
    out, recent, kept, i = np.zeros(n, np.uint32), np.zeros(1 << cache, np.uint32), 0, 0

    def keep(upto: int) -> None:
        nonlocal kept
        if cache:
            for v in out[kept:upto].tolist():
                recent[(v * HASH & 0xFFFFFFFF) >> (32 - cache)] = v
        kept = upto

    while i < n:
        green, red, blue, alpha, far = groups[of[(i // width) >> tile, (i % width) >> tile]]
        s = bits.symbol(green)
        if s < 256:
            r, b, a = bits.symbol(red), bits.symbol(blue), bits.symbol(alpha)
            out[i] = a << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 256 + LENGTHS:
            m = int(OFFSET[s - 256]) + bits.read(int(EXTRA[s - 256]))
            t = bits.symbol(far)
            d = int(_distance(np.array([OFFSET[t] + bits.read(int(EXTRA[t]))]), width)[0])
            if d > i:
                raise ValueError("a copy from before the image")
            m = min(m, n - i)
            for k in range(i, i + m):
                out[k] = out[k - d]
            i += m
        else:
            keep(i)
            out[i] = recent[s - 256 - LENGTHS]
            i += 1
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
    return out


def _image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache = 0
    if bits.read(1):
        cache = bits.read(4)
        if not 1 <= cache <= 11:
            raise ValueError("a colour cache of a wrong size")
    groups, of, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across, down = -(-width >> tile), -(-height >> tile)
        of = (_image(bits, across, down, False).reshape(down, across) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(of.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache if cache else 0), 256, 256, 256, DISTANCES)
    codes = [[_read_code(bits, a) for a in sizes] for _ in range(groups)]
    if groups == 1:
        return _pixels(bits, width, height, cache, codes[0])
    return _pixels_by_group(bits, width, height, cache, codes, of, tile)


def _bytes(argb: np.ndarray) -> np.ndarray:
    """Pixels as bytes blue, green, red, alpha in a last dimension."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _pack(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts, np.uint8).view("<u4")[..., 0]


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _select(left, top, corner):
    by_left, by_top = np.abs(top - corner).sum(axis=-1), np.abs(left - corner).sum(axis=-1)
    return np.where((by_left < by_top)[..., None], left, top)


#: From the left, upper, upper right and upper left neighbours (whole numbers), mode 1 to 13.
PREDICTORS = {
    1: lambda le, t, tr, tl: le,
    2: lambda le, t, tr, tl: t,
    3: lambda le, t, tr, tl: tr,
    4: lambda le, t, tr, tl: tl,
    5: lambda le, t, tr, tl: _average(_average(le, tr), t),
    6: lambda le, t, tr, tl: _average(le, tl),
    7: lambda le, t, tr, tl: _average(le, t),
    8: lambda le, t, tr, tl: _average(tl, t),
    9: lambda le, t, tr, tl: _average(t, tr),
    10: lambda le, t, tr, tl: _average(_average(le, tl), _average(t, tr)),
    11: lambda le, t, tr, tl: _select(le, t, tl),
    12: lambda le, t, tr, tl: np.clip(le + t - tl, 0, 255),
    13: lambda le, t, tr, tl: np.clip(_average(le, t) + np.fix((_average(le, t) - tl) / 2).astype(np.int32), 0, 255),
}
FREE_OF_LEFT = {0, 2, 3, 4, 8, 9, 14, 15}


def _opaque(shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros((*shape, 4), np.int32)
    out[..., 3] = 255
    return out


def unpredict(residual: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Pixels from residuals, a row at a time; modes by tile. The first pixel is predicted as black, the first row from the left, the first column from above."""
    height, width = residual.shape
    out = _bytes(residual).astype(np.int32)
    out[0, 0, 3] = (out[0, 0, 3] + 255) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, up = out[y], out[y - 1]
        row[0] = (row[0] + up[0]) & 255
        right = np.concatenate((up[1:], row[:1]))
        x = 1
        while x < width:
            mode = int(modes[y >> tile, x >> tile])
            end = x
            while end < width and modes[y >> tile, end >> tile] == mode:
                end = min(width, ((end >> tile) + 1) << tile)
            if mode in FREE_OF_LEFT:
                guess = PREDICTORS[mode](None, up[x:end], right[x:end], up[x - 1 : end - 1]) if 2 <= mode <= 9 else _opaque((end - x,))
                row[x:end] = (row[x:end] + guess) & 255
            elif mode == 1:
                row[x - 1 : end] = np.cumsum(row[x - 1 : end], axis=0) & 255
            else:
                guess = PREDICTORS[mode]
                for i in range(x, end):
                    row[i] = (row[i] + guess(row[i - 1], up[i], right[i], up[i - 1])) & 255
            x = end
    return _pack(out.astype(np.uint8))


def predict(argb: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """What unpredict gives back the pixels from."""
    height, width = argb.shape
    p = _bytes(argb).astype(np.int32)
    guess = _opaque((height, width))
    guess[0, 1:] = p[0, :-1]
    guess[1:, 0] = p[:-1, 0]
    if height > 1 and width > 1:
        up = p[:-1]
        right = np.concatenate((up[:, 1:], p[1:, :1]), axis=1)
        mode = np.repeat(np.repeat(modes, 1 << tile, axis=0), 1 << tile, axis=1)[1:height, 1:width]
        for m in np.unique(mode).tolist():
            at = mode == m
            if m in PREDICTORS:
                guess[1:, 1:][at] = PREDICTORS[m](p[1:, :-1], up[:, 1:], right[:, 1:], up[:, :-1])[at]
    return _pack(((p - guess) & 255).astype(np.uint8))


def _crossed(argb: np.ndarray, elements: np.ndarray, tile: int, back: bool) -> np.ndarray:
    """Takes out of red and blue what the elements of the tiles (red to blue, green to blue, green to red as red, green, blue) foretell, or puts it back."""
    height, width = argb.shape
    p = _bytes(argb)
    e = _bytes(np.repeat(np.repeat(elements, 1 << tile, axis=0), 1 << tile, axis=1)[:height, :width]).view(np.int8).astype(np.int32)
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(p[..., 1]), p[..., 2].astype(np.int32), p[..., 0].astype(np.int32)
    sign = 1 if back else -1
    new = (red + sign * (e[..., 0] * green >> 5)) & 255
    blue = (blue + sign * ((e[..., 1] * green >> 5) + (e[..., 2] * signed(new if back else red) >> 5))) & 255
    out = p.copy()
    out[..., 2], out[..., 0] = new, blue
    return _pack(out)


def _green_added(argb: np.ndarray, sign: int) -> np.ndarray:
    green = (argb >> np.uint32(8)) & np.uint32(255)
    if sign < 0:
        green = np.uint32(256) - green
    sides = np.uint32(0x00FF00FF)
    return (argb & ~sides) | (((argb & sides) + green * np.uint32(0x00010001)) & sides)


def _bundle(colours: int) -> int:
    """How many pixels go into one, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(argb: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    fold = _bundle(len(colours))
    index = (argb >> np.uint32(8)) & np.uint32(255)
    each = 8 >> fold
    x = np.arange(width)
    index = (index[:, x >> fold] >> ((x & ((1 << fold) - 1)) * each).astype(np.uint32)) & np.uint32((1 << each) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels (rows x columns) of one lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if data[20] != 0x2F or 20 + size > len(data):
        raise ValueError("no whole image in the file")
    bits = _Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(u[0] == kind for u in undo):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            across, down = -(-now >> tile), -(-height >> tile)
            undo.append((kind, now, _image(bits, across, down, False).reshape(down, across), tile))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = _pack(np.cumsum(_bytes(_image(bits, n, 1, False)).astype(np.int64), axis=0).astype(np.uint8))
            undo.append((kind, now, colours, 0))
            now = -(-now >> _bundle(n))
        else:
            undo.append((kind, now, None, 0))
    argb = _image(bits, now, height, True).reshape(height, now)
    for kind, own, extra, tile in reversed(undo):
        if kind == PREDICTOR:
            argb = unpredict(argb, (extra >> np.uint32(8)) & np.uint32(15), tile)
        elif kind == CROSS_COLOUR:
            argb = _crossed(argb, extra, tile, True)
        elif kind == SUBTRACT_GREEN:
            argb = _green_added(argb, 1)
        else:
            argb = _unpalette(argb, extra, own)
    return argb


# ---- writing


class _Out:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_all(self, value: np.ndarray, size: np.ndarray) -> None:
        """Items of up to 33 bits, one after the other."""
        at = np.cumsum(size) - size
        total = int(at[-1] + size[-1]) if len(at) else 0
        word = at >> 5
        x = value.astype(np.uint64) << (at & 31).astype(np.uint64)
        n = total // 32 + 2
        # the bits of a word are disjoint, so their sum is under 2^32 and exact in a float
        low = np.bincount(word, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), n) + np.bincount(word + 1, (x >> np.uint64(32)).astype(np.float64), n)
        self.put(int.from_bytes(low.astype("<u4").tobytes(), "little"), total)

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def lengths_of(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a Huffman code for symbols with these counts, none over `most`; rare symbols count for more until it fits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weight, kind="stable")
        w = weight[order].tolist()
        n = len(w)
        # leaves, then merged nodes in the order of their making; none that isn't there is ever least
        none = 1 << 62
        w += [none] * n
        parent = [0] * (2 * n - 1)
        w.insert(n, none)
        a, b = 0, n + 1  # the least leaf and the least merged node that are free
        for new in range(n, 2 * n - 1):
            x, y = w[a], w[b]
            if x <= y:
                parent[a] = new
                a += 1
                total, x = x, w[a]
            else:
                parent[b - 1] = new
                b += 1
                total, y = y, w[b]
            if x <= y:
                parent[a] = new
                a += 1
                total += x
            else:
                parent[b - 1] = new
                b += 1
                total += y
            w[new + 1] = total
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= most:
            out[used[order]] = depth[:n]
            return out
        weight = weight // 2 + max(1, int(weight.sum()) >> most)


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The code of every symbol, its first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    size = lengths[order]
    if len(order) > 1:
        most = int(size[-1])
        room = 1 << (most - size)
        out[order] = _mirror(most)[np.cumsum(room) - room] & ((1 << size) - 1)
    return out


def _few_codes(lengths: list[int]) -> list[int]:
    """`codes_of` for a short list."""
    out, used = [0] * len(lengths), sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) > 1:
        most, at = used[-1][0], 0
        mirror = _mirror(most)
        for n, s in used:
            out[s] = int(mirror[at]) & ((1 << n) - 1)
            at += 1 << (most - n)
    return out


def _write_code(out: _Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for symbols with these counts; gives the code and its length for every symbol."""
    used = np.flatnonzero(counts).tolist()
    nothing = np.zeros(len(counts), np.int64)
    if len(used) <= 1 and (not used or used[0] < 256):
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(used[0] if used else 0, 8)
        return nothing, nothing
    lengths = lengths_of(counts, 15)
    items: list[tuple[int, int, int]] = []  # symbol of the code-length code, extra bits and their number
    edges = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    for value, at, end in zip(lengths[edges[:-1]].tolist(), edges, edges[1:], strict=False):
        n = end - at
        if n == 1:
            items.append((value, 0, 0))
            continue
        if value:
            items.append((value, 0, 0))
            n -= 1
            while n >= 3:
                m = min(n, 6)
                items.append((16, m - 3, 2))
                n -= m
        else:
            while n >= 3:
                m = min(n, 138)
                items.append((18, m - 11, 7) if m >= 11 else (17, m - 3, 3))
                n -= m
        items += [(value, 0, 0)] * n
    while items and items[-1][0] in (0, 17, 18):  # zeros at the end need not be told
        items.pop()
    own = lengths_of(np.bincount([i[0] for i in items], minlength=len(LENGTH_ORDER)), 7)
    own = own.tolist()
    code = _few_codes(own)
    out.put(0, 1)
    told = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if own[s]))
    out.put(told - 4, 4)
    for s in LENGTH_ORDER[:told]:
        out.put(own[s], 3)
    out.put(1, 1)
    room = max(2, (len(items) - 2).bit_length() + (len(items) - 2).bit_length() % 2)
    out.put((room - 2) // 2, 3)
    out.put(len(items) - 2, room)
    value, size = 0, 0
    cheap = [0] * len(own) if own.count(0) == len(own) - 1 else own  # a single symbol takes no bits
    for s, extra, n in items:
        value |= (code[s] | extra << cheap[s]) << size
        size += cheap[s] + n
    out.put(value, size)
    if len(used) == 1:
        return nothing, nothing
    return np.array(_few_codes(lengths.tolist())) if len(lengths) <= 64 else codes_of(lengths), lengths


GRAM = 5
_log2 = np.log2(np.maximum(np.arange(1 << 14), 1))


def copies(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, distance of copies of earlier runs of pixels, in order and apart from each other.

    Every run of GRAM pixels points to the last equal one; where neighbours point equally far back, they are one copy.
    """
    n = len(pixels) - GRAM + 1
    nothing = np.empty(0, np.int64)
    if n < 2:
        return nothing, nothing, nothing
    value = pixels.astype(np.uint64)
    if pixels.max() < 256:
        two = value[:-1] << np.uint64(8) | value[1:]
        key = (two[:-2] << np.uint64(16) | two[2:])[:n] << np.uint64(8) | value[GRAM - 1 :]
        exact = True
    else:
        key = np.zeros(n, np.uint64)
        for j in range(GRAM):
            key = key * np.uint64(0x9E3779B97F4A7C15) + value[j : j + n]
        key, exact = key >> np.uint64(20), False
    key = np.sort(key << np.uint64(20) | np.arange(n, dtype=np.uint64)) if exact else np.sort((key << np.uint64(20)) | np.arange(n, dtype=np.uint64))
    at = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    same = np.flatnonzero((key[1:] ^ key[:-1]) < np.uint64(1 << 20))
    back = np.zeros(n + 1, np.int64)
    back[at[same + 1]] = at[same + 1] - at[same]
    if not exact and len(same):
        here = np.flatnonzero(back)
        ok = np.ones(len(here), bool)
        for j in range(GRAM):
            ok &= pixels[here + j] == pixels[here - back[here] + j]
        back[here[~ok]] = 0
    edge = np.flatnonzero(back[1:] != back[:-1]) + 1  # the first run has none before it
    some = np.flatnonzero(back[edge])
    first, edge = edge[some], np.append(edge, n)
    end = edge[some + 1] + GRAM - 1
    start = np.maximum(first, np.concatenate(([0], end[:-1])))
    dist, length = back[first], end - start
    # a copy has to be worth more than its literals
    far = dist + len(NEAR)
    cost = _log2[far] if len(far) and far.max() < len(_log2) else np.log2(far)
    worth = np.flatnonzero((length > 1) & (length * 9 > 2 * (11 + cost)))
    start, length, dist = start[worth], length[worth], dist[worth]
    parts = -(-length // MOST_LENGTH)
    if len(parts) and parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, length, dist = np.repeat(start, parts) + k * MOST_LENGTH, np.repeat(length, parts) - k * MOST_LENGTH, np.repeat(dist, parts)
        length = np.minimum(length, MOST_LENGTH)
    return start, length, dist


def _write_image(out: _Out, argb: np.ndarray, main: bool, cache: int = 0) -> None:
    flat = argb.reshape(-1)
    n = len(flat)
    if n > 1 << 20:
        raise ValueError("over 2^20 pixels")
    out.put(cache << 1 | 1 if cache else 0, 5 if cache else 1)
    if main:
        out.put(0, 1)
    green = (flat >> np.uint32(8)) & np.uint32(255)
    plain = bool((flat == flat[0] & np.uint32(0xFFFF00FF) | green << np.uint32(8)).all())  # the other parts never change
    start, length, dist = copies(green if plain else flat)
    if plain and not cache and (len(length) == 0 or length.min() > 1):
        _write_plain(out, green, int(flat[0]), start, length, dist)
        return
    begins = np.zeros(n + 1, np.int64)
    begins[start] = 1
    covered = np.zeros(n + 1, np.int64)
    covered[start] += 1
    np.add.at(covered, start + length, -1)
    covered = np.cumsum(covered)[:n] > 0
    at = np.flatnonzero(~covered | (begins[:n] > 0))
    copy = begins[at] > 0
    code_l, extra_l, bits_l = prefixes(length)
    code_d, extra_d, bits_d = prefixes(dist + len(NEAR))
    symbol = green[at].astype(np.int64)
    symbol[copy] = 256 + code_l
    cached = np.zeros(len(at), bool)
    if cache:
        hashes = flat * np.uint32(HASH) >> np.uint32(32 - cache)
        order = np.lexsort((np.arange(n), hashes))
        before = np.full(n, -1)
        before[order[1:]] = np.where(hashes[order[1:]] == hashes[order[:-1]], order[:-1], -1)
        known = (before >= 0) & (flat[np.maximum(before, 0)] == flat)
        cached = known[at] & ~copy
        symbol[cached] = 256 + LENGTHS + hashes[at[cached]]
    literal = ~copy & ~cached
    codes = [_write_code(out, np.bincount(symbol, minlength=256 + LENGTHS + (1 << cache if cache else 0)))]
    parts = []
    if plain:
        for s in (16, 0, 24):  # one symbol each
            out.put(5 | (int(flat[0]) >> s & 255) << 3, 11)
    else:
        parts = [(flat[at[literal]] >> np.uint32(s)) & np.uint32(255) for s in (16, 0, 24)]
        codes += [_write_code(out, np.bincount(p, minlength=256)) for p in parts]
    far = _write_code(out, np.bincount(code_d, minlength=DISTANCES))
    width = 1 + len(parts) + 1
    value, size = np.zeros((len(at), width), np.int64), np.zeros((len(at), width), np.int64)
    code, lengths = codes[0]
    value[:, 0], size[:, 0] = code[symbol], lengths[symbol]
    value[copy, 0] |= bits_l << size[copy, 0]
    size[copy, 0] += extra_l
    if width > 2:
        for k, ((code, lengths), p) in enumerate(zip(codes[1:], parts, strict=True)):
            value[literal, 1 + k], size[literal, 1 + k] = code[p], lengths[p]
    code, lengths = far
    value[copy, -1] = code[code_d] | bits_d << lengths[code_d]
    size[copy, -1] = lengths[code_d] + extra_d
    if width == 2 and not copy.any():
        out.put_all(value[:, 0], size[:, 0])
    else:
        value, size = value.reshape(-1), size.reshape(-1)
        some = size > 0
        out.put_all(value[some], size[some])


def _write_plain(out: _Out, green: np.ndarray, pixel: int, start: np.ndarray, length: np.ndarray, dist: np.ndarray) -> None:
    """Codes and symbols of an image of which only green changes, with copies of two pixels or more."""
    code_l, extra_l, bits_l = prefixes(length)
    code_d, extra_d, bits_d = prefixes(dist + len(NEAR))
    # a copy's first two pixels stand for its length and its distance, which have numbers after the green alphabet's
    told = np.ones(len(green), bool)
    if len(start):
        runs = np.empty((len(start), 2), np.int64)
        runs[:, 1] = length - 2
        runs[0, 0] = start[0] + 2
        runs[1:, 0] = start[1:] - start[:-1] - length[:-1] + 2
        runs = runs.reshape(-1)
        told[: start[-1] + length[-1]] = np.repeat(np.arange(len(runs)) & 1 == 0, runs)
    symbol = green[told].astype(np.int64)
    far = 256 + LENGTHS
    at = start - np.cumsum(length) + length + 2 * np.arange(len(start))
    after = at + 1
    symbol[at] = 256 + code_l
    symbol[after] = far + code_d
    counts = np.bincount(symbol, minlength=far + DISTANCES)
    first = _write_code(out, counts[:far])
    for s in (16, 0, 24):  # one symbol each
        out.put(5 | (pixel >> s & 255) << 3, 11)
    code, lengths = (np.concatenate(x) for x in zip(first, _write_code(out, counts[far:]), strict=True))
    value, size = code[symbol], lengths[symbol]
    for place, bits, extra in ((at, bits_l, extra_l), (after, bits_d, extra_d)):
        own = size[place]
        value[place] |= bits << own
        size[place] = own + extra
    out.put_all(value, size)


def encode(argb: np.ndarray, *, palette: bool = False, predictor: tuple[np.ndarray, int] | None = None, cross: tuple[np.ndarray, int] | None = None, subtract_green: bool = False, cache: int = 0) -> bytes:
    """A lossless WebP file of pixels (rows x columns, at most 2^20 of them), with the transforms asked for: predictor modes and cross-colour elements come by tile with the tile's power of two."""
    height, width = argb.shape
    if not (1 <= width <= 1 << 14 and 1 <= height <= 1 << 14):
        raise ValueError("too wide or too high")
    out = _Out()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int((argb >> np.uint32(24)).min() < 255), 1)
    out.put(0, 3)
    if palette:
        colours, index = np.unique(argb, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("over 256 colours")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        steps = _bytes(colours)
        _write_image(out, _pack(np.diff(steps.astype(np.int32), axis=0, prepend=np.zeros((1, 4), np.int32)).astype(np.uint8)).reshape(1, -1), False)
        fold = _bundle(len(colours))
        index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % (1 << fold)))).reshape(height, -1, 1 << fold)
        argb = ((index << (np.arange(1 << fold) * (8 >> fold))).sum(axis=2).astype(np.uint32) << np.uint32(8)) | np.uint32(BLACK)
    for kind, with_tiles in ((PREDICTOR, predictor), (CROSS_COLOUR, cross)):
        if with_tiles is not None:
            elements, tile = with_tiles
            out.put(1 | kind << 1 | (tile - 2) << 3, 6)
            if kind == PREDICTOR:
                argb = predict(argb, elements, tile)
                elements = np.uint32(BLACK) | elements.astype(np.uint32) << np.uint32(8)
            else:
                argb = _crossed(argb, elements, tile, False)
            _write_image(out, elements, False)
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        argb = _green_added(argb, -1)
    out.put(0, 1)
    _write_image(out, argb, True, cache)
    body = b"\x2f" + out.bytes()
    odd = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(odd)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + odd
