"""Lossless WebP (VP8L) in numpy: a decoder of the whole format, and an encoder that tests and media columns use.

The decoder finds, for every bit of a span at once, where a pixel that began there would end, then follows these steps
from pixel to pixel; symbols, literals and extra bits are gathered at the places met. Only images with several prefix
code groups are read pixel by pixel.
"""

from __future__ import annotations

import struct
from collections import Counter
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTHS, DISTANCES, LITERALS = 24, 40, 256
CACHE_FACTOR = np.uint32(0x1E35A7BD)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Short distance codes: the offsets (x to the left, y up) of the nearest 120 earlier pixels, from near to far.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
MAX_CODE, SPAN_BITS = 15, 1 << 20

_EXTRA = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(DISTANCES)], np.int64)
_OFFSET = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(DISTANCES)], np.int64)


class Code:
    """A prefix code as two tables over the next 15 bits: symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if len(used) <= 1:
            self.symbol = np.full(1, used[0] if len(used) else 0, np.int16)
            self.length, self.bits, self.refers = np.zeros(1, np.uint8), 0, False
            self.step = self.length
            return
        self.bits = int(lengths.max())
        order = used[lengths[used].argsort(kind="stable")]
        share = np.left_shift(1, self.bits - lengths[order])
        if share.sum() != 1 << self.bits:
            raise ValueError("incomplete prefix code")
        self.symbol = order.astype(np.int16).repeat(share)[reversal(self.bits)]
        own = lengths.astype(np.uint8)
        self.length = self.step = own[self.symbol]
        self.refers = bool(own[LITERALS : LITERALS + LENGTHS].any())
        if self.refers:  # 0 marks the back-references of a green code, which end elsewhere
            own[LITERALS : LITERALS + LENGTHS] = 0
            self.step = own[self.symbol]

    def at(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = windows & ((1 << self.bits) - 1)
        return self.symbol[k], self.length[k]


@lru_cache(maxsize=LITERALS)
def lone(symbol: int) -> Code:
    """The code of one symbol, which takes no bits."""
    lengths = np.zeros(symbol + 1, np.int64)
    lengths[symbol] = 1
    return Code(lengths)


@lru_cache
def reversal(n: int) -> np.ndarray:
    """All numbers of n bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, with the bits in the order in which the stream holds them."""
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(used):
        order = used[np.argsort(lengths[used], kind="stable")]
        most = int(lengths.max())
        share = np.left_shift(1, most - lengths[order])
        codes[order] = reversal(most)[np.cumsum(share) - share]
    return codes


class Bits:
    """Bits of a stream, lowest first; ``windows`` gives the 32 bits from each of many places."""

    def __init__(self, data: bytes):
        self.data = data
        self.size = 8 * len(data)
        # the 64 bits from each byte, none of them copied
        self.words = np.ndarray(len(data) + 4, "<u8", data + bytes(12), strides=(1,))
        self.at = 0

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the stream ends early")
        got = int(self.words[self.at >> 3]) >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got

    def held(self) -> int:
        """The next bits as one number, 1,024 of them or more; zeros follow the stream."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 129], "little") >> (self.at & 7)

    def peek(self) -> int:
        return int(self.words[min(self.at >> 3, len(self.words) - 1)]) >> (self.at & 7)

    def windows(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 3] >> (places & 7).astype(np.uint64)).astype(np.int64) & 0xFFFFFFFF

    def span(self, lo: int, hi: int) -> np.ndarray:
        """16 bits from each place from lo to hi, where lo is a multiple of 8."""
        words = self.words[lo >> 3 : -(-hi // 8)].astype(np.uint32)
        out = np.empty((len(words), 8), np.uint16)
        for k in range(8):
            out[:, k] = words >> np.uint32(k)
        return out.reshape(-1)


def _small_code(lengths: list[int]) -> tuple[list[int], list[int], int]:
    """The code of code lengths as lists over the next bits: symbol and length; and the mask of those bits."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) <= 1:
        return [used[0][1] if used else 0], [0], 0
    most, code = used[-1][0], 0
    symbol, length, turned = [0] * (1 << most), [0] * (1 << most), reversal(most).tolist()
    for n, s in used:
        share = 1 << most - n
        if code + share > 1 << most:
            raise ValueError("incomplete prefix code")
        symbol[turned[code] :: 1 << n], length[turned[code] :: 1 << n] = [s] * share, [n] * share
        code += share
    if code != 1 << most:
        raise ValueError("incomplete prefix code")
    return symbol, length, (1 << most) - 1


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            if first >= alphabet:
                raise ValueError("a symbol outside its alphabet")
            return lone(first)
        lengths = np.zeros(alphabet, np.int64)
        second = bits.read(8)
        if max(first, second) >= alphabet:
            raise ValueError("a symbol outside its alphabet")
        lengths[[first, second]] = 1
        return Code(lengths)
    own, n, held = [0] * 19, 4 + bits.read(4), bits.held()
    for k in range(n):
        own[CODE_LENGTH_ORDER[k]] = held >> 3 * k & 7
    bits.at += 3 * n
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbol, length, mask = _small_code(own)
    got, before, held, at = [], 8, bits.held(), 0
    while len(got) < alphabet and most:
        most -= 1
        if at > 1000:
            bits.at += at
            held, at = bits.held(), 0
        k = held >> at & mask
        at += length[k]
        v = symbol[k]
        if v < 16:
            got.append(v)
            before = v or before
        else:
            value, least, n = (before, 3, 2) if v == 16 else (0, 3, 3) if v == 17 else (0, 11, 7)
            got += [value] * (least + (held >> at & (1 << n) - 1))
            at += n
    bits.at += at
    if len(got) > alphabet:
        raise ValueError("too many code lengths")
    if bits.at > bits.size:
        raise ValueError("the stream ends early")
    lengths = np.zeros(alphabet, np.int64)
    lengths[: len(got)] = got
    return Code(lengths)


def _distance(codes: np.ndarray, width: int) -> np.ndarray:
    near = np.array([max(x + y * width, 1) for x, y in NEAR])
    return np.where(codes > len(NEAR), codes - len(NEAR), near[np.minimum(codes, len(NEAR)) - 1])


def _cache_keys(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return (argb * CACHE_FACTOR) >> np.uint32(32 - cache_bits)


class _Canvas:
    """Pixels being filled in stream order, with the colour cache."""

    def __init__(self, n: int, cache_bits: int):
        self.out, self.cache_bits, self.cached = np.zeros(n, np.uint32), cache_bits, 0
        self.cache = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None

    def copy(self, at: int, length: int, distance: int) -> None:
        if distance > at or at + length > len(self.out):
            raise ValueError("a back-reference leaves the image")
        src = self.out[at - distance : at - distance + length]
        self.out[at : at + length] = src if distance >= length else np.resize(self.out[at - distance : at], length)

    def recall(self, at: int, key: int) -> None:
        part = self.out[self.cached : at]
        self.cache[_cache_keys(part, self.cache_bits)] = part  # of equal keys the last stays
        self.cached = at
        self.out[at] = self.cache[key]


def _chain(step: np.ndarray, p: int) -> tuple[np.ndarray, int]:
    """The places that steps (of at most 60) lead to from ``p``, and the first beyond the last; walked by four at a time."""
    last, places = len(step), np.arange(len(step))
    one, two = np.zeros((2, last + 256), np.uint8)
    one[:last] = step
    two[:last] = step + one.take(places + step)
    hops, marks = (two[:last] + two.take(places + two[:last])).tobytes(), bytearray(last)
    while p < last:
        marks[p] = 1
        p += hops[p]
    begins = np.frombuffer(marks, bool).nonzero()[0]
    met = np.empty((len(begins), 4), np.int64)
    met[:, 0] = begins
    met[:, 2] = begins + two[begins]
    met[:, 1::2] = met[:, ::2] + one[met[:, ::2]]
    met = met.reshape(-1)
    return met[: int(met.searchsorted(last))], p


def _pixels(bits: Bits, codes: list[Code], width: int, n: int, cache_bits: int) -> np.ndarray:
    """All pixels of an image with one group of codes: green, red, blue, alpha, distance."""
    green, *others, dist = codes
    coloured = any(c.bits for c in others)
    canvas, done = _Canvas(n, cache_bits), 0
    lone_others = int(others[2].symbol[0]) << 24 | int(others[0].symbol[0]) << 16 | int(others[1].symbol[0])
    literals = green.bits and not (green.refers or coloured or cache_bits)
    if not green.bits and int(green.symbol[0]) < LITERALS and not coloured:
        canvas.out[:] = lone_others | int(green.symbol[0]) << 8
        return canvas.out
    while done < n:
        # where a pixel that begins at a place of this span ends
        lo = bits.at & ~7
        hi = min(lo + SPAN_BITS, bits.size + 8)
        if coloured or not green.bits:
            places = np.arange(lo, hi)
            symbol, step = green.at(bits.windows(np.minimum(places, bits.size)))
            place = places + step
            for c in others:
                place += c.at(bits.windows(np.minimum(place, bits.size)))[1]
            step = np.where(symbol < LITERALS, place - places, step).astype(np.uint8)
            ref = np.flatnonzero((symbol >= LITERALS) & (symbol < LITERALS + LENGTHS))
        else:
            keys = bits.span(lo, hi)[: hi - lo] & np.uint16((1 << green.bits) - 1)
            step = green.step.take(keys)
            ref = np.flatnonzero(step == 0) if green.refers else ()
        if len(ref):
            symbol, used = green.at(bits.windows(ref + lo))
            after = ref + lo + used + _EXTRA[symbol - LITERALS]
            d, more = dist.at(bits.windows(np.minimum(after, bits.size)))
            step[ref] = after + more + _EXTRA[d] - ref - lo
        p = bits.at - lo
        if not step[p]:  # a lone symbol of the colour cache takes no bits
            met = np.full(n - done, p)
        else:
            met, p = _chain(step, p)
        if literals:
            if len(met) > n - done:
                p, met = int(met[n - done]), met[: n - done]
            if lo + p > bits.size:
                raise ValueError("the stream ends early")
            canvas.out[done : done + len(met)] = green.symbol.take(keys[met]).astype(np.uint32) << np.uint32(8) | np.uint32(lone_others)
            done, bits.at = done + len(met), lo + p
            continue
        places = met + lo
        symbol = green.at(bits.windows(places))[0].astype(np.int64)
        ref = (symbol >= LITERALS) & (symbol < LITERALS + LENGTHS)
        length = np.ones(len(met), np.int64)
        r = np.flatnonzero(ref)
        if len(r):
            s = symbol[r] - LITERALS
            _, used = green.at(bits.windows(places[r]))
            extra = places[r] + used
            length[r] = _OFFSET[s] + (bits.windows(extra) & ((1 << _EXTRA[s]) - 1))
        ends = done + np.cumsum(length)
        keep = int(np.searchsorted(ends, n)) + 1
        if keep < len(met):
            p = int(met[keep])
            met, symbol, places, length, ends, ref = (x[:keep] for x in (met, symbol, places, length, ends, ref))
        if ends[-1] > n or lo + p > bits.size:
            raise ValueError("the stream ends early")
        begins = ends - length
        plain = np.flatnonzero(symbol < LITERALS)
        argb = (symbol[plain] << 8).astype(np.uint32)
        place = places[plain] + green.at(bits.windows(places[plain]))[1] if coloured else None
        for c, shift in zip(others, (16, 0, 24), strict=True):
            if c.bits:
                v, used = c.at(bits.windows(place))
                place = place + used
                argb |= v.astype(np.uint32) << np.uint32(shift)
            else:
                argb |= np.uint32(int(c.symbol[0]) << shift)
        canvas.out[begins[plain]] = argb
        events = np.flatnonzero(symbol >= LITERALS)
        if len(events):
            r = np.flatnonzero(ref)
            s = symbol[r] - LITERALS
            _, used = green.at(bits.windows(places[r]))
            at = places[r] + used + _EXTRA[s]
            d, used = dist.at(bits.windows(at))
            code = _OFFSET[d] + (bits.windows(at + used) & ((1 << _EXTRA[d]) - 1))
            distance = np.zeros(len(symbol), np.int64)
            distance[r] = _distance(code, width)
            for k in events.tolist():
                if ref[k]:
                    canvas.copy(int(begins[k]), int(length[k]), int(distance[k]))
                else:
                    canvas.recall(int(begins[k]), int(symbol[k]) - LITERALS - LENGTHS)
        done, bits.at = int(ends[-1]), lo + p
    return canvas.out


def _pixels_by_group(bits: Bits, groups: list[list[Code]], tiles: np.ndarray, tile_bits: int, width: int, n: int, cache_bits: int) -> np.ndarray:
    """All pixels of an image whose tiles have codes of their own, one by one."""
    canvas, done = _Canvas(n, cache_bits), 0

    def take(code: Code) -> int:
        k = bits.peek() & ((1 << code.bits) - 1)
        bits.at += int(code.length[k])
        return int(code.symbol[k])

    def value(s: int) -> int:
        return int(_OFFSET[s]) + bits.read(int(_EXTRA[s]))

    while done < n:
        y, x = divmod(done, width)
        green, red, blue, alpha, dist = groups[tiles[y >> tile_bits, x >> tile_bits]]
        s = take(green)
        if s < LITERALS:
            r, b, a = take(red), take(blue), take(alpha)
            canvas.out[done] = a << 24 | r << 16 | s << 8 | b
            done += 1
        elif s < LITERALS + LENGTHS:
            length = value(s - LITERALS)
            canvas.copy(done, length, int(_distance(np.array([value(take(dist))]), width)[0]))
            done += length
        else:
            canvas.recall(done, s - LITERALS - LENGTHS)
            done += 1
    if bits.at > bits.size:
        raise ValueError("the stream ends early")
    return canvas.out


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tiles, tile_bits = 1, None, 0
    if main and bits.read(1):
        tile_bits = 2 + bits.read(3)
        tiles = _image(bits, -(-width >> tile_bits), -(-height >> tile_bits), False) >> np.uint32(8) & np.uint32(0xFFFF)
        groups = int(tiles.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, k) for k in sizes] for _ in range(groups)]
    if groups == 1:
        flat = _pixels(bits, codes[0], width, width * height, cache_bits)
    else:
        flat = _pixels_by_group(bits, codes, tiles, tile_bits, width, width * height, cache_bits)
    return flat.reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """The bytes blue, green, red, alpha on a last axis."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int32) + b) >> 1


def _predicted(mode: int, left, top, right, corner) -> np.ndarray:
    """A predictor's value for pixels with these neighbours, as channels; ``right``: above to the right."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([0, 0, 0, 255], np.int32), top.shape)
    if mode == 11:
        l, t, c = (v.astype(np.int32) for v in (left, top, corner))
        nearer = np.abs(t - c).sum(-1, keepdims=True) < np.abs(l - c).sum(-1, keepdims=True)
        return np.where(nearer, l, t)
    if mode == 12:
        return np.clip(left.astype(np.int32) + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        twice = mean - corner.astype(np.int32)
        return np.clip(mean + np.sign(twice) * (np.abs(twice) >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: _average(_average(left, right), top), 6: lambda: _average(left, corner),
        7: lambda: _average(left, top), 8: lambda: _average(corner, top), 9: lambda: _average(top, right), 10: lambda: _average(_average(left, corner), _average(top, right)),
    }[mode]()


def _unpredict(residual: np.ndarray, modes: np.ndarray, tile_bits: int) -> np.ndarray:
    height, width = residual.shape
    px = _channels(residual).copy()
    px[0, 0, 3] = (int(px[0, 0, 3]) + 255) & 255
    px[0] = np.cumsum(px[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = px[y], px[y - 1]
        row[0] += above[0]
        right = np.concatenate((above[1:], row[:1]))  # the last pixel's is the first of its own row
        for tile in range(-(-width >> tile_bits)):
            lo, hi = max(tile << tile_bits, 1), min((tile + 1) << tile_bits, width)
            mode = int(modes[y >> tile_bits, tile])
            if lo >= hi:
                continue
            if mode == 1:
                row[lo - 1 : hi] = np.cumsum(row[lo - 1 : hi], axis=0, dtype=np.uint8)
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):
                row[lo:hi] += _predicted(mode, None, above[lo:hi], right[lo:hi], above[lo - 1 : hi - 1]).astype(np.uint8)
            else:
                for x in range(lo, hi):
                    row[x] += _predicted(mode, row[x - 1], above[x], right[x], above[x - 1]).astype(np.uint8)
    return px.view("<u4").reshape(height, width)


def _over_tiles(tiles: np.ndarray, tile_bits: int, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(tiles, 1 << tile_bits, 0), 1 << tile_bits, 1)[: shape[0], : shape[1]]


def _shift(factor: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (factor.view(np.int8).astype(np.int32) * value.view(np.int8)) >> 5


def _recolour(argb: np.ndarray, factors: np.ndarray, tile_bits: int, sign: int) -> np.ndarray:
    """Cross-colour: adds (sign 1) or takes off what green and red say about red and blue."""
    px, f = _channels(argb).copy(), _channels(_over_tiles(factors, tile_bits, argb.shape))
    f = [f[..., k].copy() for k in range(3)]  # green to red, green to blue, red to blue
    blue, green, red = (px[..., k].copy() for k in range(3))
    new_red = (red + sign * _shift(f[0], green)).astype(np.uint8)
    px[..., 2] = new_red
    px[..., 0] = (blue + sign * (_shift(f[1], green) + _shift(f[2], new_red if sign > 0 else red))).astype(np.uint8)
    return px.view("<u4").reshape(argb.shape)


def _add_green(argb: np.ndarray, sign: int) -> np.ndarray:
    px = _channels(argb).copy()
    px[..., 0] += (sign * px[..., 1].astype(np.int16)).astype(np.uint8)
    px[..., 2] += (sign * px[..., 1].astype(np.int16)).astype(np.uint8)
    return px.view("<u4").reshape(argb.shape)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (uint32, height by width) of a lossless WebP file; anything damaged raises ValueError."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[20 : 20 + size])
    if bits.size != 8 * size or bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP file")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    todo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in {k for k, *_ in todo}:
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile_bits = 2 + bits.read(3)
            tiles = _image(bits, -(-now >> tile_bits), -(-height >> tile_bits), False)
            todo.append((kind, tile_bits, tiles))
        elif kind == PALETTE:
            colours = _image(bits, bits.read(8) + 1, 1, False)
            colours = np.cumsum(_channels(colours), axis=1, dtype=np.uint8).view("<u4").reshape(-1)
            todo.append((kind, now, colours))
            now = -(-now >> _palette_bits(len(colours)))
        else:
            todo.append((kind,))
    argb = _image(bits, now, height, True)
    for kind, *how in reversed(todo):
        if kind == PREDICTOR:
            argb = _unpredict(argb, how[1] >> np.uint32(8) & np.uint32(15), how[0])
        elif kind == CROSS_COLOUR:
            argb = _recolour(argb, how[1], how[0], 1)
        elif kind == SUBTRACT_GREEN:
            argb = _add_green(argb, 1)
        else:
            full, colours = how
            wide = _palette_bits(len(colours))
            depth = 8 >> wide
            index = (argb >> np.uint32(8)) & np.uint32(255)
            if wide:
                parts = [(index >> np.uint32(depth * k)) & np.uint32((1 << depth) - 1) for k in range(1 << wide)]
                index = np.stack(parts, -1).reshape(height, -1)[:, :full]
            argb = np.concatenate((colours, np.zeros(256 - len(colours), np.uint32)))[index]
    return argb


# --- encoding ---


class Writer:
    """Values and their numbers of bits, packed lowest bit first; two that follow each other have at most 62 bits."""

    def __init__(self):
        self.values, self.sizes = [], []
        self.few, self.held = 0, 0

    def put(self, value: int, n: int) -> None:
        self.few |= value << self.held
        self.held += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.held:
            few = np.frombuffer(self.few.to_bytes(-(-self.held // 16) * 2, "little"), "<u2")
            own = np.full(len(few), 16)
            own[-1] = self.held - 16 * (len(few) - 1)
            self.values.append(few)
            self.sizes.append(own)
            self.few = self.held = 0
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        self.put_all(np.zeros(0, np.int64), np.zeros(0, np.int64))
        v, n = np.concatenate(self.values, dtype=np.int64), np.concatenate(self.sizes, dtype=np.int64)
        if len(v) & 1:
            v, n = np.append(v, 0), np.append(n, 0)
        v, n = (v[::2] | v[1::2] << n[::2]).astype(np.uint64), n[::2] + n[1::2]
        ends = n.cumsum()
        at = ends - n
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        # in each word of 64 bits some value begins, and of these only the last can go on into the next word
        first = word.searchsorted(np.arange(int(word[-1]) + 1))
        last = np.append(first[1:], len(v)) - 1
        out = np.zeros(len(first) + 1, "<u8")
        out[:-1] = np.bitwise_or.reduceat(v << bit, first)
        out[1:] |= v[last] >> np.uint64(1) >> (np.uint64(63) - bit[last])
        return out.tobytes()[: -(-int(ends[-1]) // 8)]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; a lone symbol gets 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = counts.nonzero()[0]
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weight, n = counts[used], len(used)
    while True:
        # leaves by weight, and nodes in the order in which they are made, which is by weight too
        order = weight.argsort(kind="stable")
        leaf, node, parent = [*weight[order].tolist(), float("inf")], [float("inf")] * n, [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):
            if leaf[i] <= node[j]:
                x, parent[i] = leaf[i], n + k
                i += 1
            else:
                x, parent[n + j] = node[j], n + k
                j += 1
            if leaf[i] <= node[j]:
                y, parent[i] = leaf[i], n + k
                i += 1
            else:
                y, parent[n + j] = node[j], n + k
                j += 1
            node[k] = x + y
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        lengths[used[order]] = depth[:n]
        if max(depth) <= most:
            return lengths
        weight = (weight + 1) // 2


@lru_cache(maxsize=512)
def _zeros(run: int) -> list[tuple[int, int, int]]:
    """A run of code lengths 0 as symbols with extra bits."""
    tokens = []
    while run:
        some = min(run, 138)
        tokens += [(18, some - 11, 7)] if some >= 11 else [(17, some - 3, 3)] if some >= 3 else [(0, 0, 0)] * some
        run -= some
    return tokens


def _write_lone(w: Writer, symbol: int) -> None:
    """Write the code of one symbol below 256."""
    w.put(5 | symbol << 3, 11)


def _write_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code for these counts; returns codes and lengths by symbol."""
    used = counts.nonzero()[0]
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        _write_lone(w, int(used[0]) if len(used) else 0)
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    lengths = code_lengths(counts, MAX_CODE)
    tokens, before = [], -1
    for symbol, length in zip(used.tolist(), lengths[used].tolist(), strict=True):
        tokens += _zeros(symbol - before - 1)
        tokens.append((length, 0, 0))
        before = symbol
    tokens += _zeros(len(counts) - before - 1)
    seen = Counter(t for t, _, _ in tokens)
    own = code_lengths(np.array([seen.get(k, 0) for k in range(19)]), 7)
    codes, own, single = canonical(own).tolist(), own.tolist(), len(seen) == 1
    order = [own[k] for k in CODE_LENGTH_ORDER]
    n = max(4, max(k for k, x in enumerate(order) if x) + 1)
    w.put(0, 1)
    w.put(n - 4, 4)
    for k in range(n):
        w.put(order[k], 3)
    w.put(0, 1)
    if single:
        codes, own = [0] * 19, [0] * 19
    few, held = 0, 0
    for t, extra, size in tokens:
        few |= (codes[t] | extra << own[t]) << held
        held += own[t] + size
    w.put(few, held)
    if len(used) == 1:
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    return canonical(lengths), lengths


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra value and extra bits of a length or distance code."""
    s = np.searchsorted(_OFFSET, value, side="right") - 1
    return s, value - _OFFSET[s], _EXTRA[s]


def _write_green(w: Writer, green: np.ndarray, others: list[int], refs: list[tuple[int, int, int]] = ()) -> None:
    """Codes and pixels of an image whose red, blue and alpha are the same everywhere."""
    if len(refs):
        at, length, distance = np.array(refs, np.int64).T
        copied = np.zeros(len(green) + 1, np.int8)
        copied[at] += 1
        copied[at + length] -= 1
        literal = green[copied[:-1].cumsum(dtype=np.int8) == 0].astype(np.int64)
        kind, extra, size = _prefix(length)
        far, far_extra, far_size = _prefix(_distance_codes(distance))
        begin = at - (length.cumsum() - length)  # literals before each reference
        green = np.insert(literal, begin, LITERALS + kind)
        begin += np.arange(len(begin))
    codes, sizes = _write_code(w, np.bincount(green, minlength=LITERALS + LENGTHS))
    for value in others:
        _write_lone(w, value)
    values, sizes = codes.take(green), sizes.take(green)
    if len(refs):
        codes, own = _write_code(w, np.bincount(far, minlength=DISTANCES))
        values[begin] |= extra << sizes[begin]
        sizes[begin] += size
        values = np.insert(values, begin + 1, codes[far] | far_extra << own[far])
        sizes = np.insert(sizes, begin + 1, own[far] + far_size)
    else:
        _write_lone(w, 0)
    w.put_all(values, sizes)


def _distance_codes(distance: np.ndarray) -> np.ndarray:
    # the codes of short distances are left to other encoders, but for the pixel before
    return np.where(distance == 1, 2, distance + len(NEAR))


def _write_image(w: Writer, argb: np.ndarray, main: bool, refs: list[tuple[int, int, int]] = (), cache_bits: int = 0, tiles: np.ndarray | None = None, tile_bits: int = 0) -> None:
    """``refs``: (place, length, distance) of back-references, in order and apart from each other."""
    height, width = argb.shape
    flat = np.ascontiguousarray(argb).reshape(-1)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0 if tiles is None else 1, 1)
        if tiles is not None:
            w.put(tile_bits - 2, 3)
            _write_image(w, tiles.astype(np.uint32) << np.uint32(8), False)
    px = _channels(flat)
    if not len(refs) and not cache_bits and tiles is None and (px[0, [0, 2, 3]] == px[:, [0, 2, 3]]).all():
        _write_green(w, px[:, 1], [int(px[0, k]) for k in (2, 0, 3)])
        return
    copied = np.zeros(len(flat), bool)
    for at, length, _ in refs:
        copied[at : at + length] = True
    at_ref = np.array([r[0] for r in refs], np.int64)
    places = np.sort(np.concatenate((np.flatnonzero(~copied), at_ref))) if len(refs) else np.arange(len(flat))
    is_ref = np.isin(places, at_ref) if len(refs) else np.zeros(len(places), bool)
    px = px[places]
    green = px[:, 1].astype(np.int64)
    is_cached = np.zeros(len(places), bool)
    if cache_bits:
        cache, fed, keys = np.zeros(1 << cache_bits, np.uint32), 0, _cache_keys(flat, cache_bits)
        for k, p in enumerate(places.tolist()):
            while fed < p:
                cache[keys[fed]] = flat[fed]
                fed += 1
            if not is_ref[k] and cache[keys[p]] == flat[p]:
                is_cached[k], green[k] = True, LITERALS + LENGTHS + int(keys[p])
    length = _prefix(np.array([r[1] for r in refs], np.int64))
    distance = _prefix(_distance_codes(np.array([r[2] for r in refs], np.int64)))
    green[is_ref] = LITERALS + length[0]
    literal = ~is_ref & ~is_cached
    group = np.zeros(len(places), np.int64) if tiles is None else tiles[(places // width) >> tile_bits, (places % width) >> tile_bits].astype(np.int64)
    values, sizes = np.zeros((len(places), 4), np.int64), np.zeros((len(places), 4), np.int64)
    n_green = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    for g in range(int(group.max()) + 1):
        mine = group == g
        c, n = _write_code(w, np.bincount(green[mine], minlength=n_green))
        values[mine, 0], sizes[mine, 0] = c[green[mine]], n[green[mine]]
        for k, channel in ((1, 2), (2, 0), (3, 3)):
            m = mine & literal
            c, n = _write_code(w, np.bincount(px[m, channel], minlength=256))
            values[m, k], sizes[m, k] = c[px[m, channel]], n[px[m, channel]]
        m = mine & is_ref
        c, n = _write_code(w, np.bincount(distance[0][m[is_ref]], minlength=DISTANCES))
        values[m, 1], sizes[m, 1] = length[1][m[is_ref]], length[2][m[is_ref]]
        values[m, 2], sizes[m, 2] = c[distance[0][m[is_ref]]], n[distance[0][m[is_ref]]]
        values[m, 3], sizes[m, 3] = distance[1][m[is_ref]], distance[2][m[is_ref]]
    if sizes[:, 1:].any():
        w.put_all(values.reshape(-1), sizes.reshape(-1))
    else:
        w.put_all(values[:, 0], sizes[:, 0])


def encode(argb: np.ndarray, refs: list[tuple[int, int, int]] = (), cache_bits: int = 0, tiles: np.ndarray | None = None, tile_bits: int = 2, transforms: list[tuple] = ()) -> bytes:
    """A lossless WebP file of ARGB pixels (uint32, height by width).

    ``transforms``: (PREDICTOR, tile_bits, modes), (CROSS_COLOUR, tile_bits, factors), (SUBTRACT_GREEN,), (PALETTE,) in
    the order in which they are applied; ``refs`` and ``tiles`` (the code group of each tile) refer to what they leave.
    """
    height, width = argb.shape
    argb = argb.astype(np.uint32)
    w = Writer()
    _write_head(w, height, width)
    for kind, *how in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == PREDICTOR:
            bits, modes = how
            px = _channels(argb)
            left, top, corner, right = np.zeros_like(px), np.zeros_like(px), np.zeros_like(px), np.zeros_like(px)
            left[:, 1:], top[1:], corner[1:, 1:], right[1:, :-1], right[1:, -1] = px[:, :-1], px[:-1], px[:-1, :-1], px[:-1, 1:], px[1:, 0]
            of = _over_tiles(modes, bits, argb.shape)
            guess = np.zeros(px.shape, np.int32)
            for mode in np.unique(modes).tolist():
                guess[of == mode] = _predicted(mode, left, top, right, corner)[of == mode]
            guess[0, 1:], guess[1:, 0], guess[0, 0] = left[0, 1:], top[1:, 0], (0, 0, 0, 255)
            argb = (px - guess).astype(np.uint8).view("<u4").reshape(argb.shape)
            w.put(bits - 2, 3)
            _write_image(w, modes.astype(np.uint32) << np.uint32(8), False)
        elif kind == CROSS_COLOUR:
            bits, factors = how
            argb = _recolour(argb, factors, bits, -1)
            w.put(bits - 2, 3)
            _write_image(w, factors, False)
        elif kind == SUBTRACT_GREEN:
            argb = _add_green(argb, -1)
        else:
            colours, index = np.unique(argb, return_inverse=True)
            steps = _channels(colours).copy()
            steps[1:] -= _channels(colours)[:-1]
            w.put(len(colours) - 1, 8)
            _write_image(w, steps.view("<u4").reshape(1, -1), False)
            wide = _palette_bits(len(colours))
            index = index.reshape(argb.shape).astype(np.uint32)
            index = np.pad(index, ((0, 0), (0, -width % (1 << wide)))).reshape(height, -1, 1 << wide)
            argb = (index << (np.arange(1 << wide, dtype=np.uint32) * np.uint32(8 >> wide))).sum(-1, dtype=np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    w.put(0, 1)
    _write_image(w, argb, True, refs, cache_bits, tiles, tile_bits)
    return _file(w)


def encode_green(green: np.ndarray, refs: list[tuple[int, int, int]] = ()) -> bytes:
    """What ``encode`` gives for an opaque picture of these green samples (uint8) without red and blue, made sooner."""
    w = Writer()
    _write_head(w, *green.shape)
    w.put(0, 3)  # no transforms, no colour cache, no tiles
    _write_green(w, green.reshape(-1), [0, 0, 255], refs)
    return _file(w)


def _write_head(w: Writer, height: int, width: int) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)


def _file(w: Writer) -> bytes:
    data = w.bytes()
    return b"RIFF" + struct.pack("<I", 12 + len(data) + (len(data) & 1)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
