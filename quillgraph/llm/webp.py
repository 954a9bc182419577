"""Lossless WebP images: a decoder for the whole format and an encoder.

Pixels are ARGB numbers in arrays of shape (height, width). The decoder reads
prefix codes, back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Where one code for green
and one for distances make up the image, the other channels being constant, the
code is looked up at all bit positions at once; other images go pixel by pixel.

``encode`` follows a plan. ``encode_samples`` makes the plans for bytes itself and
keeps the smallest image: green alone, as it is, predicted, or packed by a
palette, each with literals only or with back-references; or four bytes a pixel
with cross-colour and a colour cache. Quick signs (a compressor's size, the share
of the commonest residual, the number of colours, correlations between bytes)
say which plans are worth a try.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np

MOST = 1 << 14  # pixels a side
#: Fixed values of the format: the order in which lengths of the length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LEFT, TOP = 1, 2  # predictors
LITERALS, LENGTHS, DISTANCES = 256, 24, 40


@cache
def near_offsets() -> list[tuple[int, int]]:
    """(left, up) for the 120 short distances: by squared distance, then |left|, left before right."""
    spots = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(spots, key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), -s[0]))


# --- bits and prefix codes ------------------------------------------------------------------


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data) - 64:
            raise ValueError("the image ends too early")
        return value


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bits(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


@cache
def _reversed(n: int) -> np.ndarray:
    """Every n-bit number with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([out, out | 1 << (n - 1 - k)]) if k else np.array([0, 1 << (n - 1)])
    return out


class Code:
    """A canonical prefix code from the lengths of its symbols."""

    def __init__(self, lengths: np.ndarray, only: int | None = None):
        used = np.flatnonzero(lengths) if only is None else [only]
        if len(used) < 2:
            self.most, self.only = 0, int(used[0]) if len(used) else 0
            self.lengths, self.symbols = np.zeros(1, np.uint8), np.array([self.only], np.int32)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order].astype(np.int64)
        self.most, self.only = int(n[-1]), None
        span = 1 << (self.most - n)
        if span.sum() != 1 << self.most:
            raise ValueError("the lengths make no prefix code")
        turned = _reversed(self.most)
        self.symbols = np.repeat(order.astype(np.int32), span)[turned]
        self.lengths = np.repeat(n.astype(np.uint8), span)[turned]

    def marked(self) -> np.ndarray:
        """Length of each word, 128 added for those that aren't literals."""
        return self.lengths | (self.symbols >= LITERALS).astype(np.uint8) << 7

    def read(self, bits: Bits) -> int:
        k = bits.peek(self.most)
        bits.at += int(self.lengths[k])
        return int(self.symbols[k])


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal code; if one is over ``most``, counts are flattened until none is."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(weights) - 1), len(weights)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = n
            heapq.heappush(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(weights)]) <= most:
            lengths[used] = depth[: len(weights)]
            return lengths
        weights = [w // 2 + 1 for w in weights]


def codewords(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol's word, the first bit lowest; a single symbol needs none."""
    words = np.zeros(len(lengths), np.int64)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    for symbol, n in zip(order.tolist(), lengths[order].tolist()):
        code <<= n - last
        words[symbol] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return words


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):  # one or two symbols
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return Code(lengths, first)
        lengths[[first, bits.read(8)]] = 1
        return Code(lengths)
    inner = np.zeros(19, np.uint8)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        inner[k] = bits.read(3)
    code = Code(inner)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    k, last = 0, 8
    while k < size and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[k] = symbol
            last, k = symbol or last, k + 1
        else:
            value, n = (last, 3 + bits.read(2)) if symbol == 16 else (0, 3 + bits.read(3)) if symbol == 17 else (0, 11 + bits.read(7))
            if k + n > size:
                raise ValueError("too many lengths")
            lengths[k : k + n] = value
            k += n
    return Code(lengths)


def _write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256) or len(used) == 2 and used[1] < 256:
        out.write(1 | (len(used) == 2) << 1 | 4, 3)
        out.write(int(used[0]) if len(used) else 0, 8)
        if len(used) == 2:
            out.write(int(used[1]), 8)
        return
    tokens, k, values = [], 0, lengths[: used[-1] + 1].tolist()
    while k < len(values):  # runs of zeros, then runs of the same length
        run = 1
        while k + run < len(values) and values[k + run] == values[k] and run < (138 if not values[k] else 7):
            run += 1
        if not values[k] and run >= 3:
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        elif values[k] and run >= 4:
            tokens += [(values[k], 0, 0), (16, run - 4, 2)]
        else:
            tokens += [(values[k], 0, 0)] * run
        k += run
    inner = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    if (inner > 0).sum() == 1:  # a code of one word would have no bits to count
        inner[17 if inner[17] == 0 else 18] = 1
    words = codewords(inner).tolist()
    last = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if inner[s]))
    out.write(0 | (last - 4) << 1, 5)
    for s in LENGTH_ORDER[:last]:
        out.write(int(inner[s]), 3)
    if len(tokens) < 2:
        tokens.append((17 if inner[17] else 18, 0, 3 if inner[17] else 7))
    size = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
    out.write(1 | (size - 2) // 2 << 1, 4)
    out.write(len(tokens) - 2, size)
    for token, extra, n in tokens:
        out.write(words[token] | extra << int(inner[token]), int(inner[token]) + n)


def _split(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance from 1."""
    value -= 1
    if value < 4:
        return value, 0, 0
    n = value.bit_length() - 2
    return 2 * n + 2 + (value >> n & 1), value & ((1 << n) - 1), n


def _joined(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    n = symbol - 2 >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


# --- transforms -----------------------------------------------------------------------------


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) in the order alpha, red, green, blue, as signed numbers."""
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _pixels(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels[..., k].astype(np.uint32) & np.uint32(255) for k in range(4))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def predict(mode: int, left: list, top: list, top_right: list, top_left: list) -> list:
    """The predicted pixel, channel by channel."""
    zipped = zip(left, top, top_right, top_left)
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return [(((x + r) >> 1) + t) >> 1 for x, t, r, _ in zipped]
    if mode <= 9:
        return [(a + b) >> 1 for a, b in zip(*{6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}[mode])]
    if mode == 10:
        return [(((x + c) >> 1) + ((t + r) >> 1)) >> 1 for x, t, r, c in zipped]
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, _, c in zipped]
    middles = [((x + t) >> 1, c) for x, t, _, c in zipped]
    return [min(255, max(0, m + int((m - c) / 2))) for m, c in middles]


def _predicted(pixels: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Residuals of all pixels, or the pixels again from residuals."""
    height, width = pixels.shape
    mode = int(modes.flat[0])
    if inverse and mode in (LEFT, TOP) and (modes == mode).all():  # sums along one axis, after the first row or column along the other
        c = _channels(pixels)
        c[0, 0, 0] += 255
        c[0] = np.cumsum(c[0], axis=0)
        if mode == TOP:
            return _pixels(np.cumsum(c, axis=0))
        c[:, 0] = np.cumsum(c[:, 0], axis=0)
        c[1:] = np.cumsum(c[1:], axis=1)
        return _pixels(c)
    given = _channels(pixels).reshape(-1, 4).tolist()
    known, out = [] if inverse else given, []
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not i:
                guess = [255, 0, 0, 0]
            elif not y:
                guess = known[i - 1]
            elif not x:
                guess = known[i - width]
            else:
                # over the right edge, the pixel above right is the first of this row
                guess = predict(int(modes[y >> bits, x >> bits]), known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
            value = [(a + b if inverse else a - b) & 255 for a, b in zip(given[i], guess)]
            out.append(value)
            if inverse:
                known.append(value)
    return _pixels(np.array(out).reshape(height, width, 4))


def _crossed(pixels: np.ndarray, blocks: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Takes what green predicts of red and blue, and red of blue, off or adds it again."""
    height, width = pixels.shape
    c = _channels(pixels)
    m = _channels(blocks)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits].astype(np.int8).astype(np.int64)
    delta = lambda by, colour: by * colour.astype(np.int8).astype(np.int64) >> 5
    a, red, green, blue = (c[..., k] for k in range(4))
    sign = 1 if inverse else -1
    new_red = red + sign * delta(m[..., 3], green) & 255
    new_blue = blue + sign * (delta(m[..., 2], green) + delta(m[..., 1], new_red if inverse else red)) & 255
    return _pixels(np.stack([a, new_red, green, new_blue], axis=-1))


def _greened(pixels: np.ndarray, sign: int) -> np.ndarray:
    """Green added to red and blue, or taken off."""
    both, green = pixels & np.uint32(0x00FF00FF), (pixels >> np.uint32(8) & np.uint32(255)) * np.uint32(0x00010001)
    both = both + green if sign > 0 else both + (np.uint32(0x01000100) - green)
    return both & np.uint32(0x00FF00FF) | pixels & np.uint32(0xFF00FF00)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpacked(pixels: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    shift = _packing(len(colours))
    x, bits = np.arange(width), 8 >> shift
    index = (pixels[:, x >> shift] >> np.uint32(8) & np.uint32(255)) >> (bits * (x & (1 << shift) - 1)).astype(np.uint32) & np.uint32((1 << bits) - 1)
    return np.concatenate([colours, np.zeros(256, np.uint32)])[index]


# --- decoding -------------------------------------------------------------------------------


def _chain(steps: np.ndarray, at: int, n: int) -> np.ndarray:
    """Where the first n words and the one after them begin; eight words are passed at a time."""
    hop = np.minimum(np.arange(len(steps), dtype=np.int32) + steps, np.int32(len(steps) - 1))
    far, spots = hop, []
    for _ in range(3):
        far = far.take(far)
    view, put = memoryview(far), spots.append
    for _ in range(n // 8 + 1):
        put(at)
        at = view[at]
    rows = [np.array(spots, np.int32)]
    for _ in range(7):
        rows.append(hop.take(rows[-1]))
    return np.stack(rows, axis=1).ravel()[: n + 1]


def _greens(bits: Bits, code: Code, distance: Code, rest: list[Code], n: int, width: int) -> np.ndarray | None:
    """n pixels whose green comes from one code and whose other channels are constant.

    The word at every bit position is looked up at once; the chain of positions
    that are words' starts is then followed, and back-references are copied.
    """
    red, blue, alpha = (c.only for c in rest)
    if not code.most:
        if code.only >= LITERALS:
            return None
        return np.full(n, alpha << 24 | red << 16 | code.only << 8 | blue, np.uint32)
    start, data = bits.at >> 3, bits.data
    raw = np.frombuffer(data, np.uint8)[start:].astype(np.uint32)
    raw = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    window = (raw[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << code.most) - 1)).ravel()
    if code.symbols.max() < LITERALS:
        at = _chain(code.lengths.take(window), bits.at & 7, n)
        if at[n] >= len(window) - 64:
            raise ValueError("the image ends too early")
        bits.at = 8 * start + int(at[n])
        return code.symbols.astype(np.uint32).take(window.take(at[:n])) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)
    steps, values = code.marked().take(window).tobytes(), code.symbols.astype(np.uint8).take(window).tobytes()
    at, end, out = bits.at & 7, len(steps) - 64, bytearray()
    put, near = out.append, [max(1, x + y * width) for x, y in near_offsets()]
    far, far_sizes, mask = distance.symbols.tolist(), distance.lengths.tolist(), (1 << distance.most) - 1
    while (have := len(out)) < n:
        for _ in range(n - have):
            step = steps[at]
            if step > 127:
                break
            put(values[at])
            at += step
        else:
            break
        have = len(out)
        s = values[at]  # the symbol less 256
        at += step & 127
        word = int.from_bytes(data[start + (at >> 3) : start + (at >> 3) + 8], "little") >> (at & 7)
        length, used = s + 1, 0
        if s > 3:
            used = s - 2 >> 1
            length = ((2 + (s & 1)) << used) + (word & (1 << used) - 1) + 1
            word >>= used
        k = word & mask
        s, size = far[k], far_sizes[k]
        word >>= size
        back, used = s + 1, used + size
        if s > 3:
            size = s - 2 >> 1
            back = ((2 + (s & 1)) << size) + (word & (1 << size) - 1) + 1
            used += size
        at += used
        back = near[back - 1] if back <= 120 else back - 120
        if back > have or have + length > n:
            raise ValueError("a back-reference leaves the image")
        if back >= length:
            out += out[have - back : have - back + length]
        else:
            piece = bytes(out[have - back :])
            out += (piece * (length // back + 1))[:length]
    if at > end:
        raise ValueError("the image ends too early")
    bits.at = 8 * start + at
    return np.frombuffer(bytes(out), np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at, group_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        groups_at = _entropy_image(bits, -(-width >> group_bits), -(-height >> group_bits), False) >> np.uint32(8) & np.uint32(0xFFFF)
        n_groups = int(groups_at.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[_read_code(bits, size) for size in sizes] for _ in range(n_groups)]
    n = width * height
    green, *others, distance = groups[0]
    if n_groups == 1 and not cache_bits and all(c.only is not None for c in others):
        found = _greens(bits, green, distance, others, n, width)
        if found is not None:
            return found.reshape(height, width)
    out, held = [0] * n, [0] * (1 << cache_bits)
    new, i = 0, 0  # pixels up to `new` are in the cache
    near = near_offsets()

    def remember(upto: int) -> None:
        nonlocal new
        while new < upto:
            held[(out[new] * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits] = out[new]
            new += 1

    while i < n:
        green, red, blue, alpha, distance = groups[0 if groups_at is None else int(groups_at[i // width >> group_bits, i % width >> group_bits])]
        s = green.read(bits)
        if s < LITERALS:
            r, b = red.read(bits), blue.read(bits)
            out[i] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < LITERALS + LENGTHS:
            length = _joined(s - LITERALS, bits)
            back = _joined(distance.read(bits), bits)
            back = max(1, near[back - 1][0] + near[back - 1][1] * width) if back <= 120 else back - 120
            if back > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(i, i + length):
                out[k] = out[k - back]
            i += length
        else:
            remember(i)
            out[i] = held[s - LITERALS - LENGTHS]
            i += 1
        if bits.at > 8 * len(bits.data) - 64:
            raise ValueError("the image ends too early")
    return np.array(out, np.uint32).reshape(height, width)


def decode(data: bytes) -> np.ndarray:
    """The pixels of one image."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP image")
    bits = Bits(data[21 : 20 + struct.unpack_from("<I", data, 16)[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            blocks = _entropy_image(bits, -(-now >> size), -(-height >> size), False)
            if kind == PREDICTOR:
                undo.append(lambda p, modes=blocks >> np.uint32(8) & np.uint32(15), s=size: _predicted(p, modes, s, True))
            else:
                undo.append(lambda p, b=blocks, s=size: _crossed(p, b, s, True))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda p: _greened(p, 1))
        else:
            table = _entropy_image(bits, bits.read(8) + 1, 1, False)
            colours = _pixels(np.cumsum(_channels(table[0]), axis=0))
            undo.append(lambda p, c=colours, w=now: _unpacked(p, c, w))
            now = -(-now >> _packing(len(colours)))
    pixels = _entropy_image(bits, now, height, True)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


# --- encoding -------------------------------------------------------------------------------


@dataclass
class Plan:
    """What the encoder is to use, in the order in which transforms are applied."""

    transforms: list[tuple] = field(default_factory=list)  # (PREDICTOR, bits, modes), (CROSS_COLOUR, bits, blocks), (SUBTRACT_GREEN,), (PALETTE,)
    cache_bits: int = 0
    references: bool = False
    groups: tuple[int, np.ndarray] | None = None  # (bits, group of each block)


def _write_entropy(out: Writer, pixels: np.ndarray, main: bool, plan: Plan) -> list[tuple[int, int]]:
    """Writes the head and codes; returns (value, bits) of the pixels' own data."""
    out.write(1 | plan.cache_bits << 1 if plan.cache_bits else 0, 5 if plan.cache_bits else 1)
    height, width = pixels.shape
    group_of = lambda i: 0
    n_groups = 1
    if main:
        out.write(int(plan.groups is not None), 1)
        if plan.groups:
            size, where = plan.groups
            out.write(size - 2, 3)
            for value, n in _write_entropy(out, where.astype(np.uint32) << np.uint32(8), False, Plan()):
                out.write(value, n)
            n_groups = int(where.max()) + 1
            group_of = lambda i: int(where[i // width >> size, i % width >> size])
    flat, held, seen, steps, i = pixels.ravel().tolist(), {}, {}, [], 0
    short = {max(1, x + y * width): k for k, (x, y) in reversed(list(enumerate(near_offsets(), 1)))}

    def pass_by(k: int) -> None:
        if plan.cache_bits:
            held[(flat[k] * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - plan.cache_bits] = flat[k]
        if k >= 2:
            seen[tuple(flat[k - 2 : k + 1])] = k - 2

    while i < len(flat):
        g, p = group_of(i), flat[i]
        length = 0
        if plan.references and (at := seen.get(tuple(flat[i : i + 3]))) is not None:
            while i + length < len(flat) and length < 4096 and flat[at + length] == flat[i + length]:
                length += 1
        slot = (p * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - plan.cache_bits
        if length >= 3:
            a, b = _split(length), _split(short.get(i - at, i - at + 120))
            steps.append((g, [(0, LITERALS + a[0]), (None, a[1:]), (4, b[0]), (None, b[1:])]))
        elif plan.cache_bits and held.get(slot) == p:
            length = 1
            steps.append((g, [(0, LITERALS + LENGTHS + slot)]))
        else:
            length = 1
            steps.append((g, [(0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)]))
        for k in range(i, i + length):
            pass_by(k)
        i += length
    sizes = (LITERALS + LENGTHS + (1 << plan.cache_bits if plan.cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(n_groups)]
    for g, parts in steps:
        for code, symbol in parts:
            if code is not None:
                counts[g][code][symbol] += 1
    lengths = [[code_lengths(c) for c in group] for group in counts]
    for group in lengths:
        for one in group:
            _write_code(out, one)
    words = [[(codewords(x), x * (np.count_nonzero(x) > 1)) for x in group] for group in lengths]
    flat_out = []
    for g, parts in steps:
        for code, symbol in parts:
            flat_out.append(symbol if code is None else (int(words[g][code][0][symbol]) if words[g][code][1][symbol] else 0, int(words[g][code][1][symbol])))
    return flat_out


def _wrapped(bits: np.ndarray) -> bytes:
    return _framed(np.packbits(bits, bitorder="little").tobytes())


def _framed(data: bytes) -> bytes:
    body = b"\x2f" + data
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _head(width: int, height: int, alpha: bool) -> Writer:
    out = Writer()
    out.write(width - 1 | height - 1 << 14 | int(alpha) << 28, 32)
    return out


def encode(pixels: np.ndarray, plan: Plan | None = None) -> bytes:
    """An image with the transforms and codings that ``plan`` names."""
    plan = plan or Plan()
    height, width = pixels.shape
    out = _head(width, height, bool((pixels >> np.uint32(24) != 255).any()))
    for kind, *how in plan.transforms:
        out.write(1 | kind << 1, 3)
        if kind == SUBTRACT_GREEN:
            pixels = _greened(pixels, -1)
            continue
        if kind == PALETTE:
            colours, index = np.unique(pixels, return_inverse=True)
            index = index.reshape(pixels.shape)
            shift = _packing(len(colours))
            out.write(len(colours) - 1, 8)
            table = _pixels(np.diff(_channels(colours), axis=0, prepend=0))[None]
            packed = np.zeros((height, -(-pixels.shape[1] >> shift)), np.uint32)
            for x in range(pixels.shape[1]):
                packed[:, x >> shift] |= index[:, x].astype(np.uint32) << np.uint32((8 >> shift) * (x & (1 << shift) - 1))
            pixels, sub = OPAQUE | packed << np.uint32(8), table
        else:
            size, blocks = how
            out.write(size - 2, 3)
            pixels = _predicted(pixels, blocks, size, False) if kind == PREDICTOR else _crossed(pixels, blocks, size, False)
            sub = blocks.astype(np.uint32) << np.uint32(8) if kind == PREDICTOR else blocks
        for value, n in _write_entropy(out, sub, False, Plan()):
            out.write(value, n)
    out.write(0, 1)
    for value, n in _write_entropy(out, pixels, True, plan):
        out.write(value, n)
    return _wrapped(out.bits())


# --- encoding bytes -------------------------------------------------------------------------

#: Shortest and longest reference, and the gain that a compressor must promise before references are tried.
LEAST_MATCH, MOST_MATCH, GAIN = 6, 4096, 0.8
#: Colours that a palette packs, and the correlation from which bytes are taken as the channels of a pixel.
PACKED, ALIKE = 16, 0.95


def matches(flat: np.ndarray) -> np.ndarray:
    """(start, length, distance) of the references to take, in order: greedy, each to the latest place with the same ``LEAST_MATCH`` bytes (at most eight)."""
    n, data = len(flat), flat.tobytes()
    if n < 2 * LEAST_MATCH:
        return np.zeros((0, 3), np.int64)
    wide = flat.astype(np.uint64)
    key = sum(wide[k : n - LEAST_MATCH + 1 + k] << np.uint64(8 * k) for k in range(LEAST_MATCH))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    before = np.full(len(key), -1)
    before[order[same + 1]] = order[same]
    spots = np.flatnonzero(before >= 0)
    found, upto = [], 0
    for i, p in zip(spots.tolist(), before[spots].tolist()):
        if i < upto:
            continue
        k, most = LEAST_MATCH, min(MOST_MATCH, n - i)
        while k < most:
            a, b = data[i + k : i + k + 32], data[p + k : p + k + 32]
            if a != b:
                apart = int.from_bytes(a, "little") ^ int.from_bytes(b[: len(a)], "little")
                k += (apart & -apart).bit_length() - 1 >> 3 if apart else len(a)
                break
            k += len(a)
        k = min(k, most)
        found.append((i, k, i - p))
        upto = i + k
    return np.array(found, np.int64).reshape(-1, 3)


def _splits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_split`` for an array."""
    v = values - 1
    n = np.where(v < 4, 0, np.frexp(np.maximum(v, 1))[1] - 2)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), np.where(v < 4, 0, v & (1 << n) - 1), n


class _Greens:
    """Bytes as the green of an image, its other channels constant: head, codes and, once chosen, data."""

    def __init__(self, head: Writer, flat: np.ndarray, width: int, alpha: int, found: np.ndarray | None = None):
        self.head = head
        fields = [flat]
        if found is not None and len(found):
            starts, lengths, backs = found.T
            ends = np.zeros(len(flat) + 1, np.int64)
            ends[starts] += 1
            ends[starts + lengths] -= 1
            own = np.cumsum(ends[:-1]) == 0
            own[starts] = True
            at = np.flatnonzero(own)
            green = flat[at].astype(np.int64)
            short = np.zeros(8 * width + 9, np.int64)
            for k, (x, y) in reversed(list(enumerate(near_offsets(), 1))):
                short[max(1, x + y * width)] = k
            near = short[np.minimum(backs, len(short) - 1)] * (backs < len(short))
            m = np.searchsorted(at, starts)
            (s, *more), (far, *far_more) = _splits(lengths), _splits(np.where(near > 0, near, backs + 120))
            green[m] = LITERALS + s
            fields = [green, m, more, far, far_more]
        self.fields = fields
        self.lengths = code_lengths(np.bincount(fields[0], minlength=LITERALS + LENGTHS))
        self.far_lengths = code_lengths(np.bincount(fields[3], minlength=DISTANCES)) if len(fields) > 1 else None
        _write_code(head, self.lengths)
        for symbol in (0, 0, alpha):
            head.write(5 | symbol << 3, 11)
        if self.far_lengths is None:
            head.write(5, 11)
        else:
            _write_code(head, self.far_lengths)
        self.size = head.n + self._bits(fields[0], self.lengths)
        if len(fields) > 1:
            self.size += self._bits(fields[3], self.far_lengths) + int(fields[2][1].sum() + fields[4][1].sum())

    @staticmethod
    def _bits(symbols: np.ndarray, lengths: np.ndarray) -> int:
        return int(lengths[symbols].sum(dtype=np.int64)) if np.count_nonzero(lengths) > 1 else 0

    def written(self) -> bytes:
        values, sizes = self._words(self.fields[0], self.lengths)
        if len(self.fields) > 1:
            _, m, more, far, far_more = self.fields
            every, widths = np.zeros((2, len(values), 4), np.int64)
            (every[:, 0], widths[:, 0]), (every[m, 1], widths[m, 1]), (every[m, 3], widths[m, 3]) = (values, sizes), more, far_more
            every[m, 2], widths[m, 2] = self._words(far, self.far_lengths)
            values, sizes = every.ravel(), widths.ravel()
        return _joined_bits(self.head, values, sizes)

    @staticmethod
    def _words(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if np.count_nonzero(lengths) < 2:
            return np.zeros((2, len(symbols)), np.int64)
        return codewords(lengths)[symbols], lengths[symbols].astype(np.int64)


def _joined_bits(head: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The image of a head and fields of up to 24 bits: each falls into one or two of the words of 32, whose parts add up."""
    ends = head.n + np.cumsum(sizes)
    at = ends - sizes
    n = int(ends[-1] >> 5) + 2 if len(ends) else (head.n >> 5) + 2
    moved = values << (at & 31)
    words = np.bincount(at >> 5, moved & 0xFFFFFFFF, n)[:n] + np.bincount((at >> 5) + 1, moved >> 32, n)[:n]
    data = np.bitwise_or(words.astype("<u4"), np.frombuffer(head.value.to_bytes(4 * n, "little"), "<u4"))
    total = int(ends[-1]) if len(ends) else head.n
    return _framed(data.tobytes()[: (total + 7) // 8])


def _green_head(samples: np.ndarray, kind: int | None = None) -> tuple[Writer, np.ndarray, int, int]:
    """(head, green bytes, width, alpha) of grey samples: as they are, predicted by LEFT or TOP, or packed by a palette."""
    height, width = samples.shape
    out = _head(width, height, False)
    if kind == PALETTE:
        colours, index = np.unique(samples, return_inverse=True)
        index, shift = index.reshape(samples.shape), _packing(len(colours))
        out.write(1 | PALETTE << 1, 3)
        out.write(len(colours) - 1, 8)
        table = np.uint32(OPAQUE) | colours.astype(np.uint32) * np.uint32(0x010101)
        for value, n in _write_entropy(out, _pixels(np.diff(_channels(table), axis=0, prepend=0))[None], False, Plan()):
            out.write(value, n)
        packed = np.zeros((height, -(-width >> shift)), np.uint8)
        for x in range(width):
            packed[:, x >> shift] |= (index[:, x] << (8 >> shift) * (x & (1 << shift) - 1)).astype(np.uint8)
        out.write(0, 3)  # no further transform, no cache, one group
        return out, packed.ravel(), packed.shape[1], 255
    out.write(1 | SUBTRACT_GREEN << 1, 3)
    if kind:
        out.write(1 | PREDICTOR << 1 | 7 << 3, 6)  # blocks of 512 pixels a side, all with one predictor
        for value, n in _write_entropy(out, np.full((-(-height >> 9), -(-width >> 9)), kind << 8, np.uint32), False, Plan()):
            out.write(value, n)
    out.write(0, 3)
    return out, (residuals(samples, kind) if kind else samples).ravel(), width, 0 if kind else 255


def residuals(samples: np.ndarray, mode: int) -> np.ndarray:
    """What predictor LEFT or TOP leaves of grey samples."""
    out = samples.copy()
    if mode == TOP:
        out[1:] -= samples[:-1]
        out[0, 1:] -= samples[0, :-1]
    else:
        out[:, 1:] -= samples[:, :-1]
        out[1:, 0] -= samples[:-1, 0]
    return out


def _coloured(samples: np.ndarray) -> list[bytes]:
    """Images of four bytes a pixel, where red or blue follows green; none if they don't."""
    if len(samples) < 2:
        return []
    four = samples[:-1].reshape(-1, 4).astype(np.float32)  # the last row's padding tells nothing
    four -= four.mean(axis=0)
    cov = four.T @ four
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-6))
    if max(abs(cov[1, 2]) / (spread[1] * spread[2]), abs(cov[1, 0]) / (spread[1] * spread[0])) < ALIKE:
        return []
    red, blue = (int(np.clip(round(32 * cov[1, c] / max(cov[1, 1], 1e-6)), -128, 127)) & 255 for c in (2, 0))
    pixels = np.ascontiguousarray(samples).view("<u4").astype(np.uint32)
    height, width = pixels.shape
    crossed = [(CROSS_COLOUR, 9, np.full((-(-height >> 9), -(-width >> 9)), OPAQUE | blue << 8 | red, np.uint32))]
    return [encode(pixels, Plan(transforms, cache, True)) for transforms in ([], crossed) for cache in (0, 4, 8)]


def encode_samples(samples: np.ndarray) -> bytes:
    """Rows of 64 bytes as the smallest of the images tried: 64 grey pixels a row, or 16 pixels of four bytes."""
    heads = [_green_head(samples)]
    counts = np.bincount(samples.ravel(), minlength=256)
    if np.count_nonzero(counts) <= PACKED:
        heads.append(_green_head(samples, PALETTE))
    for mode in (LEFT, TOP):
        if np.bincount(residuals(samples, mode).ravel()).max() >= 2 * counts.max():
            heads.append(_green_head(samples, mode))
    tried = []
    for head, flat, width, alpha in heads:
        again = Writer()
        again.value, again.n = head.value, head.n
        tried.append(_Greens(head, flat, width, alpha))
        if 8 * len(zlib.compress(flat.tobytes(), 1)) < GAIN * tried[-1].size:
            tried.append(_Greens(again, flat, width, alpha, matches(flat)))
    best = min(tried, key=lambda x: x.size).written()
    return min([best, *_coloured(samples)], key=len)


def decode_samples(data: bytes) -> np.ndarray:
    """The bytes of an image by ``encode_samples``, 64 a row."""
    pixels = decode(data)
    if pixels.shape[1] == 16:
        return pixels.astype("<u4").view(np.uint8)
    samples = (pixels >> np.uint32(8)).astype(np.uint8)
    if pixels.shape[1] != 64 or not (pixels == (samples * np.uint32(0x010101) | np.uint32(OPAQUE))).all():
        raise ValueError("not an image of bytes")
    return samples
