import numpy as np
import pytest

from quillgraph.llm import webp as W

RNG = np.random.default_rng(7)


def picture(height, width, colours=None):
    if colours:
        return RNG.integers(0, 2**32, colours, dtype=np.uint32)[RNG.integers(0, colours, (height, width))]
    y, x = np.mgrid[:height, :width]
    smooth = np.stack([255 - (x // 9), x * 3 + y, x + 2 * y, 200 - x + RNG.integers(0, 4, x.shape)], axis=-1)
    return W._pixels(smooth)


def blocks(height, width, bits, high):
    return RNG.integers(0, high, (-(-height >> bits), -(-width >> bits)), dtype=np.uint32)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (13, 1), (21, 33)])
@pytest.mark.parametrize("cache_bits", [0, 3])
@pytest.mark.parametrize("references", [False, True])
def test_round_trip_with_every_transform(shape, cache_bits, references):
    h, w = shape
    p = picture(h, w)
    for transforms in (
        [],
        [(W.SUBTRACT_GREEN,)],
        [(W.PREDICTOR, 2, blocks(h, w, 2, 14))],
        [(W.CROSS_COLOUR, 3, blocks(h, w, 3, 2**24))],
        [(W.PREDICTOR, 2, blocks(h, w, 2, 14)), (W.CROSS_COLOUR, 2, blocks(h, w, 2, 2**24)), (W.SUBTRACT_GREEN,)],
    ):
        plan = W.Plan(transforms, cache_bits, references, (2, blocks(h, w, 2, 3)))
        assert (W.decode(W.encode(p, plan)) == p).all()
        plan.groups = None
        assert (W.decode(W.encode(p, plan)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    p = picture(14, 19, colours)
    for references in (False, True):
        assert (W.decode(W.encode(p, W.Plan([(W.PALETTE,)], 0, references))) == p).all()


def test_known_file():
    """The one-pixel file by which browsers are asked for lossless WebP."""
    data = bytes.fromhex("524946461a000000574542505650384c0d0000002f00000010071011118888fe0700")
    assert W.decode(data).shape == (1, 1)


def test_every_predictor_by_hand():
    left, top, right, corner = [10] * 4, [20] * 4, [40] * 4, [5] * 4
    got = [W.predict(m, left, top, right, corner)[1] for m in range(14)]
    assert got == [0, 10, 20, 40, 5, (25 + 20) // 2, 7, 15, 12, 30, (7 + 30) // 2, 20, 25, 20]


def test_short_distances():
    near = W.near_offsets()
    assert len(near) == 120 and near[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and near[-1] == (8, 7)


def test_code_lengths_are_limited():
    counts = np.array([int(1.7**k) for k in range(40)])
    lengths = W.code_lengths(counts)
    assert lengths.max() <= 15 and sum(2.0 ** -int(x) for x in lengths) == 1


@pytest.mark.parametrize("data", [b"\0" * 64, b"a" * 127 + b"\0", bytes(range(256)) * 2, b"abc" * 64 * 700, b"x" * 9000 + bytes(24), bytes(RNG.integers(0, 256, 64 * 300, dtype=np.uint8)), bytes(RNG.integers(48, 50, 64 * 90, dtype=np.uint8)), b"some words, some other words, and so on. " * 64])
def test_images_of_bytes(data):
    samples = np.frombuffer(data, np.uint8).reshape(-1, 64)
    assert (W.decode_samples(W.encode_samples(samples)) == samples).all()
    for kind in (None, W.LEFT, W.TOP, *([W.PALETTE] if len(set(data)) <= W.PACKED else [])):  # every plan, chosen or not
        for references in (False, True):
            head, flat, width, alpha = W._green_head(samples, kind)
            plan = W._Greens(head, flat, width, alpha, W.matches(flat) if references else None)
            image = plan.written()
            assert (W.decode_samples(image) == samples).all()
            assert 8 * (len(image) - 23) <= plan.size <= 8 * (len(image) - 20)


def test_matches_by_hand():
    flat = np.frombuffer(b"abcdefghij--abcdefghijabcdefghij!", np.uint8)
    assert W.matches(flat).tolist() == [[12, 10, 12], [22, 10, 10]]
    assert W.matches(np.zeros(5000, np.uint8)).tolist() == [[1, 4096, 1], [4097, 903, 1]]
    assert [W._split(v) for v in range(1, 5000)] == list(zip(*(x.tolist() for x in W._splits(np.arange(1, 5000)))))


def test_broken_files_are_refused():
    good = W.encode_samples(np.frombuffer(bytes(RNG.integers(0, 200, 64 * 9, dtype=np.uint8)), np.uint8).reshape(-1, 64))
    for bad in (b"", good[:20], b"JUNK" + good[4:], good[:60]):
        with pytest.raises((ValueError, IndexError)):
            W.decode(bad)


# --- files put together bit by bit from the format's description, without the encoder ---------------


def one(symbol):
    """A code of one symbol: its words have no bits."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(a, b):
    """A code of two symbols: 0 is the smaller, 1 the larger."""
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def file(width, height, *parts):
    value = at = 0
    for v, n in [(width - 1, 14), (height - 1, 14), (1, 1), (0, 3), *(b for p in parts for b in p)]:
        value, at = value | v << at, at + n
    body = b"\x2f" + value.to_bytes(at // 8 + 1, "little")
    body += b"\0" * (len(body) % 2)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def bits(text):
    return [(int(b), 1) for b in text]


END, PLAIN = [(0, 1)], [(0, 1), (0, 1)]  # no further transform; no cache and one group
GREY = one(0) + one(0) + one(255)  # red, blue, alpha


def greens(pixels):
    assert (pixels >> 24 == 255).all() and not (pixels & 0xFF00FF).any()
    return (pixels >> 8 & 255).tolist()


def test_subtract_green_by_hand():
    data = file(1, 1, [(1, 1), (2, 2)], END, PLAIN, one(20), one(10), one(30), one(255), one(0))
    assert W.decode(data).tolist() == [[0xFF1E1432]]


@pytest.mark.parametrize("mode, last", [(1, 9), (2, 15), (3, 9), (4, 8), (5, 12), (6, 8), (7, 12), (8, 11), (9, 12), (10, 10), (11, 15), (12, 16), (13, 14)])
def test_predictors_in_a_file(mode, last):
    """Residuals 1 7 / 1 7: the first row follows its left, the first column its top; at the right edge the pixel above right is the row's first."""
    block = [(0, 1)] + one(mode) + one(0) + one(0) + one(255) + one(0)
    data = file(2, 2, [(1, 1), (0, 2), (0, 3)], block, END, PLAIN, two(1, 7), one(0), one(0), one(0), one(0), bits("0101"))
    assert greens(W.decode(data)) == [[1, 8], [2, last]]


@pytest.mark.parametrize("to_red, pixel", [(16, 0xFF2A403F), (0xF0, 0xFFEA40FF)])
def test_cross_colour_by_hand(to_red, pixel):
    """Green 64: red 10 + 16 * 64 / 32 = 42 (or 10 - 32 = -22), blue 5 + 8 * 64 / 32 + 32 * red / 32."""
    block = [(0, 1)] + one(8) + one(32) + one(to_red) + one(255) + one(0)
    data = file(1, 1, [(1, 1), (1, 2), (0, 3)], block, END, PLAIN, one(64), one(10), one(5), one(255), one(0))
    assert W.decode(data).tolist() == [[pixel]]


def test_palette_by_hand():
    """Three colours, each the one before and a difference; four indices of two bits in a pixel's green."""
    table = [(0, 1)] + two(0, 1) + one(0) + two(0, 16) + two(0, 255) + one(0) + bits("011" + "100" + "100")
    data = file(5, 1, [(1, 1), (3, 2), (2, 8)], table, END, PLAIN, two(1, 0b10010010), GREY, one(0), bits("10"))
    assert W.decode(data).tolist() == [[0xFF000210, 0xFF000010, 0xFF000110, 0xFF000210, 0xFF000110]]


def long_code(last):
    """Green words 0 (5), 10 (7) and 11 (``last``, over 255), by code lengths in runs: 00 a 2, 01 some zeros, 10 many zeros, 110 a 0, 111 a 1."""
    total = 280 if last < 280 else 282
    head = [(0, 1), (1, 4), (2, 3), (2, 3), (3, 3), (3, 3), (2, 3), (0, 1)]
    zeros = last - 8 - 138
    middle = bits("01") + [(2, 3)] + bits("111") + bits("110") + bits("00") + bits("10") + [(127, 7)] + bits("10") + [(zeros - 11, 7)] + bits("00")
    rest = total - last - 1
    return head + middle + (bits("10") + [(rest - 11, 7)] if rest >= 11 else bits("110") * rest)


@pytest.mark.parametrize("distance, more, second", [(0, [], [5, 7, 5, 7]), (13, [(25, 5)], [5, 5, 5, 7])])
def test_back_references_by_hand(distance, more, second):
    """Three pixels again, from the row above (the first short distance), or from two back (122 - 120)."""
    data = file(4, 2, END, PLAIN, long_code(258), GREY, one(distance), bits("0" + "10" + "0" + "0" + "11"), more, bits("10"))
    assert greens(W.decode(data)) == [[5, 7, 5, 5], second]


def test_colour_cache_by_hand():
    five, seven = ((0xFF000000 | g << 8) * 0x1E35A7BD % 2**32 >> 31 for g in (5, 7))
    for held, want in ((five, 5), (seven, 7)):
        want = {five: 5, seven: 7}[held]  # of two colours in one place the later stays
        data = file(3, 1, END, [(1, 1), (1, 4), (0, 1)], long_code(280 + held), GREY, one(0), bits("0" + "10" + "11"))
        assert greens(W.decode(data)) == [[5, 7, want]]


def test_groups_of_codes_by_hand():
    where = [(0, 1)] + two(0, 1) + one(0) + one(0) + one(255) + one(0) + bits("01")
    data = file(5, 1, END, [(0, 1), (1, 1), (0, 3)], where, one(3), GREY, one(0), one(200), GREY, one(0))
    assert greens(W.decode(data)) == [[3, 3, 3, 3, 200]]
