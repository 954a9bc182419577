import hashlib
import zlib

import numpy as np

from quillgraph.llm import media as M
from quillgraph.llm import queries, webp


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "é" * 31), (4, "x" * 64), (5, "y" * 65), (5, "y" * 65), (6, "long text " * 120_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, media string")
    got = {(r.doc_id, r.n_bytes): r for r in M.measured(M.stored(df)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert r.feature.startswith(f"{len(payload) // 64}x64 ")
    assert got[1, 0].media_sha256 == got[2, 0].media_sha256
    assert M.read_back(M.stored(df.where("doc_id = 4"))).first().samples == b"x" * 64
    assert M.measured(M.stored(df.limit(0))).count() == 0


def test_long_payloads_take_several_images(monkeypatch):
    monkeypatch.setattr(M, "ROWS", 3)
    payload = bytes(range(256)) * 2
    assert M.to_media(payload).count(b"WEBPVP8L") == 3
    assert M.from_media(M.to_media(payload)).tobytes() == payload


def steps(media):
    """What an image's head says: its transforms in order and whether it has a colour cache."""
    bits, found = webp.Bits(media[21:]), []
    bits.read(32)
    while bits.read(1):
        found.append(bits.read(2))
        if found[-1] in (webp.PREDICTOR, webp.CROSS_COLOUR):
            size = bits.read(3) + 2
            webp._entropy_image(bits, 1, 1, False)
            assert size == 9
        elif found[-1] == webp.PALETTE:
            webp._entropy_image(bits, bits.read(8) + 1, 1, False)
    return found, bool(bits.read(1))


def test_rows_of_the_query_reach_every_step(spark, tmp_path):
    """Texts for which each step makes the smallest image, through the registered query."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(c) for c in rng.integers(97, 123, 9))
    first = rng.integers(33, 90, 64)
    green = rng.integers(33, 126, 800)
    red = 30 + (green * 24 >> 5)
    shades = rng.permutation(np.arange(40, 52))[rng.integers(0, 12, 800)]
    quads = lambda b, g, r, a: "".join(map(chr, np.stack([b, g, r, a], axis=1).ravel()))
    texts = {
        "letters": "".join(chr(c) for c in rng.integers(33, 126, 640)),
        "references": "the same passage of words again, ".join(word() for _ in range(30)),
        "palette": "".join("01"[x] for x in (rng.random(6400) < 0.1).astype(int)),
        "predictor": "".join(chr(c) for k in range(30) for c in first + k),
        "cross colour": quads(red, green, red, rng.integers(65, 69, 800)),
        "cache": quads(shades, shades + 20, shades * 0 + 70, (shades * 7) % 50 + 60),
    }
    spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    stored = {r.doc_id: bytes(r.media) for r in M.stored(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    rows = {r.doc_id: r for r in queries.op7_media(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts.values()):
        assert rows[i].payload_sha256 == hashlib.sha256(M.padded(text.encode())).hexdigest()
        assert rows[i].media_sha256 == hashlib.sha256(stored[i]).hexdigest()
    found = {name: steps(stored[i]) for i, name in enumerate(texts)}
    assert found["letters"] == ([webp.SUBTRACT_GREEN], False)
    assert found["references"] == ([webp.SUBTRACT_GREEN], False) and len(stored[1]) < 0.6 * len(texts["references"])
    assert found["palette"] == ([webp.PALETTE], False)
    assert found["predictor"] == ([webp.SUBTRACT_GREEN, webp.PREDICTOR], False)
    assert found["cross colour"][0] == [webp.CROSS_COLOUR]
    assert found["cache"][1]


def test_feature_by_hand():
    flat = np.full((16, 64), 7, np.uint8)
    assert M.feature(flat) == "16x64 mean=7.0000 sd=0.0000 ahash=0000000000000000"
    half = np.zeros((16, 64), np.uint8)
    half[:, :32] = 200
    assert M.feature(half) == "16x64 mean=100.0000 sd=100.0000 ahash=f0f0f0f0f0f0f0f0"
