"""Media columns: bytes kept as lossless WebP images, read back, and measured.

A payload becomes 8-bit samples, 64 to a row: grey pixels, or, where that is
smaller, channels of 16 pixels. Images have at most ``ROWS`` rows; a longer
payload is stored as several images, one after the other, each a whole file with
its own size, so any payload fits and memory is bounded. ``stored`` adds the column,
``read_back`` decodes it into sample arrays, ``measured`` turns samples into
features. All work row by row, nothing is shuffled.

Edge cases: a null or empty text is stored as one row of zeros; texts of any
length are stored whole; equal texts give equal bytes; repeated rows stay; an
empty table gives an empty result; further columns come out as they went in,
those with the names added here are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import webp
from quillgraph.llm.common import parts, place, positional

WIDTH, ROWS = 64, 4096


def padded(data: bytes) -> bytes:
    """``data`` and zeros up to a positive multiple of 64 bytes."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_media(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode_samples(samples[k : k + ROWS]) for k in range(0, len(samples), ROWS))


def from_media(media: bytes) -> np.ndarray:
    """Samples, (rows, 64), of all images in turn."""
    images, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        images.append(webp.decode_samples(media[at : at + size]))
        at += size
    return np.concatenate(images) if len(images) > 1 else images[0]


def feature(samples: np.ndarray) -> str:
    """Rows, mean, spread and a 64-bit average hash over an 8 x 8 grid of the image."""
    rows = np.minimum(np.arange(8) * len(samples) // 8, len(samples) - 1)
    cells = np.add.reduceat(samples, np.arange(0, WIDTH, 8), axis=1, dtype=np.int64)
    cells = np.add.reduceat(cells, rows, axis=0) if len(samples) >= 8 else cells[rows]
    heights = np.diff([*rows, len(samples)]) if len(samples) >= 8 else np.ones(8, np.int64)
    grid = cells / (8 * heights[:, None])
    total, squares = int(samples.sum(dtype=np.int64)), float(np.square(samples, dtype=np.int64).sum()) if len(samples) else 0.0
    mean = total / samples.size
    mark = np.packbits(grid > mean).tobytes().hex()
    return f"{len(samples)}x{WIDTH} mean={mean:.4f} sd={max(0.0, squares / samples.size - mean * mean) ** 0.5:.4f} ahash={mark}"


def _mapped(df: DataFrame, value: Column, kind: str, added: str, make) -> DataFrame:
    """``df`` and columns made of one value a row; ``make`` gives a tuple for each. Columns go by place, whatever their names."""
    inside, schema = positional(df), T._parse_datatype_string(added)
    keep = [at for at, c in zip(inside.columns, df.columns) if c.lower() not in schema.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        for part in parts(batches, "given"):
            rows = [make(x) for x in part.column("given").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], [*keep, *(f"new_{c}" for c in schema.names)])

    made = T.StructType([T.StructField(f"new_{f.name}", f.dataType) for f in schema.fields])
    found = inside.select(*keep, value.cast(kind).alias("given")).mapInArrow(run, T.StructType([*(inside.schema[c] for c in keep), *made.fields]))
    return found.toDF(*(c for c in df.columns if c.lower() not in schema.names), *schema.names)


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes and media, the text's UTF-8 bytes as images."""

    def make(data: bytes | None) -> tuple:
        return len(data or b""), to_media(padded(data or b""))

    return _mapped(docs, F.col(place(docs, text)).cast("string"), "binary", "n_bytes long, media binary", make)


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with samples (binary, 64 bytes a row) decoded from the stored bytes."""
    return _mapped(df, F.col(place(df, media)), "binary", "samples binary", lambda m: (None if m is None else from_media(m).tobytes(),))


def measured(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what the stored bytes hold: digests of payload and media, and the feature."""

    def make(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        samples = from_media(data)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)

    return _mapped(df, F.col(place(df, media)), "binary", "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
