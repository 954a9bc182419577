"""Line deduplication through a sharded minimal perfect hash.

1. Every document gives the set of its line keys, hashed to 128 bits; batches
   add up what they hold before anything is shuffled.
2. The distinct hashes found in enough documents are split into shards by their
   first half. Each shard gets a minimal perfect hash (levels of bit arrays in
   which a key owns a bit that no other key of the level hits) and, at the
   hash's index, arrays of 64-bit fingerprints (the second half) and counts.
   Hashes below the threshold can never drop a line, so they are left out; a
   line that was left out fails on the fingerprint.
3. Documents probe the arrays where they are: no line is joined or shuffled a
   second time. The index's size is known when it is written. Up to
   ``PASS_BYTES`` it is broadcast whole. A larger one is worked off in groups of
   shards within that bound: each document's line hashes are written once, every
   group passes over those and gives only row numbers and the places of lines
   that go, and the texts are read once more at the end.

A key is the line stripped of ASCII white space at both ends, A-Z lower-cased.

Edge cases: a null text counts as one empty line and becomes an empty text;
empty keys are never dropped; a document whose lines all go keeps its row with
an empty text; a line repeated inside a document counts once for it; rows with
equal or null ids count as documents of their own; an empty table gives an empty
result. Columns other than the text pass through untouched, whatever their names.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import parts, place, positional
from quillgraph.session import written

#: Keys a shard aims at, and bytes of index that one pass over the documents holds.
SHARD_KEYS = 1 << 20
PASS_BYTES = 128 << 20
GAMMA = 2.0  # bits per key at each level of the perfect hash


def line_keys(text: bytes | None) -> list[bytes]:
    return [line.strip().lower() for line in (text or b"").split(b"\n")]  # bytes: ASCII rules


def _halves(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 0):
        seen: Counter[bytes] = Counter()
        for text in batch.column(0).to_pylist():
            seen.update(set(line_keys(text)) - {b""})
        h = _halves(list(seen)).view("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], ["h1", "h2", "n"])


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """h1, h2, n: the number of documents for every distinct line hash."""
    bare = positional(docs).select(F.col(place(docs, text)).cast("string").cast("binary").alias("text"))
    return bare.mapInArrow(_counted, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A bit for each key at a level: a finaliser over key and level, then modulo."""
    x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> bytes:
    """The index of one shard: levels, then fingerprints and counts by index.

    Keys that share h1 (a 64-bit collision) are stored in a plain list at the
    end, so that no hash is ever lost.
    """
    order = np.lexsort((h2, h1))
    h1, h2, counts = h1[order], h2[order], counts[order]
    alone = np.ones(len(h1), bool)
    alone[1:] &= h1[1:] != h1[:-1]
    extra = ~alone
    keys, levels = h1[alone], []
    where, base, left = np.zeros(len(keys), np.int64), 0, np.arange(len(keys))
    while len(left):
        size = max(64, int(GAMMA * len(left)) + 63 & ~63)
        spot = _spot(keys[left], len(levels), size)
        hits = np.bincount(spot.astype(np.int64), minlength=size)
        bits = hits == 1
        own = bits[spot.astype(np.int64)]
        ranks = np.cumsum(bits) - 1
        where[left[own]] = base + ranks[spot[own].astype(np.int64)]
        levels.append(np.packbits(bits, bitorder="little"))
        base += int(bits.sum())
        left = left[~own]
    prints, tally = np.zeros(base, "<u8"), np.zeros(base, "<u4")
    prints[where], tally[where] = h2[alone], np.minimum(counts[alone], 2**32 - 1)
    head = struct.pack("<III", len(levels), base, int(extra.sum())) + b"".join(struct.pack("<I", len(x) * 8) for x in levels)
    rest = np.stack([h1[extra], h2[extra], counts[extra].astype("<u8")]) if extra.any() else np.zeros((3, 0), "<u8")
    return head + b"".join(x.tobytes() for x in levels) + prints.tobytes() + tally.tobytes() + rest.astype("<u8").tobytes()


class Shard:
    """A shard's arrays, read in place from its bytes."""

    def __init__(self, blob: bytes):
        n, total, extra = struct.unpack_from("<III", blob)
        sizes, at = struct.unpack_from(f"<{n}I", blob, 12), 12 + 4 * n
        self.levels, base = [], 0
        for size in sizes:
            words = np.frombuffer(blob, "<u8", size // 64, at)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((size, words, base + before))
            base, at = base + int(before[-1]), at + size // 8
        self.prints = np.frombuffer(blob, "<u8", total, at)
        self.counts = np.frombuffer(blob, "<u4", total, at + 8 * total)
        rest = np.frombuffer(blob, "<u8", 3 * extra, at + 12 * total).reshape(3, -1)
        self.extra = {(int(a), int(b)): int(c) for a, b, c in rest.T}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count stored for each hash; 0 for a hash that isn't in the index."""
        found, left = np.zeros(len(h1), np.int64), np.arange(len(h1))
        for level, (size, words, before) in enumerate(self.levels):
            spot = _spot(h1[left], level, size)
            word, bit = (spot >> np.uint64(6)).astype(np.int64), spot & np.uint64(63)
            own = (words[word] >> bit) & np.uint64(1) == 1
            inner = np.bitwise_count(words[word[own]] & ((np.uint64(1) << bit[own]) - np.uint64(1)))
            index, rows = before[word[own]] + inner, left[own]
            same = self.prints[index] == h2[rows]
            found[rows[same]] = self.counts[index[same]]
            left = left[~own]
        for k in range(len(h1)) if self.extra else ():
            found[k] = self.extra.get((int(h1[k]), int(h2[k])), found[k])
        return found


def build_index(counts: DataFrame, min_docs: int) -> DataFrame:
    """shard, bytes, blob: one row per shard of the hashes found in ``min_docs`` documents."""
    often = written(counts.where(F.col("n") >= min_docs), "line-counts")
    shards = max(1, -(-often.count() // SHARD_KEYS))
    dealt = often.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_numpy().astype("<i8").view("<u8") for c in ("h1", "h2", "n")]
        blob = build_shard(*columns)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bytes": pa.array([len(blob)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    # a shard holds about SHARD_KEYS hashes, dealt evenly as hashes are distinct
    return written(dealt.groupBy("shard").applyInArrow(built, "shard int, bytes long, blob binary"), "line-index"), shards


def _passes(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Shards in groups of at most PASS_BYTES (a shard alone may exceed it by its own size)."""
    groups: list[list[int]] = [[]]
    room = PASS_BYTES
    for shard, size in sorted(sizes):
        if groups[-1] and size > room:
            groups.append([])
            room = PASS_BYTES
        groups[-1].append(shard)
        room -= size
    return groups


def _flags(h: np.ndarray, index: dict[int, Shard], shards: int) -> np.ndarray:
    """For every hash, whether the shards at hand hold it. An empty key never counts: it was not indexed."""
    hit = np.zeros(len(h), bool)
    shard = h[:, 0].view("<i8") % np.int64(shards)  # numpy's remainder is never negative
    for s, held in index.items():
        rows = np.flatnonzero(shard == s)
        hit[rows] = held.probe(h[rows, 0], h[rows, 1]) > 0
    return hit


def _without(texts: list[bytes | None], marks: list[np.ndarray]) -> list[pa.Array]:
    """text, n_lines, n_dropped of documents whose marked lines go."""
    out = []
    for text, mark in zip(texts, marks):
        if mark.any():
            text = b"\n".join(line for line, drop in zip(text.split(b"\n"), mark) if not drop)
        out.append((text or b"").decode())
    return [pa.array(out, pa.string()), pa.array([len(m) for m in marks], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64())]


def _in_one_pass(inside: DataFrame, text: str, keep: list[str], sent, shards: int, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: Shard(blob) for s, blob in sent.value.items()}
        for batch in parts(batches, "bytes"):
            texts = batch.column("bytes").to_pylist()
            keys = [line_keys(t) for t in texts]
            ids: dict[bytes, int] = {}
            at = np.fromiter((ids.setdefault(k, len(ids)) for doc in keys for k in doc), np.int64)
            flags = _flags(_halves(list(ids)), index, shards)[at]
            marks = np.split(flags, np.cumsum([len(doc) for doc in keys])[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *_without(texts, marks)], schema.names)

    return inside.select(*keep, F.col(text).cast("string").cast("binary").alias("bytes")).mapInArrow(run, schema)


def _in_passes(inside: DataFrame, text: str, keep: list[str], groups: list[dict], shards: int, schema: T.StructType) -> DataFrame:
    """``groups``: of the index's rows; each is broadcast in turn."""
    spark = inside.sparkSession
    rows = written(inside.select(*keep, F.col(text).cast("string").cast("binary").alias("bytes"), F.monotonically_increasing_id().alias("row")), "line-rows")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "bytes"):
            blobs = [_halves(line_keys(t)).tobytes() for t in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(blobs, pa.binary())], ["row", "hashes"])

    hashes = written(rows.select("bytes", "row").mapInArrow(hashed, "row long, hashes binary"), "line-hashes")
    places = None
    for blobs in groups:
        sent = spark.sparkContext.broadcast(blobs())

        def probed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = {s: Shard(blob) for s, blob in sent.value.items()}
            for batch in parts(batches, "hashes"):
                found = [np.flatnonzero(_flags(np.frombuffer(b, "<u8").reshape(-1, 2), index, shards)).astype(np.int32) for b in batch.column("hashes").to_pylist()]
                some = [k for k, x in enumerate(found) if len(x)]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(some, pa.int64())), pa.array([found[k] for k in some], pa.list_(pa.int32()))], ["row", "gone"])

        pass_by = written(hashes.mapInArrow(probed, "row long, gone array<int>"), "line-places")
        sent.unpersist()
        places = pass_by if places is None else places.unionByName(pass_by)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "bytes"):
            texts, marks = batch.column("bytes").to_pylist(), []
            for t, gone in zip(texts, batch.column("gone").to_pylist()):
                marks.append(np.zeros((t or b"").count(b"\n") + 1, bool))
                marks[-1][gone or []] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *_without(texts, marks)], schema.names)

    gone = places.groupBy("row").agg(F.flatten(F.collect_list("gone")).alias("gone"))  # no more than a document has lines
    return rows.join(gone, "row", "left").select(*keep, "bytes", "gone").mapInArrow(cut, schema)


def _deduped(docs: DataFrame, min_docs: int, text: str, keep: list[str]) -> DataFrame:
    """``keep`` (columns by place), then text, n_lines and n_dropped."""
    inside, spark = positional(docs), docs.sparkSession
    index, shards = build_index(document_counts(docs, text), min_docs)
    sizes = [(r.shard, r.bytes) for r in index.select("shard", "bytes").collect()]  # a row per 2**20 hashes
    groups = [lambda g=g: {r.shard: bytes(r.blob) for r in index.where(F.col("shard").isin(g)).collect()} if g else {} for g in _passes(sizes)]
    schema = T.StructType([inside.schema[c] for c in keep]).add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    if len(groups) > 1:
        return _in_passes(inside, place(docs, text), keep, groups, shards, schema)
    return _in_one_pass(inside, place(docs, text), keep, spark.sparkContext.broadcast(groups[0]()), shards, schema)


def dedup_lines(docs: DataFrame, columns: list[str], min_docs: int = 10, text: str = "text") -> DataFrame:
    """``columns`` of ``docs``, then text without the lines whose key is in at least ``min_docs`` documents, n_lines (before) and n_dropped."""
    return _deduped(docs, min_docs, text, [place(docs, c) for c in columns]).toDF(*columns, "text", "n_lines", "n_dropped")


def without_common_lines(docs: DataFrame, min_docs: int = 10, text: str = "text") -> DataFrame:
    """``docs`` with those lines gone from its texts; every column keeps its name and place, the others their values."""
    inside, at = positional(docs), place(docs, text)
    found = _deduped(docs, min_docs, text, [c for c in inside.columns if c != at])
    return found.select(*(F.col("text" if c == at else c) for c in inside.columns)).toDF(*docs.columns)
