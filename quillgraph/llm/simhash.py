"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has bit b set if more than half of its shingle hashes
have it. Two fingerprints link if they differ in few bits (``threshold``).

Candidates come from a covering code. The anchors are the pairs of words of the
binary Golay code, laid over bits 0-22 and 23-45; the code is perfect, so every
fingerprint has exactly one anchor within its covering radius, three bits a
block: its home. A fingerprint is replicated to every anchor within covering
radius plus threshold of it, the excess over the radius shared between the two
blocks. If x and y differ in at most ``threshold`` bits, y is that near to the
home of x: each block of y is at most 3 + (the bits of that block in which they
differ) away. So comparing, at every anchor, those at home with all that were
sent there finds every link. That is about 61 rows per distinct fingerprint and
2**24 anchors, each with few at home.

Equal fingerprints are one row from the start, so copies are never expanded.
At an anchor, only a spanning forest of the links found goes on, and the
connected components come from alternating star contractions over written
tables; nothing is collected to the driver.

Edge cases: null and empty texts have fingerprint zero and link like any other;
fewer words than a shingle: the whole sequence is the one shingle; equal rows
end up in one component; a component without any non-null id has a null id; an
empty table gives an empty result; further columns of the input are ignored or,
in ``drop_duplicates``, come out as they went in, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import joined_evenly, parts, place, positional
from quillgraph.session import written

SEED = 42
RADIUS, BLOCK = 3, 23  # of the Golay code
GOLAY = 0b110001110101  # its generator polynomial
#: An anchor with more at home than this is salted: homes are split, visitors copied.
HOME_ROWS = 1 << 16
#: Cells (home x visitor) compared at once.
TILE = 1 << 22


# --- fingerprints ---------------------------------------------------------------------


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included."""
    found = (text or b"").lower().split()  # bytes: A-Z only, the six ASCII white-space characters
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-words]])
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())]), ">u8").astype(np.uint64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        votes += np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, words: int, text: str, columns: list[str], name: str = "fingerprint") -> DataFrame:
    """``columns`` of ``docs`` and the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_shingled"):
            prints = np.array([fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*columns, name])

    bare = docs.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").cast("string").cast("binary").alias("_shingled"))
    schema = bare.drop("_shingled").schema.add(name, "long")
    return bare.mapInArrow(run, schema)


# --- anchors ----------------------------------------------------------------------------


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = values.copy()
    for bit in range(BLOCK - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@cache
def _coset_errors(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For excess 0..threshold: (start by syndrome, errors), the words of weight <= 3 or = 3 + excess."""
    from itertools import combinations

    found = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if not excess else [RADIUS + excess]
        errors = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(BLOCK), w)], np.int64)
        s = _syndromes(errors)
        order = np.argsort(s, kind="stable")
        found.append((np.searchsorted(s[order], np.arange(2049)), errors[order]))
    return found


def _near(block: np.ndarray, excess: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word) for every code word at the given excess from each block."""
    starts, errors = _coset_errors(threshold)[excess]
    s = _syndromes(block)
    n = starts[s + 1] - starts[s]
    rows = np.repeat(np.arange(len(block)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return rows, block[rows] ^ errors[starts[s][rows] + inner]


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) for unsigned fingerprints."""
    mask = np.uint64((1 << BLOCK) - 1)
    low, high = (prints & mask).astype(np.int64), (prints >> np.uint64(BLOCK) & mask).astype(np.int64)
    out = []
    for first in range(threshold + 1):
        rows, one = _near(low, first, threshold)
        for second in range(threshold + 1 - first):
            sub, two = _near(high[rows], second, threshold)
            out.append((rows[sub], one[sub] | two << BLOCK, np.full(len(sub), first == second == 0)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _dealt(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                prints = whole.column(0).slice(k, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                rows, at, home = anchors(prints, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(~home), pa.array(prints[rows].view(np.int64))], ["anchor", "visits", "fingerprint"])

    return run


def _forest(homes: np.ndarray, visitors: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between the two sets connect."""
    near = np.bitwise_count(homes[:, None] ^ visitors[None, :]) <= threshold
    a, b = np.nonzero(near)
    if len(a) <= 2 * (len(homes) + len(visitors)):
        return homes[a], visitors[b]
    own, other = np.arange(len(homes)), np.full(len(visitors), len(homes))
    while True:  # lowest row of a component, by both sides in turn
        new_other = np.where(near, own[:, None], len(homes)).min(axis=0)
        new_own = np.minimum(own, np.where(near, new_other[None, :], len(homes)).min(axis=1))
        if (new_own == own).all() and (new_other == other).all():
            break
        own, other = new_own, new_other
    inside = other < len(homes)
    return np.concatenate([homes[own], homes[other[inside]]]), np.concatenate([homes, visitors[inside]])


def _compared(threshold: int):
    """Rows come sorted by (anchor, salt, visits): those at home, then those sent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes = None, np.zeros(0, np.uint64)
        for batch in batches:
            anchor, salt, visits, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            prints = prints.view(np.uint64)
            if not len(anchor):
                continue
            starts = np.concatenate([[0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(anchor)]])
            left, right = [], []
            if key != (anchor[0], salt[0]):
                homes = np.zeros(0, np.uint64)
            # most anchors have nobody at home: only the others are looked at
            for g in np.union1d([0, len(starts) - 2], np.flatnonzero(~visits[starts[:-1]])).tolist():
                a, b = int(starts[g]), int(starts[g + 1])
                m = a + int(np.searchsorted(visits[a:b], True))
                own = prints[a:m]
                homes = own if g else np.concatenate([homes, own])
                # those at home come first and are compared with each other as well
                step = max(1, TILE // max(1, len(homes)))
                for k in range(a, b if len(homes) else a, step):
                    x, y = _forest(homes, prints[k : min(b, k + step)], threshold)
                    left.append(x[x != y])
                    right.append(y[x != y])
            key = (anchor[-1], salt[-1])
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """a, b: edges between distinct fingerprints with the components of all links."""
    sent = prints.select("fingerprint").mapInArrow(_dealt(threshold), "anchor long, visits boolean, fingerprint long")
    crowded = prints.select("fingerprint").mapInArrow(_homes(threshold), "anchor long").groupBy("anchor").count().where(F.col("count") > HOME_ROWS)
    crowded = written(crowded, "simhash-crowded")
    if crowded.isEmpty():
        sent = sent.withColumn("salt", F.lit(0))
    else:
        salts = F.ceil(F.coalesce("count", F.lit(1)) / HOME_ROWS).cast("int")
        spread = F.when(F.col("visits"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("fingerprint"), salts).cast("int")))
        # homes must meet the homes of other salts as well: they visit those
        both = sent.unionByName(sent.where("not visits").withColumn("visits", F.lit(True)))
        sent = both.join(crowded, "anchor", "left").withColumn("salt", F.explode(spread)).drop("count")
    grouped = sent.select("anchor", "salt", "visits", "fingerprint").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "visits")
    return grouped.mapInArrow(_compared(threshold), "a long, b long").distinct()


def _homes(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            mask = np.uint64((1 << BLOCK) - 1)
            low, high = (prints & mask).astype(np.int64), (prints >> np.uint64(BLOCK) & mask).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_near(low, 0, threshold)[1] | _near(high, 0, threshold)[1] << BLOCK)], ["anchor"])

    return run


# --- components --------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, by alternating star contractions.

    A hub's links are spread over all tasks: see ``joined_evenly``.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    lowest = [F.min("v").alias("m"), F.count("*").alias("n")]
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(around.groupBy("u").agg(*lowest).withColumn("m", F.least("u", "m")), "large-low")
        large = joined_evenly(around, low, "u", 2 * edges.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        low = written(large.groupBy("u").agg(*lowest), "small-low")
        small = joined_evenly(large, low, "u", large.count())
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        small = written(small.select("x.*").where("u <> v").distinct(), "small-star")
        if _same(edges, small):
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def _same(one: DataFrame, two: DataFrame) -> bool:
    digest = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    return one.agg(*digest).first() == two.agg(*digest).first()


def rooted(prints: DataFrame, threshold: int) -> DataFrame:
    """``prints`` (a row per fingerprint) with root, the same for all that links connect."""
    roots = components(links(prints, threshold)).withColumnRenamed("node", "fingerprint")
    return prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def clusters(rows: DataFrame, threshold: int = 2) -> DataFrame:
    """``rows`` (doc_id, fingerprint, ...) with component_id, the smallest doc_id reachable."""
    prints = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    found = written(rooted(prints, threshold), "simhash-members")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = joined_evenly(found.select("fingerprint", "root", F.col("n").alias("copies")), least, "root", found.count())
    named = written(named.select("fingerprint", "component_id", F.col("copies").alias("n")), "simhash-named")
    return joined_evenly(rows, named, "fingerprint", rows.count())


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = written(with_fingerprint(slim, words, "text", ["doc_id"]), "simhash-rows")
    found = clusters(rows, threshold)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the smallest id, nulls last; all its columns as they are.

    Only the numbers of the rows that stay are joined back, so texts are shuffled
    once at most; columns go by their places, whatever their names.
    """
    inside = positional(docs)
    numbered = with_fingerprint(inside, words, place(docs, text), inside.columns)
    numbered = written(numbered.withColumn("row", F.monotonically_increasing_id()), "simhash-docs")
    rows = numbered.select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), "fingerprint", "row")
    kept = first_rows(rows, threshold)
    return numbered.join(kept, "row", "left_semi").select(*inside.columns).toDF(*docs.columns)


def first_rows(rows: DataFrame, threshold: int) -> DataFrame:
    """row: of each component the one with the smallest doc_id. Copies are reduced to their fingerprint's first row before anything is joined."""
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    prints = written(rows.groupBy("fingerprint").agg(F.min(least).alias("least")), "prints")
    return rooted(prints, threshold).groupBy("root").agg(F.min("least").alias("least")).select("least.row")
