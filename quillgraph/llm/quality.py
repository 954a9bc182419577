"""A quality classifier on document statistics.

A text becomes a vector of statistics (``STATISTICS``). Random Fourier features
stand in for a Gaussian kernel over them; every partition sums its share of the
ridge regression's normal equations, the sums are added and solved once. A part
of the training rows is kept out of the sums for isotonic calibration: their raw
scores are counted in bins, pooled until they rise, and interpolated, so the
final score is a probability that label 1 holds. What reaches the driver has a
fixed size (at most ``SUM_TASKS`` sums, as a tree of tasks adds up more, and
``BINS`` bins); all labelled training rows take part, however many.

A row is held out if crc32 of its id, as text, modulo 3 is 1. Ids serve for that
alone; language, source and labels are never inputs of a score.

Edge cases: null and empty texts have statistics of their own and get a score;
rows with null labels are no training rows, a null id is never one and counts as
held out false; several labels of a document each count; without any training
row the score is 0.5, with one class only it is that class; equal texts get
equal scores; an empty table gives an empty result; further columns are ignored
or passed through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import parts, place, positional
from quillgraph.session import written

FEATURES, SEED, RIDGE = 256, 11, 1e-3
SUM_TASKS, BINS = 16, 2048
#: Rows that one task sums, and partial sums that the tree adds at once.
TASK_ROWS, FAN = 250_000, 32
SUMS = "place long, a binary, b binary, n long"
RAW_LOW, RAW_HIGH = -1.0, 2.0
#: One row in this many of the training rows calibrates.
CALIBRATION = 4

STATISTICS = (
    "log_bytes letters upper digits space stops symbols exclamations other word_mean word_sd log_words distinct distinct_growth top_word "
    "symbol_words upper_words repeated_lines log_line short_lines stop_words compressed repeated_pairs long_words"
).split()

_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\f", b".,;:?'\"()-", b"#$%&*|@^~<>{}[]\\=+_`/", b"!")):
    _CLASS[list(_set)] = _k + 1
_SYMBOL_END = re.compile(rb"[#$%&*|@^~<>{}\[\]\\=+_`!/]$")


def statistics(text: bytes | None) -> np.ndarray:
    """The vector of one whole text."""
    text = text or b""
    n = max(1, len(text))
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=8)
    other, lower, upper, digits, space, stops, symbols, exclaim = (kinds / n).tolist()
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    ends = sum(c for w, c in seen.items() if _SYMBOL_END.search(w))
    loud = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    stopped = sum(c for w, c in seen.items() if len(w) <= 3)
    pairs = len(set(zip(words, words[1:])))
    lines = text.split(b"\n")
    short = sum(len(x) < 40 for x in lines)
    packed = len(zlib.compress(text, 1)) / (n + 20)
    return np.array(
        [
            np.log1p(len(text)), lower + upper, upper / max(1e-9, lower + upper), digits, space, stops, symbols, exclaim, other,
            sizes.mean(), sizes.std(), np.log1p(len(words)), len(seen) / m, len(seen) / m**0.7, max(seen.values(), default=0) / m,
            ends / m, loud / m, 1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), short / len(lines), stopped / m,
            packed, 1 - pairs / max(1, m - 1) if m > 1 else 0.0, float((sizes > 15).mean()),
        ]
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_statistics(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` and ``statistics``, an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_measured"):
            rows = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            values = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, values)], [*columns, "statistics"])

    base = docs.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").cast("string").cast("binary").alias("_measured"))
    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField("statistics", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of standardised statistics, and a constant."""
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def rising(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: block centres and block means."""
    blocks: list[list[float]] = []
    for c, s, n in zip(centres, sums, counts):
        blocks.append([c * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([c / n for c, _, n in blocks]), np.array([s / n for _, s, n in blocks])


def _added(key: tuple, sums: pa.Table) -> pa.Table:
    """The sum of at most FAN partial sums."""
    add = lambda c: sum(np.frombuffer(x) for x in sums.column(c).to_pylist()).tobytes()
    return pa.table({"place": pa.array([key[0].as_py()], pa.int64()), "a": [add("a")], "b": [add("b")], "n": [sum(sums.column("n").to_pylist())]})


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", width: float = 0.12) -> Model:
    """``measured`` has doc_id and statistics. ``width``: of the kernel, for standardised statistics."""
    spark = measured.sparkSession
    k = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    waves, phases = rng.normal(0, width, (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y is not null")
    train = measured.join(told, "doc_id").where(~held_out(F.col("doc_id"))).select("statistics", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0).alias("calibrates"))
    train = written(train, "quality-train")
    moments = train.agg(F.count("*"), F.avg("y"), *(f(F.col("statistics")[i]) for i in range(k) for f in (F.avg, F.stddev_pop))).first()
    tasks = max(SUM_TASKS, -(-moments[0] // TASK_ROWS))
    model = Model(np.zeros(k), np.ones(k), waves, phases, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if not moments[0]:
        return model
    if moments[1] in (0.0, 1.0):
        model.levels = np.array([moments[1]])
        return model
    model.centre, model.spread = np.array(moments[2::2]), np.maximum(np.array(moments[3::2]), 1e-6)
    sent = spark.sparkContext.broadcast(model)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, rows = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            z = sent.value.lifted(_matrix(batch.column(0)))
            left, right, rows = left + z.T @ z, right + z.T @ batch.column(1).to_numpy(), rows + len(z)
        place = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([left.tobytes()]), pa.array([right.tobytes()]), pa.array([rows])], ["place", "a", "b", "n"])

    partial = train.where("not calibrates").select("statistics", "y").repartition(tasks).mapInArrow(sums, SUMS)
    while tasks > SUM_TASKS:  # a tree: FAN partial sums become one
        tasks = -(-tasks // FAN)
        partial = written(partial.withColumn("place", F.pmod("place", F.lit(tasks))).groupBy("place").applyInArrow(_added, SUMS), "quality-sums")
    found = partial.collect()  # at most SUM_TASKS rows
    left, right = (sum(np.frombuffer(bytes(p[c])) for p in found) for c in "ab")
    left, rows = left.reshape(FEATURES + 1, -1), sum(p.n for p in found)
    model.weights = np.linalg.solve(left + RIDGE * max(1, rows) / FEATURES * np.eye(FEATURES + 1), right)
    sent = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = sent.value.raw(_matrix(batch.column(0)))
            at = np.clip((raw - RAW_LOW) / (RAW_HIGH - RAW_LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    counts = train.where("calibrates").select("statistics", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    counts.sort()
    if counts:
        at, y, n = (np.array(x, float) for x in zip(*counts))
        model.knots, model.levels = rising(RAW_LOW + (at + 0.5) * (RAW_HIGH - RAW_LOW) / BINS, y, n)
    else:  # too few rows to calibrate: the raw score, cut to 0..1
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with score in place of its statistics."""
    sent = measured.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in measured.columns if c != "statistics"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.score(_matrix(batch.column("statistics")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], [*keep, "score"])

    base = measured.select(*(F.col(f"`{c}`") for c in keep), "statistics")
    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def classified(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; texts are read once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    measured = written(with_statistics(slim, ["doc_id"]), "quality-statistics")
    found = scored(measured, fit(measured, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, all columns as they are, whatever their names.

    The documents are measured once and written with their statistics; the model
    reads those alone, and the rows that stay are picked from what was written.
    """
    inside = positional(docs)
    measured = written(with_statistics(inside, inside.columns, place(docs, text)), "quality-documents")
    model = fit(measured.select(F.col(place(docs, "doc_id")).cast("long").alias("doc_id"), "statistics"), labels)
    return scored(measured, model).where("score >= 0.5").select(*inside.columns).toDF(*docs.columns)
