"""Nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are scaled to length one, where the largest cosine is the smallest
distance, and projected to ``PROJECTED`` dimensions by a fixed Gaussian (2-stable)
matrix. For a true distance s the squared projected distance over s**2 follows a
chi-square law with that many degrees of freedom. A query takes leaves of the
kd-tree in the order of projected distance, in steps that double, and verifies
their points on the original vectors. A leaf so far off that a point at the
distance of the current k-th best would, with probability ``sure``, be nearer in
projection is left out. Expected recall is thus at least ``sure``.

The tree's upper levels are fitted on a sample of at most ``SAMPLE`` projections;
they deal all vectors into cells, and a crowded cell into parts. Each part is
split on by its own medians down to leaves, and the vectors are written once, in
the order of their leaves. Nothing else moves them: the queries go out in chunks
of about ``CHUNK_BYTES``, every task streams its share of the table past a chunk
and returns at most k rows a query. What is shuffled is thus the vectors once and
k rows for each query and task.

Scores are cosines in double precision on the original vectors, which keep their
own type until then; each is first scaled by a power of two, which changes no
cosine and keeps products of huge or tiny components finite.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id; vectors of different
dimension are never compared; rows with the query's own id are no candidates;
equal scores go by the smaller id; repeated query rows give repeated answers;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import place, positional
from quillgraph.session import written

PROJECTED, SEED = 8, 5
LEAF = 64
#: Vectors that the upper levels are fitted on, vectors a cell aims at, and bytes of queries in one pass.
SAMPLE, BLOCK_ROWS, CHUNK_BYTES = 1 << 16, 8192, 32 << 20
#: Queries that meet a batch at once, pairs verified at once, and what a block product or a projection may be off.
AT_ONCE, PAIRS, SLACK = 2048, 1 << 15, 1e-9


def chi_square_cdf(x: float, freedom: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 16.0 * freedom + 200
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < p else (low, middle)
    return high


def projection(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dimension, PROJECTED))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double vectors, each by a power of two that brings its largest component near one, and their lengths."""
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) if len(v) else v
    return v, np.sqrt((v * v).sum(axis=1))


def projected(vectors: np.ndarray) -> np.ndarray:
    v, norms = scaled(vectors)
    return (v / norms[:, None]) @ projection(v.shape[1])


# --- the tree -----------------------------------------------------------------------------------


def split(points: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """(axis, value) at the median of the widest axis; points up to the value go left. None if all are equal."""
    part = points[rows]
    spread = np.ptp(part, axis=0)
    axis = int(spread.argmax())
    if not spread[axis]:
        return None
    value = float(np.median(part[:, axis]))
    if value >= part[:, axis].max():  # many at the top: they go right together
        value = float(part[:, axis][part[:, axis] < value].max())
    return axis, value


def leaves(points: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Rows of each leaf; points that are all equal stay together."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        cut = split(points, rows) if len(rows) > most else None
        if cut is None:
            out.append(rows)
            continue
        left = points[rows, cut[0]] <= cut[1]
        todo += [rows[~left], rows[left]]
    return out


@dataclass
class Top:
    """The upper levels: for each node its axis, its value and its children; a leaf of these levels is its own child."""

    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    depth: int

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> Top:
        axis, value, child, todo, depth = [0], [0.0], [[0, 0]], [(0, np.arange(len(points)), 0)], 0
        while todo and len(axis) < 2 * cells - 1:
            node, rows, level = todo.pop(0)  # breadth first
            cut = split(points, rows) if len(rows) > 1 else None
            if cut is None:
                continue
            left = points[rows, cut[0]] <= cut[1]
            axis[node], value[node], child[node] = cut[0], cut[1], [len(axis), len(axis) + 1]
            for part in (rows[left], rows[~left]):
                todo.append((len(axis), part, level + 1))
                child.append([len(axis), len(axis)])
                axis.append(0)
                value.append(0.0)
            depth = max(depth, level + 1)
        return cls(np.array(axis), np.array(value), np.array(child), depth)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.value[node]
            node = self.child[node, right.astype(np.int64)]
        return node


# --- verification ---------------------------------------------------------------------------------


class Search:
    """The k best so far for the queries of one chunk and dimension."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bound: float):
        self.numbers, self.own, self.k, self.bound = numbers, ids, k, bound
        self.vectors, self.norms = scaled(vectors)
        self.unit = self.vectors / self.norms[:, None]
        self.spots = self.unit @ projection(vectors.shape[1])
        self.scores, self.ids = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def reach(self) -> np.ndarray:
        """How far in projection, squared, a leaf may be for each query."""
        worst = self.scores[:, -1]
        return np.where(np.isfinite(worst), self.bound * np.maximum(0.0, 2 - 2 * worst) + SLACK, np.inf)

    def block(self, ids: np.ndarray, vectors: np.ndarray, starts: np.ndarray) -> None:
        """Take in vectors whose leaves begin at ``starts``."""
        v, norms = scaled(vectors)
        unit = v / norms[:, None]
        points = unit @ projection(v.shape[1])
        low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        ends = [*starts[1:].tolist(), len(ids)]
        away = np.zeros((len(starts), len(self.own)))
        for d in range(points.shape[1]):
            gap = np.maximum(0.0, np.maximum(low[:, d, None] - self.spots[:, d], self.spots[:, d] - high[:, d, None]))
            away += gap * gap
        rank = np.argsort(np.argsort(away, axis=0, kind="stable"), axis=0, kind="stable")
        done, step = 0, 2
        while done < len(starts):
            wanted = (rank >= done) & (rank < done + step) & (away <= self.reach())
            if not ((rank >= done) & (away <= self.reach())).any():
                break
            for leaf in np.flatnonzero(wanted.any(axis=1)).tolist():
                a, b = int(starts[leaf]), ends[leaf]
                asked = np.flatnonzero(wanted[leaf])
                width = max(1, PAIRS // (b - a))
                for q in range(0, len(asked), width):
                    self._verify(ids[a:b], v[a:b], norms[a:b], unit[a:b], asked[q : q + width])
            done, step = done + step, 2 * step

    def _verify(self, ids: np.ndarray, v: np.ndarray, norms: np.ndarray, unit: np.ndarray, asked: np.ndarray) -> None:
        near = unit @ self.unit[asked].T >= self.scores[asked, -1] - SLACK
        rows, at = np.nonzero(near & (ids[:, None] != self.own[asked]))
        if not len(rows):
            return
        q = asked[at]
        exact = (v[rows] * self.vectors[q]).sum(axis=1) / (norms[rows] * self.norms[q])
        some = np.unique(q)
        all_q = np.concatenate([np.repeat(some, self.k), q])
        all_scores, all_ids = np.concatenate([self.scores[some].ravel(), exact]), np.concatenate([self.ids[some].ravel(), ids[rows]])
        order = np.lexsort((all_ids, -all_scores, all_q))
        first = np.searchsorted(all_q[order], some)
        best = order[first[:, None] + np.arange(self.k)]
        self.scores[some], self.ids[some] = all_scores[best], all_ids[best]

    def found(self) -> list[np.ndarray]:
        """_query, query_id, vec_id, score of what has been found."""
        q, j = np.nonzero(np.isfinite(self.scores))
        return [self.numbers[q], self.own[q], self.ids[q, j], self.scores[q, j]]


# --- tables -----------------------------------------------------------------------------------------


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding, dimension: the rows that take part; floats stay floats, other numbers become doubles."""
    inside = positional(df)
    kind = inside.schema[place(df, embedding)].dataType
    kind = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    v, limit = F.col("embedding"), F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)
    base = inside.select(F.col(place(df, vec_id)).cast("long").alias("vec_id"), F.col(place(df, embedding)).cast(kind).alias("embedding"))
    base = base.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0))
    return base.withColumn("dimension", F.size("embedding"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _by_dimension(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, pa.RecordBatch | pa.Table]]:
    sizes = batch.column("dimension").to_numpy()
    for d in np.unique(sizes).tolist():
        yield d, batch.filter(pa.array(sizes == d))


def _pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, mine in _by_dimension(batch):
            points = projected(_matrix(mine.column("embedding"), d))
            yield pa.RecordBatch.from_arrays([mine.column("dimension"), pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), PROJECTED).cast(pa.list_(pa.float64()))], ["dimension", "point"])


def _tops(rows: DataFrame, n: int) -> dict[int, Top]:
    """Upper levels for each dimension that the sample holds; a sampled row is PROJECTED numbers, whatever its dimension."""
    part = rows.select("dimension", "embedding")
    part = (part if n <= SAMPLE else part.sample(0.9 * SAMPLE / n, SEED)).limit(SAMPLE)
    sample = part.mapInArrow(_pointed, "dimension int, point array<double>").toArrow()
    cells, out = -(-n // BLOCK_ROWS), {}
    for d, mine in _by_dimension(sample):
        points = _matrix(mine.column("point").combine_chunks(), PROJECTED)
        out[d] = Top.fit(points, min(-(-cells * len(points) // sample.num_rows), -(-len(points) // 8)))
    return out


def indexed(vectors: DataFrame) -> DataFrame:
    """dimension, part, leaf, vec_id, embedding: all usable vectors, written in the order of their leaves."""
    rows = written(usable(vectors), "ann-rows")
    n, names, spark = rows.count(), rows.columns, rows.sparkSession
    sent = spark.sparkContext.broadcast(_tops(rows, n))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, mine in _by_dimension(batch):
                top = sent.value.get(d)
                cells = top.cell(projected(_matrix(mine.column("embedding"), d))) if top else np.zeros(mine.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(cells)], [*names, "cell"])

    dealt = written(rows.mapInArrow(celled, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())])).withColumn("row", F.monotonically_increasing_id()), "ann-cells")
    crowds = dealt.groupBy("dimension", "cell").agg(F.ceil(F.count("*") / (2 * BLOCK_ROWS)).alias("parts"))
    crowded = written(crowds.where("parts > 1"), "ann-crowded")  # bounded: a cell of this size holds 2 * BLOCK_ROWS rows, and cells are at most SAMPLE / 8
    salt = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    dealt = dealt.join(F.broadcast(crowded), ["dimension", "cell"], "left").withColumn("part", F.xxhash64("dimension", "cell", salt))

    def leaved(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        d = table.column("dimension")[0].as_py()
        found = leaves(projected(_matrix(table.column("embedding").combine_chunks(), d)))
        order = np.concatenate(found)
        leaf = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
        table = table.select(["dimension", "part", "vec_id", "embedding"]).take(pa.array(order))
        return table.add_column(2, "leaf", pa.array(leaf))

    kind = rows.schema["embedding"].dataType
    schema = T.StructType().add("dimension", "integer").add("part", "long").add("leaf", "integer").add("vec_id", "long").add("embedding", kind)
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // (8 * BLOCK_ROWS)))  # a pass over the table has work for all cores
    return written(dealt.repartition(tasks, "dimension", "part").groupBy("dimension", "part").applyInArrow(leaved, schema), "ann-leaves")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, sure: float = 0.98) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. Both inputs: vec_id, embedding."""
    spark = vectors.sparkSession
    table = indexed(vectors)
    asked = written(usable(queries).withColumn("_query", F.monotonically_increasing_id()), "ann-queries")
    size = asked.agg(F.sum(8 * F.col("dimension"))).first()[0] or 0
    chunks, bound = max(1, -(-size // CHUNK_BYTES)), chi_square_quantile(sure, PROJECTED)
    found = None
    for c in range(chunks):
        chunk = asked.where(F.pmod(F.xxhash64("_query"), F.lit(chunks)) == c).select("_query", "vec_id", "embedding", "dimension").toArrow()
        given = {d: tuple(t.column(x).to_numpy() for x in ("_query", "vec_id")) + (_matrix(t.column("embedding").combine_chunks(), d),) for d, t in _by_dimension(chunk)}
        sent = spark.sparkContext.broadcast(given)

        def passed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches = {d: [Search(*(x[a : a + AT_ONCE] for x in given), k, bound) for a in range(0, len(given[0]), AT_ONCE)] for d, given in sent.value.items()}
            for batch in batches:
                for d, mine in _by_dimension(batch):
                    if d in searches:
                        ids, given = mine.column("vec_id").to_numpy(), _matrix(mine.column("embedding"), d)
                        leaf = np.stack([mine.column("part").to_numpy(), mine.column("leaf").to_numpy()], axis=1)
                        starts = np.concatenate([[0], np.flatnonzero((leaf[1:] != leaf[:-1]).any(axis=1)) + 1])
                        for one in searches[d]:
                            one.block(ids, given, starts)
            for one in (x for several in searches.values() for x in several):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in one.found()], ["_query", "query_id", "vec_id", "score"])

        part = table.mapInArrow(passed, "_query long, query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("_query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
