"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit position from a hash of its id and text. A source
takes whole copies of itself while its target allows, and for what remains the
documents below a threshold on that position. The threshold comes from
histograms: words are summed by (source, hash bucket), the bucket in which the
running sum crosses the budget is found, and only that bucket is divided again,
ten bits at a time, until all that it holds has one position. Rows are never
sorted, and a smaller budget takes a subset of what a larger one takes.

Equal rows (same id and text) share a position. Where the threshold falls on
such a group, as many of its rows are taken as come nearest to the budget: the
rows of that group alone are numbered, by counts of the tasks that hold them.

Edge cases: null and empty texts have size 0, take part and take 0 words; a
null source is a source of its own, last in order; of equal rows any may be
taken, their number is fixed; a source whose documents are all empty has target
0; an empty table gives an empty result; further columns of the input are
ignored or, in ``repeated``, come out as they went in, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import place, positional, projection, word_count
from quillgraph.operators.training_set import ranked
from quillgraph.session import written

BITS = 60  # of a position: fifteen hex digits
STEP = 10  # bits a level: at most 1,024 buckets a source
#: Sources are broadcast up to this many, joined with a shuffle beyond.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One slim row per document: doc_id, source, size, position."""
    base = projection(docs, {"doc_id": doc_id, "source": source, "text": text}, {"doc_id": "long", "source": "string", "text": "string"})
    return base.select("doc_id", "source", word_count(F.col("text")).alias("size"), _position(F.col("doc_id"), F.col("text")).alias("at"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, target: the water-filling of ``share`` of all words.

    Sources in code-point order (null last) get the weights in turn. A target
    stops at ``most`` times its source; what it leaves goes to the others by
    weight. The level that the others share is raised, a sum over all sources a
    round, until no further source is capped.
    """
    total = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-totals")
    turn = F.array(*map(F.lit, map(float, weights)))
    placed = ranked(total, [F.col("source").isNull(), F.col("source")], "place")
    goal = placed.select("source", "source_size", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"))
    goal = written(goal, "mixing-weights")
    everything = goal.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        x = goal.agg(F.count_if(over).alias("capped"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if x.capped == capped or not x.weights:
            break
        level, capped = (everything * share - (x.caps or 0.0)) / x.weights, x.capped
    return goal.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), "cap").alias("target"))


def _beside(left: DataFrame, right: DataFrame, few: bool, source: str = "source") -> DataFrame:
    """Join on a null-safe source; ``few``: the right side's size was checked."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(right) if few else right, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")


def thresholds(sizes: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """source, edge, rows, take: positions below ``edge`` are taken, and ``take`` of the rows at it; that sums to about ``rest`` words.

    ``wanted`` has source and rest, the words to take beyond whole copies.
    """
    rows, bounds = sizes.where("size > 0"), wanted.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(BITS // STEP):
        shift = BITS - STEP * (level + 1)
        rows = _beside(rows.select("source", "size", "at"), bounds.select("source", "rest", "prefix", "below"), few)
        rows = rows.where(F.col("rest").isNotNull() & (F.shiftright("at", shift + STEP) == F.col("prefix")))
        if level:
            rows = written(rows, "mixing-boundary")  # a thousandth of what it was
        held = rows.groupBy("source", F.shiftright("at", shift).alias("prefix")).agg(
            F.sum("size").alias("held"), F.first("rest").alias("rest"), F.first("below").alias("below"), F.count("*").alias("rows"), F.min("at").alias("edge"), F.max("at").alias("high")
        )
        order = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        crossed = held.withColumn("upto", F.col("below") + F.sum("held").over(order)).where("upto > rest")
        bounds = crossed.groupBy("source").agg(F.min_by(F.struct("rest", "prefix", (F.col("upto") - F.col("held")).alias("below"), "held", "rows", "edge", "high"), "prefix").alias("b")).select("source", "b.*")
        bounds = written(bounds, "mixing-bounds")
        if bounds.where("edge < high").isEmpty():
            break
    # rows at one position are of one size; one more comes in if that brings the sum nearer
    size, left = F.col("held") / F.col("rows"), F.col("rest") - F.col("below")
    fits = F.floor(left / size)
    nearer = (fits + 1) * size - left < left - fits * size
    return bounds.select("source", "edge", "rows", (fits + F.when(nearer, 1).otherwise(0)).cast("long").alias("take"))


def _position(doc_id: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _planned(sizes: DataFrame, weights: tuple[float, ...], share: float, most: int) -> tuple[DataFrame, bool]:
    """A row per source: source_size, target, whole (copies of all), edge, rows, take; and whether they are few."""
    goal = written(targets(sizes, weights, share, most), "mixing-targets")
    few = goal.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return written(_beside(goal, thresholds(sizes, goal.select("source", "rest"), few), few), "mixing-plan"), few


def _numbered(rows: DataFrame, source: str) -> DataFrame:
    """``rows`` with nth, from 0 within each source, in no particular order.

    Rows are numbered inside the task that holds them and shifted by the counts
    of the tasks before, so a group of any size stays where it is.
    """
    held = written(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "mixing-edge")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = held.groupBy(F.col(source).alias("source"), "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    inner = F.row_number().over(Window.partitionBy(source, "part").orderBy("place")) - 1
    offsets = counts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "before")
    met = held.withColumn("inner", inner).join(offsets, (F.col("part") == F.col("_part")) & F.col(source).eqNullSafe(F.col("_source")))
    return met.withColumn("nth", F.col("inner") + F.col("before")).drop("part", "place", "inner", "before", "_source", "_part")


def _with_copies(rows: DataFrame, goal: DataFrame, few: bool, source: str = "source", at: str = "at") -> DataFrame:
    """``rows`` with their source's plan and copies, how often each enters."""
    beside = _beside(rows, goal, few, source)
    below, here = F.col(at) < F.col("edge"), F.col(at) == F.col("edge")
    simple = beside.withColumn("copies", F.col("whole") + F.when(below, 1).when(here, F.least("take", F.lit(1))).otherwise(0))
    if goal.where("rows > 1").isEmpty():
        return simple
    shared = F.coalesce(here & (F.col("rows") > 1), F.lit(False))
    tied = _numbered(beside.where(shared), source)
    tied = tied.withColumn("copies", F.col("whole") + F.when(F.col("nth") < F.col("take"), 1).otherwise(0)).drop("nth")
    return simple.where(~shared).unionByName(tied)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, at: what the mix takes of each document.

    ``copies`` is how often the document enters, ``taken`` = copies x size.
    """
    sizes = written(sized(docs, **columns), "mixing-sizes")
    goal, few = _planned(sizes, weights, share, most)
    return _with_copies(sizes, goal, few).select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "at")


def repeated(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as the mix takes it.

    Plans are a row per source, so documents are filtered where they are, without
    a shuffle of their texts; only those that share the position on which a
    threshold falls are written and numbered. Empty documents follow their
    source's whole copies and threshold like any other.
    """
    sizes = written(sized(docs, doc_id, text, source), "mixing-sizes")
    goal, few = _planned(sizes, weights, share, most)
    inside = positional(docs)
    key = {c: F.col(place(docs, c)) for c in (doc_id, text, source)}
    rows = inside.select("*", key[source].cast("string").alias("from"), _position(key[doc_id].cast("long"), key[text].cast("string")).alias("at"))
    out = _with_copies(rows, goal, few, "from").where("copies > 0")
    return out.select(*inside.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*inside.columns).toDF(*docs.columns)
