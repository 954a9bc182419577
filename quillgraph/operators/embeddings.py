"""Scores, ranks and neighbours over tables of vectors (id, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary
from quillgraph.functions.text import local_name
from quillgraph.schemas import NAMESPACE, RDF, WDT
from quillgraph.session import small, written

#: Bytes of query vectors that one pass over the entities holds, and queries multiplied at a time.
CHUNK_BYTES, AT_ONCE = 32 << 20, 256
#: Pairs computed number by number at a time.
PAIRS = 1 << 16


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _norm(a: Column, p: int) -> Column:
    return _sum(F.transform(a, F.abs)) if p == 1 else F.sqrt(_dot(a, a))


def _halves(a: Column, n: int) -> tuple[Column, Column]:
    """Real and imaginary parts of a complex vector stored one after the other."""
    return F.slice(a, 1, n // 2), F.slice(a, n // 2 + 1, n // 2)


def _turned(h: Column, r: Column, n: int, back: bool = False) -> Column:
    """h times r, number by number; ``back``: times r's conjugate."""
    (a, b), (c, d) = _halves(h, n), _halves(r, n)
    if back:
        return F.concat(_add(_mul(a, c), _mul(b, d)), _sub(_mul(b, c), _mul(a, d)))
    return F.concat(_sub(_mul(a, c), _mul(b, d)), _add(_mul(a, d), _mul(b, c)))


def unit(r: Column, n: int) -> Column:
    """Complex numbers scaled to modulus one."""
    a, b = _halves(r, n)
    size = F.zip_with(a, b, lambda x, y: F.sqrt(x * x + y * y))
    return F.concat(F.zip_with(a, size, lambda x, s: x / s), F.zip_with(b, size, lambda x, s: x / s))


MODELS = ("TransE", "DistMult", "ComplEx", "RotatE")


def query_vector(model: str, side: str, known: Column, r: Column, n: int) -> Column:
    """What the missing end is compared with; ``known`` is the other end's vector."""
    if model == "TransE":
        return _add(known, r) if side == "tail" else _sub(known, r)
    if model == "DistMult":
        return _mul(known, r)
    r = unit(r, n) if model == "RotatE" else r
    return _turned(known, r, n, back=side == "head")


def match(model: str, query: Column, end: Column, p: int = 1) -> Column:
    """How well an end fits a query vector: minus a distance, or a product."""
    if model == "TransE":
        return -_norm(_sub(query, end), p)
    if model == "RotatE":
        return -_norm(_sub(query, end), 2)
    return _dot(query, end)


def score(model: str, h: Column, r: Column, t: Column, n: int, p: int = 1) -> Column:
    """The published score of a triple; n: the vectors' length, p: the norm of TransE."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    return match(model, query_vector(model, "tail", h, r, n), t, p)


def vectors_of(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples (s, p, o as ids) with h, r and t."""
    e = lambda c, v: entities.select(F.col("id").alias(c), F.col("v").alias(v))
    return triples.join(e("s", "h"), "s").join(e("o", "t"), "o").join(relations.select(F.col("id").alias("p"), F.col("v").alias("r")), "p")


def _vectors(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _one_by_one(model: str, p: int, q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Scores of pairs of rows, added in the vectors' order as ``match`` does, so that equal scores are equal here, too."""
    out = []
    for k in range(0, len(q), PAIRS):
        a, b = q[k : k + PAIRS], e[k : k + PAIRS]
        acc = np.zeros(len(a))
        for j in range(q.shape[1]):
            if model in ("TransE", "RotatE"):
                x = a[:, j] - b[:, j]
                acc += np.abs(x) if model == "TransE" and p == 1 else x * x
            else:
                acc += a[:, j] * b[:, j]
        if model == "RotatE" or (model == "TransE" and p != 1):
            acc = np.sqrt(acc)
        out.append(-acc if model in ("TransE", "RotatE") else acc)
    return np.concatenate(out) if out else np.zeros(0)


def _passes(asked: DataFrame, vector: str) -> list[DataFrame]:
    """``asked`` in parts whose vectors take about CHUNK_BYTES; it has ``_query``, its rows' numbers."""
    size = asked.agg(F.sum(8 * F.size(vector))).first()[0] or 0
    n = max(1, -(-size // CHUNK_BYTES))
    return [asked.where(F.pmod(F.xxhash64("_query"), F.lit(n)) == k) for k in range(n)]


def _spread(entities: DataFrame) -> DataFrame:
    """The table with work for all cores."""
    spark = entities.sparkSession
    return written(entities, "vectors").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _counted(model: str, queries: DataFrame, end: str, entities: DataFrame, p: int) -> DataFrame:
    """s, p, o, q, true, better, equal: how many entities but the one in ``end`` score above ``true``, or the same.

    Queries go out in chunks; the entities stream past them in blocks and are
    multiplied by NumPy. Scores nearer to ``true`` than rounding are computed once
    more, number by number. Counts of all tasks are added.
    """
    asked = written(queries.withColumn("_query", F.monotonically_increasing_id()), "rank-queries")
    table = _spread(entities.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")))
    out = None
    for part in _passes(asked, "q"):
        rows = part.select("_query", F.col(end).cast("long").alias("hidden"), "true", "q").toArrow()
        given = (rows["_query"].to_numpy(), rows["hidden"].to_numpy(), rows["true"].to_numpy(), _vectors(rows["q"], len(rows)) if len(rows) else np.zeros((0, 1)))
        sent = asked.sparkSession.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number, hidden, true, q = sent.value
            better, equal = np.zeros((2, len(number)), np.int64)
            for batch in batches:
                if batch.num_rows and len(number):
                    _compare(model, p, batch.column(0).to_numpy(), _vectors(batch.column(1), batch.num_rows), hidden, true, q, better, equal)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(better), pa.array(equal)], ["_query", "better", "equal"])

        found = table.mapInArrow(run, "_query long, better long, equal long")
        out = found if out is None else out.unionByName(found)
    counts = out.groupBy("_query").agg(F.sum("better").alias("better"), F.sum("equal").alias("equal"))
    return asked.join(counts, "_query").drop("_query")


def _compare(model: str, p: int, ids: np.ndarray, e: np.ndarray, hidden: np.ndarray, true: np.ndarray, q: np.ndarray, better: np.ndarray, equal: np.ndarray) -> None:
    """Add to ``better`` and ``equal`` what a block of entities gives."""
    n = e.shape[1]
    if model == "TransE" and p == 1:
        columns, x = np.ascontiguousarray(e.T), np.empty(len(e))
        for k in range(len(q)):
            acc = np.zeros(len(e))
            for y, column in zip(q[k].tolist(), columns):
                np.subtract(y, column, out=x)
                np.abs(x, out=x)
                acc += x
            acc[ids == hidden[k]] = np.inf  # the end itself is not its own rival
            better[k] += np.count_nonzero(-acc > true[k])
            equal[k] += np.count_nonzero(-acc == true[k])
        return
    squares, most = (e * e).sum(axis=1), np.sqrt((e * e).sum(axis=1).max())
    for k in range(0, len(q), AT_ONCE):
        a, t = q[k : k + AT_ONCE], true[k : k + AT_ONCE, None]
        own = (a * a).sum(axis=1)[:, None]
        product = a @ e.T
        if model in ("TransE", "RotatE"):  # the nearer the better
            gain, doubt = t * t - (own + squares - 2 * product), 1e-15 * n * (np.sqrt(own) + most) ** 2
        else:
            gain, doubt = product - t, 1e-15 * n * np.sqrt(own) * most
        rival = ids[None, :] != hidden[k : k + AT_ONCE, None]
        better[k : k + AT_ONCE] += ((gain > doubt) & rival).sum(axis=1)
        row, at = np.nonzero((np.abs(gain) <= doubt) & rival)
        exact, mine = _one_by_one(model, p, a[row], e[at]), t[row, 0]
        better[k : k + AT_ONCE] += np.bincount(row[exact > mine], minlength=len(a))
        equal[k : k + AT_ONCE] += np.bincount(row[exact == mine], minlength=len(a))


def filtered_ranks(model: str, test: DataFrame, known: DataFrame, entities: DataFrame, relations: DataFrame, n: int, p: int = 1) -> DataFrame:
    """s, p, o, side, optimistic, pessimistic, realistic for each test triple and side.

    All entities are compared with each query, in blocks by NumPy; what known
    triples add to the counts is found by a join and taken off, so no pair is
    checked against them one by one.
    """
    out = None
    truth = known.select("s", "p", "o").distinct()
    for side, end, other, vec in (("tail", "o", "s", "h"), ("head", "s", "o", "t")):
        x = vectors_of(test.select("s", "p", "o").distinct(), entities, relations)
        x = x.select("s", "p", "o", query_vector(model, side, F.col(vec), F.col("r"), n).alias("q"), F.col("t" if side == "tail" else "h").alias("own"))
        x = written(_counted(model, x.withColumn("true", match(model, F.col("q"), F.col("own"), p)).drop("own"), end, entities, p), "ranks")
        better, equal = F.count_if(F.col("score") > F.col("true")), F.count_if(F.col("score") == F.col("true"))
        facts = truth.select(F.col(other).alias(f"_{other}"), F.col("p").alias("_p"), F.col(end).alias("fact"))
        hits = x.join(facts, (F.col(other) == F.col(f"_{other}")) & (F.col("p") == F.col("_p")) & (F.col("fact") != F.col(end)))
        hits = hits.join(entities.select(F.col("id").alias("fact"), F.col("v").alias("ev")), "fact").withColumn("score", match(model, F.col("q"), F.col("ev"), p))
        off = hits.groupBy("s", "p", "o").agg(better.alias("better_known"), equal.alias("equal_known"))
        y = x.select("s", "p", "o", "better", "equal").join(off, ["s", "p", "o"], "left").select(
            "s", "p", "o", F.lit(side).alias("side"), (1 + F.col("better") - F.coalesce("better_known", F.lit(0))).alias("optimistic"), (F.col("equal") - F.coalesce("equal_known", F.lit(0))).alias("ties")
        )
        y = y.select("s", "p", "o", "side", "optimistic", (F.col("optimistic") + F.col("ties")).alias("pessimistic"), (F.col("optimistic") + F.col("ties") / 2).alias("realistic"))
        out = y if out is None else out.unionByName(y)
    return out


def rank_metrics(ranks: DataFrame, entities: int, hits: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """side (head, tail, both), policy, metric, value: MRR, Hits@k, count, median and adjusted mean rank."""
    long = ranks.unpivot(["side"], ["optimistic", "pessimistic", "realistic"], "policy", "rank")
    long = long.withColumn("side", F.explode(F.array("side", F.lit("both"))))
    names = {"mrr": F.avg(1 / F.col("rank")), "count": F.count("*").cast("double"), "mean_rank": F.avg("rank"), "median_rank": F.median("rank"), "adjusted_mean_rank": F.avg("rank") / F.lit((entities + 1) / 2)}
    names |= {f"hits_at_{k}": F.avg((F.col("rank") <= k).cast("double")) for k in hits}
    wide = long.groupBy("side", "policy").agg(*(c.cast("double").alias(n) for n, c in names.items()))
    return wide.unpivot(["side", "policy"], list(names), "metric", "value")


def bernoulli_stats(triples: DataFrame) -> DataFrame:
    """p, tph, hpt, head_probability: tails per head and heads per tail decide which end is corrupted."""
    tails = triples.groupBy("p", "s").agg(F.count_distinct("o").alias("k")).groupBy("p").agg(F.avg("k").alias("tph"))
    heads = triples.groupBy("p", "o").agg(F.count_distinct("s").alias("k")).groupBy("p").agg(F.avg("k").alias("hpt"))
    return tails.join(heads, "p").withColumn("head_probability", F.col("tph") / (F.col("tph") + F.col("hpt")))


def negatives(triples: DataFrame, entities: DataFrame, per: int = 256, seed: int = 42) -> DataFrame:
    """s, p, o, k: ``per`` corruptions of each triple, the end by the relation's probability, the entity by hash. Entities: id from 0 without gaps.

    Draws are 32 bits of an MD5 sum of triple, number, seed and purpose: the same on every engine.
    """
    n = entities.count()
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", "s", "p", "o", "k", F.lit(seed), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("long")
    x = triples.select("s", "p", "o").join(small(bernoulli_stats(triples).select("p", "head_probability")), "p").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    head, other = draw("side") / F.lit(float(1 << 32)) < F.col("head_probability"), F.shiftright(draw("entity") * F.lit(n), 32)
    return x.select(F.when(head, other).otherwise(F.col("s")).alias("s"), "p", F.when(head, F.col("o")).otherwise(other).alias("o"), "k")


# --- neighbours -----------------------------------------------------------------------------


def normalised(v: Column) -> Column:
    """Length one; a zero vector stays."""
    return F.transform(F.transform(v, lambda x: x.cast("double")), lambda x: x / F.greatest(F.sqrt(_dot(v, v).cast("double")), F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    d = lambda x: F.transform(x, lambda y: y.cast("double"))
    return F.try_divide(_dot(d(a), d(b)), F.sqrt(_dot(d(a), d(a))) * F.sqrt(_dot(d(b), d(b))))


def nearest(anchors: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """anchor, rank, id, similarity: the k nearest by cosine, the anchor itself left out; ties by id.

    ``anchors`` may have ``exclude``, an array of ids. Anchors go out in chunks, the
    entities stream past them in blocks, and every task keeps the best k of each
    anchor. Similarities are added number by number.
    """
    left_out = F.col("exclude") if "exclude" in anchors.columns else F.array(F.col("id"))
    asked = anchors.select(F.col("id").alias("anchor"), normalised(F.col("v")).alias("q"), F.transform(left_out, lambda x: x.cast("long")).alias("exclude"))
    asked = written(asked.withColumn("_query", F.monotonically_increasing_id()), "anchors")
    table = _spread(entities.select(F.col("id").cast("long").alias("id"), normalised(F.col("v")).alias("v")))
    out = None
    for part in _passes(asked, "q"):
        rows = part.select("_query", "exclude", "q").toArrow()
        given = (rows["_query"].to_numpy(), [set(x or []) for x in rows["exclude"].to_pylist()], _vectors(rows["q"], len(rows)) if len(rows) else np.zeros((0, 1)))
        sent = asked.sparkSession.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number, excluded, q = sent.value
            scores, best = np.full((len(number), k), -np.inf), np.zeros((len(number), k), np.int64)
            for batch in batches:
                if batch.num_rows and len(number):
                    _keep_best(batch.column(0).to_numpy(), _vectors(batch.column(1), batch.num_rows), excluded, q, scores, best)
            a, j = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array(number[a]), pa.array(best[a, j]), pa.array(scores[a, j])], ["_query", "id", "similarity"])

        found = table.mapInArrow(run, "_query long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(F.col("similarity").desc(), "id"))
    top = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.select("_query", "anchor").join(top, "_query").select("anchor", "id", "similarity", "rank")


def _keep_best(ids: np.ndarray, e: np.ndarray, excluded: list[set[int]], q: np.ndarray, scores: np.ndarray, best: np.ndarray) -> None:
    """Take a block of entities into the best so far."""
    k = scores.shape[1]
    for a in range(0, len(q), AT_ONCE):
        product = q[a : a + AT_ONCE] @ e.T
        for j, line in enumerate(product, a):
            wide = k + len(excluded[j])  # those left out may be among the nearest
            low = np.partition(line, -wide)[-wide] if wide < len(line) else -np.inf
            at = np.flatnonzero(line >= max(scores[j, -1], low) - 1e-9)
            at = at[np.array([x not in excluded[j] for x in ids[at].tolist()], bool)]
            own = np.concatenate([scores[j], _one_by_one("DistMult", 1, np.broadcast_to(q[j], (len(at), q.shape[1])), e[at])])
            names = np.concatenate([best[j], ids[at]])
            order = np.lexsort((names, -own))[:k]
            scores[j], best[j] = own[order], names[order]


def anchor_matrix(anchors: DataFrame) -> DataFrame:
    """a, b, similarity for all pairs of the anchors."""
    a = anchors.select(F.col("id").alias("a"), F.col("v").alias("av"))
    b = anchors.select(F.col("id").alias("b"), F.col("v").alias("bv"))
    return a.crossJoin(small(b)).select("a", "b", cosine(F.col("av"), F.col("bv")).alias("similarity"))


def analogy(start: DataFrame, steps: list[DataFrame], entities: DataFrame, target: int, k: int = 10) -> DataFrame:
    """rank, id, similarity, hit: neighbours of v(start) + v(step) + ..., start left out."""
    x = start.select("id", "v")
    for step in steps:
        x = x.crossJoin(small(step.select(F.col("v").alias("_r")))).select("id", _add(F.col("v"), F.col("_r")).alias("v"))
    return nearest(x, entities, k).select("rank", "id", "similarity", (F.col("id") == target).alias("hit"))


def agreement(rank: Column) -> Column:
    return F.when(rank <= 3, "strong").when(rank <= 10, "partial").otherwise("absent")


def first_available(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """name, uri, id: of each name's candidates (name, place, uri) the first that has an id."""
    found = candidates.join(ids, "uri")
    return found.groupBy("name").agg(F.min_by(F.struct("uri", "id"), "place").alias("x")).select("name", "x.uri", "x.id")


def label_of(uri: Column, label: Column) -> Column:
    return F.coalesce(label, local_name(uri))


def is_plain_id(label: Column) -> Column:
    return F.rlike(label, F.lit("^Q[0-9]+$"))


def entity_classes(ids: DataFrame, graph: DataFrame, triples: DataFrame, namespace: str = NAMESPACE, instance_of: str = WDT + "P31", signals: tuple[str, ...] = vocabulary.PERSON_PROPERTIES, classes: dict[str, str] = vocabulary.INSTANCE_CLASSES, own: dict[str, str] = vocabulary.OWN_CLASSES) -> DataFrame:
    """id, uri, class: the graph's own class, else by instance-of (the last in order), else Person by its predicates, else Other."""
    from quillgraph.functions.text import mapped

    first = graph.where(F.col("p") == RDF + "type").select(F.col("s").alias("uri"), mapped(F.regexp_replace("o", "^" + namespace.replace(".", r"\."), ""), own).alias("c1")).where("c1 is not null").groupBy("uri").agg(F.max("c1").alias("c1"))
    kinds = triples.where(F.col("p") == instance_of).select(F.col("s").alias("uri"), "o", mapped(local_name(F.col("o")), classes).alias("c2")).where("c2 is not null").groupBy("uri").agg(F.max_by("c2", "o").alias("c2"))
    people = triples.where(F.col("p").isin(*signals)).select(F.col("s").alias("uri"), F.lit("Person").alias("c3")).distinct()
    x = ids.join(first, "uri", "left").join(kinds, "uri", "left").join(people, "uri", "left")
    return x.select("id", "uri", F.coalesce("c1", "c2", "c3", F.lit("Other")).alias("class"))


def class_distribution(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "class")


def plane(entities: DataFrame) -> DataFrame:
    """id, x, y: the first two principal components of the scaled vectors, in place of a stochastic map."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = entities.select("id", array_to_vector(normalised(F.col("v"))).alias("features"))
    out = PCA(k=2, inputCol="features", outputCol="xy").fit(x).transform(x).select("id", vector_to_array("xy").alias("xy"))
    return out.select("id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
