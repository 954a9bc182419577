"""From a graph to a training set: filters, pruning, ids, split, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary
from quillgraph.functions.text import any_word
from quillgraph.session import small, written

URI = r"^<(https?://[^\s<>]+)>$"
WHITE = r"[\x09-\x0D\x1C-\x20]"
SEED = 42


def extract_uri(token: Column) -> Column:
    """The address in angle brackets; null for anything else."""
    return F.nullif(F.regexp_extract(token, URI, 1), F.lit(""))


def reasons(
    lines: DataFrame,
    literal: tuple[str, ...] = vocabulary.LITERAL_PROPERTIES,
    hubs: tuple[str, ...] = vocabulary.HUB_PROPERTIES,
    hub_objects: dict[str, tuple[str, ...]] = vocabulary.HUB_OBJECTS,
    schema: tuple[str, ...] = vocabulary.SCHEMA_PARTS,
) -> DataFrame:
    """s, p, o, reason for each line (value) of N-Triples; ``kept`` is a reason, too.

    A line has the first reason that holds, in the order of this chain; of equal
    kept triples all but one are duplicates. One pass gives every counter.
    """
    value = F.regexp_replace("value", f"^{WHITE}+|{WHITE}+$", "")
    x = lines.select(value.alias("value")).where("value <> '' and not startswith(value, '#')")
    parts = F.split("value", f"{WHITE}+", 4)
    row = F.struct(F.size(parts).alias("n"), *(extract_uri(F.get(parts, F.lit(k))).alias(c) for k, c in enumerate(("s", "p", "o"))))
    # a generator of one row: filters on the reason stay above it, so a line is split once
    x = x.select(F.inline(F.array(row)))
    hub = F.lit(False)
    for p, objects in hub_objects.items():
        hub = hub | ((F.col("p") == p) & F.coalesce(F.col("o").isin(*objects), F.lit(False)))
    reason = (
        F.when(F.col("n") < 3, "malformed")
        .when(F.col("s").isNull(), "non-uri subject")
        .when(F.col("p").isNull(), "malformed")
        .when(F.col("p").isin(*literal), "literal predicate")
        .when(F.col("p").isin(*hubs), "hub")
        .when(any_word(F.col("p"), schema), "schema predicate")
        .when(F.col("o").isNull(), "literal object")
        .when(hub, "hub")
        .otherwise("kept")
    )
    return x.select("s", "p", "o", reason.alias("reason"))


def clean_triples(marked: DataFrame) -> DataFrame:
    return marked.where("reason = 'kept'").select("s", "p", "o").distinct()


def reason_counts(marked: DataFrame) -> DataFrame:
    """reason, n, with duplicates taken out of kept; both from one aggregation over distinct kept triples."""
    once = marked.groupBy("reason", F.when(F.col("reason") == "kept", F.struct("s", "p", "o")).alias("t")).agg(F.count("*").alias("k"))
    pairs = F.when(F.col("reason") == "kept", F.array(F.struct(F.lit("kept").alias("reason"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("duplicate").alias("reason"), (F.col("k") - 1).alias("n"))))
    pairs = pairs.otherwise(F.array(F.struct("reason", F.col("k").alias("n"))))
    return once.select(F.explode(pairs).alias("x")).groupBy("x.reason").agg(F.sum("x.n").alias("n")).where("n > 0")


def degrees(triples: DataFrame) -> DataFrame:
    """node, degree: subject and object each count, a loop twice."""
    return triples.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def prune(triples: DataFrame, least: int = 2, rounds: int = 20, protected: tuple[str, ...] = vocabulary.PROTECTED_PARTS) -> DataFrame:
    """Triples whose ends both have the degree, or whose predicate is protected; until nothing changes.

    A round is one aggregation and two semi-joins; its result is written, so
    lineage never grows.
    """
    safe = any_word(F.col("p"), protected)
    now = written(triples.select("s", "p", "o"), "prune")
    size = now.count()
    for _ in range(rounds):
        few = degrees(now).where(F.col("degree") < least).select("node")
        loose = now.where(~safe)
        kept = loose.join(few, F.col("s") == F.col("node"), "left_anti").join(few, F.col("o") == F.col("node"), "left_anti")
        now = written(kept.unionByName(now.where(safe)), "prune")
        before, size = size, now.count()
        if size == before:
            break
    return now


def position(seed: int, *columns: str) -> Column:
    """A fixed pseudo-random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def relation_cap(triples: DataFrame, most: int | None, seed: int = SEED) -> DataFrame:
    """At most so many triples of a relation, in hash order; None: all."""
    if most is None:
        return triples
    return ranked_within(triples, "p", [position(seed, "s", "p", "o"), F.col("s"), F.col("o")], "_n").where(F.col("_n") < most).drop("_n")


def ranked(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``rows`` numbered from 0 in a total order, without bringing them into one task.

    Rows are dealt into sorted ranges; the sizes of the ranges, a row for each,
    give every range its offset.
    """
    keys = {f"_k{k}": c for k, c in enumerate(by)}
    dealt = rows.select("*", *(c.alias(n) for n, c in keys.items())).repartitionByRange(*keys)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_from", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return dealt.withColumn("_in", inner).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_from") + F.col("_in")).cast("long")).drop("_part", "_in", "_from", *keys)


def ranked_within(rows: DataFrame, group: str, by: list[Column], name: str) -> DataFrame:
    """``rows`` numbered from 0 inside each group, in a total order; a group of any size is spread over all tasks."""
    placed = ranked(rows, [F.col(group), *by], "_place")
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    met = placed.join(small(first), F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_group", "_first")


def entity_ids(triples: DataFrame) -> DataFrame:
    """id, uri in code-point order, from 0."""
    return ranked(triples.select(F.explode(F.array("s", "o")).alias("uri")).distinct(), [F.col("uri")], "id").select("id", "uri")


def relation_ids(triples: DataFrame) -> DataFrame:
    return ranked(triples.select(F.col("p").alias("uri")).distinct(), [F.col("uri")], "id").select("id", "uri")


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """s, p, o as ids; triples with a name that has no id are left out."""
    e = lambda c: entities.select(F.col("uri").alias(c), F.col("id").alias(f"_{c}"))
    out = triples.select("s", "p", "o").join(e("s"), "s").join(e("o"), "o").join(relations.select(F.col("uri").alias("p"), F.col("id").alias("_p")), "p")
    return out.select(F.col("_s").alias("s"), F.col("_p").alias("p"), F.col("_o").alias("o"))


def split(triples: DataFrame, valid: float = 0.1, test: float = 0.1, seed: int = SEED, rescue: bool = True) -> DataFrame:
    """s, p, o, split: exact sizes in hash order; rows with names unknown to train are rescued into it.

    One pass of rescue is stable: what is kept was known, and train only grows.
    """
    n = triples.count()
    n_valid, n_test = int(n * valid), int(n * test)
    n_train = n - n_valid - n_test
    at = ranked(triples.select("s", "p", "o"), [position(seed, "s", "p", "o"), F.col("s"), F.col("p"), F.col("o")], "_at")
    out = at.withColumn("split", F.when(F.col("_at") < n_train, "train").when(F.col("_at") < n_train + n_valid, "valid").otherwise("test")).drop("_at")
    return rescued(out) if rescue else out


def rescued(rows: DataFrame) -> DataFrame:
    rows = written(rows, "split")
    train, rest = rows.where("split = 'train'"), rows.where("split <> 'train'")
    nodes = train.select(F.explode(F.array("s", "o")).alias("node")).distinct()
    relations = train.select(F.col("p").alias("relation")).distinct()
    x = rest.join(nodes.select(F.col("node").alias("s"), F.lit(1).alias("_s")), "s", "left").join(nodes.select(F.col("node").alias("o"), F.lit(1).alias("_o")), "o", "left")
    x = x.join(relations.select(F.col("relation").alias("p"), F.lit(1).alias("_p")), "p", "left")
    known = F.col("_s").isNotNull() & F.col("_o").isNotNull() & F.col("_p").isNotNull()
    return train.unionByName(x.select("s", "p", "o", F.when(known, F.col("split")).otherwise("train").alias("split")))


def pool(*parts: DataFrame) -> DataFrame:
    """All rows of several splits, repeats included."""
    out = parts[0].select("s", "p", "o")
    for part in parts[1:]:
        out = out.unionByName(part.select("s", "p", "o"))
    return out


def subsample(triples: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` triples in hash order, or all."""
    if size >= triples.count():
        return triples
    return ranked(triples, [position(seed, "s", "p", "o"), F.col("s"), F.col("p"), F.col("o")], "_at").where(F.col("_at") < size).drop("_at")


def size_grid(total: int, sizes: tuple[int, ...] = (20_000, 50_000)) -> list[tuple[str, int]]:
    """(label, size), smallest first, the whole pool last."""
    return [(f"{n // 1000}k" if n % 1000 == 0 else str(n), n) for n in sorted({s for s in sizes if s < total})] + [("full", total)]


def report(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """metric, value: sizes, upper median and mean degree, share of single nodes, unknown names in valid and test."""
    d = written(degrees(triples), "degrees")
    n = d.count()
    middle = ranked(d, [F.col("degree"), F.col("node")], "_at").where(F.col("_at") == n // 2).select(F.col("degree").cast("double").alias("value"))
    train = rows.where("split = 'train'").select(F.explode(F.array("s", "o")).alias("node")).distinct()
    unknown = lambda part: rows.where(F.col("split") == part).select(F.explode(F.array("s", "o")).alias("node")).distinct().join(train, "node", "left_anti").agg(F.count("*").cast("double").alias("value"))
    out = d.agg(
        F.round(F.avg("degree"), 1).alias("mean_degree"), F.round(100.0 * F.count_if(F.col("degree") == 1) / F.count("*"), 1).alias("single_pct"), F.count("*").cast("double").alias("entities")
    ).unpivot([], ["mean_degree", "single_pct", "entities"], "metric", "value")
    sizes = rows.groupBy(F.col("split").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    relations = triples.agg(F.lit("relations").alias("metric"), F.count_distinct("p").cast("double").alias("value"))
    for name, part in (("median_degree", middle), ("unknown_valid", unknown("valid")), ("unknown_test", unknown("test"))):
        out = out.unionByName(part.select(F.lit(name).alias("metric"), "value"))
    return out.unionByName(sizes).unionByName(relations)


def relation_histogram(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.col("p").alias("relation")).agg(F.count("*").alias("n"))
