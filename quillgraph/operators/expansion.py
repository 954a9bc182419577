"""Expansion of a graph from a table that plays the remote knowledge base."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary
from quillgraph.operators.graph import KEYS, new_triples
from quillgraph.schemas import OWL, RDFS, URI, WD, WDT
from quillgraph.session import written


def literal(lang: Column, dtype: Column) -> tuple[Column, Column]:
    """Language wins over datatype."""
    return F.nullif(lang, F.lit("")), F.when(F.coalesce(lang, F.lit("")) == "", F.nullif(dtype, F.lit("")))


def kept_predicates(base: DataFrame, allowed: tuple[str, ...], labels: tuple[str, ...] = (RDFS + "label",)) -> DataFrame:
    return base.where(F.col("p").isin(*allowed, *labels))


def limited(rows: DataFrame, per: list[str], limit: int) -> DataFrame:
    """At most so many rows for each key, in the order of the triples themselves."""
    rank = F.row_number().over(Window.partitionBy(*per).orderBy("p", "s", "o", F.coalesce("o_lang", F.lit("")), F.coalesce("o_dtype", F.lit(""))))
    return rows.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


def one_hop(base: DataFrame, seeds: DataFrame, limit: int, allowed: tuple[str, ...], direct: str = WDT) -> DataFrame:
    """Direct claims and English labels of the seeds (uri). The limit holds before the predicates are chosen."""
    claims = base.where(F.startswith("p", F.lit(direct)) | ((F.col("p") == RDFS + "label") & (F.col("o_lang") == "en")))
    reached = claims.join(seeds.select(F.col("uri").alias("s")).distinct(), "s", "left_semi")
    return kept_predicates(limited(reached, ["s"], limit), allowed).select(*KEYS)


def outgoing(base: DataFrame, anchors: DataFrame, allowed: tuple[str, ...], limit: int) -> DataFrame:
    """Claims of the anchors by each allowed predicate, so many per anchor and predicate."""
    found = base.where(F.col("p").isin(*allowed)).join(anchors.select(F.col("uri").alias("s")), "s", "left_semi")
    return limited(found, ["s", "p"], limit).select(*KEYS)


def incoming(base: DataFrame, anchors: DataFrame, predicates: tuple[tuple[str, int], ...]) -> DataFrame:
    """Claims that point to the anchors by the given predicates, so many per anchor and predicate."""
    most = F.lit(None).cast("int")
    for p, n in predicates:
        most = F.when(F.col("p") == p, F.lit(n)).otherwise(most)
    found = base.where(F.col("p").isin(*(p for p, _ in predicates)) & (F.col("o_kind") == URI)).join(anchors.select(F.col("uri").alias("o")), "o", "left_semi")
    rank = F.row_number().over(Window.partitionBy("o", "p").orderBy("s"))
    return found.withColumn("_n", rank).where(F.col("_n") <= most).select(*KEYS)


def nodes(graph: DataFrame, part: str = WD + "Q") -> DataFrame:
    """uri: distinct URI nodes, subjects and objects, whose name contains ``part``."""
    both = graph.select(F.explode(F.array("s", F.when(F.col("o_kind") == URI, F.col("o")))).alias("uri"))
    return both.where(F.contains("uri", F.lit(part))).distinct()


def aligned(graph: DataFrame, part: str = WD + "Q") -> DataFrame:
    """uri, id of what the graph says is the same elsewhere."""
    same = graph.where((F.col("p") == OWL + "sameAs") & F.contains("o", F.lit(part)))
    return same.select(F.col("o").alias("uri"), F.substring_index("o", "/", -1).alias("id")).distinct()


def of_types(candidates: DataFrame, base: DataFrame, instance_of: str, types: tuple[str, ...]) -> DataFrame:
    """Candidates (uri) that are instances of one of the types; an optional filter, off by default."""
    typed = base.where((F.col("p") == instance_of) & F.col("o").isin(*types)).select(F.col("s").alias("uri"))
    return candidates.join(typed, "uri", "left_semi")


@dataclass(frozen=True)
class Plan:
    """What an expansion follows and how far."""

    anchors: tuple[str, ...] = tuple(WD + q for q in vocabulary.ANCHORS)
    allowed: tuple[str, ...] = tuple(WDT + p for p in vocabulary.KEPT_PROPERTIES)
    incoming: tuple[tuple[str, int], ...] = tuple((WDT + p, n) for p, n in vocabulary.INCOMING)
    part: str = WD + "Q"
    direct: str = WDT
    anchor_limit: int = vocabulary.ANCHOR_LIMIT
    aligned_limit: int = vocabulary.ALIGNED_LIMIT
    outgoing_limit: int = vocabulary.OUTGOING_LIMIT
    new_limit: int = vocabulary.NEW_LIMIT
    new_entities: int = vocabulary.NEW_ENTITIES


def expand(graph: DataFrame, base: DataFrame, plan: Plan = Plan()) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The graph with what four phases add, and (phase, new triples).

    Anchors; aligned entities; outgoing then incoming claims of all known
    entities; one hop from the new ones, by name, up to the plan's number. Every
    phase is written before the next one reads it.
    """
    spark, added = graph.sparkSession, []
    now = written(graph.select(*KEYS).distinct(), "expand-base")

    def grow(name: str, found: DataFrame) -> DataFrame:
        nonlocal now
        fresh = written(new_triples(found, now), f"expand-{name}")
        added.append((name, fresh.count()))
        now = now.unionByName(fresh)
        return fresh

    seeds = spark.createDataFrame([(a,) for a in plan.anchors], "uri string")
    grow("anchors", one_hop(base, seeds, plan.anchor_limit, plan.allowed, plan.direct))
    same = written(aligned(now, plan.part), "expand-aligned")
    grow("aligned", one_hop(base, same, plan.aligned_limit, plan.allowed, plan.direct))
    grow("outgoing", outgoing(base, nodes(now, plan.part), plan.allowed, plan.outgoing_limit))
    reached = written(incoming(base, nodes(now, plan.part), plan.incoming), "expand-incoming-all")
    grow("incoming", reached)
    new = reached.select(F.col("s").alias("uri")).where(F.contains("uri", F.lit(plan.part))).distinct().join(same, "uri", "left_anti")
    grow("new", one_hop(base, new.orderBy("uri").limit(plan.new_entities), plan.new_limit, plan.allowed, plan.direct))
    return now, added
