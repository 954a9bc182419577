"""From mentions to a graph: registry, aliases, relations, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary
from quillgraph.functions.text import any_word, ascii_fold, local_name, mapped, slug, words
from quillgraph.schemas import LITERAL, NAMESPACE, OWL, RDF, RDFS, URI


def _triple(s: Column, p: str | Column, o: Column, kind: str = URI, lang: str | None = None) -> Column:
    return F.struct(
        s.alias("s"), (p if isinstance(p, Column) else F.lit(p)).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(lang).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_dtype")
    )


def entity_uri(text: Column, label: Column, folded: Column, namespace: str = NAMESPACE) -> Column:
    """Rounds and exits go through their vocabulary, others through the slug of the folded text."""
    low = F.lower(text)
    name = F.when(label == "FUNDING_ROUND", mapped(low, vocabulary.ROUND_NAMES)).when(label == "EXIT_TYPE", mapped(low, vocabulary.EXIT_NAMES))
    return F.concat(F.lit(namespace), F.coalesce(name, slug(folded)))


def registry(mentions: DataFrame, namespace: str = NAMESPACE, doc_order: str = "doc_id") -> DataFrame:
    """text, label, uri, class_uri, place: the first accepted mention of each text.

    Rejected mentions are filtered first, so a later one with another label may
    still be accepted: empty and blocked texts, one-word people, firms and
    companies of more than five words, words that repeat as two halves.
    """
    low, w = F.lower("text"), F.col("w")
    label = F.coalesce(mapped(low, vocabulary.LABEL_OVERRIDES), F.col("label"))
    half = F.floor(F.size("w") / 2).cast("int")
    x = mentions.where("text <> ''").withColumn("w", words(F.col("text"))).withColumn("label", label).where(~low.isin(*vocabulary.BLOCKLIST))
    x = x.where(~((F.col("label") == "PERSON") & (F.size("w") < 2)) & ~(F.col("label").isin("ORG", "VC_FIRM") & (F.size("w") > 5)))
    x = x.where((F.size("w") < 4) | (F.slice(w, 1, F.greatest(half, F.lit(1))) != F.slice(w, half + 1, F.greatest(half, F.lit(1)))))
    place = F.struct(F.col(doc_order).alias("doc"), "start", "end", "label")
    firsts = x.groupBy("text").agg(F.min_by("label", place).alias("label"), F.min(place).alias("place")).withColumn("folded", ascii_fold(F.col("text")))
    cls = F.coalesce(mapped(F.lower("text"), vocabulary.CLASS_OVERRIDES), mapped(F.col("label"), vocabulary.LABEL_CLASSES))
    return firsts.select("text", "label", entity_uri(F.col("text"), F.col("label"), F.col("folded"), namespace).alias("uri"), F.concat(F.lit(namespace), cls).alias("class_uri"), "place")


def resolve_aliases(entries: DataFrame) -> DataFrame:
    """Entries under the URI of the form, in their label, with most words that starts with theirs.

    The self-join's keys are label and first word. Ties go by place in the registry.
    """
    x = entries.withColumn("w", words(F.col("text"))).withColumn("first", F.element_at("w", F.when(F.size("w") > 0, 1)))
    long = x.select("label", "first", F.col("text").alias("form"), F.col("uri").alias("form_uri"), F.col("w").alias("fw"), F.col("place").alias("fplace"))
    starts = F.slice("fw", 1, F.greatest(F.size("w"), F.lit(1))) == F.col("w")
    pairs = x.join(long, ["label", "first"]).where((F.length("form") > F.length("text")) & starts)
    best = pairs.groupBy("text").agg(F.min_by("form_uri", F.struct((-F.size("fw")).alias("n"), "fplace")).alias("alias_uri"))
    return entries.join(best, "text", "left").withColumn("uri", F.coalesce("alias_uri", "uri")).drop("alias_uri").select(*entries.columns)


def entity_triples(entries: DataFrame) -> DataFrame:
    """Type and English label of every entry that has a class; equal triples are one."""
    pair = F.array(_triple(F.col("uri"), RDF + "type", F.col("class_uri")), _triple(F.col("uri"), RDFS + "label", F.col("text"), LITERAL, "en"))
    return entries.where("class_uri is not null").select(F.explode(pair).alias("t")).select("t.*").distinct()


def present(sentences: DataFrame, mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, pos, sentence, text, label, uri: nodes whose text a sentence contains, two or more to a sentence.

    Documents are the equi-key; inside a document containment decides. Texts are
    made distinct per document first, and sentences that hold fewer than two go.
    """
    known = mentions.select("doc_id", "text").distinct().join(entries.where("class_uri is not null").select("text", "label", "uri"), "text")
    found = sentences.join(known, "doc_id").where(F.contains(F.lower("sentence"), F.lower("text")))
    return found.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "pos"))).where("_n >= 2").drop("_n")


def pairs(found: DataFrame) -> DataFrame:
    """doc_id, pos, sentence, s, s_label, o, o_label: ordered pairs of different nodes in a sentence."""
    left = found.select("doc_id", "pos", "sentence", F.col("uri").alias("s"), F.col("label").alias("s_label")).distinct()
    right = found.select("doc_id", "pos", F.col("uri").alias("o"), F.col("label").alias("o_label")).distinct()
    return left.join(right, ["doc_id", "pos"]).where("s <> o")


def relation_triples(both: DataFrame, relations: tuple = vocabulary.RELATIONS, namespace: str = NAMESPACE) -> DataFrame:
    """Triples of the patterns that pairs of labels and a sentence's words match."""
    low = F.lower("sentence")
    names = F.array_compact(
        F.array(*(F.when(F.col("s_label").isin(*subjects) & F.col("o_label").isin(*objects) & (any_word(low, keys) if keys else F.lit(True)), F.lit(namespace + name)) for name, subjects, objects, keys in relations))
    )
    return both.select("s", "o", F.explode(names).alias("p")).distinct().select(_triple(F.col("s"), F.col("p"), F.col("o")).alias("t")).select("t.*")


def seat_triples(found: DataFrame, mentions: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """headquarteredIn literals: firms present (with another node) and places in a sentence that speaks of a seat."""
    firms = found.where(F.col("label").isin(*vocabulary.SEAT_LABELS) & any_word(F.lower("sentence"), vocabulary.SEAT_WORDS))
    places = mentions.where("label = 'GPE'").select("doc_id", F.col("text").alias("place")).distinct()
    rows = firms.join(places, "doc_id").where(F.contains(F.lower("sentence"), F.lower("place"))).select("uri", "place").distinct()
    return rows.select(_triple(F.col("uri"), namespace + "headquarteredIn", F.col("place"), LITERAL, "en").alias("t")).select("t.*")


KEYS = ["s", "p", "o", "o_kind", "o_lang", "o_dtype"]


def new_triples(triples: DataFrame, graph: DataFrame) -> DataFrame:
    """Those that the graph lacks, each once; language and type compare null-safe."""
    g = graph.select(*(F.col(c).alias(f"_{c}") for c in KEYS))
    x = triples.select(*KEYS).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS])
    return x.join(g, on, "left_anti")


def header_triples(spark, graph_uri: str = "http://example.org/graph", ontology: str = "http://example.org/ontology") -> DataFrame:
    from quillgraph.schemas import TRIPLES

    return spark.createDataFrame([(graph_uri, RDF + "type", OWL + "Ontology", URI, None, None), (graph_uri, OWL + "imports", ontology, URI, None, None)], TRIPLES)


def build(entity_docs: DataFrame, clean: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """The whole graph: header, declarations, relations, seats; documents without sentences add none."""
    from quillgraph.operators.cleaning import sentence_rows

    mentions = entity_docs.select(F.col("url").alias("doc_id"), F.explode("entities").alias("e")).select("doc_id", "e.label", "e.text", "e.start", "e.end")
    entries = resolve_aliases(registry(mentions, namespace))
    found = present(sentence_rows(clean), mentions, entries)
    parts = [header_triples(clean.sparkSession), entity_triples(entries), relation_triples(pairs(found), namespace=namespace), seat_triples(found, mentions, namespace)]
    return reduce(DataFrame.unionByName, parts).distinct()


# --- statistics -----------------------------------------------------------------------------


def totals(graph: DataFrame) -> DataFrame:
    """triples, entities, predicates."""
    nodes = graph.select(F.explode(F.array(F.struct("s"), F.struct(F.when(F.col("o_kind") == URI, F.col("o")).alias("s")))).alias("n")).select("n.s").where("s is not null and s not like '\\\\_:%'")
    n = nodes.distinct().agg(F.count("*").alias("entities"))
    return graph.agg(F.count("*").alias("triples"), F.count_distinct("p").alias("predicates")).crossJoin(n).select("triples", "entities", "predicates")


def class_counts(graph: DataFrame) -> DataFrame:
    """class, n: instances of each class, by local name."""
    return graph.where(F.col("p") == RDF + "type").groupBy(local_name(F.col("o")).alias("class")).agg(F.count("*").alias("n"))


def predicate_counts(graph: DataFrame, k: int | None = None) -> DataFrame:
    """predicate, n: by count, ties by name; the k most frequent."""
    found = graph.groupBy(local_name(F.col("p")).alias("predicate")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "predicate")
    return found.limit(k) if k else found
