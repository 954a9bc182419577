"""Alignment of entities and predicates with an external vocabulary, from candidate tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary
from quillgraph.functions.text import any_word, mapped
from quillgraph.schemas import LITERAL, NAMESPACE, OWL, RDF, RDFS, SKOS, URI, WD, WDT, XSD
from quillgraph.session import small

SCORE = "decimal(4,3)"


def one_text_per_uri(entries: DataFrame) -> DataFrame:
    """The longest text of each URI that has a class; ties by text."""
    first = Window.partitionBy("uri").orderBy(F.length("text").desc(), "text")
    return entries.where("class_uri is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def confidence(text: Column, label: Column, found: Column, description: Column) -> Column:
    """Exact 1, but for case 0.95, contained 0.8, other 0.6; 0.15 less if no hint of the label's kind is in the description. Decimal, so that 1 - 0.15 is 0.85."""
    d = lambda x: F.lit(x).cast(SCORE)
    base = F.when(found == text, d("1")).when(F.lower(found) == F.lower(text), d("0.95")).when(F.contains(F.lower(found), F.lower(text)), d("0.8")).otherwise(d("0.6"))
    missing = F.lit(False)
    for kind, hints in vocabulary.TYPE_HINTS.items():
        missing = missing | ((label == kind) & ~any_word(F.lower(F.coalesce(description, F.lit(""))), hints))
    return F.greatest(F.least(base - F.when(missing, d("0.15")).otherwise(d("0")), d("1")), d("0")).cast(SCORE)


def link(entries: DataFrame, candidates: DataFrame, forced: dict[str, str] = vocabulary.FORCED) -> DataFrame:
    """uri, text, label, class_uri, qid, wd_label, confidence, decision (sameAs, closeMatch, local) of one text per URI.

    Forced texts skip the search; otherwise the first-ranked candidate counts.
    """
    one = one_text_per_uri(entries).withColumn("forced", mapped(F.col("text"), forced))
    top = candidates.where("rank = 1").groupBy(F.col("label").alias("text")).agg(F.min_by(F.struct("qid", "wd_label", "wd_desc"), "qid").alias("hit"))
    x = one.join(top, "text", "left").withColumn("qid", F.coalesce("forced", "hit.qid")).withColumn("wd_label", F.col("hit.wd_label"))
    score = F.when(F.col("forced").isNotNull(), F.lit("1").cast(SCORE)).when(F.col("hit").isNotNull(), confidence(F.col("text"), F.col("label"), F.col("hit.wd_label"), F.col("hit.wd_desc")))
    x = x.withColumn("confidence", score)
    decision = F.when(F.col("confidence") >= F.lit(vocabulary.SAME).cast(SCORE), "sameAs").when(F.col("confidence") >= F.lit(vocabulary.CLOSE).cast(SCORE), "closeMatch").otherwise("local")
    return x.select("uri", "text", "label", "class_uri", "qid", "wd_label", "confidence", decision.alias("decision"))


def decision_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("decision").agg(F.count("*").alias("n"))


def _t(s: Column, p: str | Column, o: Column, kind: str = URI, lang: str | None = None, dtype: str | None = None) -> Column:
    text = lambda v: F.lit(v).cast("string")
    return F.struct(s.alias("s"), (p if isinstance(p, Column) else F.lit(p)).alias("p"), o.alias("o"), text(kind).alias("o_kind"), text(lang).alias("o_lang"), text(dtype).alias("o_dtype"))


def link_triples(links: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Score and id of everything that had a candidate, the match, or a local definition with its reason."""
    uri, decision = F.col("uri"), F.col("decision")
    local = decision == "local"
    own = F.coalesce(F.concat(F.lit(namespace), mapped(F.col("text"), vocabulary.LOCAL_CLASSES)), F.col("class_uri"))
    # as a number is written: 1.0, 0.8
    score = F.regexp_replace(F.regexp_replace(F.col("confidence").cast("string"), "0+$", ""), r"\.$", ".0")
    reason = F.when(F.col("qid").isNull(), "no candidates returned").otherwise(F.concat(F.lit("best candidate "), F.col("qid"), F.lit(" '"), F.coalesce("wd_label", F.lit("")), F.lit("' had low confidence ("), score, F.lit(")")))
    rows = F.array(
        F.when(F.col("qid").isNotNull(), _t(uri, namespace + "alignmentConfidence", score, LITERAL, None, XSD + "decimal")),
        F.when(F.col("qid").isNotNull(), _t(uri, namespace + "wikidataId", F.col("qid"), LITERAL, None, XSD + "string")),
        F.when(~local, _t(uri, F.when(decision == "sameAs", OWL + "sameAs").otherwise(SKOS + "closeMatch"), F.concat(F.lit(WD), "qid"))),
        F.when(local & own.isNotNull(), _t(uri, RDF + "type", own)),
        F.when(local, _t(uri, RDFS + "label", F.col("text"), LITERAL, "en")),
        F.when(local, _t(uri, RDFS + "comment", F.concat(F.lit("Locally defined entity: no alignment ("), reason, F.lit(").")), LITERAL, "en")),
    )
    return links.select(F.explode(F.array_compact(rows)).alias("t")).select("t.*").distinct()


# --- predicates -----------------------------------------------------------------------------


def label_search(properties: DataFrame, keywords: DataFrame, k: int = vocabulary.LABEL_HITS) -> DataFrame:
    """name, pid: the first k properties, by id, whose English label contains the keyword.

    ``properties``: pid, label, lang. ``keywords``: name, keyword, few by nature.
    """
    hits = small(keywords).join(properties.where("lang = 'en'"), F.contains(F.lower("label"), F.lower("keyword")))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("pid"))
    return hits.select("name", "pid").distinct().withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def triple_validation(claims: DataFrame, properties: DataFrame, known: DataFrame) -> DataFrame:
    """name, pid: properties that link a known pair. ``claims``: s, p, o; ``properties`` also has direct, the predicate in claims."""
    hit = claims.join(small(known), (F.col("s") == F.col("subject")) & (F.col("o") == F.col("object")))
    return hit.join(properties.where("lang = 'en'"), F.col("p") == F.col("direct")).select("name", "pid").distinct()


def align_predicates(spark: SparkSession, claims: DataFrame, properties: DataFrame, predicates: tuple = vocabulary.PREDICATES) -> DataFrame:
    """name, pid, relation, candidates, support for each predicate of the fixed list."""
    rows = [(k, n, kw, pid, rel) for k, (n, kw, _, pid, rel) in enumerate(predicates)]
    base = spark.createDataFrame(rows, "place int, name string, keyword string, pid string, relation string")
    known = spark.createDataFrame([(n, WD + a, WD + b) for n, _, pairs, *_ in predicates for a, b in pairs], "name string, subject string, object string")
    by_label = label_search(properties, base.where("keyword is not null").select("name", "keyword")).withColumn("by_label", F.lit(True))
    by_triple = triple_validation(claims, properties, known).withColumn("by_triple", F.lit(True))
    both = by_label.join(by_triple, ["name", "pid"], "full_outer").select("name", F.col("pid").alias("found"), F.coalesce("by_label", F.lit(False)).alias("by_label"), F.coalesce("by_triple", F.lit(False)).alias("by_triple"))
    x = base.join(both, "name", "left").groupBy("place", "name", "keyword", "pid", "relation").agg(
        F.array_join(F.array_sort(F.collect_set("found")), ",").alias("candidates"),
        F.coalesce(F.max((F.col("found") == F.col("pid")) & F.col("by_triple")), F.lit(False)).alias("t"),
        F.coalesce(F.max((F.col("found") == F.col("pid")) & F.col("by_label")), F.lit(False)).alias("l"),
    )
    support = F.when(F.col("pid").isNull(), "local only").when(F.col("t"), "confirmed by triple validation").when(F.col("l"), "confirmed by label search").otherwise("WARNING: found by neither search")
    return x.select("name", "pid", "relation", "candidates", support.alias("support"))


def predicate_triples(aligned: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    s = F.concat(F.lit(namespace), F.col("name"))
    said = F.concat(F.lit("Manually aligned to wdt:"), F.col("pid"), F.lit(" after reviewing candidates ["), F.col("candidates"), F.lit("]. Support: "), F.col("support"), F.lit("."))
    relation = F.when(F.col("relation") == "closeMatch", SKOS + "closeMatch").otherwise(OWL + "equivalentProperty")
    rows = F.array(
        _t(s, RDF + "type", F.lit(OWL + "ObjectProperty")),
        F.when(F.col("pid").isNotNull(), _t(s, relation, F.concat(F.lit(WDT), "pid"))),
        _t(s, RDFS + "comment", F.coalesce(said, F.lit("Local-only property: no equivalent exists.")), LITERAL, "en"),
    )
    return aligned.select(F.explode(F.array_compact(rows)).alias("t")).select("t.*")


def build(spark: SparkSession, entries: DataFrame, candidates: DataFrame, claims: DataFrame, properties: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """The alignment graph: entities and predicates."""
    parts = [link_triples(link(entries, candidates), namespace), predicate_triples(align_predicates(spark, claims, properties), namespace)]
    return reduce(DataFrame.unionByName, parts).distinct()


