"""Entity mentions: dictionary tagging, canonical forms, whitelists.

Mentions are rows (doc_id, label, text, start, end). Maps from surface to
canonical form have a row per distinct form; they are joined with AQE choosing
the strategy, and hot forms are counted before they meet anything.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary
from quillgraph.functions.text import without_possessive, words
from quillgraph.operators.training_set import ranked_within
from quillgraph.schemas import MENTIONS

#: Two to four capitalised words, for documents that no model has tagged.
CAPITALISED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b"


def dictionary_mentions(docs: DataFrame, phrases: dict[str, tuple[str, ...]] = vocabulary.PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact, case-sensitive phrases on token borders; longer phrases win, matches don't overlap.

    One alternation of all phrases scans a text once.
    """
    label_of = {p: label for label, ps in phrases.items() for p in ps}
    ordered = sorted(label_of, key=lambda p: (-len(p), p))
    pattern = r"(?<![\w])(" + "|".join(re.escape(p) for p in ordered) + r")(?![\w])"
    kinds = F.create_map(*(F.lit(x) for p in ordered for x in (p, label_of[p])))
    # the texts between matches give the offsets of those
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("hits"), F.split(body, pattern).alias("gaps")).where(F.size("hits") > 0)
    rows = found.select("doc_id", "hits", "gaps", F.posexplode("hits").alias("k", "text"))
    before = F.aggregate(F.slice("gaps", 1, F.col("k") + 1), F.lit(0), lambda a, x: a + F.length(x))
    start = (before + F.aggregate(F.slice("hits", 1, F.col("k")), F.lit(0), lambda a, x: a + F.length(x))).cast("int")
    return rows.select("doc_id", kinds[F.col("text")].alias("label"), "text", start.alias("start"), (start + F.length("text")).alias("end"))


def capitalised_mentions(docs: DataFrame, label: str = "ORG", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stand-in for a statistical tagger: capitalised phrases, all with one label."""
    hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CAPITALISED), F.lit(0))
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.lit(label).alias("label"), F.explode(hits).alias("text"))
    return rows.select("*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))


def tagged_mentions(docs: DataFrame, tagger: Callable[[str], list[tuple[str, str, int, int]]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Mentions of a pluggable tagger: text -> (text, label, start, end); unwanted labels are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, label, t.strip(), a, b) for i, body in zip(batch.doc_id, batch.text) for t, label, a, b in tagger(body or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "text", "start", "end"])

    given = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInPandas(run, MENTIONS).where(F.col("label").isin(*vocabulary.KEPT_LABELS))


def overridden(model: DataFrame, rules: DataFrame) -> DataFrame:
    """Both, without the model's mentions that overlap a rule's in the same document."""
    r = rules.select("doc_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    kept = model.join(r, (model["doc_id"] == r["doc_id"]) & (model["start"] < r["_b"]) & (model["end"] > r["_a"]), "left_anti")
    return kept.unionByName(rules)


def without_possessives(mentions: DataFrame, as_coded: bool = False) -> DataFrame:
    return mentions.withColumn("text", without_possessive(F.col("text"), as_coded))


def _suffix(long: str, short: str):
    """Whether the words of one column end with those of another."""
    return (F.size(long) > F.size(short)) & (F.slice(long, F.size(long) - F.size(short) + 1, F.greatest(F.size(short), F.lit(1))) == F.col(short))


def document_canonical(mentions: DataFrame) -> DataFrame:
    """Mentions with each text replaced by the longest form, in its document and label, that ends with its words.

    The self-join's keys are document, label and last word, so that only forms
    that can match meet.
    """
    forms = mentions.select("doc_id", "label", "text").distinct().withColumn("w", words(F.col("text"))).withColumn("last", F.element_at("w", F.when(F.size("w") > 0, -1)))
    long = forms.select("doc_id", "label", "last", F.col("text").alias("form"), F.col("w").alias("fw"))
    pairs = forms.join(long, ["doc_id", "label", "last"]).where((F.length("form") > F.length("text")) & (_suffix("fw", "w") | (F.col("fw") == F.col("w"))))
    # the longest wins; of equally long ones the first in order
    best = pairs.groupBy("doc_id", "label", "text").agg(F.min(F.struct((-F.length("form")).alias("n"), "form"))["form"].alias("canonical"))
    return mentions.join(best, ["doc_id", "label", "text"], "left").withColumn("text", F.coalesce("canonical", "text")).drop("canonical").select(*mentions.columns)


def counts(mentions: DataFrame) -> DataFrame:
    """label, text, n."""
    return mentions.groupBy("label", "text").agg(F.count("*").alias("n"))


def global_canonical(forms: DataFrame, as_coded: bool = False) -> DataFrame:
    """label, text, canonical for distinct forms (label, text, n) of the whole corpus.

    PERSON: more than three words map to the empty form, to be dropped; a bare
    last name maps to the only full name that has it. Others: a form maps to the
    only longer form that ends with its words. ``as_coded``: to the most frequent
    form that is looked at while it is still free, as the one candidate needn't be it.
    """
    x = forms.select("label", "text", "n").withColumn("w", words(F.col("text"))).withColumn("last", F.element_at("w", F.when(F.size("w") > 0, -1)))
    people, others = x.where("label = 'PERSON'"), x.where("label <> 'PERSON'")
    names = people.where("size(w) between 1 and 3")
    full = names.groupBy("last").agg(F.count_if(F.size("w") > 1).alias("full"), F.max(F.when(F.size("w") > 1, F.col("text"))).alias("one"))
    mapped = names.join(full, "last").select("label", "text", F.when((F.col("full") == 1) & (F.size("w") == 1), F.col("one")).otherwise(F.col("text")).alias("canonical"))
    dropped = people.where("size(w) > 3 or size(w) = 0").select("label", "text", F.lit("").alias("canonical"))
    long = others.select("label", "last", F.col("text").alias("form"), F.col("w").alias("fw"))
    ends = others.join(long, ["label", "last"]).where((F.length("form") > F.length("text")) & (_suffix("fw", "w") | (F.col("fw") == F.col("w"))))
    single = ends.groupBy("label", "text").agg(F.count("*").alias("k"), F.min("form").alias("only"))
    rest = others.join(single, ["label", "text"], "left")
    if as_coded:
        # the form in the outer loop claims every shorter form that has one candidate: the first of the longer ones, if it comes before the form itself
        place = F.struct((-F.col("n")).alias("less"), "text")
        longer = Window.partitionBy("label").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
        lead = others.groupBy("label", F.length("text").alias("size")).agg(F.min(place).alias("first")).withColumn("outer", F.min("first").over(longer))  # a row per length
        claims = rest.where("k = 1").withColumn("size", F.length("text")).join(lead.select("label", "size", "outer"), ["label", "size"])
        claimed = claims.where(F.col("outer") < place).select("label", "text", F.col("outer.text").alias("claim"))
        return mapped.unionByName(dropped).unionByName(others.join(claimed, ["label", "text"], "left").select("label", "text", F.coalesce("claim", "text").alias("canonical")))
    kept = rest.select("label", "text", F.when(F.col("k") == 1, F.col("only")).otherwise(F.col("text")).alias("canonical"))
    return mapped.unionByName(dropped).unionByName(kept)


def applied(mentions: DataFrame, canonical: DataFrame) -> DataFrame:
    """Mentions under their canonical forms; forms that aren't in the map stay."""
    out = mentions.join(canonical, ["label", "text"], "left").withColumn("text", F.coalesce("canonical", "text"))
    return out.select(*mentions.columns)


def whitelist(found: DataFrame, least: int = vocabulary.MIN_MENTIONS, caps: dict[str, int | None] = vocabulary.LABEL_CAPS, other: int = vocabulary.OTHER_CAP) -> DataFrame:
    """label, text, n, rank: forms with enough mentions, the most frequent of each label up to its cap.

    Ties go by text. The empty form, which stands for a dropped one, never comes in.
    """
    cap = F.lit(other)
    for label, most in caps.items():
        cap = F.when(F.col("label") == label, F.lit(most).cast("int")).otherwise(cap)
    often = ranked_within(found.where((F.col("n") >= least) & (F.col("text") != "")), "label", [-F.col("n"), F.col("text")], "rank")
    return often.withColumn("rank", (F.col("rank") + 1).cast("int")).where((F.col("rank") <= cap) | cap.isNull())


def kept_mentions(mentions: DataFrame, white: DataFrame) -> DataFrame:
    return mentions.join(white.select("label", "text"), ["label", "text"], "left_semi")


def top(found: DataFrame, k: int = 5) -> DataFrame:
    """label, text, n, rank: the k most frequent forms of each label."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.col("n").desc(), "text"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def entity_documents(docs: DataFrame, mentions: DataFrame, key: str = "url") -> DataFrame:
    """url, title, entity_count, entities: every document, also those without mentions."""
    lists = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", "label"))).alias("e"))
    out = docs.select(F.col(key).alias("url"), "title").join(lists, F.col("url") == F.col("doc_id"), "left")
    entities = F.transform(F.coalesce("e", F.array().cast("array<struct<start:int,end:int,text:string,label:string>>")), lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select("url", "title", F.size(entities).alias("entity_count"), entities.alias("entities"))


def run(clean: DataFrame, model: DataFrame | None = None, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """(entity documents, counts): tagging, canonical forms, whitelist.

    The two barriers, the global map and the whitelist, are aggregations over
    distinct forms. ``model``: mentions of another tagger, which phrases override.
    """
    docs = clean.where(F.length("clean_text") > 0)
    found = dictionary_mentions(docs, doc_id=key, text="clean_text")
    found = overridden(model, found) if model is not None else found
    found = document_canonical(without_possessives(found))
    found = applied(found, global_canonical(counts(found)))
    kept = kept_mentions(found, whitelist(counts(found)))
    return entity_documents(docs, kept, key), counts(kept)


#: The three kinds of ambiguity that reports show.
AMBIGUITIES = (
    ("Apple", "ORG", "a company or a fruit", "words such as revenue or store mean the company"),
    ("Amazon", "ORG", "a company or a river", "words such as invested mean the company, rainforest the river"),
    ("Mercury", "ORG", "a company, a planet or a person", "a phrase in the dictionary decides for the company"),
)


def ambiguity_cases(spark) -> DataFrame:
    return spark.createDataFrame(AMBIGUITIES, "entity string, label string, problem string, resolution string")
