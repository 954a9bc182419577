"""Cleaning of raw documents and statistics about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import vocabulary
from quillgraph.functions.text import ASCII_SPACE, ascii_fold, firsts, keyed, sentences, without_noise


def clean_documents(raw: DataFrame, text: str = "text", min_sentence: int = vocabulary.MIN_SENTENCE) -> DataFrame:
    """``raw`` with sentences, clean_text and sentence_count in place of its text.

    Folded to ASCII, noise removed, cut into sentences, short ones dropped,
    repeated ones dropped but for the first. Nothing is shuffled.
    """
    plain = without_noise(ascii_fold(F.col(text)), ASCII_SPACE)
    cut = F.filter(sentences(plain, ASCII_SPACE), lambda s: F.length(s) >= min_sentence)
    keep = [c for c in raw.columns if c not in (text, "sentences", "clean_text", "sentence_count")]
    ordered = raw.select(*keep, keyed(cut).alias("_ordered"))
    return ordered.select(*keep, firsts(F.col("_ordered")).alias("sentences")).select(
        *keep, "sentences", F.array_join("sentences", " ").alias("clean_text"), F.size("sentences").alias("sentence_count")
    )


def clean_corpus(raw: DataFrame) -> DataFrame:
    """Clean documents (url, title, sentences, clean_text, sentence_count) of the raw ones with a text."""
    ok = raw.where((F.col("status") == "ok") & (F.length("text") > 0))
    return clean_documents(ok.select("url", F.coalesce("title", F.lit("")).alias("title"), "text"))


def sentence_rows(clean: DataFrame, key: str = "url") -> DataFrame:
    """doc_id, pos, sentence: the long form.

    The outer form, as the plain one lets Spark infer a filter on the sentences,
    which would be pushed below and make every text be cleaned once more.
    """
    return clean.select(F.col(key).cast("string").alias("doc_id"), F.posexplode_outer("sentences").alias("pos", "sentence")).where("pos is not null")


def corpus_stats(raw: DataFrame, clean: DataFrame, key: str = "url", by: str | None = None) -> DataFrame:
    """documents, raw_chars, clean_chars, reduction_pct, sentences; for all, or for each value of ``by``."""
    sizes = raw.select(key, *([by] if by else []), F.length("text").alias("raw_chars"))
    both = sizes.join(clean.select(key, F.length("clean_text").alias("clean_chars"), "sentence_count"), key)
    groups = both.groupBy(by) if by else both.groupBy()
    return groups.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("raw_chars"), F.lit(0)).alias("raw_chars"), F.coalesce(F.sum("clean_chars"), F.lit(0)).alias("clean_chars"),
        F.coalesce(F.round(100 * (1 - F.try_divide(F.sum("clean_chars").cast("double"), F.sum("raw_chars").cast("double"))), 1), F.lit(0.0)).alias("reduction_pct"),
        F.coalesce(F.sum("sentence_count"), F.lit(0)).alias("sentences"),
    )


def status_counts(raw: DataFrame) -> DataFrame:
    """ok, total."""
    return raw.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count("*").alias("total"))
