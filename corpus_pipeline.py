"""A corpus pipeline of five stages, each of which works on all that the one before kept.

1. quality: documents that the classifier rejects go.
2. lines: lines whose key is in ten documents or more go; documents stay, even
   emptied ones, and n_chars follows the text.
3. copies: of documents linked by SimHash, the one with the smallest id stays.
4. mix: documents enter as often as their source's target says, none to three
   times; a document that enters twice is two equal rows.
5. encode: the texts as SentencePiece ids.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import line_dedup, mixing, quality, sentencepiece_codec, simhash
from quillgraph.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, empty and null texts scored like any other; all columns as they are."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten share; a null text becomes an empty one, n_chars counts what is left, other columns stay as they are."""
    found = line_dedup.without_common_lines(docs, min_docs=10)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id, null ids last; equal rows are one group, so are null and empty texts; all columns as they are."""
    return simhash.drop_duplicates(docs, words=3, threshold=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target says; a null source is one of its own, of equal rows any may enter; all columns as they are."""
    return mixing.repeated(docs, weights=(5, 2, 1))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: its ids and whether they decode to its text; a null text has null ids."""
    found = sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), columns=["doc_id", "source"])
    return found.select("doc_id", "source", "n_tokens", "parity", "round_trip", "ids")


STAGES: list[tuple[str, Stage]] = [("quality", keep_quality), ("lines", drop_lines), ("copies", drop_copies), ("mix", mix_sources), ("encode", encode_texts)]

#: SQL can express neither the classifier nor the model's ids; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
