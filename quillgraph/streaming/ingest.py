"""Triples that arrive over time, added to a graph that is a set.

Each micro-batch appends what the graph lacks; nothing is rewritten. Triples
carry no time, so there is no watermark: the graph itself is the memory. A batch
that is run again after a failure finds its triples there and adds none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.graph import new_triples
from quillgraph.schemas import TRIPLES
from quillgraph.sources import ntriples
from quillgraph.sources.tables import exists


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRIPLES).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples files as they appear in a folder."""
    return ntriples.parse_lines(spark.readStream.text(path))


def append_new(batch: DataFrame, graph: str) -> int:
    """Add to the Parquet graph what it lacks; returns how many."""
    spark = batch.sparkSession
    old = spark.read.schema(TRIPLES).parquet(graph) if exists(spark, graph) else spark.createDataFrame([], TRIPLES)
    fresh = new_triples(batch, old).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(graph)
        return n
    finally:
        fresh.unpersist()


def ingest(stream: DataFrame, graph: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the ingest; ``once``: work off what is there and stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_new(batch, graph) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()
