"""JSON lines and whole JSON documents (fixed schemas, UTF-8, no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_document(df: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object of all rows, key to value; for tables that a document may hold."""
    quoted = F.get_json_object(F.to_json(F.struct(F.col(key).alias("k"))), "$")  # {"k":"..."}
    name = F.regexp_extract(quoted, r'(?s)^\{"k":(.*)\}$', 1)
    inner = F.regexp_extract(F.to_json(F.struct(F.col(value).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    rows = df.select(F.struct(F.col(key).alias("key"), F.concat(name, F.lit(":"), inner).alias("text")).alias("row"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["text"]), ",")
    rows.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_counts(df: DataFrame, path: str) -> None:
    """label -> text -> n, from rows (label, text, n)."""
    inner = df.groupBy("label").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("text", "n")))).alias("texts"))
    write_document(inner, "label", "texts", path)
