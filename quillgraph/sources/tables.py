"""Model and result tables: Parquet, written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made and written only if it isn't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def filled(rows: DataFrame, labels: DataFrame, key: str = "uri", label: str = "label") -> DataFrame:
    """``rows`` with labels that are missing taken from a table (uri, label)."""
    other = labels.groupBy(F.col("uri").alias("_uri")).agg(F.min("label").alias("_label"))
    found = rows.join(other, F.col(key) == F.col("_uri"), "left").drop("_uri")
    has = F.col(label) if label in rows.columns else F.lit(None).cast("string")
    return found.withColumn(label, F.coalesce(has, "_label")).drop("_label")
