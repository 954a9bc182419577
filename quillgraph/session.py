"""Session defaults and the shared folder every multi-pass operator writes to."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "quillgraph", cores: int | None = None) -> SparkSession:
    """A local session with the settings the library assumes (UTC, AQE, Arrow)."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; without that setting it is
    refused, as its machines see no folder of the driver's. Only a session in one
    process (tests) gets a temporary folder instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        own = tempfile.mkdtemp(prefix="quillgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, by: tuple[str, ...] = (), **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, a folder for each value of ``by``, and read it back.

    Cuts the lineage durably: the rows survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many rows; otherwise as it is, for the planner to choose."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_WRITTEN: list[str] = []


def discard(df: DataFrame) -> None:
    """Delete the tables that ``written`` has made and ``df`` reads."""
    for file in {f.rpartition("/")[0] + "/" for f in df.inputFiles()}:
        for path in [p for p in _WRITTEN if p.split(":", 1)[-1].lstrip("/") + "/" in file]:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard_written(spark: SparkSession) -> None:
    """Delete the tables that ``written`` has made; results that still read them are gone, too."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
