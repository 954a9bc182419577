"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def projection(df: DataFrame, columns: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """Only the named columns, under the operator's own names and types.

    Further columns of the input, whatever their names, never reach an
    operator's internals, so they can't clash with what it adds.
    """
    return positional(df).select(*(F.col(place(df, columns[k])).cast(kinds[k]).alias(k) for k in kinds))


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by place (c0, c1, ...), whatever they were called: nothing that is added can clash."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What ``positional`` calls a column: of that spelling, or else the only one that differs in case alone."""
    names = df.columns
    found = [k for k, c in enumerate(names) if c == name] or [k for k, c in enumerate(names) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are called {name}")
    return f"c{found[0]}"


#: A key with more than one row in this many is joined by broadcast; there are fewer such keys than this.
HEAVY = 1000


def joined_evenly(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and in ``n`` the number of its rows among ``total``.

    Keys that would fill a task of their own are fewer than ``HEAVY`` whatever the
    input, so those are broadcast; the others are shuffled.
    """
    heavy = keyed.where(F.col("n") * HEAVY > total).drop("n")
    rest = keyed.where(F.col("n") * HEAVY <= total).drop("n")
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rest, key))


def parts(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts with about ``most`` bytes in one column, a row at least.

    Python objects are made of one part at a time, so a worker's memory doesn't
    follow the size of Arrow's batches.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)]):
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Hand freed memory back to the system: workers outlive their tasks, and executors count them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)
