"""Sharding through fixed virtual slots.

A record hashes into one of thousands of slots that never change. Bytes are
summed per slot, and a stored map gives each slot its shard, by version: the
first deals the slots out in turn, before any size is known; every later version
is an edit of the one before, which moves only the slots that rebalancing needs.
Records are never compared and only slim rows (no text) are shuffled.

Equal rows (same id and text) are counted before anything else and go on as one
row with their number. They are spread over consecutive slots from the one that
their hash names, so no slot holds more of them than its share, and shards stay
near equal however many of a corpus's rows are copies. Equal texts under
different ids are spread by their ids.

Edge cases: a null text has no bytes (size 1) and CRC 0, as an empty one; a null
id hashes like any value; equal rows are spread as said; an empty table gives an
empty result and a map in which every slot holds nothing; further columns of
the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import projection
from quillgraph.session import shared_folder, written

SLOTS = 4096


def slotted(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, print, virtual_slot, copies: equal records that share a slot are one slim row."""
    base = projection(docs, {"doc_id": doc_id, "text": text}, {"doc_id": "long", "text": "string"})
    slim = base.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("print"),
    )
    keys = ["doc_id", "size", "text_crc32", "print"]
    counted = slim.groupBy(*keys).agg(F.count("*").alias("n"))
    # a bundle for each slot that a group reaches: at most ``slots`` of them, whatever the group's size
    bundles = counted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(slots)) - 1)))
    copies = F.floor((F.col("n") - F.col("k") - 1) / slots) + 1
    return bundles.select(*keys, F.pmod(F.pmod("print", F.lit(slots)) + F.col("k"), F.lit(slots)).cast("int").alias("virtual_slot"), copies.cast("long").alias("copies"))


def slot_sums(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows: for every slot, also those without records."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, shard: all slots dealt out in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(current: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """An edit of a map: virtual_slot, shard for ``shards`` shards of about equal bytes.

    Each shard keeps its slots, the largest first, up to the fair share. The
    others, small ones as they are, go one by one to the lightest shard, the
    largest first, so shards end up within about one of them of each other. All
    arrays have at most a slot or a shard for each entry, a fixed number.
    """
    held = current.select("virtual_slot", "shard").join(sums, "virtual_slot")
    upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    fair = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    marked = held.withColumn("upto", upto).withColumn("stays", (F.col("shard") < shards) & (F.col("upto") <= fair))
    loads = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = marked.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left")
    loads = loads.agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))), lambda x: x["load"]).alias("loads"))
    movers = marked.agg(F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot")))).alias("movers"))

    def dealt(so_far: Column, slot: Column) -> Column:
        lightest = F.array_position(so_far["load"], F.array_min(so_far["load"]))
        load = F.transform(so_far["load"], lambda x, k: F.when(k + 1 == lightest, x - slot["less"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(so_far["shard"], F.array((lightest - 1).cast("int"))).alias("shard"))

    start = F.struct(F.col("loads").alias("load"), F.array().cast("array<int>").alias("shard"))
    folded = movers.crossJoin(loads).select("movers", F.aggregate("movers", start, dealt)["shard"].alias("shard"))  # one row each
    moved = folded.select(F.explode(F.arrays_zip(F.col("movers.virtual_slot").alias("virtual_slot"), F.col("shard").alias("shard"))).alias("x")).select("x.*")
    return marked.where("stays").select("virtual_slot", "shard").unionByName(moved)


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store a version of the map; saved again it is replaced, the others stay as they are."""
    slot_map.select("virtual_slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """virtual_slot, shard, version: one version of the stored map, by default the latest."""
    stored = spark.read.parquet(path)
    version = version or stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("virtual_slot", "shard", "version")


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, store: str | None = None, **columns: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot: every record's place by the map's second version.

    ``store``: where the versions of the map are kept; by default a new place in
    the shared folder. ``slot`` numbers a shard's records from 0 without gaps: the
    records of the slots before, which the slots' row counts give, plus a number
    inside the slot. No window spans a shard.
    """
    spark = docs.sparkSession
    store = store or f"{shared_folder(spark)}/shard-map-{uuid.uuid4().hex}"
    rows = written(slotted(docs, slots, **columns), "sharding-rows")
    sums = written(slot_sums(rows, slots), "sharding-sums")
    save_map(first_map(spark, shards, slots), store, 1)
    save_map(rebalanced(load_map(spark, store, 1), sums, shards), store, 2)
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    bases = load_map(spark, store, 2).join(sums, "virtual_slot").select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("base"))
    inner = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "print").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("first", F.coalesce(F.sum("copies").over(inner), F.lit(0)))
    # the map has `slots` rows, whatever the input: a fixed size to broadcast
    met = first.join(F.broadcast(written(bases, "sharding-map")), "virtual_slot").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("first") + F.col("nth")).cast("long").alias("slot"), "virtual_slot")
