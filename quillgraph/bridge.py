"""Triples of the star schema, the graph that queries and tests run over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import training_set
from quillgraph.schemas import LITERAL, NAMESPACE, RDF, RDFS, URI, XSD
from quillgraph.session import discard, small, written


def uri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{NAMESPACE}{kind}"), F.col(key).cast("string"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Table, kind and key of the subject, relation, kind and key of the object.
LINKS = (
    ("customer", "Customer", "c_custkey", "inNation", "Nation", "c_nationkey"),
    ("supplier", "Supplier", "s_suppkey", "inNation", "Nation", "s_nationkey"),
    ("nation", "Nation", "n_nationkey", "inRegion", "Region", "n_regionkey"),
    ("orders", "Order", "o_orderkey", "placedBy", "Customer", "o_custkey"),
    ("lineitem", "Order", "l_orderkey", "contains", "Part", "l_partkey"),
    ("lineitem", "Supplier", "l_suppkey", "supplies", "Part", "l_partkey"),
)


def _pairs(spark: SparkSession, sf_dir: str, table: str, s: str, o: str) -> DataFrame:
    rows = _table(spark, sf_dir, table).select(s, o)
    return rows.distinct() if table == "lineitem" else rows


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, p, o: the links between rows; each part of the union is distinct by construction, or made so."""
    parts = [_pairs(spark, sf_dir, table, s, o).select(uri(a, s).alias("s"), F.lit(NAMESPACE + p).alias("p"), uri(b, o).alias("o")) for table, a, s, p, b, o in LINKS]
    return reduce(DataFrame.unionByName, parts)


def coded_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edges`` as ids, with entities and relations (id, uri), as ``training_set`` numbers them; keys meet as numbers, names aren't shuffled with the links."""
    kinds = sorted({x for _, a, _, _, b, _ in LINKS for x in (a, b)})
    columns = sorted({(table, kind, key) for table, a, s, _, b, o in LINKS for kind, key in ((a, s), (b, o))})
    ends = [_table(spark, sf_dir, table).select(F.lit(kinds.index(kind)).alias("kind"), F.col(key).cast("long").alias("key")) for table, kind, key in columns]
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1)
    nodes = reduce(DataFrame.unionByName, ends).where("key is not null").distinct().select("kind", "key", F.concat(F.lit(NAMESPACE), name, F.col("key").cast("string")).alias("uri"))
    numbered = training_set.ranked(nodes, [F.col("uri")], "id")
    entities = written(numbered.select("id", "kind", "key", "uri"), "entities")
    discard(numbered)
    names = sorted({NAMESPACE + p for table, _, _, p, _, _ in LINKS if not _table(spark, sf_dir, table).isEmpty()})
    relations = spark.createDataFrame(list(enumerate(names)), "id long, uri string")
    of = {kind: small(entities.where(F.col("kind") == k).select("key", "id")) for k, kind in enumerate(kinds)}
    parts = []
    for table, a, s, p, b, o in LINKS:
        if NAMESPACE + p in names:
            x = _pairs(spark, sf_dir, table, s, o).select(F.col(s).cast("long").alias("_s"), F.col(o).cast("long").alias("_o"))
            for c, kind in (("s", a), ("o", b)):
                x = x.join(of[kind].select(F.col("key").alias(f"_{c}"), F.col("id").alias(c)).hint("shuffle_hash"), f"_{c}").drop(f"_{c}")
            parts.append(x.select("s", F.lit(names.index(NAMESPACE + p)).cast("long").alias("p"), "o"))
    return reduce(DataFrame.unionByName, parts), entities.select("id", "uri"), relations


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples: links, types, English names and typed balances."""
    null = F.lit(None).cast("string")
    links = edges(spark, sf_dir).select("s", "p", "o", F.lit(URI).alias("o_kind"), null.alias("o_lang"), null.alias("o_dtype"))
    out = [links]
    for table, kind, key, name in (
        ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name"), ("nation", "Nation", "n_nationkey", "n_name"),
        ("region", "Region", "r_regionkey", "r_name"), ("part", "Part", "p_partkey", "p_name"),
    ):
        rows = _table(spark, sf_dir, table).withColumn("s", uri(kind, key))
        out.append(rows.select("s", F.lit(RDF + "type").alias("p"), F.lit(NAMESPACE + kind).alias("o"), F.lit(URI).alias("o_kind"), null.alias("o_lang"), null.alias("o_dtype")))
        out.append(rows.select("s", F.lit(RDFS + "label").alias("p"), F.col(name).alias("o"), F.lit(LITERAL).alias("o_kind"), F.lit("en").alias("o_lang"), null.alias("o_dtype")))
    for table, kind, key, value in (("customer", "Customer", "c_custkey", "c_acctbal"), ("supplier", "Supplier", "s_suppkey", "s_acctbal")):
        rows = _table(spark, sf_dir, table)
        amount = F.col(value).cast("decimal(18,2)").cast("string")
        out.append(rows.select(uri(kind, key).alias("s"), F.lit(NAMESPACE + "balance").alias("p"), amount.alias("o"), F.lit(LITERAL).alias("o_kind"), null.alias("o_lang"), F.lit(XSD + "decimal").alias("o_dtype")))
    return reduce(DataFrame.unionByName, out)
