"""Queries run over whole tables, and so does the SQL that states their results (``test_catalog`` compares the two)."""

from pathlib import Path

from quillgraph import bridge, catalog

FOLDER = "/root/testdata/sf0.001"
#: Filters that once left rows out.
PARTS = (" WHERE l_orderkey % 10 = 0", " WHERE s < 20", " WHERE l_linenumber = 1")


def test_no_statement_leaves_rows_out():
    assert not [n for n, sql in catalog.oracle_sql().items() if any(x in sql for x in PARTS)]


def test_every_node_gets_a_vector(spark):
    links = bridge.edges(spark, FOLDER).collect()
    got = catalog.queries()["train_transe"](spark, FOLDER).collect()
    assert sorted(r.uri for r in got) == sorted({x for r in links for x in (r.s, r.o)})
    assert all(len(r.v) == 16 for r in got)


def test_links_are_encoded_by_their_keys(spark):
    from quillgraph.operators import training_set as ts

    x, e, r = bridge.coded_edges(spark, FOLDER)
    links = bridge.edges(spark, FOLDER)
    assert sorted(e.collect()) == sorted(ts.entity_ids(links).collect()) and sorted(r.collect()) == sorted(ts.relation_ids(links).collect())
    assert sorted(x.collect()) == sorted(ts.encode(links, e, r).collect())


def test_a_part_on_a_later_line_is_contained(spark, tmp_path):
    from pyspark.sql import functions as F

    for f in Path(FOLDER).glob("*.parquet"):
        if f.stem != "lineitem":
            (tmp_path / f.name).symlink_to(f)
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(1)
    two = lines.withColumns({"l_orderkey": F.lit(1).cast("long"), "l_partkey": F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 2))))})
    two.withColumn("l_linenumber", F.when(F.col("l_partkey") == 1, 1).otherwise(2)).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r.o.rsplit("#")[-1] for r in bridge.edges(spark, str(tmp_path)).where("p like '%contains'").collect()]
    assert sorted(got) == ["Part1", "Part2"]


def test_turtle_holds_the_whole_graph(spark):
    from quillgraph.sources import turtle

    text = "".join(r.value for r in catalog.queries()["turtle_lines"](spark, FOLDER).collect())
    want = {tuple(r) for r in bridge.triples(spark, FOLDER).select("s", "p", "o", "o_kind", "o_lang", "o_dtype").collect()}
    assert set(turtle.parse_turtle(text)) == want
