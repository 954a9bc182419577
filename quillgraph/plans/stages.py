"""Whole runs from files to files, with each stage's output written for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators import cleaning, embeddings, graph, mentions, trainer
from quillgraph.operators import training_set as ts
from quillgraph.schemas import CLEAN_DOCUMENTS, ENTITY_DOCUMENTS, NAMESPACE, RAW_DOCUMENTS
from quillgraph.session import written
from quillgraph.sources import jsonl, ntriples, tables, turtle

MODEL_ROW = "model string, mrr double, hits_at_1 double, hits_at_3 double, hits_at_10 double, train_time_s double, epochs int, embedding_dim int"
SIZE_ROW = f"size_label string, num_triples long, num_train long, num_entities long, num_relations long, {MODEL_ROW}"


def documents_to_graph(spark: SparkSession, raw: str, out: str, model: DataFrame | None = None, namespace: str = NAMESPACE) -> DataFrame:
    """Raw documents (JSON lines) to clean ones, entity documents, counts and a graph, all under ``out``."""
    jsonl.write_lines(cleaning.clean_corpus(jsonl.read_lines(spark, raw, RAW_DOCUMENTS)), f"{out}/cleaned_documents")
    clean = jsonl.read_lines(spark, f"{out}/cleaned_documents", CLEAN_DOCUMENTS)
    entities, counts = mentions.run(clean, model)
    jsonl.write_lines(entities, f"{out}/entity_documents")
    jsonl.write_counts(counts, f"{out}/entity_counts")
    built = graph.build(jsonl.read_lines(spark, f"{out}/entity_documents", ENTITY_DOCUMENTS), clean, namespace)
    turtle.write(built, f"{out}/graph")
    return built


def graph_to_training_set(spark: SparkSession, lines: str, out: str, cap: int | None = None) -> DataFrame:
    """N-Triples to pruned triples, dictionaries, id triples and the three splits; returns the report."""
    marked = ts.reasons(spark.read.text(lines))
    triples = ts.relation_cap(ts.prune(ts.clean_triples(marked)), cap)
    entities, relations = ts.entity_ids(triples), ts.relation_ids(triples)
    rows = ts.split(triples)
    for name in ("train", "valid", "test"):
        ntriples.write_tsv(rows.where(f"split = '{name}'").select("s", "p", "o"), f"{out}/{name}")
    ntriples.write_tsv(ts.encode(triples, entities, relations), f"{out}/ids")
    ntriples.write_tsv(entities, f"{out}/entities", header=True)
    ntriples.write_tsv(relations, f"{out}/relations", header=True)
    return ts.report(triples, rows)


def trained(rows: DataFrame, config: trainer.Config, out: str, partitions: int = 1) -> tuple:
    """One model on a split (s, p, o, split): its row of metrics, and tables entities, relations and losses under ``out``.

    All parts are encoded with the names of train; unknown ones are left out.
    """
    spark = rows.sparkSession
    rows = written(rows, "model-split")
    train = rows.where("split = 'train'")
    e, r = ts.entity_ids(train), ts.relation_ids(train)
    coded = {name: written(ts.encode(rows.where(f"split = '{name}'"), e, r), "model-ids") for name in ("train", "valid", "test")}
    n = e.count()
    blocks, losses, seconds = trainer.fit(coded["train"], config, n, r.count(), partitions)
    for name, ids, part in (("entities", e, "e"), ("relations", r, "r")):
        trainer.parameters(blocks, part, config).join(ids, "id").write.mode("overwrite").parquet(f"{out}/{name}")
    spark.createDataFrame(list(enumerate(losses, 1)), "epoch int, loss double").write.mode("overwrite").parquet(f"{out}/losses")
    ents, rels = (spark.read.parquet(f"{out}/{name}").select("id", "v") for name in ("entities", "relations"))
    known = coded["train"].unionByName(coded["valid"]).unionByName(coded["test"])
    ranks = embeddings.filtered_ranks(config.model, coded["test"], known, ents, rels, trainer.width(config), config.norm)
    m = trainer.summary(config.model, embeddings.rank_metrics(ranks, n), seconds, config)
    return tuple(m.values())


def compare_models(rows: DataFrame, out: str, configs: dict[str, trainer.Config] = trainer.CONFIGS, partitions: int = 1) -> DataFrame:
    """A row of metrics per model; a model whose row is there already isn't trained again. What a comparison chart plots."""
    spark, found = rows.sparkSession, None
    for name, config in configs.items():
        make = lambda name=name, config=config: spark.createDataFrame([trained(rows, config, f"{out}/{name}", partitions)], MODEL_ROW)
        row = tables.cached(spark, f"{out}/{name}/metrics", make)
        found = row if found is None else found.unionByName(row)
    return found


def size_sensitivity(pool: DataFrame, config: trainer.Config, out: str, sizes: tuple[int, ...] = (20_000, 50_000), partitions: int = 1) -> DataFrame:
    """A row of metrics for each size of a hash-ordered subset, each split anew; what a sensitivity chart plots."""
    spark, found = pool.sparkSession, None
    pool = written(pool.select("s", "p", "o").distinct(), "pool")
    for label, size in ts.size_grid(pool.count(), sizes):

        def make(label: str = label, size: int = size) -> DataFrame:
            part = written(ts.split(ts.subsample(pool, size)), "subset")
            train = part.where("split = 'train'")
            head = (label, size, train.count(), ts.entity_ids(train).count(), ts.relation_ids(train).count())
            return spark.createDataFrame([(*head, *trained(part, config, f"{out}/{label}", partitions))], SIZE_ROW)

        row = tables.cached(spark, f"{out}/{label}/metrics", make)
        found = row if found is None else found.unionByName(row)
    return found
