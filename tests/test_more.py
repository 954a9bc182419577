"""Operators that the other files don't reach: taggers, fallbacks, labels, whole runs."""

from pyspark.sql import functions as F

from quillgraph.operators import embeddings, mentions, trainer
from quillgraph.operators import training_set as ts
from quillgraph.plans import stages
from quillgraph.schemas import MENTIONS
from quillgraph.sources import ntriples, tables


def test_tagger_and_rules(spark):
    docs = spark.createDataFrame([("1", "Acme met Sequoia Capital"), ("2", None)], "doc_id string, text string")

    def tagger(text):
        return [(w, "ORG", text.index(w), text.index(w) + len(w)) for w in text.split() if w[0].isupper()] + [("x", "DATE", 0, 1)]

    model, known = mentions.tagged_mentions(docs, tagger), mentions.dictionary_mentions(docs)
    assert sorted(r.text for r in model.collect()) == ["Acme", "Capital", "Sequoia"]
    both = mentions.overridden(model, known)
    assert sorted((r.text, r.label) for r in both.collect()) == [("Acme", "ORG"), ("Sequoia Capital", "VC_FIRM")]


def test_a_label_per_document_list(spark):
    docs = spark.createDataFrame([("u", "t"), ("v", "t")], "url string, title string")
    found = spark.createDataFrame([("u", "ORG", "b", 5, 6), ("u", "ORG", "a", 1, 2)], MENTIONS)
    rows = {r.url: r for r in mentions.entity_documents(docs, found).collect()}
    assert [e.text for e in rows["u"].entities] == ["a", "b"] and rows["v"].entity_count == 0 and rows["v"].entities == []


def test_missing_labels(spark):
    rows = spark.createDataFrame([("http://a#x", "have"), ("http://a#y", None), ("http://a/Q5", None)], "uri string, label string")
    other = spark.createDataFrame([("http://a#y", "found"), ("http://a#x", "not this")], "uri string, label string")
    out = tables.filled(rows, other).select("uri", embeddings.label_of(F.col("uri"), F.col("label")).alias("l"))
    assert {r.uri[-1]: r.l for r in out.collect()} == {"x": "have", "y": "found", "5": "Q5"}
    assert [r.q for r in out.orderBy("uri").select(embeddings.is_plain_id(F.col("l")).alias("q")).collect()] == [False, False, True]


def test_first_available(spark):
    candidates = spark.createDataFrame([("n", 0, "a"), ("n", 1, "b"), ("m", 0, "z")], "name string, place int, uri string")
    ids = spark.createDataFrame([(4, "b"), (5, "c")], "id long, uri string")
    assert [tuple(r) for r in embeddings.first_available(candidates, ids).collect()] == [("n", "b", 4)]
    got = spark.range(12).select(embeddings.agreement(F.col("id")).alias("a")).collect()
    assert [r.a for r in got][3:5] + [got[11].a] == ["strong", "partial", "absent"]


def test_graph_to_training_set(spark, tmp_path):
    lines = [f"<http://e{a}> <http://p> <http://e{(a * 7 + b) % 30}> ." for a in range(30) for b in range(3)] + ['<http://e1> <http://p> "x" .', "broken"]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    report = {r.metric: r.value for r in stages.graph_to_training_set(spark, str(tmp_path / "x.nt"), str(tmp_path / "out")).collect()}
    n = ntriples.read_tsv(spark, str(tmp_path / "out/train")).count()
    assert n == report["train"] and report["unknown_test"] == 0 and report["entities"] == 30
    ids = ntriples.read_dictionary(spark, str(tmp_path / "out/entities"))
    assert ids.count() == 30 and ids.agg(F.max("id")).first()[0] == 29
    coded = ntriples.read_tsv(spark, str(tmp_path / "out/ids"), "s int, p int, o int")
    assert coded.count() == report["train"] + report.get("valid", 0) + report.get("test", 0)


def test_models_and_sizes_are_compared(spark, tmp_path):
    rows = [(f"http://e{a}", f"http://p{b}", f"http://e{(a * 5 + b) % 24}") for a in range(24) for b in range(3)]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    configs = {m: trainer.smaller(trainer.CONFIGS[m], dim=4, epochs=2, batch=16, negatives=3) for m in ("TransE", "ComplEx")}
    out = stages.compare_models(ts.split(triples), str(tmp_path / "m"), configs)
    got = {r.model: r for r in out.collect()}
    assert set(got) == set(configs) and all(0 < r.mrr <= 1 for r in got.values())
    again = stages.compare_models(ts.split(triples), str(tmp_path / "m"), configs)
    assert {r.model: r.train_time_s for r in again.collect()} == {m: r.train_time_s for m, r in got.items()}
    assert spark.read.parquet(str(tmp_path / "m/TransE/losses")).count() == 2
    sizes = stages.size_sensitivity(triples, configs["TransE"], str(tmp_path / "s"), sizes=(40,))
    assert {r.size_label: r.num_triples for r in sizes.collect()} == {"40": 40, "full": len(rows)}
