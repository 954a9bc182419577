import pytest

from quillgraph.functions import text as X
from quillgraph.operators import cleaning, graph, mentions
from quillgraph.plans import questions, stages
from quillgraph.schemas import LITERAL, NAMESPACE, RAW_DOCUMENTS, RDFS, TRIPLES
from quillgraph.sources import turtle
from quillgraph.streaming import ingest
from pyspark.sql import functions as F


def column(spark, values, make):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", make(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_fold_and_slug(spark):
    given = ["TechCrunch", "Bloomberg.com", "René Girard", "Sam Bankman-Fried", "***", "", "ﬁve  x"]
    assert column(spark, given, lambda t: X.slug(X.ascii_fold(t))) == ["Techcrunch", "Bloombergcom", "ReneGirard", "SamBankmanfried", "Unknown", "Unknown", "FiveX"]


def test_possessive(spark):
    given = ["Peter Thiel's", "Leo Strauss", "Owen Thomas"]
    assert column(spark, given, lambda t: X.without_possessive(t, as_coded=True)) == ["Peter Thiel", "Leo Strau", "Owen Thoma"]
    assert column(spark, given + ["Jones'"], X.without_possessive) == ["Peter Thiel", "Leo Strauss", "Owen Thomas", "Jones"]


def test_noise(spark):
    given = ["A[12] b &amp;lt; c https://x.y/z d", " x [Citation Needed][EDIT]\n\ny ", "a&nbsp;b&quot;"]
    assert column(spark, given, X.without_noise) == ["A b < c d", "x y", 'a b"']


def test_sentences(spark):
    given = ["One is here. Two! three? Four.", "", "A. A. a. B"]
    assert column(spark, given, X.sentences) == [["One is here.", "Two! three?", "Four."], [], ["A.", "A. a.", "B"]]
    assert column(spark, ["Xy. ab. XY. Q. xy."], lambda t: X.firsts(X.keyed(F.split(t, " ")))) == [["Xy.", "ab.", "Q."]]
    assert column(spark, [""], lambda t: X.firsts(X.keyed(F.filter(F.split(t, " "), lambda x: x != "")))) == [[]]


def test_clean_corpus(spark):
    long = "This sentence has exactly forty letters." * 1
    raw = [("u", None, f"{long} Short one. {long.upper()} Ünïcode sentence that is certainly long enough.", 1, "ok"), ("v", "t", "", 0, "ok"), ("w", None, "", None, "error")]
    df = spark.createDataFrame(raw, RAW_DOCUMENTS)
    clean = cleaning.clean_corpus(df)
    assert clean.columns == ["url", "title", "sentences", "clean_text", "sentence_count"]
    (r,) = clean.collect()
    assert r.sentences == [long, "Unicode sentence that is certainly long enough."] and r.sentence_count == 2
    assert len(long) == 40
    assert tuple(cleaning.status_counts(df).first()) == (2, 3)
    s = cleaning.corpus_stats(df, clean).first()
    assert s.documents == 1 and s.sentences == 2


def test_dictionary(spark):
    df = spark.createDataFrame([("1", "Sequoia Capital and Sequoia, Accelerate; Accel Partners' IPO in AI/ML. ipo"), ("2", None)], "doc_id string, text string")
    rows = mentions.dictionary_mentions(df).orderBy("start").collect()
    assert [(r.text, r.label) for r in rows] == [("Sequoia Capital", "VC_FIRM"), ("Sequoia", "VC_FIRM"), ("Accel Partners", "VC_FIRM"), ("IPO", "EXIT_TYPE"), ("AI/ML", "SECTOR")]
    body = df.first().text
    assert all(body[r.start : r.end] == r.text for r in rows)


def test_canonical_forms(spark):
    m = lambda *rows: spark.createDataFrame([(d, l, t, None, None) for d, l, t in rows], "doc_id string, label string, text string, start int, end int")
    x = m(("1", "PERSON", "Thiel"), ("1", "PERSON", "Peter Thiel"), ("2", "PERSON", "Thiel"), ("1", "ORG", "Thiel"))
    assert sorted((r.doc_id, r.label, r.text) for r in mentions.document_canonical(x).collect()) == [("1", "ORG", "Thiel"), ("1", "PERSON", "Peter Thiel"), ("1", "PERSON", "Peter Thiel"), ("2", "PERSON", "Thiel")]
    forms = [("PERSON", "Graham", 9), ("PERSON", "Paul Graham", 2), ("PERSON", "Lee", 1), ("PERSON", "Ann Lee", 1), ("PERSON", "Bob Lee", 1), ("PERSON", "One Two Three Four", 1), ("PERSON", "Cher", 1), ("ORG", "Capital", 4), ("ORG", "Big Capital", 3), ("ORG", "Ventures", 2), ("ORG", "A Ventures", 1), ("ORG", "B Ventures", 1)]
    f = spark.createDataFrame(forms, "label string, text string, n long")
    got = {(r.label, r.text): r.canonical for r in mentions.global_canonical(f).collect()}
    assert got == {(l, t): t for l, t, _ in forms} | {("PERSON", "Graham"): "Paul Graham", ("PERSON", "One Two Three Four"): "", ("ORG", "Capital"): "Big Capital"}
    coded = {(r.label, r.text): r.canonical for r in mentions.global_canonical(f, as_coded=True).collect()}
    assert coded["ORG", "Capital"] == "Capital" and coded["PERSON", "Graham"] == "Paul Graham"


def test_whitelist(spark):
    rows = [("GPE", f"g{k:02}", 5) for k in range(40)] + [("SECTOR", f"s{k}", 3) for k in range(40)] + [("X", "", 9), ("X", "few", 2), ("X", "some", 3)]
    white = mentions.whitelist(spark.createDataFrame(rows, "label string, text string, n long")).collect()
    assert sum(r.label == "GPE" for r in white) == 30 and sum(r.label == "SECTOR" for r in white) == 40
    assert max(r.text for r in white if r.label == "GPE") == "g29" and [r.text for r in white if r.label == "X"] == ["some"]


@pytest.fixture(scope="module")
def entities(spark):
    rows = [
        ("1", "PERSON", "Ada", 0), ("1", "ORG", "Ada", 9), ("1", "ORG", "Acme", 20), ("1", "PERSON", "Ben Horowitz", 30), ("1", "VC_FIRM", "Sequoia Capital", 40), ("1", "VC_FIRM", "Sequoia", 50),
        ("1", "ORG", "fbi", 60), ("1", "ORG", "One two three four five six", 61), ("1", "ORG", "Big Co Big Co", 62), ("1", "GPE", "Paris", 70), ("1", "ORG", "Stanford", 71), ("1", "FUNDING_ROUND", "seed funding", 72), ("1", "ORG", "FinTech", 73),
    ]
    return spark.createDataFrame([(d, l, t, s, s + len(t)) for d, l, t, s in rows], "doc_id string, label string, text string, start int, end int")


def test_registry(spark, entities):
    got = {r.text: (r.label, r.uri.removeprefix(NAMESPACE), r.class_uri and r.class_uri.removeprefix(NAMESPACE)) for r in graph.resolve_aliases(graph.registry(entities)).collect()}
    assert got == {
        "Ada": ("ORG", "Ada", "Company"), "Acme": ("ORG", "Acme", "Company"), "Ben Horowitz": ("PERSON", "BenHorowitz", "Person"), "Sequoia Capital": ("VC_FIRM", "SequoiaCapital", "VCFirm"), "Sequoia": ("VC_FIRM", "SequoiaCapital", "VCFirm"),
        "Paris": ("GPE", "Paris", None), "Stanford": ("ORG", "Stanford", "Organization"), "seed funding": ("FUNDING_ROUND", "SeedRound", "FundingRound"), "FinTech": ("SECTOR", "Fintech", "Sector"),
    }


def test_relations(spark, entities):
    said = ["Acme was founded by Ben Horowitz and is based in Paris.", "Sequoia backed Acme in its seed funding.", "Acme is located in Paris.", "Ben Horowitz likes FinTech."]
    sentences = spark.createDataFrame([("1", k, s) for k, s in enumerate(said)], "doc_id string, pos int, sentence string")
    found = graph.present(sentences, entities, graph.resolve_aliases(graph.registry(entities)))
    short = lambda df: sorted((r.s.removeprefix(NAMESPACE), r.p.removeprefix(NAMESPACE), r.o.removeprefix(NAMESPACE)) for r in df.collect())
    assert short(graph.relation_triples(graph.pairs(found))) == [("Acme", "foundedBy", "BenHorowitz"), ("Acme", "hasFundingRound", "SeedRound"), ("SequoiaCapital", "investedIn", "Acme")]
    # a sentence with a single node speaks of no seat
    assert short(graph.seat_triples(found, entities)) == [("Acme", "headquarteredIn", "Paris")]


def test_new_triples_compare_null_safe(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), TRIPLES)
    a, b = ("s", "p", "o", LITERAL, "en", None), ("s", "p", "o", LITERAL, None, None)
    assert [tuple(r) for r in graph.new_triples(t(a, b, b), t(a)).collect()] == [b]


def test_stages_from_documents(spark, tmp_path):
    body = "Sequoia Capital invested early in the software company that would become Acme Widgets. " + " ".join(f"Sequoia Capital also backed enterprise software number {k} of the long list." for k in range(4))
    spark.createDataFrame([("u1", "T", body, len(body), "ok"), ("u2", None, "", None, "error")], RAW_DOCUMENTS).write.json(str(tmp_path / "raw"), ignoreNullFields=False)
    out = stages.documents_to_graph(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    rows = {(r.s.split("#")[-1], r.p.split("#")[-1], r.o.split("#")[-1]) for r in out.collect()}
    assert ("SequoiaCapital", "operatesIn", "EnterpriseSoftware") in rows and ("SequoiaCapital", "type", "VCFirm") in rows
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/graph")).collect())
    assert len(turtle.parse_turtle(text)) == out.count()
    assert spark.read.text(str(tmp_path / "out/entity_counts")).first()[0] == '{"SECTOR":{"enterprise software":4},"VC_FIRM":{"Sequoia Capital":5}}'


#: A small graph with the answers to the seven questions.
GOLDEN = f"""@prefix k: <{NAMESPACE}> . @prefix rdfs: <{RDFS}> .
k:AndreessenHorowitz a k:VCFirm ; rdfs:label "Andreessen Horowitz"@en ; k:investedIn k:Airbnb , k:Netscape .
k:YCombinator a k:VCFirm ; rdfs:label "Y Combinator"@en ; k:foundedBy k:PaulGraham ; k:headquarteredIn "Mountain View"@en , "California"@en ; k:investedIn k:Airbnb .
k:Airbnb a k:Company ; rdfs:label "Airbnb"@en .
k:Netscape a k:Company ; rdfs:label "Netscape"@en ; k:foundedBy k:BenHorowitz ; k:hadExit k:IPO .
k:Opsware a k:Company ; rdfs:label "Opsware"@en ; k:foundedBy k:BenHorowitz .
k:BenHorowitz a k:Person ; rdfs:label "Ben Horowitz"@en ; k:partnerAt k:AndreessenHorowitz .
k:IPO a k:ExitEvent ; rdfs:label "IPO"@en , "initial public offering"@en ; rdfs:label "Börsengang"@de .
"""


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(turtle.parse_turtle(GOLDEN), TRIPLES).cache()


def test_statistics(golden):
    assert {r["class"]: r.n for r in graph.class_counts(golden).collect()} == {"VCFirm": 2, "Company": 3, "Person": 1, "ExitEvent": 1}
    assert [(r.predicate, r.n) for r in graph.predicate_counts(golden, 2).collect()] == [("label", 9), ("type", 7)]
    t = graph.totals(golden).first()
    assert (t.triples, t.entities, t.predicates) == (golden.count(), 12, 7)


def test_schema_summary(golden):
    text = questions.schema_summary(golden)
    assert "PREFIX kg: <" in text and '  kg:IPO  # "initial public offering"' in text and "Börsengang" not in text
    assert text.index("kg:foundedBy") < text.index("rdf:type")


def test_question_loop(golden):
    ask = {"good": f"Sure:\n```sparql\nPREFIX k: <{NAMESPACE}> SELECT ?f ?h WHERE {{ ?f k:foundedBy k:PaulGraham OPTIONAL {{ ?f k:headquarteredIn ?h }} }}\n```", "bad": "SELECT nonsense", "none": f"PREFIX k: <{NAMESPACE}> SELECT ?c ?h {{ ?c k:hadExit k:IPO OPTIONAL {{ ?c k:headquarteredIn ?h }} }}"}
    schema = "schema"
    said = []
    model = lambda replies: lambda text: said.append(text) or replies.pop(0)
    r = questions.answer(golden, schema, "q", model([ask["bad"], ask["good"]]))
    assert r["repairs"] == 1 and r["error"] is None and sorted(x[1] for x in r["rows"]) == ["California", "Mountain View"]
    assert "SELECT nonsense" in said[1]
    assert questions.answer(golden, schema, "q", model([ask["none"]]))["rows"] == [[NAMESPACE + "Netscape", "None"]]
    r = questions.answer(golden, schema, "q", model([ask["bad"]] * 3))
    assert r["repairs"] == 2 and r["error"] and r["rows"] == []
    kinds = [e["type"] for e in questions.events(golden, schema, lambda _: ask["good"], ("a", "b"))]
    assert kinds == ["progress", "result", "progress", "result", "done"]
    assert questions.shown(r).startswith("error")


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "graph")
    folder.mkdir()
    (folder / "a.nt").write_text('<http://a> <http://p> "x"@en .\n<http://a> <http://p> "x"@en .\n<http://a> <http://p> <http://b> .\n')
    ingest.ingest(ingest.read_lines(spark, str(folder)), out, str(tmp_path / "c1"), once=True).awaitTermination()
    (folder / "b.nt").write_text('<http://a> <http://p> "x" .\n<http://a> <http://p> <http://b> .\n')
    for checkpoint in ("c1", "c2"):  # the second starts over and sees all files again
        ingest.ingest(ingest.read_lines(spark, str(folder)), out, str(tmp_path / checkpoint), once=True).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(set(rows)) == 3


