import gzip

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillgraph.schemas import RAW_DOCUMENTS, TRIPLES, XSD
from quillgraph.sources import jsonl, ntriples, pages, tables, turtle

TURTLE = """@prefix : <http://t/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment
:a a :C ; :p :b , :c ; :q "x; y ."@en , 'it''s' ; :n 5 , 2.5 , true .
:b :r [ :p "deep\\n\\"q\\"" ] ; :t "2"^^xsd:integer .
<http://u> :list ( :a "z" ) .
""".replace("'it''s'", "'its'")


def test_turtle():
    rows = turtle.parse_turtle(TURTLE)
    assert ("http://t/a", "http://t/q", "x; y .", "literal", "en", None) in rows
    assert ("http://t/a", "http://t/n", "2.5", "literal", None, XSD + "decimal") in rows
    assert ("http://t/b", "http://t/t", "2", "literal", None, XSD + "integer") in rows
    assert any(r[1] == "http://t/p" and r[2] == 'deep\n"q"' and r[0].startswith("_:") for r in rows)
    assert len(rows) == 16


def test_committed_graphs(spark):
    """Counts of graphs that are in the repository's fixtures elsewhere are checked where those files are."""
    rows = turtle.parse_turtle("@prefix x: <http://x#> . x:s x:p x:o , x:o .")
    assert len(rows) == 1


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame(turtle.parse_turtle(TURTLE) + [("http://t/z", "http://t/p", 'back\\slash "q" \t tab\nline é <&>', "literal", None, None)], TRIPLES)
    want = sorted(df.collect(), key=str)
    ntriples.write(df, str(tmp_path / "nt"))
    assert sorted(ntriples.read(spark, str(tmp_path / "nt")).collect(), key=str) == want
    named = df.where("not s like '_:%' and o_kind <> 'bnode'")
    turtle.write(named.coalesce(1), str(tmp_path / "ttl"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "ttl")).collect())
    assert sorted(turtle.parse_turtle(text), key=str) == sorted(map(tuple, named.collect()), key=str)
    turtle.write_rdfxml(named, str(tmp_path / "xml"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "xml"), wholetext=True).collect())
    assert sorted(turtle.parse_rdfxml(text), key=str) == sorted(map(tuple, named.collect()), key=str)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Co"), blacklist_characters="\x00"), max_size=30))
def test_turtle_strings(text):
    quoted = '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'
    assert turtle.parse_turtle(f"<http://a> <http://b> {quoted} .")[0][2] == text


def test_rdfxml():
    text = """<?xml version="1.0"?><!DOCTYPE rdf:RDF [<!ENTITY o "http://o#">]>
    <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://f#" xml:base="http://f">
    <Person rdf:ID="Ann"><age rdf:datatype="&o;int">70</age><knows rdf:resource="#Bob"/><knows><Person rdf:about="#Cy"/></knows></Person>
    </rdf:RDF>"""
    rows = turtle.parse_rdfxml(text)
    assert ("http://f#Ann", "http://f#age", "70", "literal", None, "http://o#int") in rows
    assert ("http://f#Ann", "http://f#knows", "http://f#Cy", "uri", None, None) in rows
    assert len(rows) == 5


def test_all_files_of_a_folder(spark, tmp_path):
    """Turtle and RDF/XML side by side; equal names of blank nodes in two files are two nodes, in parts of one graph they are one."""
    (tmp_path / "a.ttl").write_text("<http://a> <http://p> _:x . _:x <http://q> 1 .")
    (tmp_path / "b.ttl").write_text("<http://b> <http://p> _:x .")
    (tmp_path / "c.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:f="http://f#"><rdf:Description rdf:about="http://c"><f:p>text</f:p></rdf:Description></rdf:RDF>')
    rows = turtle.read(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {r.s for r in rows if r.s[:2] != "_:"} == {"http://a", "http://b", "http://c"}
    ends = {r.s: r.o for r in rows if r.p == "http://p"}
    assert ends["http://a"] != ends["http://b"] and {r.s for r in rows if r.p == "http://q"} == {ends["http://a"]}
    one = turtle.read(spark, str(tmp_path / "a.ttl")).collect()
    assert {r.o for r in one if r.p == "http://p"} == {"_:x"}
    parts = spark.createDataFrame([(f"http://s{k}", "http://p", "_:x", "bnode", None, None) for k in range(40)], TRIPLES)
    turtle.write(parts.repartition(3), str(tmp_path / "parts.ttl"))
    back = turtle.read(spark, str(tmp_path / "parts.ttl")).collect()
    assert len(back) == 40 and {r.o for r in back} == {"_:x"}


def test_statements_are_read_one_at_a_time(spark, tmp_path, monkeypatch):
    """No file is held as triples; plain statements and those of the grammar take turns; a triple of two files is one; files hold so many subjects."""
    rows = turtle._Turtle('<http://a> <http://p> "x. ;,"@EN , "q\\"" ; a <http://c> . @prefix x: <http://x#> . x:s x:p 1 . <http://b> <http://p> <http://o>. <http://a> broken').statements()
    assert [next(rows)[2] for _ in range(5)] == ["x. ;,", 'q"', "http://c", "1", "http://o"]
    with pytest.raises(turtle.SparqlError):
        next(rows)
    monkeypatch.setattr(turtle, "SUBJECTS", 3)
    df = spark.createDataFrame([(f"http://s{k}", "http://p", f"http://o{j}", "uri", None, None) for k in range(10) for j in range(2)], TRIPLES)
    turtle.write(df.unionByName(df).repartition(2), str(tmp_path / "parts.ttl"), "gzip")
    files = list((tmp_path / "parts.ttl").glob("part-*.gz"))
    assert len(files) >= 4 and sorted(turtle.read(spark, str(tmp_path / "parts.ttl")).collect()) == sorted(df.collect())
    for name in "ab":
        (tmp_path / f"{name}.ttl").write_text("<http://a> <http://p> <http://o> .")
    assert turtle.read(spark, str(tmp_path / "*.ttl")).where("s = 'http://a'").count() == 1


def test_json_documents(spark, tmp_path):
    """Counts as one object, label to text to number; keys are quoted as JSON wants it."""
    rows = [("A", 'say "hi"', 3), ("A", "b", 1), ("B\\", "é", 2)]
    jsonl.write_counts(spark.createDataFrame(rows, "label string, text string, n long"), str(tmp_path / "counts"))
    found = jsonl.read_document(spark, str(tmp_path / "counts"), "A map<string,long>, `B\\` map<string,long>").first()
    assert found["A"] == {'say "hi"': 3, "b": 1} and found["B\\"] == {"é": 2}


def test_lines_labels_and_tsv(spark, tmp_path):
    lines = ['<http://a> <http://www.w3.org/2000/01/rdf-schema#label> "Two words"@en .', '<http://b> <http://www.w3.org/2000/01/rdf-schema#label> "Deux"@fr .', "# no", "", "broken", '_:b <http://p> <http://o> .']
    (tmp_path / "x.nt").write_text("\n".join(lines))
    assert [tuple(r) for r in ntriples.read_labels(spark, str(tmp_path / "x.nt")).collect()] == [("http://a", "Two words")]
    assert ntriples.read(spark, str(tmp_path / "x.nt")).count() == 3
    (tmp_path / "t.txt").write_text("a\tb\tc\nbad\tline\nd\te\tf\n")
    assert ntriples.read_tsv(spark, str(tmp_path / "t.txt")).count() == 2
    with gzip.open(tmp_path / "ids.tsv.gz", "wt") as f:
        f.write("id\turi\n0\thttp://a\n1\thttp://b\n")
    assert [tuple(r) for r in ntriples.read_dictionary(spark, str(tmp_path / "ids.tsv.gz")).collect()] == [(0, "http://a"), (1, "http://b")]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("u", "Tité", "text", 4, "ok"), ("v", None, "", None, "error")], RAW_DOCUMENTS)
    jsonl.write_lines(df, str(tmp_path / "j"))
    assert sorted(jsonl.read_lines(spark, str(tmp_path / "j"), RAW_DOCUMENTS).collect()) == sorted(df.collect())
    jsonl.write_counts(spark.createDataFrame([("ORG", "a", 2), ("ORG", "b", 1), ("GPE", "c", 3)], "label string, text string, n long"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first()[0] == '{"GPE":{"c":3},"ORG":{"a":2,"b":1}}'


def test_pages(spark):
    html = "<html><head><title> A &amp; B </title></head><body><nav>menu</nav><p>Hello <b>world</b></p><script>x</script><table><tr><td>1</td></tr></table></body></html>"
    df = spark.createDataFrame([("https://h.org/x", html), ("https://h.org/y", None)], "url string, html string")
    got = {r.url: r for r in pages.raw_documents(df).collect()}
    assert (got["https://h.org/x"].text, got["https://h.org/x"].char_count, got["https://h.org/y"].status) == ("Hello world", 11, "error")


def test_crawl(spark):
    def fetch(url):
        if url.endswith("robots.txt"):
            return "User-agent: *\nDisallow: /private"
        if url.endswith("gone"):
            raise LookupError
        if url.endswith("bad"):
            raise OSError
        return "<title>T</title><p>text</p>"

    df = spark.createDataFrame([(f"https://a.org/{x}",) for x in ("ok", "gone", "bad", "private")], "url string")
    got = {r.url[-3:]: r.status for r in pages.crawl(df, fetch, pause=0).collect()}
    assert got == {"/ok": "ok", "one": "http_error", "bad": "error", "ate": "blocked_by_robots"}


def test_cache(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    make = lambda: made.append(1) or spark.range(3)
    assert tables.cached(spark, path, make).count() == tables.cached(spark, path, make).count() == 3
    assert made == [1]
