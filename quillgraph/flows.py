"""Queries over sources and sinks, whole runs, and what goes on around a model; they join those of the catalog."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import bridge
from quillgraph.catalog import CAPS, CLEAN, EDGES, LINKS, NAMED, TRIPLES, _ALIGNED, _clean, _part_mentions, _scored, _space, query, t
from quillgraph.functions import vocabulary
from quillgraph.operators import alignment, cleaning, embeddings, expansion, graph, mentions, rules
from quillgraph.operators import training_set as ts
from quillgraph.plans import questions
from quillgraph.schemas import NAMESPACE as NS
from quillgraph.schemas import OWL, RDF, RDFS, SKOS, WD, WDT, XSD
from quillgraph.schemas import TRIPLES as SCHEMA
from quillgraph.session import shared_folder, written
from quillgraph.sources import jsonl, ntriples, pages, remote, tables, turtle
from quillgraph.streaming import ingest


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------------------


@query("jsonl_round_trip", "SELECT doc_id, lang, source, md5(text) AS digest, n_chars::BIGINT AS n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Whole documents as JSON lines and back."""
    path = _place(spark, "jsonl")
    jsonl.write_lines(t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", "n_chars"), path)
    found = jsonl.read_lines(spark, path, "doc_id long, lang string, source string, text string, n_chars long")
    return found.select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("digest"), "n_chars")


_KINDS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")


@query("json_document", "SELECT c_mktsegment AS label, 'Nation' || c_nationkey AS text, count(*) AS n FROM customer GROUP BY ALL")
def json_document(spark, sf_dir):
    """Counts as one JSON object, label to text to number, and back."""
    path, names = _place(spark, "counts"), _KINDS
    counted = t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("label"), F.concat(F.lit("Nation"), F.col("c_nationkey").cast("string")).alias("text")).agg(F.count("*").alias("n"))
    jsonl.write_counts(counted, path)
    whole = jsonl.read_document(spark, path, ", ".join(f"`{k}` map<string,long>" for k in names))
    rows = whole.select(F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"`{k}`").alias("m")) for k in names))).alias("x"))
    return rows.select("x.label", F.explode("x.m").alias("text", "n"))


@query("turtle_round_trip", f"WITH {TRIPLES} SELECT p, k AS o_kind, count(DISTINCT s || '|' || o) AS n FROM triples GROUP BY ALL")
def turtle_round_trip(spark, sf_dir):
    """The whole graph written as Turtle and read again, file by file."""
    path = _place(spark, "graph") + ".ttl"
    turtle.write(bridge.triples(spark, sf_dir), path, "gzip")
    return turtle.read(spark, path).groupBy("p", "o_kind").agg(F.count("*").alias("n"))


@query("rdfxml_round_trip", f"SELECT '{NS}Nation' || n_nationkey AS s, n_name AS label, '{NS}Region' || n_regionkey AS region FROM nation")
def rdfxml_round_trip(spark, sf_dir):
    """The nations' triples as one RDF/XML document and back."""
    path = _place(spark, "nations") + ".rdf"
    nation = t(spark, sf_dir, "nation").select(bridge.uri("Nation", "n_nationkey").alias("s"), "n_name", bridge.uri("Region", "n_regionkey").alias("r"))
    null = F.lit(None).cast("string")
    labels = nation.select("s", F.lit(RDFS + "label").alias("p"), F.col("n_name").alias("o"), F.lit("literal").alias("o_kind"), F.lit("en").alias("o_lang"), null.alias("o_dtype"))
    links = nation.select("s", F.lit(NS + "inRegion").alias("p"), F.col("r").alias("o"), F.lit("uri").alias("o_kind"), null.alias("o_lang"), null.alias("o_dtype"))
    turtle.write_rdfxml(labels.unionByName(links), path)
    g = turtle.read(spark, path)
    return g.groupBy("s").agg(F.max(F.when(F.col("o_lang") == "en", F.col("o"))).alias("label"), F.max(F.when(F.col("p") == NS + "inRegion", F.col("o"))).alias("region"))


@query("label_scan", f"WITH {NAMED} SELECT s AS uri, label FROM named")
def label_scan(spark, sf_dir):
    """English labels of an N-Triples file of the whole graph."""
    path = _place(spark, "labels") + ".nt"
    ntriples.write(bridge.triples(spark, sf_dir), path)
    return ntriples.read_labels(spark, path)


@query("tsv_round_trip", f"WITH {EDGES} SELECT s, p, o FROM edges")
def tsv_round_trip(spark, sf_dir):
    path = _place(spark, "edges") + ".tsv"
    ntriples.write_tsv(bridge.edges(spark, sf_dir), path)
    return ntriples.read_tsv(spark, path)


@query("dictionary_round_trip", f"WITH {EDGES} SELECT row_number() OVER (ORDER BY uri) - 1 AS id, uri FROM (SELECT s AS uri FROM edges UNION SELECT o FROM edges)")
def dictionary_round_trip(spark, sf_dir):
    """Ids of all entities, written with a header and gzip, and read again."""
    path = _place(spark, "ids") + ".tsv"
    ntriples.write_tsv(ts.entity_ids(bridge.edges(spark, sf_dir)), path, header=True, compression="gzip")
    return ntriples.read_dictionary(spark, path)


def _site(url: str) -> str:
    """A stand-in for the web: what a site answers depends on the address alone."""
    if url.endswith("/robots.txt"):
        return "User-agent: *\nDisallow: /" if "1" in url.split("/")[2] else ""
    if url.endswith("3"):
        raise LookupError(url)
    if url.endswith("4"):
        raise OSError(url)
    return f"<html><head><title> Page {url} </title></head><body><nav>menu</nav><p>Text of {url}</p></body></html>"


@query(
    "crawl_pages",
    """WITH u AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL), x AS (SELECT url, CASE WHEN contains(split_part(url, '/', 3), '1') THEN 'blocked_by_robots' WHEN url LIKE '%3' THEN 'http_error' WHEN url LIKE '%4' THEN 'error' ELSE 'ok' END AS status FROM u)
    SELECT url, status, CASE WHEN status = 'ok' THEN 'Page ' || url END AS title, CASE WHEN status = 'ok' THEN 'Text of ' || url ELSE '' END AS text, CASE WHEN status = 'ok' THEN length('Text of ' || url)::INT ELSE 0 END AS char_count FROM x""",
)
def crawl_pages(spark, sf_dir):
    """All addresses, fetched by the rules of their sites."""
    urls = t(spark, sf_dir, "pages").select("url").where("url is not null").distinct()
    return pages.crawl(urls, _site, pause=0.0).select("url", "status", "title", "text", F.coalesce("char_count", F.lit(0)).alias("char_count"))


_DROPPED = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "table", "head")


def _main_sql() -> str:
    text = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in _DROPPED:
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')):
        text = f"replace({text}, '{entity}', '{sign}')"
    return rf"trim(regexp_replace({text}, '[\x09-\x0D\x1C-\x20]+', ' ', 'g'))"


@query("main_text", f"SELECT page_id, url, {_main_sql()} AS text FROM pages")
def main_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", "url", pages.main_text(F.col("html")).alias("text"))


@query("cached_table", f"WITH {EDGES} SELECT p, count(*) AS n, 1 AS made FROM edges GROUP BY p")
def cached_table(spark, sf_dir):
    """A table that is asked for three times is made once."""
    path, made = _place(spark, "cached"), []

    def make():
        made.append(1)
        return ts.relation_histogram(bridge.edges(spark, sf_dir))

    for _ in range(3):
        found = tables.cached(spark, path, make)
    return found.select(F.col("relation").alias("p"), "n", F.lit(len(made)).alias("made"))


@query("filled_labels", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS label FROM part")
def filled_labels(spark, sf_dir):
    """Labels that are missing come from a second table."""
    part = t(spark, sf_dir, "part").withColumn("uri", F.concat(F.lit(NS), F.col("p_partkey").cast("string")))
    rows = part.select("p_partkey", "uri", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("label"))
    return tables.filled(rows, part.select("uri", F.col("p_brand").alias("label"))).select("p_partkey", "label")


@query("stream_ingest", f"WITH {EDGES} SELECT s, p, o FROM edges")
def stream_ingest(spark, sf_dir):
    """Triples as JSON lines that arrive in two lots, the second with repeats; the graph stays a set."""
    place = _place(spark, "stream")
    g = bridge.triples(spark, sf_dir).where(F.col("o_kind") == "uri").where(F.col("p") != RDF + "type")
    for lot in (g.where(F.xxhash64("s", "p", "o") % 2 == 0), g):
        lot.write.mode("append").json(f"{place}/in")
        ingest.ingest(ingest.read_json(spark, f"{place}/in"), f"{place}/graph", f"{place}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{place}/graph").select("s", "p", "o")


@query("stream_lines", f"WITH {TRIPLES} SELECT p, k AS o_kind, count(DISTINCT s || '|' || o) AS n FROM triples GROUP BY ALL")
def stream_lines(spark, sf_dir):
    """The same from N-Triples files, literals included."""
    place = _place(spark, "stream")
    ntriples.write(bridge.triples(spark, sf_dir), f"{place}/in")
    ingest.ingest(ingest.read_lines(spark, f"{place}/in"), f"{place}/graph", f"{place}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{place}/graph").groupBy("p", "o_kind").agg(F.count("*").alias("n"))


def _service(address: str, body: bytes | None = None) -> bytes:
    """A stand-in for a search service and a SPARQL endpoint: what it answers depends on the request alone."""
    asked = parse_qs((body or urlparse(address).query.encode()).decode())
    if "search" in asked:
        label = asked["search"][0]
        if label.endswith("n"):
            raise OSError(label)
        return json.dumps({"search": [{"id": f"Q{len(label)}", "label": label.upper(), "description": "first"}, {"id": "Q1", "label": label}]}).encode()
    uris = re.findall(r"<([^>]*#[^>]*)>", asked["query"][0].split(RDFS)[0])
    if "VALUES" in asked["query"][0]:
        rows = [{"s": {"type": "uri", "value": u}, "l": {"type": "literal", "xml:lang": "en", "value": "label of " + u.split("#")[1]}} for u in uris if not u.endswith("7")]
    else:
        rows = [{"p": {"type": "uri", "value": NS + "same"}, "o": {"type": "uri", "value": uris[0]}}, {"p": {"type": "uri", "value": RDFS + "label"}, "o": {"type": "literal", "xml:lang": "en", "value": uris[0].split("#")[1]}}]
    return json.dumps({"results": {"bindings": rows}}).encode()


@query(
    "searched_candidates",
    """WITH n AS (SELECT DISTINCT p_name AS label FROM part WHERE p_name NOT LIKE '%n')
    SELECT label, 1 AS rank, 'Q' || length(label) AS qid, upper(label) AS wd_label, 'first' AS wd_desc FROM n UNION ALL SELECT label, 2, 'Q1', label, NULL FROM n""",
)
def searched_candidates(spark, sf_dir):
    """Part names looked up at a service that fails for some of them."""
    return remote.search(t(spark, sf_dir, "part").select(F.col("p_name").alias("label")), "http://example.org/search", _service)


@query("remote_claims", f"SELECT '{NS}Nation' || n_nationkey AS s, '{NS}same' AS p, '{NS}Nation' || n_nationkey AS o, NULL AS o_lang FROM nation UNION ALL SELECT '{NS}Nation' || n_nationkey, '{RDFS}label', 'Nation' || n_nationkey, 'en' FROM nation")
def remote_claims(spark, sf_dir):
    """What an endpoint knows of the nations, as triples."""
    seeds = t(spark, sf_dir, "nation").select(bridge.uri("Nation", "n_nationkey").alias("uri"))
    return remote.claims(seeds, "http://example.org/sparql", 10, _service).select("s", "p", "o", "o_lang")


@query("remote_labels", f"SELECT '{NS}Customer' || c_custkey AS uri, 'label of Customer' || c_custkey AS label FROM customer WHERE c_custkey % 10 <> 7")
def remote_labels(spark, sf_dir):
    """Labels of all customers, fifty in a request; some have none."""
    return remote.labels(t(spark, sf_dir, "customer").select(bridge.uri("Customer", "c_custkey").alias("uri")), "http://example.org/sparql", _service)


# --- documents, mentions, graph ---------------------------------------------------------------------


@query("clean_corpus", f"WITH {CLEAN} SELECT c.doc_id::VARCHAR AS url, d.lang AS title, n::INT AS sentence_count, clean_chars::INT AS clean_chars FROM clean c JOIN documents d ON c.doc_id = d.doc_id WHERE d.doc_id % 7 <> 0 AND length(d.text) > 0")
def clean_corpus(spark, sf_dir):
    """Raw documents, every seventh of them one that could not be fetched."""
    status = F.when(F.col("doc_id") % 7 == 0, "error").otherwise("ok")
    raw = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("lang").alias("title"), "text", F.length("text").alias("char_count"), status.alias("status"))
    return cleaning.clean_corpus(raw).select("url", "title", "sentence_count", F.length("clean_text").alias("clean_chars"))


def _tagger(text: str) -> list[tuple[str, str, int, int]]:
    """Capitalised phrases, organisations if their length is even, else a label that is not wanted."""
    plain = re.sub(r"[^\x00-\x7F]", "_", text)
    return [(m[0], "DATE" if len(m[0]) % 2 else "ORG", m.start(), m.end()) for m in re.finditer(mentions.CAPITALISED, plain)]


@query("tagged_mentions", f"WITH {CAPS} SELECT doc_id, 'ORG' AS label, text, count(*) AS n FROM caps WHERE length(text) % 2 = 0 GROUP BY ALL")
def tagged_mentions(spark, sf_dir):
    """A tagger that is passed in; labels that are not wanted go."""
    found = mentions.tagged_mentions(t(spark, sf_dir, "documents"), _tagger)
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").agg(F.count("*").alias("n"))


@query("applied_forms", "SELECT label, text, count(*) AS n FROM (SELECT 'VC_FIRM' AS label, upper(p_name) AS text FROM part UNION ALL SELECT 'VC_FIRM', split_part(p_name, ' ', 1) FROM part UNION ALL SELECT 'ORG', p_brand FROM part UNION ALL SELECT 'PERSON', split_part(p_name, ' ', 1) FROM part) GROUP BY ALL")
def applied_forms(spark, sf_dir):
    """A map of forms applied to mentions: the firms' full names in capitals; forms without an entry stay."""
    forms = t(spark, sf_dir, "part").select(F.lit("VC_FIRM").alias("label"), F.col("p_name").alias("text"), F.upper("p_name").alias("canonical")).distinct()
    return mentions.applied(_part_mentions(spark, sf_dir), forms).groupBy("label", "text").agg(F.count("*").alias("n"))


@query("header_triples", f"SELECT * FROM (VALUES ('http://example.org/graph', '{RDF}type', '{OWL}Ontology'), ('http://example.org/graph', '{OWL}imports', 'http://example.org/ontology')) AS v(s, p, o)")
def header_triples(spark, sf_dir):
    return graph.header_triples(spark).select("s", "p", "o")


# --- alignment and expansion -----------------------------------------------------------------------------


@query("one_text_per_uri", f"SELECT '{NS}' || p_brand AS uri, arg_min(p_name, {{'a': -length(p_name), 'b': p_name}}) AS text FROM part GROUP BY 1")
def one_text_per_uri(spark, sf_dir):
    part = t(spark, sf_dir, "part").select(F.concat(F.lit(NS), "p_brand").alias("uri"), F.col("p_name").alias("text"), F.lit("ORG").alias("label"), F.lit(NS + "Company").alias("class_uri"))
    return alignment.one_text_per_uri(part).select("uri", "text")


def _linked(spark, sf_dir, forced: dict[str, str]) -> DataFrame:
    """Links of the part names: each with the candidate of its first part; every fourth part's name has none."""
    one = _scored(spark, sf_dir).groupBy("text").agg(F.min_by(F.struct("label", "wd_label", "wd_desc", "p_partkey"), "p_partkey").alias("b")).select("text", "b.*")
    entries = one.select("text", "label", F.concat(F.lit(NS), F.col("p_partkey").cast("string")).alias("uri"), F.lit(NS + "Company").alias("class_uri"))
    found = one.where("p_partkey % 4 <> 0").select(F.col("text").alias("label"), F.lit(1).alias("rank"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), "wd_label", "wd_desc")
    return alignment.link(entries, found, forced)


ONE = f"""{LINKS}, first AS (SELECT text, arg_min({{'wd': wd_label, 'c': c, 'k': p_partkey}}, p_partkey) AS b FROM base GROUP BY text),
one AS (SELECT text, '{NS}' || b.k AS uri, CASE WHEN b.k % 4 <> 0 THEN 'Q' || b.k END AS qid, CASE WHEN b.k % 4 <> 0 THEN b.wd END AS wd, CASE WHEN b.k % 4 <> 0 THEN b.c END AS c FROM first),
decided AS (SELECT *, CASE WHEN c >= 0.85 THEN 'sameAs' WHEN c >= 0.7 THEN 'closeMatch' ELSE 'local' END AS decision, regexp_replace(regexp_replace(c::DECIMAL(4,3)::VARCHAR, '0+$', ''), '\\.$', '.0') AS score FROM one)"""
LINKED = f"""{ONE}, linked AS (
  SELECT uri AS s, '{NS}alignmentConfidence' AS p, score AS o FROM decided WHERE qid IS NOT NULL
  UNION SELECT uri, '{NS}wikidataId', qid FROM decided WHERE qid IS NOT NULL
  UNION SELECT uri, CASE decision WHEN 'sameAs' THEN '{OWL}sameAs' ELSE '{SKOS}closeMatch' END, '{WD}' || qid FROM decided WHERE decision <> 'local'
  UNION SELECT uri, '{RDF}type', '{NS}Company' FROM decided WHERE decision = 'local'
  UNION SELECT uri, '{RDFS}label', text FROM decided WHERE decision = 'local'
  UNION SELECT uri, '{RDFS}comment', 'Locally defined entity: no alignment (' || CASE WHEN qid IS NULL THEN 'no candidates returned' ELSE 'best candidate ' || qid || ' ''' || wd || ''' had low confidence (' || score || ')' END || ').' FROM decided WHERE decision = 'local')"""


@query("link_triples", f"WITH {LINKED} SELECT s, p, o FROM linked")
def link_triples(spark, sf_dir):
    """What alignment says of every entity: score, id and match, or a definition of its own."""
    return alignment.link_triples(_linked(spark, sf_dir, {})).select("s", "p", "o")


@query("forced_links", f"WITH {ONE} SELECT uri, CASE WHEN text LIKE '%a' THEN 'Q1' ELSE qid END AS qid, CASE WHEN text LIKE '%a' THEN 'sameAs' ELSE decision END AS decision FROM decided")
def forced_links(spark, sf_dir):
    """Some texts have a fixed id and skip the search."""
    names = [r.p_name for r in t(spark, sf_dir, "part").select("p_name").where("p_name like '%a'").distinct().limit(1000).collect()]
    return _linked(spark, sf_dir, dict.fromkeys(names, "Q1")).select("uri", "qid", "decision")


@query(
    "alignment_build",
    f"""WITH {LINKED}, fixed(name, pid, rel) AS (VALUES {", ".join(f"('{n}', {f"'{pid}'" if pid else 'NULL'}, {f"'{rel}'" if rel else 'NULL'})" for n, _, _, pid, rel in vocabulary.PREDICATES)}),
    every AS (SELECT s, p, o FROM linked UNION ALL SELECT '{NS}' || name, '{RDF}type', '{OWL}ObjectProperty' FROM fixed UNION ALL SELECT '{NS}' || name, CASE rel WHEN 'closeMatch' THEN '{SKOS}closeMatch' ELSE '{OWL}equivalentProperty' END, '{WDT}' || pid FROM fixed WHERE pid IS NOT NULL
      UNION ALL SELECT '{NS}' || name, '{RDFS}comment', coalesce('Manually aligned to wdt:' || pid || ' after reviewing candidates []. Support: WARNING: found by neither search.', 'Local-only property: no equivalent exists.') FROM fixed)
    SELECT s, p, o FROM every""",
)
def alignment_build(spark, sf_dir):
    """The whole alignment graph: entities, and the fixed predicates, for which this vocabulary has no support."""
    one = _scored(spark, sf_dir).groupBy("text").agg(F.min_by(F.struct("label", "wd_label", "wd_desc", "p_partkey"), "p_partkey").alias("b")).select("text", "b.*")
    entries = one.select("text", "label", F.concat(F.lit(NS), F.col("p_partkey").cast("string")).alias("uri"), F.lit(NS + "Company").alias("class_uri"))
    found = one.where("p_partkey % 4 <> 0").select(F.col("text").alias("label"), F.lit(1).alias("rank"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), "wd_label", "wd_desc")
    properties = spark.createDataFrame([("placedBy", "order placed", "en", "placedBy")], "pid string, label string, lang string, direct string")
    return alignment.build(spark, entries, found, bridge.edges(spark, sf_dir), properties).select("s", "p", "o")


@query("typed_literals", "SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'en' END AS lang, CASE WHEN p_size % 3 <> 1 AND p_size % 2 = 0 THEN 'decimal' END AS dtype FROM part")
def typed_literals(spark, sf_dir):
    """A language wins over a datatype; empty ones are none."""
    size = F.col("p_size") % 3
    lang = F.when(size == 0, "").when(size == 1, "en")
    dtype = F.when(F.col("p_size") % 2 == 0, "decimal").otherwise("")
    made = expansion.literal(lang, dtype)
    return t(spark, sf_dir, "part").select("p_partkey", made[0].alias("lang"), made[1].alias("dtype"))


@query("aligned_ids", f"SELECT '{WD}Q' || c_custkey AS uri, 'Q' || c_custkey AS id FROM customer")
def aligned_ids(spark, sf_dir):
    """What customers are the same as elsewhere, beside links that don't count."""
    null = F.lit(None).cast("string")
    same = t(spark, sf_dir, "customer").select(bridge.uri("Customer", "c_custkey").alias("s"), F.lit(OWL + "sameAs").alias("p"), F.explode(F.array(F.concat(F.lit(WD + "Q"), F.col("c_custkey").cast("string")), F.lit("http://elsewhere.org/x"))).alias("o"), F.lit("uri").alias("o_kind"), null.alias("o_lang"), null.alias("o_dtype"))
    return expansion.aligned(bridge.triples(spark, sf_dir).unionByName(same))


@query("of_types", f"SELECT '{NS}Supplier' || s_suppkey AS uri FROM supplier UNION ALL SELECT '{NS}Nation' || n_nationkey FROM nation")
def of_types(spark, sf_dir):
    base = bridge.triples(spark, sf_dir)
    return expansion.of_types(base.select(F.col("s").alias("uri")).distinct(), base, RDF + "type", (NS + "Supplier", NS + "Nation"))


@query(
    "expand_aligned",
    f"""WITH {TRIPLES}, ok AS (SELECT s, p, o, k FROM triples WHERE p IN ('{NS}inNation', '{NS}inRegion')), start AS (SELECT '{NS}own' AS s, '{OWL}sameAs' AS p, '{NS}Supplier1' AS o, 'uri' AS k),
    g0 AS (SELECT * FROM start UNION SELECT s, p, o, k FROM triples WHERE s = '{NS}Supplier1' AND p IN ('{NS}inNation', '{RDFS}label')),
    n0 AS (SELECT s AS n FROM g0 UNION SELECT o FROM g0 WHERE k = 'uri'),
    g1 AS (SELECT * FROM g0 UNION SELECT * FROM ok WHERE s IN (SELECT n FROM n0)),
    n1 AS (SELECT s AS n FROM g1 UNION SELECT o FROM g1 WHERE k = 'uri'),
    i AS (SELECT * FROM ok WHERE p = '{NS}inRegion' AND o IN (SELECT n FROM n1)),
    g2 AS (SELECT * FROM g1 UNION SELECT * FROM i),
    g3 AS (SELECT * FROM g2 UNION SELECT * FROM ok WHERE s IN (SELECT s FROM i) UNION SELECT s, p, o, k FROM triples WHERE p = '{RDFS}label' AND s IN (SELECT s FROM i))
    SELECT s, p, o FROM g3""",
)
def expand_aligned(spark, sf_dir):
    """Growth from a node of the graph's own that is the same as one of the base: the phase of aligned entities has work."""
    plan = expansion.Plan(anchors=(f"{NS}none",), allowed=(NS + "inNation", NS + "inRegion"), incoming=((NS + "inRegion", 1000),), part=NS, direct=NS)
    start = spark.createDataFrame([(NS + "own", OWL + "sameAs", NS + "Supplier1", "uri", None, None)], SCHEMA)
    return expansion.expand(start, bridge.triples(spark, sf_dir), plan)[0].select("s", "p", "o")


# --- training set and vectors -------------------------------------------------------------------------------


@query("pooled", f"WITH {EDGES} SELECT p, 2 * count(*) AS n FROM edges GROUP BY p")
def pooled(spark, sf_dir):
    """All splits put together, and the whole once more: repeats stay."""
    x = bridge.edges(spark, sf_dir)
    rows = written(ts.split(x), "pooled")
    parts = [rows.where(f"split = '{name}'") for name in ("train", "valid", "test")]
    return ts.pool(*parts, x).groupBy("p").agg(F.count("*").alias("n"))


@query("size_grid", f"WITH {EDGES}, n AS (SELECT count(*) AS n FROM edges) SELECT label, least(size, n) AS size FROM (VALUES ('1k', 1000), ('2500', 2500), ('full', 9223372036854775807)) v(label, size), n WHERE size < n OR label = 'full'")
def size_grid(spark, sf_dir):
    return spark.createDataFrame(ts.size_grid(bridge.edges(spark, sf_dir).count(), (2500, 1000)), "label string, size long")


@query("first_available", "SELECT 'Nation' || n_nationkey AS name, (SELECT min(vec_id) FROM embeddings WHERE vec_id >= n_nationkey * 5) AS id FROM nation WHERE n_nationkey * 5 <= (SELECT max(vec_id) FROM embeddings)")
def first_available(spark, sf_dir):
    """Each nation's candidates are the vectors from five times its key on, in order."""
    ids = t(spark, sf_dir, "embeddings").select(F.concat(F.lit(NS), F.col("vec_id").cast("string")).alias("uri"), F.col("vec_id").alias("id"))
    nations = t(spark, sf_dir, "nation").select(F.concat(F.lit("Nation"), F.col("n_nationkey").cast("string")).alias("name"), (F.col("n_nationkey") * 5).alias("low"))
    tried = nations.select("name", F.explode(F.sequence(F.col("low"), F.col("low") + 9)).alias("place"))
    return embeddings.first_available(tried.select("name", "place", F.concat(F.lit(NS), F.col("place").cast("string")).alias("uri")), ids).select("name", "id")


@query("labels_of", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Q' || p_partkey END AS label, p_size % 2 = 1 AS plain FROM part")
def labels_of(spark, sf_dir):
    """A label, or the address's last part; and whether that is a bare id."""
    uri, label = F.concat(F.lit(WD + "Q"), F.col("p_partkey").cast("string")), F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
    shown = embeddings.label_of(uri, label)
    return t(spark, sf_dir, "part").select("p_partkey", shown.alias("label"), embeddings.is_plain_id(shown).alias("plain"))


@query("embedding_access", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding) AS width FROM embeddings")
def embedding_access(spark, sf_dir):
    """A model's vectors from its written table, by name."""
    path = _place(spark, "model")
    e, _, _ = _space(spark, sf_dir)
    e.write.parquet(f"{path}/entities")
    found = spark.read.parquet(f"{path}/entities")
    return found.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("v").cast("long").alias("width"))


# --- rules ---------------------------------------------------------------------------------------------------


@query("disjoint_members", f"SELECT '{NS}Customer' || c_custkey AS node FROM customer WHERE c_custkey % 10 = 0")
def disjoint_members(spark, sf_dir):
    """Members of two classes that exclude each other: every tenth customer is called a supplier, too."""
    null = F.lit(None).cast("string")
    odd = t(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(bridge.uri("Customer", "c_custkey").alias("s"), F.lit(RDF + "type").alias("p"), F.lit(NS + "Supplier").alias("o"), F.lit("uri").alias("o_kind"), null.alias("o_lang"), null.alias("o_dtype"))
    onto = spark.createDataFrame([(NS + "Customer", OWL + "disjointWith", NS + "Supplier", "uri", None, None)], SCHEMA)
    return rules.inconsistencies(bridge.triples(spark, sf_dir).unionByName(odd).unionByName(onto)).select("node")


@query("individuals", f"WITH {NAMED} SELECT regexp_replace(s, '^.*#', '') AS name, CAST(CAST(balance AS DECIMAL(18,2)) AS DOUBLE) AS value, c = '{NS}Supplier' AS member FROM named")
def individuals(spark, sf_dir):
    found = rules.individuals(bridge.triples(spark, sf_dir), NS + "balance", NS + "Supplier")
    return found.select("name", F.col("value").cast("double").alias("value"), "member")


@query("without_predicate", f"WITH {TRIPLES} SELECT p, count(*) AS n FROM triples WHERE p <> '{RDFS}label' GROUP BY p")
def without_predicate(spark, sf_dir):
    return rules.without_predicate(bridge.triples(spark, sf_dir), RDFS + "label").groupBy("p").agg(F.count("*").alias("n"))


@query("declared_subclass", f"WITH {NAMED} SELECT s FROM named WHERE c = '{NS}Supplier'")
def declared_subclass(spark, sf_dir):
    """A class declared under another takes its members along: all suppliers are dealers."""
    g = bridge.triples(spark, sf_dir).where(F.col("p") == RDF + "type").unionByName(rules.subclass(spark, NS + "Supplier", NS + "Dealer"))
    return rules.entailed(g).where((F.col("p") == RDF + "type") & (F.col("o") == NS + "Dealer")).select("s")


@query("intersection_classes", f"SELECT '{NS}Customer' || c_custkey AS s FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def intersection_classes(spark, sf_dir):
    """Members of all classes of a list are members of its intersection; another list, without an end, does no harm."""
    c, null = t(spark, sf_dir, "customer"), F.lit(None).cast("string")
    typed = lambda k, name: c.where(f"c_custkey % {k} = 0").select(bridge.uri("Customer", "c_custkey").alias("s"), F.lit(RDF + "type").alias("p"), F.lit(NS + name).alias("o"), F.lit("uri").alias("o_kind"), null.alias("o_lang"), null.alias("o_dtype"))
    cells = [("_:a", "first", NS + "Even"), ("_:a", "rest", "_:b"), ("_:b", "first", NS + "Third"), ("_:b", "rest", RDF + "nil"), ("_:c", "first", NS + "Lost"), ("_:d", "first", NS + "Round"), ("_:d", "rest", "_:d")]
    rows = [(s, RDF + p, o, "uri", None, None) for s, p, o in cells] + [(NS + "Sixth", OWL + "intersectionOf", "_:a", "bnode", None, None), (NS + "Loop", OWL + "intersectionOf", "_:d", "bnode", None, None)]
    g = typed(2, "Even").unionByName(typed(3, "Third")).unionByName(spark.createDataFrame(rows, SCHEMA))
    return rules.entailed(g).where((F.col("p") == RDF + "type") & (F.col("o") == NS + "Sixth")).select("s")


# --- questions ---------------------------------------------------------------------------------------------------

_GOOD = f"```sparql\nPREFIX kg: <{NS}> PREFIX rdfs: <{RDFS}>\nSELECT ?l WHERE {{ ?s a kg:Region ; rdfs:label ?l }}\n```"


def _answers(*said: str):
    """A model that gives these answers in turn, the last one for ever."""
    left = list(said)
    return lambda prompt: left.pop(0) if len(left) > 1 else left[0]


def _rows(spark, found: list[dict], more: str = "repairs int, error string"):
    rows = [(x["question"], r[0], x["repairs"], x["error"]) for x in found for r in x["rows"]]
    return spark.createDataFrame(rows, f"question string, l string, {more}")


@query("answered", "SELECT 'Which regions?' AS question, r_name AS l, 0::INT AS repairs FROM region")
def answered(spark, sf_dir):
    """A question answered at the first try."""
    g = bridge.triples(spark, sf_dir)
    return _rows(spark, [questions.answer(g, questions.schema_summary(g), "Which regions?", _answers(_GOOD))]).drop("error")


@query("repaired", "SELECT 'Which regions?' AS question, r_name AS l, 2::INT AS repairs FROM region")
def repaired(spark, sf_dir):
    """Two queries that fail, a broken one and a forbidden form, go back to the model with their errors."""
    g = bridge.triples(spark, sf_dir)
    model = _answers("SELECT ?x WHERE {", "SELECT ?x WHERE { SERVICE <http://x> { ?x ?y ?z } }", _GOOD)
    return _rows(spark, [questions.answer(g, "", "Which regions?", model)]).drop("error")


@query("given_up", "SELECT 2::INT AS repairs, 0 AS n, TRUE AS failed")
def given_up(spark, sf_dir):
    """A model that never gives a query: the error is the answer."""
    found = questions.answer(bridge.triples(spark, sf_dir), "", "Why?", _answers("I don't know."))
    return spark.createDataFrame([(found["repairs"], len(found["rows"]), found["error"] is not None)], "repairs int, n int, failed boolean")


@query("evaluated", "SELECT q AS question, r_name AS l, 'alone' AS baseline FROM (VALUES ('one?'), ('two?')) v(q), region")
def evaluated(spark, sf_dir):
    """A list of questions, each with the model's own answer beside the graph's."""
    model = lambda prompt: "alone" if prompt.startswith("Answer this") else _GOOD
    found = questions.evaluate(bridge.triples(spark, sf_dir), "", model, ("one?", "two?"))
    return spark.createDataFrame([(x["question"], r[0], x["baseline"]) for x in found for r in x["rows"]], "question string, l string, baseline string")


@query("progress_events", "SELECT * FROM (VALUES (0, 'progress'), (1, 'result'), (2, 'progress'), (3, 'result'), (4, 'done')) v(place, type)")
def progress_events(spark, sf_dir):
    """What a page that waits is told, event by event, as server-sent lines."""
    found = questions.server_sent(questions.events(bridge.triples(spark, sf_dir), "", _answers(_GOOD), ("one?", "two?")))
    types = [re.search(r'"type": "(\w+)"', line)[1] for line in found]
    return spark.createDataFrame(list(enumerate(types)), "place int, type string")


@query("summary_lines", "SELECT 'kg:Nation' || n_nationkey AS short, n_name AS label FROM nation")
def summary_lines(spark, sf_dir):
    """The instances that a schema summary lists for a class."""
    text = questions.schema_summary(bridge.triples(spark, sf_dir), listed=("Nation",))
    return spark.createDataFrame(re.findall(r'^  (kg:\S+)  # "(.*)"$', text, re.M), "short string, label string")


@query("forbidden_forms", "SELECT * FROM (VALUES ('SERVICE', TRUE), ('BIND', TRUE), ('VALUES', TRUE), ('langMatches', TRUE)) v(form, said)")
def forbidden_forms(spark, sf_dir):
    """What every prompt tells a model to leave out, or to use."""
    text = questions.prompt("", "Which?")
    return spark.createDataFrame([(x, x in text) for x in ("SERVICE", "BIND", "VALUES", "langMatches")], "form string, said boolean")
