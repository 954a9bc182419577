"""Every query of the library, with the SQL that states its result.

``queries`` and ``oracle_sql`` have the same names; the few without SQL are
named in ``WITHOUT_SQL`` with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import bridge
from quillgraph.functions import text as X
from quillgraph.operators import alignment, cleaning, embeddings, expansion, graph, mentions, rules, trainer
from quillgraph.operators import training_set as ts
from quillgraph.plans import questions, sparql
from quillgraph.schemas import NAMESPACE as NS
from quillgraph.schemas import RDF, RDFS, XSD
from quillgraph.session import written
from quillgraph.sources import ntriples, pages, turtle

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}
#: Queries that SQL can't state, and why.
WITHOUT_SQL = {
    "train_transe": "trained parameters depend on floating-point steps; tests check gradients and learning",
    "plane": "the sign and last digits of principal components are free; a test checks the shape",
    "turtle_lines": "the text of a serialisation; tests read it back",
}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return add


def queries() -> dict[str, Run]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(c: str):
    return X.local_name(F.col(c)).alias(c)


# --- SQL that several statements share --------------------------------------------------------

EDGES = f"""edges AS (
  SELECT '{NS}Customer' || c_custkey AS s, '{NS}inNation' AS p, '{NS}Nation' || c_nationkey AS o FROM customer
  UNION ALL SELECT '{NS}Supplier' || s_suppkey, '{NS}inNation', '{NS}Nation' || s_nationkey FROM supplier
  UNION ALL SELECT '{NS}Nation' || n_nationkey, '{NS}inRegion', '{NS}Region' || n_regionkey FROM nation
  UNION ALL SELECT '{NS}Order' || o_orderkey, '{NS}placedBy', '{NS}Customer' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT '{NS}Order' || l_orderkey, '{NS}contains', '{NS}Part' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT '{NS}Supplier' || l_suppkey, '{NS}supplies', '{NS}Part' || l_partkey FROM lineitem)"""
NAMED = f"""named AS (
  SELECT '{NS}Customer' || c_custkey AS s, '{NS}Customer' AS c, c_name AS label, c_acctbal AS balance FROM customer
  UNION ALL SELECT '{NS}Supplier' || s_suppkey, '{NS}Supplier', s_name, s_acctbal FROM supplier
  UNION ALL SELECT '{NS}Nation' || n_nationkey, '{NS}Nation', n_name, NULL FROM nation
  UNION ALL SELECT '{NS}Region' || r_regionkey, '{NS}Region', r_name, NULL FROM region
  UNION ALL SELECT '{NS}Part' || p_partkey, '{NS}Part', p_name, NULL FROM part)"""
TRIPLES = f"""{EDGES}, {NAMED}, triples AS (
  SELECT s, p, o, 'uri' AS k FROM edges UNION ALL SELECT s, '{RDF}type', c, 'uri' FROM named
  UNION ALL SELECT s, '{RDFS}label', label, 'literal' FROM named
  UNION ALL SELECT s, '{NS}balance', CAST(CAST(balance AS DECIMAL(18,2)) AS VARCHAR), 'literal' FROM named WHERE balance IS NOT NULL)"""
LOCAL = "regexp_replace({}, '^.*[#/]', '')"


# --- cleaning ----------------------------------------------------------------------------------

FOLDED = r"regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')"
NOISELESS = (
    r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\[\d+\]', '', 'g'), "
    r"'(?i)\[citation needed\]', '', 'g'), '(?i)\[edit\]', '', 'g'), 'https?://[^\s]+', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '" + '"' + r"'), "
    r"'[\x09-\x0D\x1C-\x20]+', ' ', 'g'))"
)
CLEAN = f"""cut AS (
  SELECT doc_id, lang, length(text) AS raw_chars, string_split(regexp_replace({NOISELESS.format(FOLDED)}, '([.!?]) ([A-Z])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS parts FROM documents),
long AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i FROM cut),
firsts AS (SELECT doc_id, sentence, i FROM long WHERE length(sentence) >= 40 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(sentence) ORDER BY i) = 1),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, sentence FROM firsts),
clean AS (SELECT c.doc_id, lang, raw_chars, coalesce(length(string_agg(sentence, ' ' ORDER BY pos)), 0) AS clean_chars, count(sentence) AS n FROM cut c LEFT JOIN sentences s ON c.doc_id = s.doc_id GROUP BY ALL)"""


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_documents(t(spark, sf_dir, "documents"))


@query("clean_sentences", f"WITH {CLEAN} SELECT doc_id, pos::INT AS pos, sentence FROM sentences")
def clean_sentences(spark, sf_dir):
    return cleaning.sentence_rows(_clean(spark, sf_dir), "doc_id").select(F.col("doc_id").cast("long"), "pos", "sentence")


_STATS = "count(*) AS documents, sum(raw_chars)::BIGINT AS raw_chars, sum(clean_chars)::BIGINT AS clean_chars, round(100 * (1 - sum(clean_chars)::DOUBLE / sum(raw_chars)), 1) AS reduction_pct, sum(n)::BIGINT AS sentences"


@query("clean_stats", f"WITH {CLEAN} SELECT {_STATS} FROM clean")
def clean_stats(spark, sf_dir):
    return cleaning.corpus_stats(t(spark, sf_dir, "documents"), _clean(spark, sf_dir), "doc_id")


@query("reduction_by_lang", f"WITH {CLEAN} SELECT lang, {_STATS} FROM clean GROUP BY lang")
def reduction_by_lang(spark, sf_dir):
    return cleaning.corpus_stats(t(spark, sf_dir, "documents"), _clean(spark, sf_dir).drop("lang"), "doc_id", by="lang")


_NOISE = (
    (1, "A[12] b &amp;lt; c https://x.y/z d"), (2, " twice  [3][44] [Citation Needed] x [EDIT]"), (3, "&quot;q&quot;&nbsp;&gt; http://only"), (4, "nothing here"),
)


@query("remove_noise", "SELECT id, " + NOISELESS.format("text") + " AS text FROM (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in _NOISE) + ") AS v(id, text)")
def remove_noise(spark, sf_dir):
    return spark.createDataFrame(list(_NOISE), "id int, text string").select("id", X.without_noise(F.col("text")).alias("text"))




@query("page_titles", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\x09-\x0D\x1C-\x20]+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query("page_host_counts", "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_host_counts(spark, sf_dir):
    return t(spark, sf_dir, "pages").groupBy(pages.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("page_status", "SELECT count(html) AS ok, count(*) AS total FROM pages")
def page_status(spark, sf_dir):
    return cleaning.status_counts(pages.raw_documents(t(spark, sf_dir, "pages").select("url", "html")))


# --- mentions -----------------------------------------------------------------------------------

_PHRASES = {"LICENSE": ("Apache License", "General Public License", "GNU General Public License", "MIT License"), "TERM": ("Licensed under", "License", "licensed")}
_ORDERED = sorted((p for ps in _PHRASES.values() for p in ps), key=lambda p: (-len(p), p))
_PATTERN = "|".join(_ORDERED)
# matches stand between word borders; RE2 has \b, and all phrases begin and end with letters
HITS = f"""hits AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b({_PATTERN})\\b', 1)) AS text FROM documents),
counts AS (SELECT CASE WHEN text IN ({", ".join(f"'{p}'" for p in _PHRASES["LICENSE"])}) THEN 'LICENSE' ELSE 'TERM' END AS label, text, count(*) AS n FROM hits GROUP BY ALL)"""


def _mentions(spark, sf_dir):
    return mentions.dictionary_mentions(t(spark, sf_dir, "documents"), _PHRASES)


@query("dict_mentions", f"WITH {HITS} SELECT doc_id, text, count(*) AS n FROM hits GROUP BY ALL")
def dict_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "text").agg(F.count("*").alias("n"))


@query("mention_spans", f"WITH {HITS} SELECT count(*) AS n, count(*) AS placed FROM hits")
def mention_spans(spark, sf_dir):
    """Every mention's offsets give its own text again."""
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body"))
    found = _mentions(spark, sf_dir).join(docs, "doc_id")
    return found.agg(F.count("*").alias("n"), F.count_if(F.substr("body", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).alias("placed"))


@query("mention_counts", f"WITH {HITS} SELECT * FROM counts")
def mention_counts(spark, sf_dir):
    return mentions.counts(_mentions(spark, sf_dir))


@query("topk_per_label", f"WITH {HITS} SELECT label, text, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, text)::INT AS rank FROM counts QUALIFY rank <= 2")
def topk_per_label(spark, sf_dir):
    return mentions.top(mention_counts(spark, sf_dir), 2)


@query("whitelist", f"WITH {HITS} SELECT label, text, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, text)::INT AS rank FROM counts WHERE n >= 5 QUALIFY rank <= CASE WHEN label = 'TERM' THEN 1 ELSE 30 END")
def whitelist(spark, sf_dir):
    return mentions.whitelist(mention_counts(spark, sf_dir), least=5, caps={"TERM": 1})


@query("kept_mentions", f"WITH {HITS} SELECT doc_id, count(*) AS n FROM hits WHERE text IN (SELECT text FROM counts WHERE n >= 5) GROUP BY doc_id")
def kept_mentions(spark, sf_dir):
    found = _mentions(spark, sf_dir)
    kept = mentions.kept_mentions(found, mentions.whitelist(mentions.counts(found), least=5))
    return kept.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))


# RE2's borders know ASCII only: other letters are made word characters first
CAPS = r"caps AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b')) AS text FROM documents)"


@query("capitalised_mentions", f"WITH {CAPS} SELECT doc_id, text, count(*) AS n FROM caps GROUP BY ALL")
def capitalised_mentions(spark, sf_dir):
    return mentions.capitalised_mentions(t(spark, sf_dir, "documents")).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "text").agg(F.count("*").alias("n"))


@query("possessive", "SELECT p_partkey, regexp_replace(p_name || '''s', '''s?$', '') AS intended, rtrim(p_name || '''s', '''s') AS as_coded FROM part")
def possessive(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit("'s"))
    return t(spark, sf_dir, "part").select("p_partkey", X.without_possessive(name).alias("intended"), X.without_possessive(name, as_coded=True).alias("as_coded"))


# forms: names of parts as people (their words are few and repeat), names of suppliers and brands as companies
_FORMS = "forms AS (SELECT p_name AS text, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT DISTINCT split_part(p_name, ' ', -1), 1::BIGINT FROM part WHERE p_partkey % 3 = 0 AND split_part(p_name, ' ', -1) NOT IN (SELECT p_name FROM part))"


def _forms(spark, sf_dir, label):
    part = t(spark, sf_dir, "part")
    own = part.groupBy(F.col("p_name").alias("text")).agg(F.count("*").alias("n"))
    last = part.where("p_partkey % 3 = 0").select(F.substring_index("p_name", " ", -1).alias("text")).distinct()
    short = last.join(own.select("text"), "text", "left_anti").select("text", F.lit(1).cast("long").alias("n"))
    return own.unionByName(short).select(F.lit(label).alias("label"), "text", "n")


@query(
    "canonical_person",
    f"""WITH {_FORMS}, w AS (SELECT text, string_split(lower(text), ' ') AS w FROM forms),
    f AS (SELECT w[-1] AS last, count_if(len(w) > 1) AS k, max(CASE WHEN len(w) > 1 THEN text END) AS one FROM w WHERE len(w) <= 3 GROUP BY 1)
    SELECT text, CASE WHEN len(w) > 3 THEN '' WHEN len(w) = 1 AND k = 1 THEN one ELSE text END AS canonical FROM w LEFT JOIN f ON w[-1] = last""",
)
def canonical_person(spark, sf_dir):
    return mentions.global_canonical(_forms(spark, sf_dir, "PERSON")).select("text", "canonical")


@query(
    "canonical_other",
    f"""WITH {_FORMS}, c AS (SELECT a.text, count(*) AS k, min(b.text) AS one FROM forms a JOIN forms b ON length(b.text) > length(a.text) AND (' ' || lower(b.text)) LIKE ('% ' || lower(a.text)) GROUP BY 1)
    SELECT f.text, CASE WHEN k = 1 THEN one ELSE f.text END AS canonical FROM forms f LEFT JOIN c ON f.text = c.text""",
)
def canonical_other(spark, sf_dir):
    return mentions.global_canonical(_forms(spark, sf_dir, "ORG")).select("text", "canonical")


@query(
    "document_canonical",
    """WITH m AS (SELECT p_size AS d, p_name AS text FROM part UNION ALL SELECT p_size, split_part(p_name, ' ', -1) FROM part),
    f AS (SELECT DISTINCT d, text FROM m),
    c AS (SELECT a.d, a.text, arg_min(b.text, (-length(b.text), b.text)) AS canonical FROM f a JOIN f b ON a.d = b.d AND length(b.text) > length(a.text) AND (' ' || lower(b.text)) LIKE ('% ' || lower(a.text)) GROUP BY ALL)
    SELECT m.d AS doc, coalesce(canonical, m.text) AS text, count(*) AS n FROM m LEFT JOIN c ON m.d = c.d AND m.text = c.text GROUP BY ALL""",
)
def document_canonical(spark, sf_dir):
    part = t(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("doc_id"), F.lit("ORG").alias("label"), F.explode(F.array("p_name", F.substring_index("p_name", " ", -1))).alias("text"))
    found = mentions.document_canonical(part.select("*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    return found.groupBy(F.col("doc_id").cast("int").alias("doc"), "text").agg(F.count("*").alias("n"))


# --- graph -------------------------------------------------------------------------------------

SLUG = r"coalesce(nullif(list_aggregate(list_transform(list_filter(string_split(regexp_replace(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'), '[^a-zA-Z0-9\s]', '', 'g'), ' '), lambda x: x <> ''), lambda x: upper(x[1:1]) || lower(x[2:])), 'string_agg', ''), ''), 'Unknown')"


@query("slug", f"SELECT p_partkey, {SLUG.format('p_name')} AS slug, {SLUG.format('p_brand')} AS brand FROM part")
def slug(spark, sf_dir):
    make = lambda c: X.slug(X.ascii_fold(F.col(c)))
    return t(spark, sf_dir, "part").select("p_partkey", make("p_name").alias("slug"), make("p_brand").alias("brand"))


def _part_mentions(spark, sf_dir):
    """Part names as firms, their first words as short forms, brands as companies, single words as people."""
    part = t(spark, sf_dir, "part")
    kinds = F.array(*(F.struct(F.lit(label).alias("label"), text.alias("text")) for label, text in (("VC_FIRM", F.col("p_name")), ("VC_FIRM", F.substring_index("p_name", " ", 1)), ("ORG", F.col("p_brand")), ("PERSON", F.substring_index("p_name", " ", 1)))))
    x = part.select(F.format_string("%08d", "p_partkey").alias("doc_id"), F.posexplode(kinds).alias("start", "m"))
    return x.select("doc_id", "m.label", "m.text", "start", (F.col("start") + 1).alias("end"))


REGISTRY = f"""m AS (SELECT p_partkey AS d, 0 AS i, 'VC_FIRM' AS label, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, 'VC_FIRM', split_part(p_name, ' ', 1) FROM part UNION ALL SELECT p_partkey, 2, 'ORG', p_brand FROM part),
ok AS (SELECT *, string_split(lower(text), ' ') AS w FROM m WHERE len(string_split(text, ' ')) <= 5),
good AS (SELECT * FROM ok WHERE len(w) < 4 OR w[1:len(w)//2] <> w[len(w)//2+1:2*(len(w)//2)]),
reg AS (SELECT text, arg_min(label, (d, i)) AS label, min((d, i)) AS place FROM good GROUP BY text),
entries AS (SELECT text, label, {SLUG.format("text")} AS name, CASE label WHEN 'VC_FIRM' THEN 'VCFirm' ELSE 'Company' END AS class, place, string_split(lower(text), ' ') AS w FROM reg),
alias AS (SELECT a.text, arg_min(b.name, (-len(b.w), b.place)) AS name FROM entries a JOIN entries b ON a.label = b.label AND length(b.text) > length(a.text) AND (lower(b.text) || ' ') LIKE (lower(a.text) || ' %') GROUP BY a.text)"""


@query("registry", f"WITH {REGISTRY} SELECT text, label, name, class FROM entries")
def registry(spark, sf_dir):
    return graph.registry(_part_mentions(spark, sf_dir)).select("text", "label", local("uri").alias("name"), local("class_uri").alias("class"))


@query("aliases", f"WITH {REGISTRY} SELECT e.text, coalesce(a.name, e.name) AS name FROM entries e LEFT JOIN alias a ON e.text = a.text")
def aliases(spark, sf_dir):
    return graph.resolve_aliases(graph.registry(_part_mentions(spark, sf_dir))).select("text", local("uri").alias("name"))


@query("entity_triples", f"WITH {REGISTRY}, e AS (SELECT e.text, coalesce(a.name, e.name) AS name, class FROM entries e LEFT JOIN alias a ON e.text = a.text) SELECT DISTINCT name AS s, 'type' AS p, class AS o FROM e UNION SELECT name, 'label', text FROM e")
def entity_triples(spark, sf_dir):
    found = graph.entity_triples(graph.resolve_aliases(graph.registry(_part_mentions(spark, sf_dir))))
    return found.select(local("s"), local("p"), F.when(F.col("o_kind") == "uri", X.local_name(F.col("o"))).otherwise(F.col("o")).alias("o"))


# a sentence per order line; suppliers as firms, parts as companies, nations as places
def _deals(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    l = l.join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))  # noqa: E741
    verb = F.when(F.col("l_linenumber") % 2 == 0, " Invested in ").otherwise(" met ")
    sentence = F.concat("s_name", verb, "p_name", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" and is based in "), "n_name")).otherwise(""))
    rows = l.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("pos"), sentence.alias("sentence"), "s_name", "p_name", "n_name")
    kinds = F.array(F.struct(F.lit("VC_FIRM").alias("label"), F.col("s_name").alias("text")), F.struct(F.lit("ORG").alias("label"), F.col("p_name").alias("text")), F.struct(F.lit("GPE").alias("label"), F.col("n_name").alias("text")))
    said = rows.select("doc_id", F.explode(kinds).alias("m")).select("doc_id", "m.label", "m.text", F.lit(0).alias("start"), F.lit(0).alias("end"))
    entries = said.select("text", "label").distinct().select("text", "label", F.concat(F.lit(NS), "label", F.lit("/"), F.regexp_replace("text", " ", "_")).alias("uri"), F.when(F.col("label") != "GPE", F.lit(NS + "x")).alias("class_uri"))
    return rows.select("doc_id", "pos", "sentence"), said, entries


DEALS = f"""rows AS (SELECT l_orderkey AS doc, l_linenumber AS pos, s_name, p_name, n_name, s_name || CASE WHEN l_linenumber % 2 = 0 THEN ' Invested in ' ELSE ' met ' END || p_name || CASE WHEN l_linenumber % 3 = 0 THEN ' and is based in ' || n_name ELSE '' END AS sentence
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT DISTINCT doc, 'VC_FIRM' AS label, s_name AS text FROM rows UNION SELECT doc, 'ORG', p_name FROM rows UNION SELECT doc, 'GPE', n_name FROM rows),
present AS (SELECT r.doc, r.pos, r.sentence, label, text, '{NS}' || label || '/' || replace(text, ' ', '_') AS uri FROM (SELECT DISTINCT doc, pos, sentence FROM rows) r JOIN m ON r.doc = m.doc AND contains(lower(r.sentence), lower(text)) WHERE label <> 'GPE'
  QUALIFY count(*) OVER (PARTITION BY r.doc, r.pos) >= 2),
pairs AS (SELECT a.doc, a.pos, a.sentence, a.uri AS s, a.label AS s_label, b.uri AS o, b.label AS o_label FROM present a JOIN (SELECT DISTINCT doc, pos, uri, label FROM present) b ON a.doc = b.doc AND a.pos = b.pos AND a.uri <> b.uri)"""


@query("cooccurrence", f"WITH {DEALS} SELECT doc, pos, s, o FROM pairs")
def cooccurrence(spark, sf_dir):
    return graph.pairs(graph.present(*_deals(spark, sf_dir))).select(F.col("doc_id").cast("long").alias("doc"), "pos", "s", "o")


@query("relation_patterns", f"WITH {DEALS} SELECT DISTINCT s, '{NS}investedIn' AS p, o FROM pairs WHERE s_label = 'VC_FIRM' AND o_label = 'ORG' AND contains(lower(sentence), 'invested')")
def relation_patterns(spark, sf_dir):
    return graph.relation_triples(graph.pairs(graph.present(*_deals(spark, sf_dir)))).select("s", "p", "o")


@query("seat_relations", f"WITH {DEALS} SELECT DISTINCT p.uri AS s, m.text AS o FROM present p JOIN m ON p.doc = m.doc AND m.label = 'GPE' AND contains(lower(p.sentence), lower(m.text)) WHERE contains(lower(sentence), 'based in')")
def seat_relations(spark, sf_dir):
    sentences, said, entries = _deals(spark, sf_dir)
    return graph.seat_triples(graph.present(sentences, said, entries), said).select("s", "o")


@query("new_triples", f"WITH {TRIPLES} SELECT s, p, o FROM triples WHERE p = '{RDFS}label' OR (p = '{NS}inNation' AND contains(s, 'Supplier'))")
def new_triples(spark, sf_dir):
    """Against a graph that has all but labels and suppliers' nations."""
    all_ = bridge.triples(spark, sf_dir)
    lacks = (F.col("p") == RDFS + "label") | ((F.col("p") == NS + "inNation") & F.contains("s", F.lit("Supplier")))
    return graph.new_triples(all_, all_.where(~lacks)).select("s", "p", "o")


@query("kb_totals", f"WITH {TRIPLES}, n AS (SELECT s FROM triples UNION SELECT o FROM triples WHERE k = 'uri') SELECT (SELECT count(*) FROM triples) AS triples, count(*) AS entities, (SELECT count(DISTINCT p) FROM triples) AS predicates FROM n")
def kb_totals(spark, sf_dir):
    return graph.totals(bridge.triples(spark, sf_dir))


@query("class_counts", f"WITH {TRIPLES} SELECT {LOCAL.format('o')} AS class, count(*) AS n FROM triples WHERE p = '{RDF}type' GROUP BY 1")
def class_counts(spark, sf_dir):
    return graph.class_counts(bridge.triples(spark, sf_dir))


@query("top_predicates", f"WITH {TRIPLES} SELECT {LOCAL.format('p')} AS predicate, count(*) AS n FROM triples GROUP BY 1 ORDER BY n DESC, predicate LIMIT 5")
def top_predicates(spark, sf_dir):
    return graph.predicate_counts(bridge.triples(spark, sf_dir), 5)


@query("turtle_lines")
def turtle_lines(spark, sf_dir):
    return turtle.to_turtle(bridge.triples(spark, sf_dir))


@query("ntriples_round_trip", f"WITH {TRIPLES} SELECT p, k AS o_kind, count(DISTINCT s || '|' || o) AS n FROM triples GROUP BY ALL")
def ntriples_round_trip(spark, sf_dir):
    return ntriples.parse_lines(ntriples.to_lines(bridge.triples(spark, sf_dir))).groupBy("p", "o_kind").agg(F.count("*").alias("n"))


# --- alignment -----------------------------------------------------------------------------------

LINKS = """x AS (SELECT p_partkey, p_name AS text, CASE p_size % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'SECTOR' ELSE 'OTHER' END AS label, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'The ' || p_name ELSE p_brand END AS wd_label, p_type AS wd_desc FROM part),
base AS (SELECT *, CASE WHEN wd_label = text THEN 1.0 WHEN lower(wd_label) = lower(text) THEN 0.95 WHEN contains(lower(wd_label), lower(text)) THEN 0.8 ELSE 0.6 END::DECIMAL(4,3)
  - CASE WHEN (label = 'ORG' AND NOT regexp_matches(lower(wd_desc), 'company|corporation|startup|software|technology|platform|service|business|enterprise')) OR (label = 'SECTOR' AND NOT regexp_matches(lower(wd_desc), 'industry|sector|technology|field')) THEN 0.15 ELSE 0 END::DECIMAL(4,3) AS c FROM x)"""


def _scored(spark, sf_dir):
    part, size = t(spark, sf_dir, "part"), F.col("p_size")
    label = F.when(size % 3 == 0, "ORG").when(size % 3 == 1, "SECTOR").otherwise("OTHER")
    found = F.when(size % 4 == 0, F.col("p_name")).when(size % 4 == 1, F.upper("p_name")).when(size % 4 == 2, F.concat(F.lit("The "), "p_name")).otherwise(F.col("p_brand"))
    return part.select("p_partkey", F.col("p_name").alias("text"), label.alias("label"), found.alias("wd_label"), F.col("p_type").alias("wd_desc"))


@query("align_confidence", f"WITH {LINKS} SELECT p_partkey, c::DOUBLE AS confidence FROM base")
def align_confidence(spark, sf_dir):
    return _scored(spark, sf_dir).select("p_partkey", alignment.confidence(F.col("text"), F.col("label"), F.col("wd_label"), F.col("wd_desc")).cast("double").alias("confidence"))


@query(
    "align_decision",
    f"""WITH {LINKS}, one AS (SELECT text, arg_min((label, wd_label, c), p_partkey) AS b FROM base GROUP BY text)
    SELECT CASE WHEN b[3] >= 0.85 THEN 'sameAs' WHEN b[3] >= 0.7 THEN 'closeMatch' ELSE 'local' END AS decision, count(*) AS n FROM one GROUP BY 1""".replace("(label, wd_label, c)", "{'label': label, 'wd': wd_label, 'c': c}").replace("b[3]", "b.c"),
)
def align_decision(spark, sf_dir):
    x = _scored(spark, sf_dir)
    one = x.groupBy("text").agg(F.min_by(F.struct("label", "wd_label", "wd_desc", "p_partkey"), "p_partkey").alias("b")).select("text", "b.*")
    entries = one.select("text", "label", F.concat(F.lit(NS), F.col("p_partkey").cast("string")).alias("uri"), F.lit(NS + "Company").alias("class_uri"))
    candidates = one.select(F.col("text").alias("label"), F.lit(1).alias("rank"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), "wd_label", "wd_desc")
    return alignment.decision_counts(alignment.link(entries, candidates))


_PROPS = ("inNation", "inRegion", "placedBy", "contains", "supplies")
_ALIGNED = (("locatedIn", "nation", (("Supplier1", None),), "inNation", "closeMatch"), ("orderedBy", "placed", (), "placedBy", "equivalentProperty"), ("other", "region", (), "supplies", "closeMatch"), ("own", None, (), None, None))


@query(
    "predicate_support",
    f"""WITH {EDGES}, p AS (SELECT unnest([{", ".join(f"'{p}'" for p in _PROPS)}]) AS pid),
    a(name, keyword, chosen) AS (VALUES ('locatedIn', 'nation', 'inNation'), ('orderedBy', 'placed', 'placedBy'), ('other', 'region', 'supplies'), ('own', NULL, NULL)),
    l AS (SELECT name, pid FROM a JOIN p ON contains(lower(pid), keyword)),
    v AS (SELECT DISTINCT 'locatedIn' AS name, regexp_replace(p, '^.*#', '') AS pid FROM edges WHERE s = '{NS}Supplier1' AND contains(o, 'Nation'))
    SELECT a.name, CASE WHEN chosen IS NULL THEN 'local only' WHEN EXISTS (FROM v WHERE v.name = a.name AND v.pid = chosen) THEN 'confirmed by triple validation' WHEN EXISTS (FROM l WHERE l.name = a.name AND l.pid = chosen) THEN 'confirmed by label search' ELSE 'WARNING: found by neither search' END AS support,
      coalesce((SELECT string_agg(pid, ',' ORDER BY pid) FROM (SELECT pid FROM l WHERE l.name = a.name UNION SELECT pid FROM v WHERE v.name = a.name)), '') AS candidates FROM a""",
)
def predicate_support(spark, sf_dir):
    from quillgraph.schemas import WD

    claims = bridge.edges(spark, sf_dir).select(F.regexp_replace("s", "^.*#", WD).alias("s"), F.regexp_replace("p", "^.*#", "").alias("p"), F.regexp_replace("o", "^.*#", WD).alias("o"))
    nation = f"Nation{t(spark, sf_dir, 'supplier').where('s_suppkey = 1').first().s_nationkey}"
    properties = spark.createDataFrame([(p, p, "en", p) for p in _PROPS], "pid string, label string, lang string, direct string")
    fixed = tuple((n, k, tuple((a, nation) for a, _ in pairs), pid, rel) for n, k, pairs, pid, rel in _ALIGNED)
    return alignment.align_predicates(spark, claims, properties, fixed).select("name", "support", "candidates")


# --- expansion ------------------------------------------------------------------------------------

_SEEDS = tuple(f"{NS}Supplier{k}" for k in (1, 2, 3))


def _seeds(spark, names=_SEEDS):
    return spark.createDataFrame([(n,) for n in names], "uri string")


def _base(spark, sf_dir):
    return bridge.triples(spark, sf_dir)


_IN = ", ".join(f"'{s}'" for s in _SEEDS)


@query(
    "one_hop",
    f"""WITH {TRIPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o) AS n FROM triples WHERE s IN ({_IN}) AND (starts_with(p, '{NS}') OR p = '{RDFS}label'))
    SELECT s, p, o FROM r WHERE n <= 20 AND p IN ('{NS}supplies', '{NS}inNation', '{RDFS}label')""",
)
def one_hop(spark, sf_dir):
    return expansion.one_hop(_base(spark, sf_dir), _seeds(spark), 20, (NS + "supplies", NS + "inNation"), direct=NS).select("s", "p", "o")


@query("outgoing", f"WITH {EDGES} SELECT s, p, o FROM edges WHERE s IN ({_IN}) AND p IN ('{NS}supplies', '{NS}inNation') QUALIFY row_number() OVER (PARTITION BY s, p ORDER BY o) <= 5")
def outgoing(spark, sf_dir):
    return expansion.outgoing(_base(spark, sf_dir), _seeds(spark), (NS + "supplies", NS + "inNation"), 5).select("s", "p", "o")


@query("incoming", f"WITH {EDGES} SELECT s, p, o FROM edges WHERE o IN ('{NS}Nation1', '{NS}Region2') AND p IN ('{NS}inNation', '{NS}inRegion') QUALIFY row_number() OVER (PARTITION BY o, p ORDER BY s) <= CASE p WHEN '{NS}inNation' THEN 7 ELSE 2 END")
def incoming(spark, sf_dir):
    return expansion.incoming(_base(spark, sf_dir), _seeds(spark, (f"{NS}Nation1", f"{NS}Region2")), ((NS + "inNation", 7), (NS + "inRegion", 2))).select("s", "p", "o")


@query("known_nodes", f"WITH {EDGES} SELECT s AS uri FROM edges WHERE contains(s, 'Nation') UNION SELECT o FROM edges WHERE contains(o, 'Nation') UNION SELECT '{NS}Nation'")
def known_nodes(spark, sf_dir):
    return expansion.nodes(_base(spark, sf_dir), "Nation")


@query(
    "expand_phases",
    f"""WITH {TRIPLES}, ok AS (SELECT s, p, o, k FROM triples WHERE p IN ('{NS}inNation', '{NS}inRegion')),
    g0 AS (SELECT s, p, o, k FROM ok WHERE s = '{NS}Nation3'),
    n0 AS (SELECT s AS n FROM g0 UNION SELECT o FROM g0 WHERE k = 'uri'),
    g1 AS (SELECT * FROM g0 UNION SELECT * FROM ok WHERE s IN (SELECT n FROM n0)),
    n1 AS (SELECT s AS n FROM g1 UNION SELECT o FROM g1),
    i AS (SELECT * FROM ok WHERE p = '{NS}inRegion' AND o IN (SELECT n FROM n1)),
    g2 AS (SELECT * FROM g1 UNION SELECT * FROM i),
    g3 AS (SELECT * FROM g2 UNION SELECT * FROM ok WHERE s IN (SELECT s FROM i) UNION SELECT s, p, o, k FROM triples WHERE p = '{RDFS}label' AND s IN (SELECT s FROM i UNION SELECT '{NS}Nation3'))
    SELECT s, p, o FROM g3""",
)
def expand_phases(spark, sf_dir):
    plan = expansion.Plan(anchors=(f"{NS}Nation3",), allowed=(NS + "inNation", NS + "inRegion"), incoming=((NS + "inRegion", 1000),), part=NS, direct=NS)
    base = _base(spark, sf_dir)
    out, _ = expansion.expand(base.limit(0), base, plan)
    return out.select("s", "p", "o")


# --- training set -----------------------------------------------------------------------------------

_BAD = (
    "# comment", "", "  ", "one two", "_:b <http://p> <http://o> .", "<http://s> p <http://o> .", '<http://s> <http://p> "text" .', f"<http://s> <{RDF}type> <http://o> .",
    "<http://s> <http://www.wikidata.org/prop/direct/P569> <http://o> .", "<http://s> <http://www.wikidata.org/prop/direct/P21> <http://o> .",
    "<http://s> <http://www.wikidata.org/prop/direct/P31> <http://www.wikidata.org/entity/Q5> .", "<http://s> <http://p> <http://o> .", "<http://s> <http://p> <http://o> .",
)


def _lines(spark, sf_dir):
    return ntriples.to_lines(bridge.triples(spark, sf_dir)).unionByName(spark.createDataFrame([(x,) for x in _BAD], "value string"))


@query(
    "reject_reasons",
    f"""WITH {TRIPLES}, c AS (SELECT CASE WHEN p = '{RDF}type' THEN 'schema predicate' WHEN p = '{RDFS}label' THEN 'literal predicate' WHEN k = 'literal' THEN 'literal object' ELSE 'kept' END AS reason, count(*) AS n FROM triples GROUP BY 1),
    b(reason, n) AS (VALUES ('malformed', 2), ('non-uri subject', 1), ('literal object', 1), ('schema predicate', 1), ('literal predicate', 1), ('hub', 2), ('kept', 1), ('duplicate', 1))
    SELECT reason, sum(n)::BIGINT AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM b) GROUP BY 1""",
)
def reject_reasons(spark, sf_dir):
    return ts.reason_counts(ts.reasons(_lines(spark, sf_dir)))


@query("clean_triples", f"WITH {EDGES} SELECT s, p, o FROM edges UNION SELECT 'http://s', 'http://p', 'http://o'")
def clean_triples(spark, sf_dir):
    return ts.clean_triples(ts.reasons(_lines(spark, sf_dir)))


@query("degrees", f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT s AS node FROM edges UNION ALL SELECT o FROM edges) GROUP BY 1")
def degrees(spark, sf_dir):
    return ts.degrees(bridge.edges(spark, sf_dir))


def _rounds(n: int) -> str:
    """n rounds of pruning; further ones change nothing at the fixpoint."""
    out = [f"{EDGES}, g0 AS MATERIALIZED (SELECT * FROM edges)"]
    for k in range(n):
        out.append(f"d{k} AS MATERIALIZED (SELECT node FROM (SELECT s AS node FROM g{k} UNION ALL SELECT o FROM g{k}) GROUP BY 1 HAVING count(*) >= 2)")
        out.append(f"g{k + 1} AS MATERIALIZED (SELECT * FROM g{k} WHERE contains(p, 'inRegion') OR (s IN (SELECT node FROM d{k}) AND o IN (SELECT node FROM d{k})))")
    return ", ".join(out)


def _pruned(spark, sf_dir):
    return ts.prune(bridge.edges(spark, sf_dir), protected=("inRegion",))


PRUNED = _rounds(6) + ", pruned AS (SELECT * FROM g6)"


@query("prune_fixpoint", f"WITH {PRUNED} SELECT s, p, o FROM pruned")
def prune_fixpoint(spark, sf_dir):
    return _pruned(spark, sf_dir)


AT = "md5('42|' || s || '|' || p || '|' || o)"


@query("relation_cap", f"WITH {EDGES} SELECT s, p, o FROM edges QUALIFY row_number() OVER (PARTITION BY p ORDER BY {AT}, s, o) <= 500")
def relation_cap(spark, sf_dir):
    return ts.relation_cap(bridge.edges(spark, sf_dir), 500)


@query("entity_ids", f"WITH {EDGES} SELECT row_number() OVER (ORDER BY uri) - 1 AS id, uri FROM (SELECT s AS uri FROM edges UNION SELECT o FROM edges)")
def entity_ids(spark, sf_dir):
    return ts.entity_ids(bridge.edges(spark, sf_dir))


@query(
    "encoded",
    f"""WITH {EDGES}, e AS (SELECT row_number() OVER (ORDER BY uri) - 1 AS id, uri FROM (SELECT s AS uri FROM edges UNION SELECT o FROM edges)), r AS (SELECT row_number() OVER (ORDER BY p) - 1 AS id, p FROM (SELECT DISTINCT p FROM edges))
    SELECT a.id AS s, r.id AS p, b.id AS o FROM edges x JOIN e a ON x.s = a.uri JOIN e b ON x.o = b.uri JOIN r ON x.p = r.p""",
)
def encoded(spark, sf_dir):
    x = bridge.edges(spark, sf_dir)
    return ts.encode(x, ts.entity_ids(x), ts.relation_ids(x))


SPLIT = f"""n AS (SELECT count(*) AS n, floor(count(*) * 0.1) AS k FROM edges), at AS (SELECT s, p, o, row_number() OVER (ORDER BY {AT}, s, p, o) - 1 AS i FROM edges),
parts AS (SELECT s, p, o, CASE WHEN i < n - 2 * k THEN 'train' WHEN i < n - k THEN 'valid' ELSE 'test' END AS split FROM at, n),
nodes AS (SELECT s AS x FROM parts WHERE split = 'train' UNION SELECT o FROM parts WHERE split = 'train'), rels AS (SELECT DISTINCT p FROM parts WHERE split = 'train'),
rescued AS (SELECT s, p, o, CASE WHEN s IN (SELECT x FROM nodes) AND o IN (SELECT x FROM nodes) AND p IN (SELECT p FROM rels) THEN split ELSE 'train' END AS split FROM parts)""".replace(" at AS", " placed AS").replace("FROM at,", "FROM placed,")


@query("split", f"WITH {EDGES}, {SPLIT} SELECT s, p, o, split FROM parts")
def split(spark, sf_dir):
    return ts.split(bridge.edges(spark, sf_dir), rescue=False)


@query("split_rescued", f"WITH {EDGES}, {SPLIT} SELECT s, p, o, split FROM rescued")
def split_rescued(spark, sf_dir):
    return ts.split(bridge.edges(spark, sf_dir))


@query("subsample", f"WITH {EDGES} SELECT s, p, o FROM edges ORDER BY {AT}, s, p, o LIMIT 1000")
def subsample(spark, sf_dir):
    return ts.subsample(bridge.edges(spark, sf_dir), 1000)


@query(
    "prep_report",
    f"""WITH {EDGES}, {SPLIT}, d AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM edges UNION ALL SELECT o FROM edges) GROUP BY 1),
    m AS (SELECT degree, row_number() OVER (ORDER BY degree, node) - 1 AS i, count(*) OVER () AS n FROM d)
    SELECT 'mean_degree' AS metric, round(avg(degree), 1)::DOUBLE AS value FROM d UNION ALL SELECT 'single_pct', round(100.0 * count_if(degree = 1) / count(*), 1) FROM d UNION ALL SELECT 'entities', count(*) FROM d
    UNION ALL SELECT 'median_degree', degree FROM m WHERE i = n // 2 UNION ALL SELECT 'unknown_valid', 0 UNION ALL SELECT 'unknown_test', 0
    UNION ALL SELECT split, count(*) FROM rescued GROUP BY split UNION ALL SELECT 'relations', count(DISTINCT p) FROM edges""",
)
def prep_report(spark, sf_dir):
    x = bridge.edges(spark, sf_dir)
    return ts.report(x, written(ts.split(x), "report"))


@query("relation_histogram", f"WITH {EDGES} SELECT p AS relation, count(*) AS n FROM edges GROUP BY 1")
def relation_histogram(spark, sf_dir):
    return ts.relation_histogram(bridge.edges(spark, sf_dir))


# --- embeddings -------------------------------------------------------------------------------------
# entities are the vectors; three of them serve as relations, triples follow from the ids


def _space(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = e.count()
    triples = e.select(F.col("id").alias("s"), (F.col("id") % 3).alias("p"), F.pmod(F.col("id") * 7 + 1, F.lit(n)).alias("o"))
    return e, e.where("id < 3"), triples


SPACE = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT count(*) AS n FROM e),
tr AS (SELECT id AS s, id % 3 AS p, (id * 7 + 1) % n AS o FROM e, n),
x AS (SELECT s, p, o, h.v AS h, r.v AS r, t.v AS t FROM tr JOIN e h ON s = h.id JOIN e r ON p = r.id JOIN e t ON o = t.id)"""
_Z = "list_sum(list_transform(list_zip({}), lambda z: {}))"
_SCORES = {
    "TransE": _Z.format("h, r, t", "-abs(z[1] + z[2] - z[3])"),
    "DistMult": _Z.format("h, r, t", "z[1] * z[2] * z[3]"),
    "ComplEx": _Z.format("h[1:32], h[33:64], r[1:32], r[33:64], t[1:32], t[33:64]", "(z[1]*z[3] - z[2]*z[4]) * z[5] + (z[1]*z[4] + z[2]*z[3]) * z[6]"),
    "RotatE": "-sqrt(" + _Z.format("h[1:32], h[33:64], r[1:32], r[33:64], t[1:32], t[33:64]", "pow((z[1]*z[3] - z[2]*z[4]) / sqrt(z[3]*z[3] + z[4]*z[4]) - z[5], 2) + pow((z[1]*z[4] + z[2]*z[3]) / sqrt(z[3]*z[3] + z[4]*z[4]) - z[6], 2)") + ")",
}


def _score(model: str, spark, sf_dir):
    e, r, triples = _space(spark, sf_dir)
    return embeddings.vectors_of(triples, e, r).select("s", "p", "o", (F.round(embeddings.score(model, F.col("h"), F.col("r"), F.col("t"), 64), 4) + 0.0).alias("score"))


for _model, _sql in _SCORES.items():
    query(f"score_{_model.lower()}", f"WITH {SPACE} SELECT s, p, o, round({_sql}, 4) + 0.0 AS score FROM x")(partial(_score, _model))

RANKS = f"""q AS (SELECT 'tail' AS side, s, p, o, list_transform(list_zip(h, r), lambda z: z[1] + z[2]) AS q, t AS own, o AS hidden FROM x
  UNION ALL SELECT 'head', s, p, o, list_transform(list_zip(t, r), lambda z: z[1] - z[2]), h, s FROM x),
own AS (SELECT *, {_Z.format("q, own", "-abs(z[1] - z[2])")} AS true FROM q),
sc AS (SELECT side, own.s, own.p, own.o, true, {_Z.format("q, e.v", "-abs(z[1] - z[2])")} AS score FROM own JOIN e ON e.id <> hidden
  WHERE NOT EXISTS (FROM tr k WHERE k.p = own.p AND ((side = 'tail' AND k.s = own.s AND k.o = e.id) OR (side = 'head' AND k.o = own.o AND k.s = e.id)))),
ranks AS (SELECT side, s, p, o, 1 + count_if(score > true) AS optimistic, 1 + count_if(score >= true) AS pessimistic, 1 + count_if(score > true) + count_if(score = true) / 2 AS realistic FROM sc GROUP BY ALL)""".replace("AS true", "AS fit").replace(" true,", " fit,").replace("> true", "> fit").replace(">= true", ">= fit").replace("= true", "= fit")


def _ranks(spark, sf_dir):
    e, r, triples = _space(spark, sf_dir)
    return embeddings.filtered_ranks("TransE", triples, triples, e, r, 64)


@query("filtered_ranks", f"WITH {SPACE}, {RANKS} SELECT side, s, p, o, optimistic::BIGINT AS optimistic, pessimistic::BIGINT AS pessimistic, realistic::DOUBLE AS realistic FROM ranks")
def filtered_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query("rank_metrics", f"WITH {SPACE}, {RANKS} SELECT round(avg(1 / realistic), 4) AS mrr, avg((realistic <= 10)::INT)::DOUBLE AS hits_at_10, count(*) AS n FROM ranks")
def rank_metrics(spark, sf_dir):
    m = embeddings.rank_metrics(_ranks(spark, sf_dir), 1).where("side = 'both' and policy = 'realistic'")
    value = lambda n: F.max(F.when(F.col("metric") == n, F.col("value")))
    return m.agg(F.round(value("mrr"), 4).alias("mrr"), value("hits_at_10").alias("hits_at_10"), value("count").cast("long").alias("n"))


@query("bernoulli_stats", f"WITH {EDGES}, a AS (SELECT p, avg(k) AS tph FROM (SELECT p, s, count(DISTINCT o) AS k FROM edges GROUP BY ALL) GROUP BY p), b AS (SELECT p, avg(k) AS hpt FROM (SELECT p, o, count(DISTINCT s) AS k FROM edges GROUP BY ALL) GROUP BY p) SELECT p, round(tph, 4) AS tph, round(hpt, 4) AS hpt, round(tph / (tph + hpt), 4) AS head_probability FROM a JOIN b USING (p)")
def bernoulli_stats(spark, sf_dir):
    r = lambda c: F.round(c, 4).alias(c)
    return embeddings.bernoulli_stats(bridge.edges(spark, sf_dir)).select("p", r("tph"), r("hpt"), r("head_probability"))


_DRAW = "('0x' || substr(md5(s || '|' || tr.p || '|' || o || '|' || k || '|42|{}'), 1, 8))::UBIGINT::BIGINT"


@query(
    "negatives",
    f"""WITH {SPACE}, a AS (SELECT p, avg(k) AS tph FROM (SELECT p, s, count(DISTINCT o) AS k FROM tr GROUP BY ALL) GROUP BY p), b AS (SELECT p, avg(k) AS hpt FROM (SELECT p, o, count(DISTINCT s) AS k FROM tr GROUP BY ALL) GROUP BY p),
    d AS (SELECT s, tr.p, o, k, {_DRAW.format("side")} / 4294967296.0::DOUBLE < tph / (tph + hpt) AS head, ({_DRAW.format("entity")} * n) >> 32 AS other FROM tr JOIN a ON tr.p = a.p JOIN b ON tr.p = b.p, n, range(4) AS r(k))
    SELECT CASE WHEN head THEN other ELSE s END AS s, p, CASE WHEN head THEN o ELSE other END AS o, k::INT AS k FROM d""",
)
def negatives(spark, sf_dir):
    """Each triple is corrupted four times: which end, and by which entity."""
    e, _, triples = _space(spark, sf_dir)
    return embeddings.negatives(triples, e, 4)


KNN = "a AS (SELECT id, v FROM e WHERE id IN (1, 7, 42)), s AS (SELECT a.id AS anchor, e.id, list_cosine_similarity(a.v, e.v) AS c FROM a JOIN e ON a.id <> e.id)"


@query("knn", f"WITH {SPACE}, {KNN} SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY c DESC, id)::INT AS rank, id, round(c, 4) AS similarity FROM s QUALIFY rank <= 10")
def knn(spark, sf_dir):
    e, _, _ = _space(spark, sf_dir)
    return embeddings.nearest(e.where(F.col("id").isin(1, 7, 42)), e, 10).select("anchor", "rank", "id", F.round("similarity", 4).alias("similarity"))


@query("anchor_matrix", f"WITH {SPACE} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM e a, e b WHERE a.id < 7 AND b.id < 7")
def anchor_matrix(spark, sf_dir):
    e, _, _ = _space(spark, sf_dir)
    return embeddings.anchor_matrix(e.where("id < 7")).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query(
    "analogy",
    f"""WITH {SPACE}, q AS (SELECT list_transform(list_zip(a.v, b.v, c.v), lambda z: z[1] + z[2] + z[3]) AS v FROM e a, e b, e c WHERE a.id = 9 AND b.id = 0 AND c.id = 1),
    s AS (SELECT e.id, list_cosine_similarity(q.v, e.v) AS c FROM q, e WHERE e.id <> 9)
    SELECT row_number() OVER (ORDER BY c DESC, id)::INT AS rank, id, round(c, 4) AS similarity, id = 0 AS hit FROM s QUALIFY rank <= 10""",
)
def analogy(spark, sf_dir):
    e, r, _ = _space(spark, sf_dir)
    return embeddings.analogy(e.where("id = 9"), [r.where("id = 0"), r.where("id = 1")], e, 0, 10).select("rank", "id", F.round("similarity", 4).alias("similarity"), "hit")


CLASSES = f"""c AS (SELECT uri, CASE WHEN contains(uri, 'Supplier') THEN 'VC Firm' WHEN contains(uri, 'Nation') THEN 'Organization' WHEN contains(uri, 'Order') THEN 'Person' ELSE 'Other' END AS class FROM (SELECT s AS uri FROM edges UNION SELECT o FROM edges))"""


def _classes(spark, sf_dir):
    all_ = bridge.triples(spark, sf_dir)
    edges = bridge.edges(spark, sf_dir)
    ids = ts.entity_ids(edges)
    return embeddings.entity_classes(ids, all_.where(F.col("o") == NS + "Supplier"), edges, instance_of=NS + "inRegion", signals=(NS + "placedBy",), classes={f"Region{k}": "Organization" for k in range(5)}, own={"Supplier": "VC Firm"})


@query("class_assign", f"WITH {EDGES}, {CLASSES} SELECT uri, class FROM c")
def class_assign(spark, sf_dir):
    return _classes(spark, sf_dir).select("uri", "class")


@query("class_distribution", f"WITH {EDGES}, {CLASSES} SELECT class, count(*) AS n FROM c GROUP BY 1")
def class_distribution(spark, sf_dir):
    return embeddings.class_distribution(_classes(spark, sf_dir))


@query("normalised", f"WITH {SPACE} SELECT id, round(list_sum(list_transform(v, lambda z: abs(z))) / sqrt(list_sum(list_transform(v, lambda z: z * z))), 4) AS size FROM e")
def normalised(spark, sf_dir):
    e, _, _ = _space(spark, sf_dir)
    return e.select("id", F.round(F.aggregate(embeddings.normalised(F.col("v")), F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("size"))


@query("plane")
def plane(spark, sf_dir):
    e, _, _ = _space(spark, sf_dir)
    return embeddings.plane(e)


@query("train_transe")
def train_transe(spark, sf_dir):
    """All links, a few epochs: entity vectors."""
    x, e, r = bridge.coded_edges(spark, sf_dir)
    config = trainer.Config("TransE", dim=16, epochs=3, batch=8, negatives=4, rate=0.05, loss="nssa", margin=3.0)
    blocks, _, _ = trainer.fit(x, config, e.count(), r.count(), partitions=2)
    return trainer.parameters(blocks, "e", config, "float").join(e, "id").select("id", "uri", F.col("v").cast("array<double>").alias("v"))


# --- rules -------------------------------------------------------------------------------------------


@query("rule_threshold", "SELECT 'Customer' || c_custkey AS name, round(c_acctbal, 2)::DOUBLE AS value FROM customer WHERE round(c_acctbal, 2) > 9000")
def rule_threshold(spark, sf_dir):
    g = bridge.triples(spark, sf_dir).where(F.contains("s", F.lit("Customer")))
    return rules.threshold_rule(g, NS + "balance", 9000, NS + "Rich").select("name", F.col("value").cast("double").alias("value"))


@query(
    "rule_two_premise",
    f"""WITH {EDGES}, f AS (SELECT DISTINCT a.s, b.o FROM edges a JOIN edges b ON a.o = b.s WHERE a.p = '{NS}placedBy' AND b.p = '{NS}inNation')
    SELECT s, o, FALSE AS asserted FROM f""",
)
def rule_two_premise(spark, sf_dir):
    rule = rules.parse_rule("Customer(?c), placedBy(?o, ?c), inNation(?c, ?n) -> inNation(?o, ?n)")
    return rules.apply(rule, bridge.triples(spark, sf_dir)).select("s", "o", "asserted")


@query(
    "rule_chain",
    f"""WITH {EDGES} SELECT x.s, x.o FROM edges x WHERE x.p = '{NS}inRegion' UNION SELECT a.s, b.o FROM edges a JOIN edges b ON a.o = b.s WHERE a.p = '{NS}inNation' AND b.p = '{NS}inRegion'
    UNION SELECT o.s, b.o FROM edges o JOIN edges a ON o.o = a.s JOIN edges b ON a.o = b.s WHERE o.p = '{NS}placedBy' AND a.p = '{NS}inNation' AND b.p = '{NS}inRegion'""",
)
def rule_chain(spark, sf_dir):
    """Two rules to a fixpoint: what is placed by a customer is in the customer's nation, what is in a nation is in its region."""
    made = [rules.parse_rule(x) for x in ("placedBy(?o, ?c), inNation(?c, ?n) -> inNation(?o, ?n)", "inNation(?x, ?n), inRegion(?n, ?r) -> inRegion(?x, ?r)")]
    g = bridge.triples(spark, sf_dir).where(F.col("p").isin(NS + "placedBy", NS + "inNation", NS + "inRegion"))
    return rules.closure(g, made).where(F.col("p") == NS + "inRegion").select("s", "o")


@query(
    "entail_closure",
    f"""WITH {NAMED}, sub(a, b) AS (VALUES ('Customer', 'Agent'), ('Supplier', 'Agent'), ('Agent', 'Thing'), ('Nation', 'Place'), ('Region', 'Place'), ('Place', 'Thing')),
    up AS (SELECT a, b FROM sub UNION SELECT x.a, y.b FROM sub x JOIN sub y ON x.b = y.a)
    SELECT s, regexp_replace(c, '^.*#', '') AS class FROM named UNION SELECT s, b FROM named JOIN up ON a = regexp_replace(c, '^.*#', '')""",
)
def entail_closure(spark, sf_dir):
    from quillgraph.schemas import TRIPLES as SCHEMA

    tree = (("Customer", "Agent"), ("Supplier", "Agent"), ("Agent", "Thing"), ("Nation", "Place"), ("Region", "Place"), ("Place", "Thing"))
    onto = spark.createDataFrame([(NS + a, RDFS + "subClassOf", NS + b, "uri", None, None) for a, b in tree], SCHEMA)
    g = bridge.triples(spark, sf_dir).where(F.col("p") == RDF + "type").unionByName(onto)
    return rules.entailed(g).where(F.col("p") == RDF + "type").select("s", X.local_name(F.col("o")).alias("class"))


# --- graph-pattern queries ------------------------------------------------------------------------------

_PREFIX = f"PREFIX : <{NS}> PREFIX rdf: <{RDF}> PREFIX rdfs: <{RDFS}> PREFIX xsd: <{XSD}> "
U = lambda kind, key: f"'{NS}{kind}' || {key}"

SPARQL: dict[str, tuple[str, str]] = {
    "bgp": ("SELECT ?c ?r WHERE { ?o :placedBy ?c . ?c :inNation ?n . ?n :inRegion ?r }", f"SELECT {U('Customer', 'o_custkey')} AS c, {U('Region', 'n_regionkey')} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "star": ("SELECT ?s ?name ?b WHERE { ?s a :Supplier ; rdfs:label ?name ; :balance ?b ; :inNation :Nation3 }", f"SELECT {U('Supplier', 's_suppkey')} AS s, s_name AS name, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS b FROM supplier WHERE s_nationkey = 3"),
    "chain": ("SELECT ?s ?r WHERE { ?s :supplies :Part1 . ?s :inNation ?n . ?n :inRegion ?r }", f"SELECT DISTINCT {U('Supplier', 's_suppkey')} AS s, {U('Region', 'n_regionkey')} AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey = 1"),
    "distinct": ("SELECT DISTINCT ?n WHERE { ?o :placedBy ?c . ?c :inNation ?n }", f"SELECT DISTINCT {U('Nation', 'c_nationkey')} AS n FROM orders JOIN customer ON o_custkey = c_custkey"),
    "optional": ('SELECT ?c ?o WHERE { ?c :inNation :Nation5 OPTIONAL { ?o :placedBy ?c . FILTER (STRENDS(STR(?o), "0")) } FILTER (CONTAINS(STR(?c), "Customer")) }', f"SELECT {U('Customer', 'c_custkey')} AS c, {U('Order', 'o_orderkey')} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 10 = 0 WHERE c_nationkey = 5"),
    "union": ("SELECT ?x WHERE { { ?x :inRegion :Region1 } UNION { ?x :inNation :Nation1 } }", f"SELECT {U('Nation', 'n_nationkey')} AS x FROM nation WHERE n_regionkey = 1 UNION ALL SELECT {U('Customer', 'c_custkey')} FROM customer WHERE c_nationkey = 1 UNION ALL SELECT {U('Supplier', 's_suppkey')} FROM supplier WHERE s_nationkey = 1"),
    "minus": ("SELECT ?x WHERE { ?x a :Part MINUS { ?o :contains ?x } }", f"SELECT {U('Part', 'p_partkey')} AS x FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"),
    "values": ("SELECT ?s ?n WHERE { VALUES ?s { :Supplier1 :Supplier2 :Supplier999999 } ?s :inNation ?n }", f"SELECT {U('Supplier', 's_suppkey')} AS s, {U('Nation', 's_nationkey')} AS n FROM supplier WHERE s_suppkey IN (1, 2)"),
    "bind": ('SELECT ?t WHERE { ?s a :Region ; rdfs:label ?l BIND (CONCAT(LCASE(?l), "!") AS ?t) }', "SELECT lower(r_name) || '!' AS t FROM region"),
    "filter_lang": ('SELECT ?s ?l WHERE { ?s a :Nation ; rdfs:label ?l FILTER (langMatches(lang(?l), "en") && lang(?l) != "en-GB") }', f"SELECT {U('Nation', 'n_nationkey')} AS s, n_name AS l FROM nation"),
    "filter_str": ('SELECT ?s WHERE { ?s a :Part ; rdfs:label ?l FILTER (REGEX(?l, "^[a-m]", "i") && STRLEN(?l) > 8) }', f"SELECT {U('Part', 'p_partkey')} AS s FROM part WHERE regexp_matches(p_name, '(?i)^[a-m]') AND length(p_name) > 8"),
    "filter_number": ("SELECT ?s WHERE { ?s :balance ?b FILTER (?b > 9000 || ?b < -900) }", f"SELECT {U('Customer', 'c_custkey')} AS s FROM customer WHERE round(c_acctbal, 2) > 9000 OR round(c_acctbal, 2) < -900 UNION ALL SELECT {U('Supplier', 's_suppkey')} FROM supplier WHERE round(s_acctbal, 2) > 9000 OR round(s_acctbal, 2) < -900"),
    "filter_kind": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o FILTER (!isLiteral(?o) && ?p != rdf:type) } GROUP BY ?p", f"WITH {EDGES} SELECT p, count(*)::VARCHAR AS n FROM edges GROUP BY p"),
    "order_limit": ("SELECT ?s ?b WHERE { ?s a :Customer ; :balance ?b } ORDER BY DESC(?b) ?s LIMIT 10 OFFSET 5", f"SELECT {U('Customer', 'c_custkey')} AS s, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS b FROM customer ORDER BY CAST(c_acctbal AS DECIMAL(18,2)) DESC, s LIMIT 10 OFFSET 5"),
    "group_count": ("SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c a :Customer ; :inNation ?n } GROUP BY ?n HAVING (COUNT(?c) > 50)", f"SELECT {U('Nation', 'c_nationkey')} AS n, count(*)::VARCHAR AS k FROM customer GROUP BY c_nationkey HAVING count(*) > 50"),
    "count_distinct": ("SELECT (COUNT(DISTINCT ?n) AS ?k) (COUNT(?c) AS ?all) WHERE { ?o :placedBy ?c . ?c :inNation ?n }", "SELECT count(DISTINCT c_nationkey)::VARCHAR AS k, count(*)::VARCHAR AS \"all\" FROM orders JOIN customer ON o_custkey = c_custkey"),
    "exists": ("SELECT ?c WHERE { ?c a :Customer FILTER EXISTS { ?o :placedBy ?c } FILTER NOT EXISTS { ?c :inNation :Nation2 } }", f"SELECT {U('Customer', 'c_custkey')} AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_nationkey <> 2"),
    "path": ("SELECT DISTINCT ?r WHERE { :Supplier1 (:inNation|:supplies)/:inRegion ?r }", f"SELECT DISTINCT {U('Region', 'n_regionkey')} AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1"),
    "path_closure": ("SELECT ?x WHERE { :Supplier1 (:inNation|:inRegion)+ ?x }", f"SELECT {U('Nation', 's_nationkey')} AS x FROM supplier WHERE s_suppkey = 1 UNION SELECT {U('Region', 'n_regionkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1"),
    "path_inverse": ("SELECT ?a ?b WHERE { ?a :inRegion/^:inRegion ?b FILTER (?a != ?b) }", f"SELECT {U('Nation', 'a.n_nationkey')} AS a, {U('Nation', 'b.n_nationkey')} AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "subquery": ("SELECT ?c ?k WHERE { ?c :inNation :Nation4 { SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o :placedBy ?c } GROUP BY ?c } }", f"SELECT {U('Customer', 'c_custkey')} AS c, count(*)::VARCHAR AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 4 GROUP BY c_custkey"),
    "triangle": ("SELECT ?o ?s ?p WHERE { ?o :contains ?p . ?s :supplies ?p . ?s :inNation ?n . ?o :placedBy ?c . ?c :inNation ?n }", f"WITH a AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT {U('Order', 'a.o')} AS o, {U('Supplier', 'b.s')} AS s, {U('Part', 'a.p')} AS p FROM a JOIN b ON a.p = b.p JOIN supplier ON s_suppkey = b.s JOIN orders ON o_orderkey = a.o JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey"),
}


def _pattern(text: str, spark, sf_dir):
    return sparql.select(bridge.triples(spark, sf_dir), _PREFIX + text)


for _name, (_text, _sql) in SPARQL.items():
    query(f"sparql_{_name}", _sql)(partial(_pattern, _text))


@query("schema_predicates", f"WITH {TRIPLES} SELECT DISTINCT p AS uri FROM triples")
def schema_predicates(spark, sf_dir):
    return questions.predicates(bridge.triples(spark, sf_dir))


@query("schema_classes", f"WITH {NAMED} SELECT DISTINCT c AS uri FROM named")
def schema_classes(spark, sf_dir):
    return questions.classes(bridge.triples(spark, sf_dir))


@query("sample_triples", f"WITH {TRIPLES} SELECT s, p, o FROM triples WHERE NOT (k = 'literal' AND p <> '{RDFS}label') ORDER BY s, p, o LIMIT 15")
def sample_triples(spark, sf_dir):
    return questions.samples(bridge.triples(spark, sf_dir))


@query("entities_by_class", "SELECT 'kg:Nation' || n_nationkey AS short, n_name AS label FROM nation ORDER BY short LIMIT 30")
def entities_by_class(spark, sf_dir):
    return questions.entities_of(bridge.triples(spark, sf_dir), NS + "Nation", questions.prefixes())


@query("ambiguity_cases", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in mentions.AMBIGUITIES) + ") AS v(entity, label, problem, resolution)")
def ambiguity_cases(spark, sf_dir):
    return mentions.ambiguity_cases(spark)


from quillgraph import flows  # noqa: E402, F401  it registers further queries
