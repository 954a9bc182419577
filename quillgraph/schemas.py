"""The tables that stages exchange; every one has a fixed schema, stated as DDL."""

TRIPLES = "s string, p string, o string, o_kind string, o_lang string, o_dtype string"
RAW_DOCUMENTS = "url string, title string, text string, char_count int, status string"
CLEAN_DOCUMENTS = "url string, title string, sentences array<string>, clean_text string, sentence_count int"
ENTITY_DOCUMENTS = "url string, title string, entity_count int, entities array<struct<text:string,label:string,start:int,end:int>>"
MENTIONS = "doc_id string, label string, text string, start int, end int"
REGISTRY = "text string, label string, uri string, class_uri string"
IDS = "id bigint, uri string"
SPLIT = "s string, p string, o string, split string"
PLAIN = "s string, p string, o string"
CANDIDATES = "label string, rank int, qid string, wd_label string, wd_desc string"

#: Kinds of terms.
URI, LITERAL, BLANK = "uri", "literal", "bnode"

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
WD = "http://www.wikidata.org/entity/"
WDT = "http://www.wikidata.org/prop/direct/"
#: The graph's own names; pass another to the operators that take ``namespace``.
NAMESPACE = "http://example.org/ontology#"
