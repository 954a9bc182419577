"""Turtle and RDF/XML: ontologies and graphs, a file parsed where it is read, Turtle statement by statement; Turtle is written by Spark."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.sparql_parser import Group, Parser, SparqlError, Term, Var, token, unescaped
from quillgraph.schemas import BLANK, LITERAL, RDF, TRIPLES, URI, XSD
from quillgraph.sources.ntriples import _escaped

#: Triples that a batch of a parsed file holds.
PARSED = 50_000
#: Subjects in a file that is written.
SUBJECTS = 10_000
_URI, _STRING = r'<[A-Za-z][\w+.-]*:[^<>"{}|^`\\\x00-\x20]*+>', r'"(?:[^"\\\n]|\\.)*+"(?!")'
_OBJECT = rf"(?:{_URI}|{_STRING}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*+|\^\^{_URI})?+)"
_PREDICATE = rf"(?:a|{_URI})\s++{_OBJECT}(?:\s*+,\s*+{_OBJECT})*+"
#: A statement of whole names and short strings, and its parts: separators, names, strings with a language or a type.
PLAIN = re.compile(rf"\s*+({_URI})\s++({_PREDICATE}(?:\s*+;\s*+{_PREDICATE})*+)\s*+\.(?![\w.])")
PARTS = re.compile(rf'([,;])|(a)(?=\s)|<([^>]*+)>|"((?:[^"\\\n]|\\.)*+)"(?:@([A-Za-z0-9-]++)|\^\^<([^>]*+)>)?+')
Row = tuple[str, str, str, str, str | None, str | None]


class _Turtle(Parser):
    """Statements share the query language's terms and property lists."""

    def __init__(self, text: str):
        super().__init__("")
        self.text, self.place, self.toks = text, 0, []

    @property
    def now(self) -> tuple[str, str]:
        """The next token; the tokens of one statement are held at a time."""
        if self.at == len(self.toks):
            self.toks, self.at = self.toks[-1:], min(self.at, 1)
            while not self.toks[self.at :] or self.toks[-1] not in (("sign", "."), ("end", "")):
                self.place, found = token(self.text, self.place)
                if found:
                    self.toks.append(found)
        return self.toks[self.at]

    def statements(self) -> Iterator[Row]:
        """The rows in the order written. Statements of whole names and short strings are read by one pattern, others by the grammar."""
        while True:
            while self.at == len(self.toks) and (m := PLAIN.match(self.text, self.place)):
                self.place = m.end()
                s, p, kept = m[1][1:-1], "", True
                for sign, a, name, string, lang, dtype in PARTS.findall(m[2]):
                    if sign:
                        kept = sign == ";"
                    elif kept:
                        p, kept = RDF + "type" if a else name, False
                    elif name:
                        yield s, p, name, URI, None, None
                    else:
                        yield s, p, unescaped(string) if "\\" in string else string, LITERAL, lang.lower() or None, dtype or None
            if self.now[0] == "end":
                return
            found = Group()
            directive = self.now[0] == "lang" and self.now[1][1:] or (self.now[1].lower() if self.ahead("PREFIX", "BASE") else None)
            if directive in ("prefix", "base"):
                old = self.now[0] == "lang"
                self.at += 1
                if directive == "base":
                    self.base = self._take("uri")[1:-1]
                else:
                    name = self._take("pname")
                    self.prefixes[name[:-1]] = self._resolve("uri", self._take("uri"))
                if old:
                    self.need(".")
                continue
            self.triples(found)
            self.need(".")
            for _, s, p, o in found.elements:
                if not isinstance(p, Term) or any(isinstance(x, Var) and not x.name.startswith("_:") for x in (s, o)):
                    raise SparqlError("a graph has no variables or paths")
                yield _name(s), p.value, _name(o), BLANK if isinstance(o, Var) else o.kind, getattr(o, "lang", "") or None, getattr(o, "dtype", "") or None

    def node(self, g: Group):
        if self.sign("("):  # a collection is a chain of blank nodes
            items = []
            while not self.sign(")"):
                items.append(self.node(g))
            first = rest = Term(RDF + "nil", "uri")
            for item in reversed(items):
                first = self.new_blank()
                g.elements += [("triple", first, Term(RDF + "first", "uri"), item), ("triple", first, Term(RDF + "rest", "uri"), rest)]
                rest = first
            return first
        return super().node(g)


def parse_turtle(text: str) -> list[Row]:
    return list(dict.fromkeys(_Turtle(text).statements()))


def _name(x) -> str:
    return x.name if isinstance(x, Var) else x.value


def parse_rdfxml(text: str) -> list[Row]:
    """Node elements, typed nodes, nested nodes, property attributes, resources, literals and collections."""
    base = ""
    entities = dict(re.findall(r'<!ENTITY\s+([\w.-]+)\s+"([^"]*)"', text))
    body = re.sub(r"<!DOCTYPE.*?\]>", "", text, flags=re.S)
    for name, value in entities.items():
        body = body.replace(f"&{name};", value)
    root = ET.fromstring(body)
    xml = "{http://www.w3.org/XML/1998/namespace}"
    base = root.get(xml + "base", "")
    rows: list[Row] = []
    count = 0

    def whole(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def resolved(ref: str) -> str:
        return ref if re.match(r"[A-Za-z][\w+.-]*:", ref) else base.rstrip("#") + ref if ref.startswith("#") or not ref else base + ref

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def subject(e: ET.Element) -> str:
        if (about := e.get(f"{{{RDF}}}about")) is not None:
            return resolved(about)
        if (name := e.get(f"{{{RDF}}}ID")) is not None:
            return resolved("#" + name)
        return "_:" + e.get(f"{{{RDF}}}nodeID") if e.get(f"{{{RDF}}}nodeID") else blank()

    def node(e: ET.Element) -> str:
        s = subject(e)
        if whole(e.tag) != RDF + "Description":
            rows.append((s, RDF + "type", whole(e.tag), URI, None, None))
        for k, v in e.attrib.items():
            if not whole(k).startswith(RDF) and not k.startswith(xml):
                rows.append((s, whole(k), v, LITERAL, e.get(xml + "lang"), None))
        for p in e:
            if not isinstance(p.tag, str):
                continue
            name, inner = whole(p.tag), [c for c in p if isinstance(c.tag, str)]
            link = lambda o: rows.append((s, name, o, BLANK if o.startswith("_:") else URI, None, None))  # noqa: B023, E731
            if (ref := p.get(f"{{{RDF}}}resource")) is not None:
                link(resolved(ref))
            elif (ref := p.get(f"{{{RDF}}}nodeID")) is not None:
                link("_:" + ref)
            elif p.get(f"{{{RDF}}}parseType") == "Collection":
                rest = RDF + "nil"
                for o in reversed([node(c) for c in inner]):
                    cell = blank()
                    rows.append((cell, RDF + "first", o, BLANK if o.startswith("_:") else URI, None, None))
                    rows.append((cell, RDF + "rest", rest, BLANK if rest.startswith("_:") else URI, None, None))
                    rest = cell
                link(rest)
            elif inner:
                for c in inner:
                    link(node(c))
            else:
                rows.append((s, name, p.text or "", LITERAL, p.get(xml + "lang"), p.get(f"{{{RDF}}}datatype")))
        return s

    for e in root if whole(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return list(dict.fromkeys(rows))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a Turtle or RDF/XML file, or of all files of a folder or pattern, read through Spark so that any store will do.

    Files are parsed where they are read, by their own ending or the path's
    (``.ttl``, or else RDF/XML); a file's text fits in memory, its triples and the
    number of files are unbounded. A triple that several statements have is one.
    Blank nodes belong to their file: with several files their names tell which.
    The part files of one graph that Spark has written are one file in this.
    """
    texts = spark.read.text(path, wholetext=True)
    several, turtle = len(texts.inputFiles()) > 1, path.rstrip("/").endswith(".ttl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, file in zip(batch.column("value"), batch.column("file")):
                text, file = text.as_py(), file.as_py()
                rows = _Turtle(text).statements() if turtle or re.search(r"\.ttl(\.gz)?$", file) else iter(parse_rdfxml(text))
                if several and not file.rpartition("/")[2].startswith("part-"):
                    scope = f"_:f{zlib.crc32(file.encode()):08x}"
                    rows = ((s.replace("_:", scope, 1) if s[:2] == "_:" else s, p, o.replace("_:", scope, 1) if kind == BLANK else o, kind, lang, dtype) for s, p, o, kind, lang, dtype in rows)
                while some := list(islice(rows, PARSED)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["s", "p", "o", "o_kind", "o_lang", "o_dtype"])

    return texts.select("value", F.col("_metadata.file_path").alias("file")).mapInArrow(run, TRIPLES).dropDuplicates()


def union(*graphs: DataFrame) -> DataFrame:
    """A graph is a set: triples that several have are one."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.dropDuplicates()


def to_turtle(triples: DataFrame) -> DataFrame:
    """A line block per subject: predicates with `;`, objects with `,`. Rows are dealt by subject once, all else goes on in place."""
    name = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_dtype"), F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == LITERAL, F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)).otherwise(name(F.col("o")))
    rows = triples.select("s", F.when(F.col("p") == RDF + "type", "a").otherwise(name(F.col("p"))).alias("p"), o.alias("o")).repartition("s").distinct()
    lists = rows.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), " ,\n        ").alias("os"))
    blocks = lists.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "os"))), " ;\n    ").alias("ps"))
    return blocks.select(F.concat(name(F.col("s")), F.lit(" "), F.col("ps"), F.lit(" .\n")).alias("value"))


def write(triples: DataFrame, path: str, compression: str = "none") -> None:
    """Files of so many subjects that each can be read in one piece."""
    to_turtle(triples).write.mode("overwrite").option("maxRecordsPerFile", SUBJECTS).text(path, compression=compression)


def to_rdfxml(triples: DataFrame) -> DataFrame:
    """One rdf:Description element per triple, to be framed by ``RDFXML_HEAD`` and ``RDFXML_TAIL``."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    local = F.regexp_extract("p", r"([A-Za-z_][\w.-]*)$", 1)
    space = F.expr("substr(p, 1, length(p) - length(regexp_extract(p, '([A-Za-z_][\\\\w.-]*)$', 1)))")
    about = F.when(F.startswith("s", F.lit("_:")), F.concat(F.lit('rdf:nodeID="'), F.substr("s", F.lit(3)))).otherwise(F.concat(F.lit('rdf:about="'), esc(F.col("s"))))
    attr = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"'))).when(F.col("o_dtype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), F.col("o_dtype"), F.lit('"'))).otherwise("")
    open_ = F.concat(F.lit("<x:"), local, F.lit(' xmlns:x="'), esc(space), F.lit('"'))
    value = F.when(F.col("o_kind") == LITERAL, F.concat(attr, F.lit(">"), esc(F.col("o")), F.lit("</x:"), local, F.lit(">"))).when(F.col("o_kind") == BLANK, F.concat(F.lit(' rdf:nodeID="'), F.substr("o", F.lit(3)), F.lit('"/>'))).otherwise(F.concat(F.lit(' rdf:resource="'), esc(F.col("o")), F.lit('"/>')))
    return triples.select(F.concat(F.lit("<rdf:Description "), about, F.lit('">'), open_, value, F.lit("</rdf:Description>")).alias("value"))


RDFXML_HEAD = f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}">'
RDFXML_TAIL = "</rdf:RDF>"


def write_rdfxml(triples: DataFrame, path: str) -> None:
    """For graphs that one file may hold, as its readers need a single root."""
    body = to_rdfxml(triples).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("body"))
    body.select(F.concat(F.lit(RDFXML_HEAD + "\n"), "body", F.lit("\n" + RDFXML_TAIL)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


INTEGER, DECIMAL = XSD + "integer", XSD + "decimal"
