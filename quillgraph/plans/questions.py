"""Questions to a graph: schema summary, prompt, query, repair; around a model that is passed in.

What a web service would offer is here as functions: ``schema_summary``,
``answer``, ``evaluate`` and ``events``, which yields progress as it happens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans import sparql
from quillgraph.schemas import LITERAL, NAMESPACE, OWL, RDF, RDFS, XSD

Model = Callable[[str], str]
PREDICATES, CLASSES, SAMPLES, ENTITIES, REPAIRS, SHOWN = 60, 20, 15, 30, 2, 20
#: Rows of an answer that come to the driver; that there are more is said.
MOST_ROWS = 10_000
#: What a summary leaves out: the ontology's own machinery.
SKIPPED = (OWL + "imports", OWL + "inverseOf", OWL + "subPropertyOf", RDFS + "subClassOf", RDFS + "domain", RDFS + "range", RDFS + "subPropertyOf")
LISTED = ("VCFirm", "Company", "Person", "FundingRound", "ExitEvent", "Sector")
QUESTIONS = (
    "Which VC firms invested in Airbnb?",
    "Who are the partners at Andreessen Horowitz?",
    "Which companies were founded by Ben Horowitz?",
    "Which companies had an IPO exit?",
    "Which VC firm was founded by Paul Graham, and where is it headquartered?",
    "What sector does Bloomberg operate in?",
    "List all companies that received a Series A funding round.",
)


def prefixes(namespace: str = NAMESPACE, name: str = "kg") -> dict[str, str]:
    return {name: namespace, "owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}


def prefix_block(known: dict[str, str]) -> str:
    return "\n".join(f"PREFIX {p}: <{ns}>" for p, ns in sorted(known.items()))


def shortened(uri: Column, known: dict[str, str]) -> Column:
    """prefix:name, or <uri>."""
    out = F.concat(F.lit("<"), uri, F.lit(">"))
    for p, ns in sorted(known.items(), reverse=True):
        if p != "xsd":
            out = F.when(F.startswith(uri, F.lit(ns)), F.concat(F.lit(f"{p}:"), F.substr(uri, F.lit(len(ns) + 1)))).otherwise(out)
    return out


def predicates(graph: DataFrame, namespace: str = NAMESPACE, limit: int = PREDICATES) -> DataFrame:
    """uri: distinct predicates that aren't skipped, the namespace's own first."""
    own = F.startswith("uri", F.lit(namespace))
    found = graph.select(F.col("p").alias("uri")).distinct().where(~F.col("uri").isin(*SKIPPED))
    return found.orderBy(own.desc(), "uri").limit(limit)


def classes(graph: DataFrame, namespace: str = NAMESPACE, limit: int = CLASSES) -> DataFrame:
    found = graph.where((F.col("p") == RDF + "type") & F.startswith("o", F.lit(namespace)))
    return found.select(F.col("o").alias("uri")).distinct().orderBy("uri").limit(limit)


def _english(lang: str) -> Column:
    return (F.lower(lang) == "en") | F.startswith(F.lower(lang), F.lit("en-"))


def samples(graph: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """s, p, o: the first triples that aren't machinery or in another language."""
    fine = (F.col("o_kind") != LITERAL) | F.coalesce(_english("o_lang"), F.lit(False))
    return graph.where(fine & ~F.col("p").isin(OWL + "imports", OWL + "inverseOf")).select("s", "p", "o").orderBy("s", "p", "o").limit(limit)


def entities_of(graph: DataFrame, cls: str, known: dict[str, str], limit: int = ENTITIES) -> DataFrame:
    """short, label: a row for each English label, the short name for those without one."""
    members = graph.where((F.col("p") == RDF + "type") & (F.col("o") == cls)).select("s").distinct()
    labels = graph.where((F.col("p") == RDFS + "label") & (F.col("o_kind") == LITERAL) & _english("o_lang")).select(F.col("s").alias("_s"), F.col("o").alias("label"))
    short = shortened(F.col("s"), known)
    return members.join(labels, F.col("s") == F.col("_s"), "left").select(short.alias("short"), F.coalesce("label", short).alias("label")).orderBy("short", "label").limit(limit)


def schema_summary(graph: DataFrame, namespace: str = NAMESPACE, name: str = "kg", listed: tuple[str, ...] = LISTED) -> str:
    """What a model is told of the graph; every part has a fixed number of rows."""
    known = prefixes(namespace, name)
    short = lambda c: shortened(F.col(c), known).alias(c)
    lines = ["# Prefixes", prefix_block(known), "", "# Distinct predicates"]
    lines += [f"  - {r.uri}" for r in predicates(graph, namespace).select(short("uri")).collect()]
    lines += ["", "# Distinct classes"] + [f"  - {r.uri}" for r in classes(graph, namespace).select(short("uri")).collect()]
    lines += ["", "# Sample triples"] + [f"  {r.s}  {r.p}  {r.o}" for r in samples(graph).select(short("s"), short("p"), short("o")).collect()]
    lines += ["", "# Known entities (use these names exactly)"]
    for cls in listed:
        rows = entities_of(graph, namespace + cls, known).collect()
        if rows:
            lines += [f"# {name}:{cls} instances"] + [f'  {r.short}  # "{r.label}"' for r in rows] + [""]
    return "\n".join(lines).strip()


INSTRUCTIONS = """Write one SPARQL 1.1 SELECT query that answers the question about the graph below.
Use only the prefixes that the summary declares and entity names that it lists.
Do not use SERVICE, BIND or VALUES. Give labels in English:
FILTER (langMatches(lang(?label), "en")). Answer with a single ```sparql code block."""

#: Questions of the three shapes that come up, worked: what a name links to, what links to a name, members of a class with a number.
EXAMPLES = (
    ("Where does Ann Example work?", 'SELECT ?label WHERE {{ {name}:AnnExample {name}:worksAt ?place . ?place rdfs:label ?label FILTER (langMatches(lang(?label), "en")) }}'),
    ("Who works at Example Works?", 'SELECT DISTINCT ?label WHERE {{ ?person {name}:worksAt {name}:ExampleWorks ; rdfs:label ?label FILTER (langMatches(lang(?label), "en")) }}'),
    ("How many people work at each place?", "SELECT ?place (COUNT(?person) AS ?n) WHERE {{ ?person {name}:worksAt ?place }} GROUP BY ?place ORDER BY DESC(?n)"),
)


def worked(namespace: str = NAMESPACE, name: str = "kg") -> str:
    """The worked examples, with the prefixes that a summary declares."""
    head = prefix_block({p: ns for p, ns in prefixes(namespace, name).items() if p in (name, "rdfs")})
    return "\n\n".join(f"QUESTION: {q}\n```sparql\n{head}\n{text.format(name=name)}\n```" for q, text in EXAMPLES)


def prompt(schema: str, question: str, namespace: str = NAMESPACE, name: str = "kg") -> str:
    return f"{INSTRUCTIONS}\n\nEXAMPLES (of another graph):\n{worked(namespace, name)}\n\nSUMMARY:\n{schema}\n\nQUESTION:\n{question}\n"


def repair_prompt(schema: str, question: str, query: str, error: str) -> str:
    return f"{INSTRUCTIONS}\nThe query below failed; correct it.\n\nSUMMARY:\n{schema}\n\nQUESTION:\n{question}\n\nQUERY:\n{query}\n\nERROR:\n{error}\n"


def extracted(text: str) -> str:
    """The first fenced block, or the whole text."""
    block = re.search(r"```(?:sparql)?\s*(.*?)```", text, re.I | re.S)
    return (block[1] if block else text).strip()


def rows_of(graph: DataFrame, query: str, most: int = MOST_ROWS) -> tuple[list[str], list[tuple[str, ...]], bool]:
    """Names, rows as strings (an unbound cell is the string None), and whether there were more than ``most``.

    A result is what a person reads, so it comes to the driver, but never more of it than that.
    """
    df = sparql.select(graph, query)
    rows = [tuple("None" if c is None else str(c) for c in r) for r in df.limit(most + 1).collect()]
    return df.columns, rows[:most], len(rows) > most


def answer(graph: DataFrame, schema: str, question: str, model: Model, repairs: int = REPAIRS) -> dict:
    """question, sparql, vars, rows, truncated, repairs, error. Errors go back to the model; an empty result is no error."""
    query, error = extracted(model(prompt(schema, question))), None
    for attempt in range(repairs + 1):
        try:
            names, rows, more = rows_of(graph, query)
            return {"question": question, "sparql": query, "vars": names, "rows": [list(r) for r in rows], "truncated": more, "repairs": attempt, "error": None}
        except Exception as e:  # whatever fails, the model may mend
            error = str(e)
        if attempt < repairs:
            query = extracted(model(repair_prompt(schema, question, query, error)))
    return {"question": question, "sparql": query, "vars": [], "rows": [], "truncated": False, "repairs": repairs, "error": error}


def baseline(question: str, model: Model) -> str:
    """The model alone."""
    return model(f"Answer this question as accurately as you can:\n\n{question}")


def asked(graph: DataFrame, schema: str, question: str, model: Model) -> dict:
    return {"question": question, "baseline": baseline(question, model)} | answer(graph, schema, question, model)


def events(graph: DataFrame, schema: str, model: Model, questions: tuple[str, ...] = QUESTIONS) -> Iterator[dict]:
    """progress and result for each question, then done."""
    for k, q in enumerate(questions):
        yield {"type": "progress", "index": k, "total": len(questions), "question": q}
        yield {"type": "result", "index": k} | asked(graph, schema, q, model)
    yield {"type": "done", "total": len(questions)}


def server_sent(stream: Iterator[dict]) -> Iterator[str]:
    for event in stream:
        yield f"data: {json.dumps(event)}\n\n"


def evaluate(graph: DataFrame, schema: str, model: Model, questions: tuple[str, ...] = QUESTIONS) -> list[dict]:
    return [e for e in events(graph, schema, model, questions) if e["type"] == "result"]


def shown(result: dict, most: int = SHOWN) -> str:
    """A result as text: at most so many rows."""
    if result["error"]:
        return f"error: {result['error']}"
    if not result["rows"]:
        return "no results"
    lines = [" | ".join(result["vars"])] + [" | ".join(r) for r in result["rows"][:most]]
    return "\n".join(lines + ([f"... {len(result['rows'])} rows"] if len(result["rows"]) > most else []))
