"""Services over HTTP: entity search, claims and labels of a SPARQL endpoint, a language model.

All go through ``fetch``, (address, body or None) -> bytes, so that a test, a
cache or a politer client can stand in for the network. Requests are made where
the rows are; one that fails gives no rows and stops nothing. The tables have the
schemas of the operators that read them: candidates, triples, labels.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.schemas import BLANK, CANDIDATES, LITERAL, RDFS, TRIPLES, URI

Fetch = Callable[[str, bytes | None], bytes]
#: Hits of a search that are kept, addresses in one request for labels, and seconds to wait.
HITS, BATCH, PATIENCE = 5, 50, 30


def http(address: str, body: bytes | None = None) -> bytes:
    """GET, or POST of a body: JSON if it looks like it, else a form."""
    kind = "application/json" if body and body[:1] == b"{" else "application/x-www-form-urlencoded"
    head = {"Accept": "application/sparql-results+json, application/json", "User-Agent": "quillgraph/1.0", **({"Content-Type": kind} if body else {})}
    with urllib.request.urlopen(urllib.request.Request(address, body, head), timeout=PATIENCE) as answer:
        return answer.read()


def _read(fetch: Fetch, address: str, body: bytes | None = None):
    """The JSON answer, None for a failure of any kind."""
    try:
        return json.loads(fetch(address, body))
    except Exception:
        return None


def search(labels: DataFrame, endpoint: str, fetch: Fetch = http, hits: int = HITS, lang: str = "en") -> DataFrame:
    """Candidates (label, rank from 1, qid, wd_label, wd_desc) of distinct labels, as a search service ranks them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for label in batch.label:
                asked = urlencode({"action": "wbsearchentities", "search": label, "language": lang, "format": "json", "limit": hits})
                found = (_read(fetch, f"{endpoint}?{asked}") or {}).get("search") or []
                rows += [(label, k, x.get("id"), x.get("label"), x.get("description")) for k, x in enumerate(found[:hits], 1)]
            yield pd.DataFrame(rows, columns=["label", "rank", "qid", "wd_label", "wd_desc"])

    return labels.select("label").where("label is not null").distinct().mapInPandas(run, CANDIDATES)


def bindings(endpoint: str, query: str, fetch: Fetch = http) -> list[dict]:
    """Rows of a SELECT, a term per variable as the result format has them; none after a failure."""
    found = _read(fetch, endpoint, urlencode({"query": query, "format": "json"}).encode())
    return ((found or {}).get("results") or {}).get("bindings") or []


def claims(seeds: DataFrame, endpoint: str, limit: int, fetch: Fetch = http) -> DataFrame:
    """Triples of every seed (uri), at most so many each: a table for ``expansion`` to grow from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"uri": URI, "bnode": BLANK}
        for batch in batches:
            rows = []
            for uri in batch.uri:
                for x in bindings(endpoint, f"SELECT ?p ?o WHERE {{ <{uri}> ?p ?o }} ORDER BY ?p ?o LIMIT {limit}", fetch):
                    o = x["o"]
                    rows.append((uri, x["p"]["value"], o["value"], kinds.get(o["type"], LITERAL), o.get("xml:lang"), o.get("datatype")))
            yield pd.DataFrame(rows, columns=["s", "p", "o", "o_kind", "o_lang", "o_dtype"], dtype=object)

    return seeds.select("uri").where("uri is not null").distinct().mapInPandas(run, TRIPLES)


def labels(uris: DataFrame, endpoint: str, fetch: Fetch = http, lang: str = "en") -> DataFrame:
    """uri, label of those that have one, ``BATCH`` of them in a request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, names = [], batch.uri.tolist()
            for k in range(0, len(names), BATCH):
                asked = " ".join(f"<{u}>" for u in names[k : k + BATCH])
                query = f'SELECT ?s ?l WHERE {{ VALUES ?s {{ {asked} }} ?s <{RDFS}label> ?l FILTER (LANG(?l) = "{lang}") }}'
                rows += [(x["s"]["value"], x["l"]["value"]) for x in bindings(endpoint, query, fetch)]
            yield pd.DataFrame(rows, columns=["uri", "label"], dtype=object)

    asked = uris.select("uri").where("uri is not null").distinct()
    return asked.mapInPandas(run, "uri string, label string").groupBy("uri").agg(F.min("label").alias("label"))


def model(endpoint: str, name: str, fetch: Fetch = http) -> Callable[[str], str]:
    """A language model behind an HTTP service, as the question loop takes it: text in, text out. Failures are raised."""

    def ask(prompt: str) -> str:
        return json.loads(fetch(f"{endpoint}/api/generate", json.dumps({"model": name, "prompt": prompt, "stream": False}).encode())).get("response", "")

    return ask


def models(endpoint: str, fetch: Fetch = http) -> list[str] | None:
    """What the service offers; None if it doesn't answer. The health check."""
    found = _read(fetch, f"{endpoint}/api/tags")
    return None if found is None else [x["name"] for x in found.get("models", [])]
