"""Services over HTTP, with a stand-in for the network."""

import json

import pytest

from quillgraph.sources import remote


def service(kind):
    """Fetchers are made inside a function, so that they travel to the workers by value."""

    def fetch(address, body=None):
        if kind == "broken":
            raise OSError(address)
        if kind == "count":  # answers with the number of addresses in the request, as the label of a name of its own
            n = body.decode().count("%3Chttp%3A%2F%2Fe%23")
            return json.dumps({"results": {"bindings": [{"s": {"value": f"http://n#{hash(body)}"}, "l": {"value": str(n)}}]}}).encode()
        return b"<html>" if kind == "nonsense" else b"{}"

    return fetch


@pytest.mark.parametrize("kind", ["broken", "nonsense", "empty"])
def test_failures_give_no_rows(spark, kind):
    fetch = service(kind)
    rows = spark.createDataFrame([("a",), (None,)], "x string")
    assert remote.search(rows.toDF("label"), "http://x", fetch).count() == 0
    assert remote.claims(rows.toDF("uri"), "http://x", 5, fetch).count() == 0
    assert remote.labels(rows.toDF("uri"), "http://x", fetch).count() == 0
    assert remote.bindings("http://x", "SELECT * {}", fetch) == []
    assert remote.models("http://x", fetch) == ([] if kind == "empty" else None)


def test_addresses_go_in_batches(spark):
    rows = spark.createDataFrame([(f"http://e#{k}",) for k in range(120)], "uri string").coalesce(1)
    found = [int(r.label) for r in remote.labels(rows, "http://x", service("count")).collect()]
    assert max(found) <= remote.BATCH and len(found) >= 3


def test_model_and_health():
    def fetch(address, body=None):
        if address.endswith("/api/tags"):
            return json.dumps({"models": [{"name": "small"}]}).encode()
        asked = json.loads(body)
        return json.dumps({"response": f"{asked['model']} heard {asked['prompt']}"}).encode()

    assert remote.models("http://x", fetch) == ["small"]
    assert remote.model("http://x", "small", fetch)("hello") == "small heard hello"
    with pytest.raises(OSError):
        remote.model("http://x", "small", service("broken"))("hello")
