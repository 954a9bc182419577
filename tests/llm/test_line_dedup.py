import numpy as np
import pytest

from quillgraph.llm import line_dedup as L

SPACE = " \t\n\r\x0b\f"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(texts, least):
    docs = [(t or "").split("\n") for t in texts]
    seen = {}
    for d in docs:
        for k in {key(x) for x in d}:
            seen[k] = seen.get(k, 0) + 1
    often = {k for k, n in seen.items() if n >= least and k}
    return [("\n".join(x for x in d if key(x) not in often), len(d), sum(key(x) in often for x in d)) for d in docs]


TEXTS = [None, "", "\n\n", "a", "A \n b", " a\t\nb\nc", "É\né", "a\na\na", " a\nx", "tail\n", "b\nx" * 5000] + ["Shared  line\nown %d" % k for k in range(12)]


@pytest.mark.parametrize("passes", [1 << 27, 1])
def test_against_brute_force(spark, monkeypatch, passes):
    monkeypatch.setattr(L, "PASS_BYTES", passes)
    monkeypatch.setattr(L, "SHARD_KEYS", 2)
    rows = [(k % 5 or None, t, "s", 1) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, n_lines int")
    for least in (2, 3, 99):
        found = L.dedup_lines(df, ["n_lines", "doc_id"], least).toDF("x", "doc_id", "text", "n_lines", "n_dropped")
        assert sorted((r.text, r.n_lines, r.n_dropped) for r in found.collect()) == sorted(brute(TEXTS, least))
        kept = L.without_common_lines(df, least)
        assert kept.columns == df.columns
        assert sorted((r.text, r.doc_id or 0, r.shard, r.n_lines) for r in kept.collect()) == sorted((t, i or 0, s, n) for (t, _, _), (i, _, s, n) in zip(brute(TEXTS, least), rows))
    assert L.dedup_lines(df.limit(0), ["doc_id"], 2).count() == 0


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    h1, h2, n = rng.integers(0, 2**64, (3, 20_000), dtype=np.uint64)
    n = n % 1000 + 1
    h1[5] = h1[6]  # two hashes that agree in the first half
    shard = L.Shard(L.build_shard(h1, h2, n))
    assert len(shard.prints) == 20_000 - 1
    assert (shard.probe(h1, h2) == n).all()
    assert not shard.probe(h1, h2 ^ np.uint64(1)).any()
    assert not shard.probe(*rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)).any()
    assert len(L.Shard(L.build_shard(h1[:0], h2[:0], n[:0])).probe(h1[:3], h2[:3]).nonzero()[0]) == 0
