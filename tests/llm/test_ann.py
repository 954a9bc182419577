import numpy as np
import pytest

from quillgraph.llm import ann as A


def brute(ids, vectors, k=5, every=50):
    v = vectors.astype(np.float64)
    n = np.sqrt((v * v).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (v * v[i]).sum(axis=1) / (n * n[i])
        rest = np.flatnonzero(ids != ids[i])
        best = rest[np.lexsort((ids[rest], -score[rest]))[:k]]
        out[ids[i]] = [(int(ids[b]), score[b]) for b in best]
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {b for b, _ in best})
        total += len(best)
    return hits / total


@pytest.mark.parametrize("kind", ["noise", "clusters", "copies"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(A, "BLOCK_ROWS", 700)
    monkeypatch.setattr(A, "CHUNK_BYTES", 20 * 64 * 8)
    monkeypatch.setattr(A, "AT_ONCE", 9)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64)).astype(np.float32)
    if kind == "clusters":
        v = (v * 0.3 + rng.normal(size=(20, 64))[rng.integers(0, 20, 3000)]).astype(np.float32)
    if kind == "copies":
        v[rng.random(3000) < 0.4] = v[7]
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), x.tolist(), 1) for i, x in zip(ids, v)], "vec_id long, embedding array<float>, rank int")
    found = A.search(df, df.where("vec_id % 50 = 0")).collect()
    want = brute(ids, v)
    assert recall(found, want) >= 0.95
    exact = {(q, b): s for q, best in want.items() for b, s in best}
    assert all(r.score == exact[r.query_id, r.vec_id] for r in found if (r.query_id, r.vec_id) in exact)


def test_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (100, None)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    found = sorted((r.query_id, r.rank, r.vec_id) for r in A.search(df, df.where("vec_id % 50 = 0")).collect())
    assert found == [(0, 1, 1), (0, 2, 8), (0, 3, 50), (0, 4, 50)] + sorted([(50, k, v) for k, v in ((1, 8), (2, 0), (3, 1))] * 2)
    assert A.search(df.limit(0), df.limit(0)).count() == 0


def test_huge_and_tiny_components(spark):
    rows = [(0, [1e300, 1e300]), (1, [3e-310, 0.0]), (2, [1e300, 0.0]), (3, [1.0, 1.0]), (50, [1e-300, 2e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id): r.score for r in A.search(df, df.where("vec_id % 50 = 0")).collect()}
    assert len(found) == 8 and found[0, 3] == pytest.approx(1) and found[0, 1] == pytest.approx(0.5**0.5) and found[0, 2] == pytest.approx(0.5**0.5) and found[50, 0] == pytest.approx(3 / 10**0.5)


def test_chi_square():
    assert abs(A.chi_square_cdf(A.chi_square_quantile(0.95, 8), 8) - 0.95) < 1e-9
    assert abs(A.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
