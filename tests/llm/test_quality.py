import zlib

import numpy as np
import pytest

from quillgraph.llm import quality as Q


def area(scores, y):
    wins = sum((a > b) + (a == b) / 2 for a in scores[y == 1] for b in scores[y == 0])
    return wins / ((y == 1).sum() * (y == 0).sum())


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = Q.classified(docs, labels).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    both = found.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    assert area(both.score.values, both.quality.values) > 0.95
    assert (both.predicted == both.quality).mean() > 0.9
    again = Q.classified(docs.repartition(7), labels).toPandas().set_index("doc_id").score
    assert np.allclose(again.sort_index(), found.set_index("doc_id").score.sort_index())


def test_labels_of_held_out_rows_are_never_used(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    one, two = (Q.classified(docs, x).toPandas().set_index("doc_id").score.sort_index() for x in (labels, flipped))
    assert np.allclose(one, two)


def test_ridge_by_direct_solution(spark, monkeypatch):
    """The summed normal equations against a least-squares solve over all training rows at once; also as a tree of sums."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    measured = Q.written(Q.with_statistics(docs, ["doc_id"]), "test")
    told = measured.join(labels.select("doc_id", "quality"), "doc_id").withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.lit(Q.CALIBRATION))).toPandas()
    told = told[[zlib.crc32(str(i).encode()) % 3 != 1 for i in told.doc_id]]
    every = np.array(told.statistics.tolist())
    part = told[told.turn != 0]
    for rows, tasks in ((250_000, 16), (10, 2)):
        monkeypatch.setattr(Q, "TASK_ROWS", rows)
        monkeypatch.setattr(Q, "SUM_TASKS", tasks)
        model = Q.fit(measured, labels)
        assert np.allclose(model.centre, every.mean(axis=0)) and np.allclose(model.spread, np.maximum(every.std(axis=0), 1e-6))
        z = model.lifted(np.array(part.statistics.tolist()))
        ridge = np.sqrt(Q.RIDGE * len(part) / Q.FEATURES) * np.eye(z.shape[1])
        want = np.linalg.lstsq(np.concatenate([z, ridge]), np.concatenate([part.quality.values, np.zeros(z.shape[1])]), rcond=None)[0]
        assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
        assert np.allclose(model.weights, want, atol=1e-4)


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        k = rng.integers(1, 9)
        n, s = rng.integers(1, 5, k).astype(float), np.zeros(k)
        s = np.array([rng.integers(0, x + 1) for x in n], float)
        knots, levels = Q.rising(np.arange(k, dtype=float), s, n)
        assert (np.diff(levels) > 0).all()
        # the min-max formula of isotonic regression
        mean = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
        assert sorted({round(x, 9) for x in want}) == sorted({round(x, 9) for x in levels})


@pytest.mark.parametrize("given,score", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, None)], 0.0)])
def test_rows(spark, given, score):
    rows = [(1, None), (1, ""), (None, "a b"), (7, "w " * 40000), (7, "w " * 40000)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, score string, statistics int")
    labels = spark.createDataFrame(given, "doc_id long, quality int")
    found = Q.classified(docs, labels).collect()
    assert len(found) == 5 and {r.score for r in found} == {score} and not any(r.held_out for r in found if r.doc_id is None)
    assert Q.classified(docs.limit(0), labels).count() == 0
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == (5 if score >= 0.5 else 0)


def test_a_tree_of_sums_gives_the_same_model(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    one = Q.classified(docs, labels).toPandas().set_index("doc_id").score.sort_index()
    monkeypatch.setattr(Q, "SUM_TASKS", 2)
    monkeypatch.setattr(Q, "TASK_ROWS", 5)
    monkeypatch.setattr(Q, "FAN", 3)
    assert np.allclose(one, Q.classified(docs, labels).toPandas().set_index("doc_id").score.sort_index())
