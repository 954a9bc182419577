import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillgraph.operators import alignment, embeddings, expansion, rules, trainer
from quillgraph.operators import training_set as ts
from quillgraph.schemas import NAMESPACE, OWL, RDF, RDFS, TRIPLES, WD, WDT, XSD
from quillgraph.sources import turtle

SCHEMA = "s string, p string, o string"


# --- training set ---


def test_reasons(spark):
    p = "http://www.wikidata.org/prop/direct/"
    lines = {
        "a b": "malformed", "_:x <http://p> <http://o> .": "non-uri subject", "<http://s> p <http://o> .": "malformed", f'<http://s> <{p}P569> "1" .': "literal predicate", f"<http://s> <{p}P21> <http://o> .": "hub",
        f"<http://s> <{RDF}type> <http://o> .": "schema predicate", '<http://s> <http://p> "x y" .': "literal object", f"<http://s> <{p}P31> <{WD}Q5> .": "hub", f"<http://s> <{p}P31> <{WD}Q6> .": "kept", "<http://s> <http://p> <http://o> .": "kept",
    }
    rows = [*lines, "", "# c", "  <http://s>  <http://p>\t<http://o> ."]
    marked = ts.reasons(spark.createDataFrame([(x,) for x in rows], "value string"))
    got = {r.reason: r.n for r in ts.reason_counts(marked).collect()}
    want = {}
    for r in lines.values():
        want[r] = want.get(r, 0) + 1
    assert got == want | {"duplicate": 1}
    assert ts.clean_triples(marked).count() == 2 and sum(got.values()) == len(rows) - 2


def brute_prune(rows, protected):
    while True:
        d = {}
        for s, _, o in rows:
            d[s] = d.get(s, 0) + 1
            d[o] = d.get(o, 0) + 1
        kept = {r for r in rows if (d[r[0]] >= 2 and d[r[2]] >= 2) or r[1] in protected}
        if kept == rows:
            return rows
        rows = kept


def test_prune(spark):
    chain = {(f"n{k}", "p", f"n{k + 1}") for k in range(5)} | {("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("x", "ontology#r", "y"), ("l", "p", "l")}
    df = spark.createDataFrame(sorted(chain), SCHEMA)
    got = ts.prune(df)
    assert {tuple(r) for r in got.collect()} == brute_prune(chain, {"ontology#r"})
    assert {tuple(r) for r in ts.prune(got).collect()} == {tuple(r) for r in got.collect()}


def test_ids_split_and_report(spark):
    rng = np.random.default_rng(0)
    rows = sorted({(f"e{a}", f"r{c}", f"e{b}") for a, b, c in rng.integers(0, [60, 60, 4], (400, 3))})
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    e = [r.uri for r in ts.entity_ids(df).orderBy("id").collect()]
    assert e == sorted({x for s, _, o in rows for x in (s, o)}) and [r.id for r in ts.entity_ids(df).orderBy("id").collect()] == list(range(len(e)))
    coded = ts.encode(df, ts.entity_ids(df), ts.relation_ids(df)).collect()
    assert sorted((e[r.s], f"r{r.p}", e[r.o]) for r in coded) == rows
    raw = {k: n for k, n in ts.split(df, rescue=False).groupBy("split").count().collect()}
    assert raw == {"valid": len(rows) // 10, "test": len(rows) // 10, "train": len(rows) - 2 * (len(rows) // 10)}
    out = ts.split(df)
    assert sorted((r.s, r.p, r.o) for r in out.collect()) == rows
    again = ts.split(df.repartition(3))
    assert sorted(out.collect()) == sorted(again.collect())
    report = {r.metric: r.value for r in ts.report(df, out).collect()}
    degree = sorted(sum((s == x) + (o == x) for s, _, o in rows) for x in e)
    assert report["median_degree"] == degree[len(degree) // 2] and report["unknown_valid"] == report["unknown_test"] == 0
    assert ts.subsample(df, 17).count() == 17 and ts.subsample(df, 10**6).count() == len(rows)
    assert ts.size_grid(52_045) == [("20k", 20_000), ("50k", 50_000), ("full", 52_045)]
    assert max(r["count"] for r in ts.relation_cap(df, 20).groupBy("p").count().collect()) == 20
    assert ts.pool(df, df).count() == 2 * len(rows)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.sampled_from("abcdef")] * 3), max_size=25))
def test_no_name_is_unknown(spark, rows):
    out = ts.split(spark.createDataFrame(sorted(set(rows)), SCHEMA), 0.3, 0.3).collect()
    train = {x for r in out if r.split == "train" for x in (r.s, r.o)}
    assert all(r.s in train and r.o in train for r in out) and len(out) == len(set(rows))


# --- alignment and expansion ---


def test_confidence(spark):
    rows = [("Acme", "X", "Acme", "", 1.0), ("Acme", "X", "ACME", "", 0.95), ("Acme", "X", "The Acme Co", "", 0.8), ("Acme", "X", "Zed", "", 0.6), ("Acme", "ORG", "Acme", "a software maker", 1.0), ("Acme", "ORG", "Acme", "a river", 0.85), ("Acme", "ORG", "acme", None, 0.8), ("Acme", "ORG", "Acmes", "x", 0.65), ("Acme", "ORG", "Zed", "x", 0.45)]
    df = spark.createDataFrame(rows, "t string, l string, f string, d string, want double")
    from pyspark.sql import functions as F

    assert all(float(r.c) == r.want for r in df.select("want", alignment.confidence(F.col("t"), F.col("l"), F.col("f"), F.col("d")).alias("c")).collect())


def test_links(spark):
    entry = lambda text, label, cls="Company": (text, label, NAMESPACE + text.replace(" ", ""), NAMESPACE + cls)
    entries = spark.createDataFrame([entry("Acme", "ORG"), entry("Bolt", "ORG"), entry("Zed", "ORG"), entry("Twitter", "ORG"), entry("Jim Clark", "PERSON", "Person"), ("Acme Inc", "ORG", NAMESPACE + "Acme", NAMESPACE + "Company"), ("Paris", "GPE", NAMESPACE + "Paris", None)], "text string, label string, uri string, class_uri string")
    candidates = spark.createDataFrame([("Acme Inc", 1, "Q1", "Acme Inc", "company"), ("Acme Inc", 2, "Q9", "x", "x"), ("Bolt", 1, "Q2", "Bolt Group", "a company"), ("Zed", 1, "Q3", "Other", "thing")], "label string, rank int, qid string, wd_label string, wd_desc string")
    links = alignment.link(entries, candidates)
    assert {r.text: (r.decision, r.qid) for r in links.collect()} == {"Acme Inc": ("sameAs", "Q1"), "Bolt": ("closeMatch", "Q2"), "Zed": ("local", "Q3"), "Twitter": ("sameAs", "Q918"), "Jim Clark": ("local", None)}
    rows = {(r.s.split("#")[-1], r.p.split("#")[-1], r.o) for r in alignment.link_triples(links).collect()}
    assert ("JimClark", "type", NAMESPACE + "Founder") in rows and ("Twitter", "alignmentConfidence", "1.0") in rows
    assert ("Zed", "comment", "Locally defined entity: no alignment (best candidate Q3 'Other' had low confidence (0.45)).") in rows
    assert {r.decision: r.n for r in alignment.decision_counts(links).collect()} == {"sameAs": 2, "closeMatch": 1, "local": 2}


def test_predicates(spark):
    claims = spark.createDataFrame([(WD + "Q210057", WDT + "P112", WD + "Q62882"), (WD + "Q62882", WDT + "P108", WD + "Q4034010")], SCHEMA)
    properties = spark.createDataFrame([("P112", "founded by", "en", WDT + "P112"), ("P108", "employer", "en", WDT + "P108"), ("P169", "chief executive officer", "en", WDT + "P169"), ("P9", "gegründet founded", "de", WDT + "P9")], "pid string, label string, lang string, direct string")
    got = {r.name: (r.pid, r.support, r.candidates) for r in alignment.align_predicates(spark, claims, properties).collect()}
    assert got["foundedBy"] == ("P112", "confirmed by triple validation", "P112") and got["worksAt"][1] == "confirmed by label search"
    assert got["investedIn"][1].startswith("WARNING") and got["founderOf"] == (None, "local only", "") and len(got) == 12
    assert alignment.predicate_triples(alignment.align_predicates(spark, claims, properties)).count() == 12 + 9 + 12


def test_expansion(spark):
    u = lambda s, p, o: (WD + s, WDT + p, WD + o, "uri", None, None)
    base = spark.createDataFrame([u("Q1", "P108", "Q2"), u("Q1", "P999", "Q3"), (WD + "Q1", RDFS + "label", "One", "literal", "en", None), (WD + "Q1", RDFS + "label", "Un", "literal", "fr", None), u("Q2", "P17", "Q4"), u("Q7", "P108", "Q2"), u("Q7", "P17", "Q8"), u("Q7", "P112", "Q4")], TRIPLES)
    graph = spark.createDataFrame([(NAMESPACE + "a", OWL + "sameAs", WD + "Q1", "uri", None, None)], TRIPLES)
    out, added = expansion.expand(graph, base, expansion.Plan(anchors=()))
    assert added == [("anchors", 0), ("aligned", 2), ("outgoing", 1), ("incoming", 2), ("new", 1)]
    assert out.count() == 7 and not out.where(f"p = '{WDT}P999'").count()
    # the limit holds before predicates are chosen
    seeds = spark.createDataFrame([(WD + "Q1",)], "uri string")
    assert expansion.one_hop(base, seeds, 1, (WDT + "P999",)).count() == 1
    assert expansion.nodes(out).count() == 5 and expansion.aligned(out).first().id == "Q1"
    assert expansion.of_types(expansion.nodes(out), base, WDT + "P17", (WD + "Q4",)).count() == 1


# --- embeddings ---


def numpy_score(model, h, r, t):
    c = lambda x: x[: len(x) // 2] + 1j * x[len(x) // 2 :]
    if model == "TransE":
        return -np.abs(h + r - t).sum()
    if model == "DistMult":
        return (h * r * t).sum()
    if model == "ComplEx":
        return (c(h) * c(r) * c(t).conj()).sum().real
    return -np.linalg.norm(c(h) * (c(r) / np.abs(c(r))) - c(t))


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(5)
    e, r = rng.normal(size=(20, 8)), rng.normal(size=(3, 8))
    e[7] = e[3]
    make = lambda x: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    rows = sorted({tuple(map(int, x)) for x in rng.integers(0, [20, 3, 20], (60, 3))})
    return e, r, make(e), make(r), rows, spark.createDataFrame(rows, "s long, p long, o long")


@pytest.mark.parametrize("model", embeddings.MODELS)
def test_scores_and_filtered_ranks(space, model):
    from pyspark.sql import functions as F

    e, r, et, rt, rows, triples = space
    x = embeddings.vectors_of(triples, et, rt).select("s", "p", "o", embeddings.score(model, F.col("h"), F.col("r"), F.col("t"), 8).alias("x"))
    for row in x.collect():
        assert abs(row.x - numpy_score(model, e[row.s], r[row.p], e[row.o])) < 1e-9
    got = {(x.s, x.p, x.o, x.side): (x.optimistic, x.pessimistic, x.realistic) for x in embeddings.filtered_ranks(model, triples.limit(12), triples, et, rt, 8).collect()}
    assert len(got) == 24
    for (s, p, o, side), ranks in got.items():
        true = numpy_score(model, e[s], r[p], e[o])
        others = [(k if side == "head" else s, p, o if side == "head" else k) for k in range(20)]
        left = [numpy_score(model, e[a], r[p], e[b]) for a, _, b in others if (a, p, b) not in rows]
        best = 1 + sum(x > true + 1e-9 for x in left)
        worst = best + sum(abs(x - true) <= 1e-9 for x in left)
        assert ranks == (best, worst, (best + worst) / 2)


def test_metrics(spark):
    ranks = spark.createDataFrame([("head", 1, 1, 1.0), ("tail", 2, 4, 3.0)], "side string, optimistic long, pessimistic long, realistic double")
    got = {(r.side, r.policy, r.metric): r.value for r in embeddings.rank_metrics(ranks, 9).collect()}
    assert got["both", "realistic", "mrr"] == pytest.approx((1 + 1 / 3) / 2) and got["both", "realistic", "hits_at_1"] == 0.5
    assert got["tail", "pessimistic", "median_rank"] == 4 and got["both", "realistic", "adjusted_mean_rank"] == pytest.approx(2 / 5)


def test_neighbours(space):
    e, _, et, _, _, _ = space
    got = embeddings.nearest(et.where("id < 2"), et, 4).collect()
    n = e / np.linalg.norm(e, axis=1, keepdims=True)
    for a in (0, 1):
        want = sorted(range(20), key=lambda k: (-round(n[k] @ n[a], 12), k))
        assert [x.id for x in sorted((g for g in got if g.anchor == a), key=lambda g: g.rank)] == [k for k in want if k != a][:4]
    assert embeddings.anchor_matrix(et.limit(3)).count() == 9
    assert embeddings.plane(et).count() == 20


def test_analogy_and_classes(spark, space):
    _, _, et, rt, _, _ = space
    out = embeddings.analogy(et.where("id = 1"), [rt.where("id = 0"), rt.where("id = 2")], et, 5, 10).collect()
    assert len(out) == 10 and 1 not in [r.id for r in out]
    ids = spark.createDataFrame(list(enumerate("abcde")), "id long, uri string")
    graph = spark.createDataFrame([("a", RDF + "type", NAMESPACE + "VCFirm", "uri", None, None)], TRIPLES)
    t = spark.createDataFrame([("a", WDT + "P31", WD + "Q783794"), ("b", WDT + "P31", WD + "Q3918"), ("c", WDT + "P106", "x"), ("d", WDT + "P31", WD + "Q1")], SCHEMA)
    assert {r.uri: r["class"] for r in embeddings.entity_classes(ids, graph, t).collect()} == {"a": "VC Firm", "b": "Organization", "c": "Person", "d": "Other", "e": "Other"}


def test_negatives(space):
    _, _, et, _, rows, triples = space
    out = embeddings.negatives(triples, et, 5).collect()
    assert len(out) == 5 * len(rows) and {r.s for r in out} | {r.o for r in out} <= set(range(20))
    assert sum((r.s, r.p) in {(a, b) for a, b, _ in rows} or (r.p, r.o) in {(b, c) for _, b, c in rows} for r in out) == len(out)


@pytest.mark.parametrize("model", embeddings.MODELS)
def test_gradients(model):
    rng = np.random.default_rng(1)
    config = trainer.Config(model, dim=3)
    n = trainer.width(config)
    x = [rng.normal(size=(1, n)) for _ in range(3)]
    _, *grads = trainer.score_and_gradients(config, *x)
    for which, g in enumerate(grads):
        for k in range(n):
            y = [a.copy() for a in x]
            y[which][0, k] += 1e-6
            high = trainer.score_and_gradients(config, *y)[0][0]
            y[which][0, k] -= 2e-6
            assert g[0, k] == pytest.approx((high - trainer.score_and_gradients(config, *y)[0][0]) / 2e-6, abs=1e-4)


@pytest.mark.parametrize("loss", ["nssa", "softplus"])
def test_loss_gradients(loss):
    rng = np.random.default_rng(2)
    config = trainer.Config("TransE", loss=loss, margin=2.0)
    p, n = rng.normal(size=4), rng.normal(size=(4, 5))
    _, dp, dn = trainer.loss_and_weights(config, p, n)
    for k in range(4):
        q = p.copy()
        q[k] += 1e-6
        assert dp[k] == pytest.approx((trainer.loss_and_weights(config, q, n)[0] - trainer.loss_and_weights(config, p, n)[0]) / 1e-6, abs=1e-4)
    if loss == "softplus":
        m = n.copy()
        m[1, 2] += 1e-6
        assert dn[1, 2] == pytest.approx((trainer.loss_and_weights(config, p, m)[0] - trainer.loss_and_weights(config, p, n)[0]) / 1e-6, abs=1e-4)


@pytest.mark.parametrize("model", embeddings.MODELS)
def test_a_small_graph_is_learnt(spark, model):
    """A ring and its inverse are remembered; the distributed form lowers its loss as well."""
    rows = [(k, 0, (k + 1) % 12) for k in range(12)] + [((k + 1) % 12, 1, k) for k in range(12)]
    base = trainer.CONFIGS[model]
    config = trainer.smaller(base, dim=16, epochs=300, batch=24, negatives=8, rate=0.05, margin=min(base.margin, 3.0))
    params, losses = trainer.train_locally(np.array(rows), config, 12, 2)
    assert losses[-1] < 0.6 * losses[0]
    ents, rels = trainer.tables(spark, params)
    triples = spark.createDataFrame(rows, "s long, p long, o long")
    metrics = embeddings.rank_metrics(embeddings.filtered_ranks(model, triples, triples, ents, rels, trainer.width(config)), 12)
    row = trainer.summary(model, metrics, 1.0, config)
    assert row["MRR"] > (0.6 if model in ("TransE", "DistMult") else 0.8)  # DistMult can't tell a relation from its inverse


def test_distributed_training(spark):
    rows = [(k, 0, (k + 1) % 12) for k in range(12)]
    triples = spark.createDataFrame(rows, "s long, p long, o long")
    config = trainer.Config("TransE", dim=8, epochs=8, batch=4, negatives=4, rate=0.1, loss="nssa", margin=3.0)
    _, losses, _ = trainer.train(triples, config, 12, 1, partitions=2)
    assert len(losses) == 8 and losses[-1] < losses[0]
    with pytest.raises(ValueError):
        trainer.train(triples, config, 10**8, 1)


@pytest.mark.parametrize("model", embeddings.MODELS)
def test_one_partition_is_local_training(spark, model):
    """Adam's moments go from epoch to epoch, so the numbers are the same."""
    rows = [(k, k % 2, (k * 5 + 1) % 12) for k in range(12)]
    triples = spark.createDataFrame(rows, "s long, p long, o long").repartition(3)
    config = trainer.smaller(trainer.CONFIGS[model], dim=3, epochs=4, batch=5, negatives=3, rate=0.1)
    head = np.array([r.head_probability for r in embeddings.bernoulli_stats(triples).orderBy("p").collect()])
    want, losses = trainer.train_locally(np.array(rows), config, 12, 2, head)
    params, found, _ = trainer.train(triples, config, 12, 2)
    assert np.allclose(found, losses) and all(np.allclose(params[n], want[n]) for n in "er")


def test_partitions_draw_their_own_numbers(spark, monkeypatch):
    """Blocks are averaged by the partitions' triples; partitions with equal triples still differ."""
    monkeypatch.setattr(trainer, "BLOCK", 5)
    config = trainer.Config("DistMult", dim=2, epochs=1, batch=4, negatives=2, rate=0.1)
    triples = spark.createDataFrame([(k % 4, 0, (k + 1) % 4) for k in range(16)], "s long, p long, o long")
    params, losses, _ = trainer.train(triples, config, 13, 1, partitions=2)
    one, _, _ = trainer.train(triples, config, 13, 1)
    assert params["e"].shape == (13, 2) and len(losses) == 1 and not np.allclose(params["e"], one["e"])


@pytest.mark.parametrize("model", embeddings.MODELS)
def test_steps_that_do_not_meet_are_made_together(model, monkeypatch):
    """The entities of each batch are its own, so scoring the batches at once moves them as one by one; a relation takes the mean."""
    config = trainer.smaller(trainer.CONFIGS[model], dim=3, epochs=1, batch=2, negatives=2, rate=0.1)
    triples = np.array([(2 * k, 0, 2 * k + 1) for k in range(8)])
    before = trainer.packed(trainer.start(config, 10_000, 1))
    apart, at_once = before.copy(), before.copy()

    class Draws:  # batch k draws 1000 + 4 k and on
        def __init__(self):
            self.next = 1000

        def permutation(self, n):
            return np.arange(n)

        def integers(self, low, high, shape):
            self.next += np.prod(shape)
            return np.arange(self.next - np.prod(shape), self.next).reshape(shape)

        def random(self, shape):
            return np.resize([0.1, 0.9], shape)

    monkeypatch.setattr(trainer, "_adam", lambda rows, g, rate: np.subtract(rows[:, : g.shape[1]], rate * g, out=rows[:, : g.shape[1]]))
    for k in range(0, 8, 2):  # each batch from the start
        now, draws = before.copy(), Draws()
        draws.next += 2 * k
        trainer.epoch(config, now, 10_000, triples[k : k + 2], np.array([0.5]), draws, group=1)
        apart[:10_000] += now[:10_000] - before[:10_000]
        apart[10_000:] += (now[10_000:] - before[10_000:]) / 4
    trainer.epoch(config, at_once, 10_000, triples, np.array([0.5]), Draws(), group=4)
    assert np.allclose(apart[:10_000], at_once[:10_000], atol=1e-5) and not np.allclose(before[:10_000], at_once[:10_000], atol=1e-5)
    assert model == "RotatE" or np.allclose(apart[10_000:], at_once[10_000:], atol=1e-5)  # whose relations are brought back to length 1


def test_only_the_last_state_is_kept(spark):
    """Small graphs are trained step by step; a large one's steps are made together; no round's state outlives the next."""
    from pathlib import Path

    from quillgraph.session import shared_folder

    config = trainer.Config("TransE", dim=2, epochs=4, batch=4, negatives=2, rate=0.1)
    assert trainer.together(config, 100) == 1 and trainer.together(config, 10**6) > 1
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("train-state-*"))
    trainer.fit(spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "s long, p long, o long"), config, 3, 1)
    assert len(set(folder.glob("train-state-*")) - before) == 1


def test_parameters_that_no_task_holds(spark, monkeypatch):
    """More than the driver may hold are trained in parts: every link is dealt out once, every entity has a vector, the loss falls."""
    monkeypatch.setattr(trainer, "WHOLE", 100, raising=False)
    monkeypatch.setattr(trainer, "MOST_PARAMETERS", 200)
    n = 103
    rows = sorted({(k, 0, (k * 7 + 1) % n) for k in range(n)} | {(k, 1, k % 9) for k in range(20, n)} | {(5, 2, 5), (3, 2, 53)})
    triples = spark.createDataFrame(rows, "s long, p long, o long")
    config = trainer.Config("TransE", dim=4, epochs=2, batch=4, negatives=2, rate=0.1, loss="nssa", margin=3.0)
    seen, heads = [], trainer._heads
    monkeypatch.setattr(trainer, "_heads", lambda *a: seen.append(heads(*a)) or seen[-1])
    blocks, losses, _ = trainer.fit(triples, config, n, 3, partitions=2)
    vectors = {r.id: r.v for r in trainer.parameters(blocks, "e", config).collect()}
    assert sorted(vectors) == list(range(n)) and trainer.parameters(blocks, "r", config).count() == 3
    assert np.isfinite(list(vectors.values())).all() and len(losses) == 2 and losses[1] < losses[0]
    assert np.allclose(seen[0][0], [r.head_probability for r in embeddings.bernoulli_stats(triples).orderBy("p").collect()]) and seen[0][1].sum() == len(rows)

    plane, found = trainer.plane(config, n, 3), []
    for r in trainer._dealt(plane, triples).collect():
        ids = np.concatenate([np.arange(b, n, plane.buckets) for b in plane.line(*divmod(r.line, plane.q))])
        x = np.frombuffer(r.data, np.int64)
        found += zip(ids[x // plane.rows() % plane.rows()].tolist(), (x // plane.rows() ** 2).tolist(), ids[x % plane.rows()].tolist())
    assert sorted(found) == rows

    blocks, losses, _ = trainer.fit(triples.limit(0), config, n, 3)
    start = trainer.start(config, n, 3)
    for name in "er":
        assert np.allclose([r.v for r in trainer.parameters(blocks, name, config).orderBy("id").collect()], start[name])
    assert not losses


def test_moments_are_stored_in_16_bits():
    rows = np.random.default_rng(1).normal(size=(7, 13)).astype(np.float32)
    got = np.empty_like(rows)
    trainer._restored(trainer._stored(rows, 4, True), 4, got)
    assert (got[:, :4] == rows[:, :4]).all() and (got[:, 12] == rows[:, 12]).all() and np.allclose(got, rows, rtol=2**-8)


def test_training_without_triples_gives_the_start(spark):
    config = trainer.Config("TransE", dim=2, epochs=2)
    params, losses, _ = trainer.train(spark.createDataFrame([], "s long, p long, o long"), config, 3, 1)
    assert not losses and np.allclose(params["e"], trainer.start(config, 3, 1)["e"])


# --- rules ---


@pytest.fixture(scope="module")
def firms(spark):
    text = f"""@prefix k: <{NAMESPACE}> . k:F a k:Firm ; k:investedIn k:A . k:B1 k:partnerAt k:F . k:B2 k:partnerAt k:G , k:F . k:A k:foundedBy k:B1 , k:B2 . k:C k:foundedBy k:B2 . k:D k:foundedBy k:B3 ."""
    return spark.createDataFrame(turtle.parse_turtle(text), TRIPLES).cache()


def test_two_premise_rule(firms):
    rule = rules.parse_rule("Firm(?f), partnerAt(?p, ?f), foundedBy(?c, ?p) -> investedIn(?f, ?c)")
    got = {(r.s.split("#")[-1], r.o.split("#")[-1]): r.asserted for r in rules.apply(rule, firms).collect()}
    assert got == {("F", "A"): True, ("F", "C"): False}
    assert rules.closure(firms, [rule]).count() == firms.count() + 1


FAMILY = f"""@prefix k: <{NAMESPACE}> . @prefix xsd: <{XSD}> . @prefix owl: <{OWL}> . @prefix rdfs: <{RDFS}> .
k:Person a owl:Class . k:Man a owl:Class ; rdfs:subClassOf k:Person . k:Parent owl:equivalentClass [ a owl:Restriction ; owl:onProperty k:hasChild ; owl:someValuesFrom k:Person ] .
k:Father owl:intersectionOf ( k:Man k:Parent ) . k:hasChild owl:inverseOf k:hasParent ; rdfs:domain k:Person . k:hasParent rdfs:subPropertyOf k:hasAncestor . k:hasAncestor a owl:TransitiveProperty . k:knows a owl:SymmetricProperty .
k:Woman owl:disjointWith k:Man .
k:Tom a k:Man ; k:age "70"^^xsd:integer ; k:hasChild k:Ann . k:Ann a k:Person , k:Woman ; k:age "60"^^xsd:integer ; k:knows k:Zoe . k:Kim k:hasParent k:Ann ; a k:Person . k:Rex a k:Dog ; k:age 61.5 .
"""


def test_entailment(spark):
    df = spark.createDataFrame(turtle.parse_turtle(FAMILY), TRIPLES)
    k = lambda x: x.removeprefix(NAMESPACE).removeprefix(RDF)
    got = {(k(r.s), k(r.p), k(r.o)) for r in rules.entailed(df).collect()}
    assert {("Tom", "type", "Father"), ("Tom", "type", "Person"), ("Ann", "hasParent", "Tom"), ("Kim", "hasAncestor", "Tom"), ("Zoe", "knows", "Ann"), ("Ann", "hasChild", "Kim"), ("Ann", "type", "Parent")} <= got
    assert ("Ann", "type", "Father") not in got and ("Rex", "type", "Person") not in got
    assert rules.inconsistencies(df).count() == 0
    both = df.unionByName(spark.createDataFrame([(NAMESPACE + "Ann", RDF + "type", NAMESPACE + "Man", "uri", None, None)], TRIPLES))
    assert rules.inconsistencies(both).count() == 1


def test_threshold(spark):
    df = spark.createDataFrame(turtle.parse_turtle(FAMILY), TRIPLES)
    old = NAMESPACE + "OldPerson"
    assert sorted(r.name for r in rules.threshold_rule(df, NAMESPACE + "age", 60, old).collect()) == ["Rex", "Tom"]
    rule = rules.parse_rule("Person(?p), age(?p, ?a), swrlb:greaterThan(?a, 60) -> OldPerson(?p)")
    full = rules.entailed(df.unionByName(rules.subclass(spark, old, NAMESPACE + "Person")), [rule])
    assert [(r.name, r.member) for r in rules.individuals(full, NAMESPACE + "age", old).collect()] == [("Ann", False), ("Kim", False), ("Rex", False), ("Tom", True)]


def test_lists_without_an_end(spark):
    """A list that breaks off or comes back on itself has the members met until then; other lists are left alone."""
    cells = [("a", "first", "A"), ("a", "rest", "b"), ("b", "first", "B"), ("r", "first", "R"), ("r", "rest", "q"), ("q", "first", "Q"), ("q", "rest", "r"), ("z", "first", "Z")]
    rows = [("_:" + s, RDF + p, ("_:" if p == "rest" else "http://c#") + o, "uri", None, None) for s, p, o in cells]
    rows += [("http://c#" + s, OWL + "intersectionOf", "_:" + o, "bnode", None, None) for s, o in (("Broken", "a"), ("Round", "r"), ("None", "x"))]
    found = rules.intersection_rules(spark.createDataFrame(rows, TRIPLES))
    whole = {r.head[2].value.split("#")[1]: [part[2].value.split("#")[1] for part in r.body] for r in found if len(r.body) > 1}
    assert whole == {"Broken": ["A", "B"], "Round": ["R", "Q"]} and len(found) == 6


def test_closure_of_many_rounds(spark, monkeypatch):
    """A long chain, compacted on the way, and rules whose premises only other rules bring about."""
    monkeypatch.setattr(rules, "COMPACT", 2)
    link = lambda a, p, b: (NAMESPACE + a, NAMESPACE + p, NAMESPACE + b, "uri", None, None)
    df = spark.createDataFrame([link(f"n{k}", "next", f"n{k + 1}") for k in range(9)], TRIPLES)
    made = [rules.parse_rule(x) for x in ("next(?a, ?b) -> reach(?a, ?b)", "next(?a, ?b), reach(?b, ?c) -> reach(?a, ?c)", "reach(?a, ?b), reach(?b, ?c) -> far(?a, ?c)", "never(?a, ?b) -> far(?a, ?b)")]
    out = rules.closure(df, made)
    count = {r.p.split("#")[1]: r["count"] for r in out.groupBy("p").count().collect()}
    assert count == {"next": 9, "reach": 45, "far": 36}
