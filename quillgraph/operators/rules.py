"""Horn rules over triples, and the entailments of an ontology, by semi-naive rounds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import local_name
from quillgraph.operators.graph import KEYS, new_triples
from quillgraph.plans.sparql import Compiler, Solution, as_bool, Expressions
from quillgraph.plans.sparql_parser import Term, Var
from quillgraph.schemas import LITERAL, NAMESPACE, OWL, RDF, RDFS, URI, XSD
from quillgraph.session import written

COMPARISONS = {"greaterThan": ">", "lessThan": "<", "greaterThanOrEqual": ">=", "lessThanOrEqual": "<=", "equal": "=", "notEqual": "!="}


@dataclass(frozen=True)
class Rule:
    """body and head: (s, p, o) of Var and Term; tests: (sign, left, right)."""

    body: tuple
    head: tuple
    tests: tuple = ()


def parse_rule(text: str, namespace: str = NAMESPACE) -> Rule:
    """``Firm(?f), partnerAt(?p, ?f) -> investedIn(?f, ?c)``; comparisons such as ``swrlb:greaterThan(?a, 60)`` are tests."""
    left, arrow, right = text.partition("->")
    if not arrow:
        raise ValueError("a rule needs ->")

    def atoms(part: str) -> list:
        return [(n, [a.strip() for a in args.split(",")]) for n, args in re.findall(r"([\w:]+)\s*\(([^)]*)\)", part)]

    def term(x: str):
        if x.startswith("?"):
            return Var(x[1:])
        if re.fullmatch(r"-?\d+(\.\d+)?", x):
            return Term(x, LITERAL, "", XSD + ("decimal" if "." in x else "integer"))
        return Term(x.strip('"'), LITERAL) if x.startswith('"') else Term(namespace + x, URI)

    def triple(name: str, args: list) -> tuple:
        if len(args) == 1:
            return term(args[0]), Term(RDF + "type", URI), Term(namespace + name, URI)
        return term(args[0]), Term(namespace + name, URI), term(args[1])

    body, tests = [], []
    for name, args in atoms(left):
        plain = name.split(":")[-1]
        if plain in COMPARISONS:
            tests.append((COMPARISONS[plain], *map(term, args)))
        else:
            body.append(triple(plain, args))
    (name, args), *more = atoms(right)
    if more:
        raise ValueError("a rule has one head")
    return Rule(tuple(body), triple(name, args), tuple(tests))


def _atom(part, s: Solution) -> Column:
    return F.col(f"`{part.name}`") if isinstance(part, Var) else F.struct(F.lit(part.value).alias("v"), F.lit(part.kind).alias("k"), F.lit(part.lang).alias("l"), F.lit(part.dtype).alias("d"))


def fired(rule: Rule, graph: DataFrame, fresh: DataFrame | None = None) -> Solution:
    """Bindings of the body; ``fresh``: at least one premise is among these triples."""
    whole = Compiler(graph)
    found = None
    for k in range(len(rule.body) if fresh is not None else 1):
        parts = list(enumerate(rule.body))
        if fresh is not None:  # the new premise first, then what connects to it
            parts = [parts[k], *parts[:k], *parts[k + 1 :]]
        now, left = None, parts
        while left:
            linked = [x for x in left if now is None or {v.name for v in x[1] if isinstance(v, Var)} & now.names]
            x = (linked or left)[0]
            left.remove(x)
            scan = (Compiler(fresh) if fresh is not None and x[0] == k else whole).scan(*x[1])
            now = scan if now is None else whole.join(now, scan)
        names = sorted(now.names)
        df = now.df.select(*(F.col(f"`{n}`") for n in names))
        found = df if found is None else found.unionByName(df)
    s = Solution(found.distinct(), set(names), set())
    for sign, a, b in rule.tests:
        e = Expressions(lambda n: F.col(f"`{n}`"))
        value = lambda x: ("var", x) if isinstance(x, Var) else ("term", x)
        s = Solution(s.df.where(as_bool(e.value((sign, value(a), value(b))))), s.certain, s.maybe)
    return s


def conclusions(rule: Rule, s: Solution) -> DataFrame:
    a, p, o = (_atom(x, s) for x in rule.head)
    rows = s.df.select(a.alias("a"), p.alias("b"), o.alias("c")).where("a.k <> 'literal'")
    return rows.select(F.col("a.v").alias("s"), F.col("b.v").alias("p"), F.col("c.v").alias("o"), F.col("c.k").alias("o_kind"), F.nullif("c.l", F.lit("")).alias("o_lang"), F.nullif("c.d", F.lit("")).alias("o_dtype")).distinct()


def apply(rule: Rule, graph: DataFrame) -> DataFrame:
    """Conclusions of one firing, with asserted: whether the graph has them already."""
    found = conclusions(rule, fired(rule, graph))
    fresh = new_triples(found, graph).withColumn("asserted", F.lit(False))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEYS]
    return found.alias("a").join(fresh.alias("b"), on, "left").select("a.*", F.coalesce("b.asserted", F.lit(True)).alias("asserted"))


#: Rounds after which the parts of a closure are written as one table again.
COMPACT = 4


def closure(graph: DataFrame, rules: list[Rule], rounds: int = 100) -> DataFrame:
    """The graph with all that the rules entail.

    A rule fires only where all its premises with a constant predicate (and
    object, for types) occur: what occurs is looked up once and added to with
    every round's conclusions, a row for each predicate or type that rules name.
    """
    now = fresh = written(graph.select(*KEYS).distinct(), "closure")
    named = {_sign(part) for rule in rules for part in rule.body} - {None}
    seen = _signs(now, named)
    recent = seen
    for k in range(rounds):
        found = None
        for rule in rules:
            signs = [_sign(part) for part in rule.body]
            if any(x is not None and x not in seen for x in signs) or not any(x is None or x in recent for x in signs):
                continue
            x = conclusions(rule, fired(rule, now, fresh if k else None))
            found = x if found is None else found.unionByName(x)
        if found is None:
            break
        fresh = written(new_triples(found, now), "closure-new")
        if fresh.isEmpty():
            break
        recent = _signs(fresh, named)
        seen = seen | recent
        now = now.unionByName(fresh)
        if (k + 1) % COMPACT == 0:
            now = written(now, "closure")
    return now


def _sign(part: tuple) -> tuple[str, str | None] | None:
    """(predicate, class if it is a type) of a premise; None if the predicate is open."""
    _, p, o = part
    if isinstance(p, Var):
        return None
    return p.value, o.value if p.value == RDF + "type" and not isinstance(o, Var) else None


def _signs(graph: DataFrame, named: set) -> set:
    """Those of ``named`` that occur."""
    if not named:
        return set()
    plain = [p for p, o in named if o is None]
    typed = [o for p, o in named if o is not None]
    is_typed = (F.col("p") == RDF + "type") & F.col("o").isin(*typed)
    rows = graph.where(F.col("p").isin(*plain) | is_typed).select("p", F.when(is_typed, F.col("o")).alias("o")).distinct().collect()
    found = {(r.p, r.o) for r in rows} | {(r.p, None) for r in rows}
    return found & named


def _v(*names: str) -> list[Var]:
    return [Var(n) for n in names]


def _u(name: str) -> Term:
    return Term(name, URI)


def ontology_rules() -> list[Rule]:
    """Inverse, sub-property, sub-class, equivalent, symmetric, transitive, domain, range, some-values-from.

    Schema triples are premises like any other, so an ontology is data. That
    classes are disjoint is a check (``inconsistencies``), not an inference.
    """
    x, y, z, c, d, p, q, r = _v("x", "y", "z", "c", "d", "p", "q", "r")
    a = _u(RDF + "type")
    s = lambda n: _u(RDFS + n)
    o = lambda n: _u(OWL + n)
    return [
        Rule(((x, a, c), (c, s("subClassOf"), d)), (x, a, d)),
        Rule(((c, s("subClassOf"), d), (d, s("subClassOf"), z)), (c, s("subClassOf"), z)),
        Rule(((c, o("equivalentClass"), d),), (c, s("subClassOf"), d)),
        Rule(((c, o("equivalentClass"), d),), (d, s("subClassOf"), c)),
        Rule(((x, p, y), (p, s("subPropertyOf"), q)), (x, q, y)),
        Rule(((p, s("subPropertyOf"), q), (q, s("subPropertyOf"), r)), (p, s("subPropertyOf"), r)),
        Rule(((x, p, y), (p, o("inverseOf"), q)), (y, q, x)),
        Rule(((x, q, y), (p, o("inverseOf"), q)), (y, p, x)),
        Rule(((x, p, y), (p, a, o("SymmetricProperty"))), (y, p, x)),
        Rule(((x, p, y), (y, p, z), (p, a, o("TransitiveProperty"))), (x, p, z)),
        Rule(((x, p, y), (p, s("domain"), c)), (x, a, c)),
        Rule(((x, p, y), (p, s("range"), c)), (y, a, c)),
        Rule(((r, o("onProperty"), p), (r, o("someValuesFrom"), c), (x, p, y), (y, a, c)), (x, a, r)),
    ]


def intersection_rules(graph: DataFrame) -> list[Rule]:
    """For classes that are intersections of lists; of the graph's lists only those come to the driver.

    Lists are followed cell by cell, all of them one step a round. A list without
    an end, or that comes back on itself, has the members met until then.
    """
    classes = [(t.s, t.o) for t in graph.where(F.col("p") == OWL + "intersectionOf").select("s", "o").distinct().collect()]
    first, rest, ahead = {}, {}, {o for _, o in classes}
    while ahead:
        part = graph.where(F.col("p").isin(RDF + "first", RDF + "rest") & F.col("s").isin(*sorted(ahead))).select("s", "p", "o").collect()
        for t in part:
            (first if t.p == RDF + "first" else rest)[t.s] = t.o
        ahead = {t.o for t in part if t.p == RDF + "rest"} - first.keys() - rest.keys()
    x, a, out = Var("x"), _u(RDF + "type"), []
    for name, cell in sorted(classes):
        members, met = [], set()
        while cell in first and cell not in met:
            members.append(first[cell])
            met.add(cell)
            cell = rest.get(cell)
        if members:
            out.append(Rule(tuple((x, a, _u(m)) for m in members), (x, a, _u(name))))
            out += [Rule(((x, a, _u(name)),), (x, a, _u(m))) for m in members]
    return out


def entailed(graph: DataFrame, extra: list[Rule] | None = None) -> DataFrame:
    """The graph with its ontology's entailments and those of further rules; imports are dropped first."""
    base = without_predicate(graph, OWL + "imports")
    return closure(base, ontology_rules() + intersection_rules(base) + (extra or []))


def inconsistencies(graph: DataFrame) -> DataFrame:
    """node, a, b: members of two disjoint classes."""
    types = graph.where(F.col("p") == RDF + "type").select("s", "o")
    apart = graph.where(F.col("p") == OWL + "disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    return types.join(apart, F.col("o") == F.col("a")).select("s", "a", "b").join(types.select(F.col("s").alias("_s"), F.col("o").alias("_o")), (F.col("s") == F.col("_s")) & (F.col("b") == F.col("_o"))).select(F.col("s").alias("node"), "a", "b")


def without_predicate(graph: DataFrame, predicate: str) -> DataFrame:
    return graph.where(F.col("p") != predicate)


def threshold_rule(graph: DataFrame, predicate: str, over: float, cls: str) -> DataFrame:
    """name, value: individuals of any class whose number is over the threshold and that aren't in the class yet."""
    value = F.col("o").try_cast("decimal(38,6)")
    rows = graph.where(F.col("p") == predicate).select(F.col("s"), value.alias("value")).where(F.col("value") > over)
    has = graph.where((F.col("p") == RDF + "type") & (F.col("o") == cls)).select("s")
    return rows.join(has, "s", "left_anti").select(local_name(F.col("s")).alias("name"), "value")


def individuals(graph: DataFrame, predicate: str, cls: str) -> DataFrame:
    """name, value, member: named individuals in order of name, with a number and whether they are in a class."""
    kinds = [OWL + k for k in ("Class", "Ontology", "ObjectProperty", "DatatypeProperty", "FunctionalProperty", "InverseFunctionalProperty", "SymmetricProperty", "TransitiveProperty", "Restriction", "AnnotationProperty")]
    typed = graph.where((F.col("p") == RDF + "type") & ~F.startswith("s", F.lit("_:")))
    schema = typed.where(F.col("o").isin(*kinds)).select("s")
    names = typed.select("s").distinct().join(schema, "s", "left_anti")
    numbers = graph.where(F.col("p") == predicate).groupBy("s").agg(F.min(F.col("o").try_cast("decimal(38,6)")).alias("value"))
    member = typed.where(F.col("o") == cls).select("s", F.lit(True).alias("member")).distinct()
    x = names.join(numbers, "s", "left").join(member, "s", "left")
    return x.select(local_name(F.col("s")).alias("name"), "value", F.coalesce("member", F.lit(False)).alias("member")).orderBy("name")


def subclass(spark, child: str, parent: str) -> DataFrame:
    """The declaration of a class under another."""
    from quillgraph.schemas import TRIPLES

    return spark.createDataFrame([(child, RDF + "type", OWL + "Class", URI, None, None), (child, RDFS + "subClassOf", parent, URI, None, None)], TRIPLES)
