"""SPARQL patterns as DataFrames: Catalyst plans what this module only declares.

A solution is a DataFrame with a column per variable, each a struct of four
strings (value, kind, lang, dtype) that are never null inside, so plain equality
joins them; an unbound variable is a null struct. A variable that every row
binds is an equi-join key; one that may be unbound joins by compatibility.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.sparql_parser import Group, Path, Query, SparqlError, Term, Var, parse
from quillgraph.schemas import BLANK, LITERAL, URI, XSD
from quillgraph.session import written

NUMERIC = tuple(XSD + n for n in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"))
TERM = "struct<v:string,k:string,l:string,d:string>"


def term(v: Column, k: Column, lang: Column, dtype: Column) -> Column:
    return F.struct(v.alias("v"), k.alias("k"), lang.alias("l"), dtype.alias("d"))


def constant(t: Term) -> Column:
    return term(F.lit(t.value), F.lit(t.kind), F.lit(t.lang), F.lit(t.dtype))


def packed(t: Column) -> Column:
    """A term as one string, different for different terms; a plain name is itself."""
    blank, bare = F.startswith(t["v"], F.lit("_:")), (t["l"] == "") & (t["d"] == "")
    plain = ((t["k"] == URI) & ~blank & ~F.startswith(t["v"], F.lit('"'))) | ((t["k"] == BLANK) & blank)
    return F.when(plain & bare, t["v"]).otherwise(F.concat(F.lit('"'), F.concat_ws("\0", t["k"], t["l"], t["d"], t["v"])))


def unpacked(c: Column) -> Column:
    parts = F.split(F.substr(c, F.lit(2)), "\0", 4)
    other, name = F.startswith(c, F.lit('"')), F.when(F.startswith(c, F.lit("_:")), BLANK).otherwise(URI)
    part = lambda k, plain: F.when(other, parts[k]).otherwise(plain)
    return term(part(3, c), part(0, name), part(1, F.lit("")), part(2, F.lit("")))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Solution:
    df: DataFrame
    certain: set[str]
    maybe: set[str]

    @property
    def names(self) -> set[str]:
        return self.certain | self.maybe


# --- expressions ----------------------------------------------------------------------------
# A value is (kind, column): term (a struct), str, num or bool. Errors are nulls.


def _numeric(t: Column) -> Column:
    return F.when((t["k"] == LITERAL) & t["d"].isin(*NUMERIC), t["v"].try_cast("double"))


def as_term(value: tuple) -> Column:
    kind, c = value
    if kind == "term":
        return c
    if kind == "str":
        made = term(c, F.lit(LITERAL), F.lit(""), F.lit(""))
    elif kind == "bool":
        made = term(c.cast("string"), F.lit(LITERAL), F.lit(""), F.lit(XSD + "boolean"))
    else:  # whole numbers are written as integers
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        made = term(F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string")), F.lit(LITERAL), F.lit(""), F.when(whole, XSD + "integer").otherwise(XSD + "decimal"))
    return F.when(c.isNotNull(), made)


def as_string(value: tuple) -> Column:
    return value[1] if value[0] == "str" else as_term(value)["v"]


def as_number(value: tuple) -> Column:
    kind, c = value
    return c if kind == "num" else _numeric(c) if kind == "term" else F.lit(None).cast("double")


def as_bool(value: tuple) -> Column:
    """The effective boolean value."""
    kind, c = value
    if kind == "bool":
        return c
    if kind == "num":
        return c != 0
    if kind == "str":
        return c != ""
    return (
        F.when(c["k"] != LITERAL, F.lit(None).cast("boolean"))
        .when(c["d"] == XSD + "boolean", c["v"].isin("true", "1"))
        .when(c["d"].isin(*NUMERIC), _numeric(c) != 0)
        .when(c["d"].isin("", XSD + "string"), c["v"] != "")
    )


class Expressions:
    """Compiles an expression over the columns that ``at`` names."""

    def __init__(self, at, aggregates: dict | None = None):
        self.at, self.aggregates = at, aggregates

    def value(self, e: tuple) -> tuple:
        op = e[0]
        if op == "var":
            return "term", self.at(e[1].name)
        if op == "term":
            return "term", constant(e[1])
        if op == "aggregate":
            if self.aggregates is None:
                raise SparqlError("an aggregate stands outside a grouped query")
            name = f"_agg{len(self.aggregates)}"
            return "term", _c(self.aggregates.setdefault(repr(e), (name, e))[0])
        if op in ("or", "and"):
            a, b = as_bool(self.value(e[1])), as_bool(self.value(e[2]))
            return "bool", a | b if op == "or" else a & b
        if op == "not":
            return "bool", ~as_bool(self.value(e[1]))
        if op == "negative":
            return "num", -as_number(self.value(e[1]))
        if op in ("+", "-", "*", "/"):
            a, b = as_number(self.value(e[1])), as_number(self.value(e[2]))
            return "num", {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return "bool", self.compared(op, self.value(e[1]), self.value(e[2]))
        if op == "in":
            left, found = self.value(e[1]), F.lit(False)
            for x in e[2]:
                found = found | self.compared("=", left, self.value(x))
            return "bool", found
        if op in ("exists", "not_exists"):
            raise SparqlError("EXISTS is supported only as a filter's own condition")
        return self.call(e[1], e[2])

    def compared(self, op: str, a: tuple, b: tuple) -> Column:
        how = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if "bool" in (a[0], b[0]):
            return how(as_bool(a), as_bool(b))
        x, y = as_number(a), as_number(b)
        if "num" in (a[0], b[0]):
            return how(x, y)
        s, t = as_term(a), as_term(b)
        both = x.isNotNull() & y.isNotNull()
        if op in ("=", "!="):
            return F.when(both, how(x, y)).otherwise(how(s, t))
        alike = (s["k"] == LITERAL) & (t["k"] == LITERAL) & x.isNull() & y.isNull()
        return F.when(both, how(x, y)).when(alike, how(s["v"], t["v"]))

    def call(self, name: str, args: list) -> tuple:
        if name == "BOUND":
            return "bool", self.value(args[0])[1].isNotNull()
        if name == "COALESCE":
            return "term", F.coalesce(*(as_term(self.value(a)) for a in args))
        if name == "IF":
            return "term", F.when(as_bool(self.value(args[0])), as_term(self.value(args[1]))).otherwise(as_term(self.value(args[2])))
        values = [self.value(a) for a in args]
        s = [as_string(v) for v in values]
        t = [as_term(v) for v in values]
        n = [as_number(v) for v in values]
        lit = F.lit
        known = {
            "STR": lambda: ("str", s[0]),
            "LANG": lambda: ("str", F.when(t[0]["k"] == LITERAL, t[0]["l"])),
            "LANGMATCHES": lambda: ("bool", F.when(s[1] == "*", s[0] != "").otherwise((F.lower(s[0]) == F.lower(s[1])) | F.startswith(F.lower(s[0]), F.concat(F.lower(s[1]), lit("-"))))),
            "DATATYPE": lambda: ("term", F.when(t[0]["k"] == LITERAL, term(F.when(t[0]["l"] != "", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").when(t[0]["d"] == "", XSD + "string").otherwise(t[0]["d"]), lit(URI), lit(""), lit("")))),
            "IRI": lambda: ("term", term(s[0], lit(URI), lit(""), lit(""))),
            "ISIRI": lambda: ("bool", t[0]["k"] == URI),
            "ISLITERAL": lambda: ("bool", t[0]["k"] == LITERAL),
            "ISBLANK": lambda: ("bool", t[0]["k"] == BLANK),
            "ISNUMERIC": lambda: ("bool", n[0].isNotNull()),
            "SAMETERM": lambda: ("bool", t[0] == t[1]),
            "STRLANG": lambda: ("term", term(s[0], lit(LITERAL), F.lower(s[1]), lit(""))),
            "STRDT": lambda: ("term", term(s[0], lit(LITERAL), lit(""), s[1])),
            "STRSTARTS": lambda: ("bool", F.startswith(s[0], s[1])),
            "STRENDS": lambda: ("bool", F.endswith(s[0], s[1])),
            "CONTAINS": lambda: ("bool", F.contains(s[0], s[1])),
            "STRLEN": lambda: ("num", F.length(s[0]).cast("double")),
            "SUBSTR": lambda: ("str", F.substr(s[0], n[1].cast("int"), n[2].cast("int")) if len(n) > 2 else F.substr(s[0], n[1].cast("int"))),
            "UCASE": lambda: ("str", F.upper(s[0])),
            "LCASE": lambda: ("str", F.lower(s[0])),
            "STRBEFORE": lambda: ("str", F.when(F.contains(s[0], s[1]), F.substr(s[0], lit(1), F.position(s[1], s[0]) - 1)).otherwise(lit(""))),
            "STRAFTER": lambda: ("str", F.when(F.contains(s[0], s[1]), F.substr(s[0], F.position(s[1], s[0]) + F.length(s[1]))).otherwise(lit(""))),
            "CONCAT": lambda: ("str", F.concat(*s) if s else lit("")),
            "REGEX": lambda: ("bool", F.rlike(s[0], F.concat(lit("(?" + args[2][1].value + ")"), s[1])) if len(s) > 2 else F.rlike(s[0], s[1])),
            "REPLACE": lambda: ("str", F.regexp_replace(s[0], s[1], s[2])),
            "ABS": lambda: ("num", F.abs(n[0])),
            "CEIL": lambda: ("num", F.ceil(n[0]).cast("double")),
            "FLOOR": lambda: ("num", F.floor(n[0]).cast("double")),
            "ROUND": lambda: ("num", F.floor(n[0] + 0.5).cast("double")),
            "YEAR": lambda: ("num", F.substring(s[0], 1, 4).try_cast("double")),
            "MONTH": lambda: ("num", F.substring(s[0], 6, 2).try_cast("double")),
            "DAY": lambda: ("num", F.substring(s[0], 9, 2).try_cast("double")),
            XSD + "string": lambda: ("str", s[0]),
            XSD + "integer": lambda: ("num", F.floor(s[0].try_cast("double")).cast("double")),
            XSD + "decimal": lambda: ("num", s[0].try_cast("double")),
            XSD + "double": lambda: ("num", s[0].try_cast("double")),
        }
        known |= {"URI": known["IRI"], "ISURI": known["ISIRI"]}
        if name not in known:
            raise SparqlError(f"unknown function {name}")
        try:
            return known[name]()
        except IndexError:
            raise SparqlError(f"{name} lacks an argument") from None


# --- patterns -------------------------------------------------------------------------------


class Compiler:
    def __init__(self, triples: DataFrame, counts: dict[str, int] | None = None):
        """``counts``: triples per predicate, where known; they order the joins."""
        self.triples, self.counts, self.spark = triples, counts or {}, triples.sparkSession

    # -- scans and paths --

    def _subject(self) -> Column:
        return term(F.col("s"), F.when(F.startswith("s", F.lit("_:")), BLANK).otherwise(URI), F.lit(""), F.lit(""))

    def _object(self) -> Column:
        return term(F.col("o"), F.col("o_kind"), F.lower(F.coalesce("o_lang", F.lit(""))), F.coalesce("o_dtype", F.lit("")))

    def _ends(self, df: DataFrame, s, o) -> DataFrame:
        """Filters on constant ends, on the plain columns, so that they reach the scan."""
        if isinstance(s, Term):
            df = df.where(F.col("s") == s.value)
        if isinstance(o, Term):
            df = df.where((F.col("o") == o.value) & (F.col("o_kind") == o.kind))
            if o.kind == LITERAL:
                df = df.where((F.lower(F.coalesce("o_lang", F.lit(""))) == o.lang) & (F.coalesce("o_dtype", F.lit("")) == o.dtype))
        return df

    def scan(self, s, p, o) -> Solution:
        if isinstance(p, Path):
            return self._bound(self.pairs(p, s, o), s, o)
        df = self._ends(self.triples, s, o)
        if isinstance(p, Term):
            df = df.where(F.col("p") == p.value)
        columns: dict[str, list[Column]] = {}
        for part, c in ((s, self._subject()), (p, term(F.col("p"), F.lit(URI), F.lit(""), F.lit(""))), (o, self._object())):
            if isinstance(part, Var):
                columns.setdefault(part.name, []).append(c)
        for same in columns.values():
            for other in same[1:]:
                df = df.where(same[0] == other)
        return Solution(df.select(*(c[0].alias(n) for n, c in columns.items())) if columns else df.select(F.lit(1).alias("_hit")), set(columns), set())

    def _bound(self, pairs: DataFrame, s, o) -> Solution:
        for part, name in ((s, "s"), (o, "o")):
            if isinstance(part, Term):
                pairs = pairs.where(F.col(name) == constant(part))
        if isinstance(s, Var) and isinstance(o, Var) and s.name == o.name:
            return Solution(pairs.where("s = o").select(F.col("s").alias(s.name)), {s.name}, set())
        chosen = {part.name: F.col(name) for part, name in ((s, "s"), (o, "o")) if isinstance(part, Var)}
        return Solution(pairs.select(*(c.alias(n) for n, c in chosen.items())) if chosen else pairs.select(F.lit(1).alias("_hit")), set(chosen), set())

    def pairs(self, path, s=None, o=None) -> DataFrame:
        """s, o: what a path connects. ``s`` and ``o``: constant ends, from which closures start."""
        if isinstance(path, Term):
            return self._ends(self.triples.where(F.col("p") == path.value), s, o).select(self._subject().alias("s"), self._object().alias("o"))
        op, parts = path.op, path.parts
        if op == "inverse":
            return self.pairs(parts[0], o, s).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if op == "sequence":
            out = self.pairs(parts[0], s)
            for k, part in enumerate(parts[1:], 1):
                step = self.pairs(part, None, o if k == len(parts) - 1 else None).select(F.col("s").alias("_m"), F.col("o").alias("_o"))
                out = out.join(step, F.col("o") == F.col("_m")).select("s", F.col("_o").alias("o"))
            return out
        if op == "alternative":
            out = self.pairs(parts[0], s, o)
            for part in parts[1:]:
                out = out.unionByName(self.pairs(part, s, o))
            return out
        if op == "negated":
            ahead = [x.value for x in parts if isinstance(x, Term)]
            back = [x.parts[0].value for x in parts if isinstance(x, Path)]
            out = None
            if ahead or not back:
                out = self._ends(self.triples.where(~F.col("p").isin(*ahead)), s, o).select(self._subject().alias("s"), self._object().alias("o"))
            if back:
                turned = self.triples.where(~F.col("p").isin(*back)).select(self._object().alias("s"), self._subject().alias("o"))
                out = turned if out is None else out.unionByName(turned)
            return out
        inner = self.pairs(parts[0])
        if op == "optional":
            return inner.unionByName(self._identity(s, o)).distinct()
        out = self._closure(inner, s, o)
        return out.unionByName(self._identity(s, o)).distinct() if op == "star" else out

    def _identity(self, s, o) -> DataFrame:
        """Every node with itself; a constant end is a node even if no triple has it."""
        for end in (s, o):
            if isinstance(end, Term):
                return self.spark.range(1).select(constant(end).alias("s"), constant(end).alias("o"))
        nodes = self.triples.select(F.explode(F.array(self._subject(), self._object())).alias("s")).distinct()
        return nodes.select("s", F.col("s").alias("o"))

    def _closure(self, inner: DataFrame, s=None, o=None) -> DataFrame:
        """One step or more, by semi-naive rounds that only follow what is new."""
        turn = not isinstance(s, Term) and isinstance(o, Term)
        if turn:
            inner, s = inner.select(F.col("o").alias("s"), F.col("s").alias("o")), o
        inner = written(inner.distinct(), "path-step")
        first = inner.where(F.col("s") == constant(s)) if isinstance(s, Term) else inner
        known = frontier = written(first, "path-found")
        step = inner.select(F.col("s").alias("_m"), F.col("o").alias("_o"))
        while not frontier.isEmpty():
            reached = frontier.join(step, F.col("o") == F.col("_m")).select("s", F.col("_o").alias("o")).distinct()
            frontier = written(reached.join(known, ["s", "o"], "left_anti"), "path-new")
            known = known.unionByName(frontier)
        return known.select(F.col("o").alias("s"), F.col("s").alias("o")) if turn else known

    # -- joins --

    def _renamed(self, right: Solution) -> tuple[DataFrame, dict[str, str]]:
        names = {n: f"_r_{n}" for n in right.names}
        return right.df.select(*(_c(n).alias(m) for n, m in names.items())) if names else right.df.select(F.lit(1).alias("_r_hit")), names

    def _compatible(self, left: Solution, right: Solution, names: dict[str, str]) -> Column | None:
        out = None
        for n in sorted(left.names & right.names):
            a, b = _c(n), _c(names[n])
            same = a == b
            if n in left.maybe or n in right.maybe:
                same = same | a.isNull() | b.isNull()
            out = same if out is None else out & same
        return out

    def _merged(self, left: Solution, names: dict[str, str]) -> dict[str, Column]:
        out = {n: _c(n) for n in left.names}
        for n, m in names.items():
            out[n] = (F.coalesce(_c(n), _c(m)) if n in left.maybe else _c(n)) if n in left.names else _c(m)
        return out

    def join(self, left: Solution, right: Solution) -> Solution:
        shared = left.names & right.names
        if shared and shared <= left.certain & right.certain:
            return Solution(left.df.join(right.df, sorted(shared)), left.certain | right.certain, left.maybe | right.maybe)
        df, names = self._renamed(right)
        on = self._compatible(left, right, names)
        out = left.df.join(df, on) if on is not None else left.df.crossJoin(df)
        certain = left.certain | right.certain
        return Solution(out.select(*(c.alias(n) for n, c in self._merged(left, names).items())) if left.names | right.names else out.select(F.lit(1).alias("_hit")), certain, (left.maybe | right.maybe) - certain)

    def optional(self, left: Solution, group: Group) -> Solution:
        filters = [e for e in group.elements if e[0] == "filter" and not _has_exists(e[1])]
        right = self.group(Group([e for e in group.elements if e not in filters]))
        df, names = self._renamed(right)
        merged = self._merged(left, names)
        on = self._compatible(left, right, names)
        on = F.lit(True) if on is None else on
        for _, e in filters:
            on = on & F.coalesce(as_bool(Expressions(lambda n: merged.get(n, F.lit(None).cast(TERM))).value(e)), F.lit(False))
        out = left.df.join(df, on, "left")
        return Solution(out.select(*(c.alias(n) for n, c in merged.items())), set(left.certain), left.maybe | (right.names - left.certain))

    def minus(self, left: Solution, right: Solution) -> Solution:
        if not left.names & right.names:
            return left
        df, names = self._renamed(right)
        both = F.lit(False)
        for n in left.names & right.names:
            both = both | (_c(n).isNotNull() & _c(names[n]).isNotNull())
        on = self._compatible(left, right, names)
        certain = left.names & right.names & left.certain & right.certain
        return Solution(left.df.join(df, on if certain else on & both, "left_anti"), left.certain, left.maybe)

    def exists(self, left: Solution, group: Group, kept: bool) -> Solution:
        filters = [e for e in group.elements if e[0] == "filter" and not _has_exists(e[1])]
        right = self.group(Group([e for e in group.elements if e not in filters]))
        df, names = self._renamed(right)
        merged = self._merged(left, names)
        on = self._compatible(left, right, names)
        on = F.lit(True) if on is None else on
        for _, e in filters:
            on = on & F.coalesce(as_bool(Expressions(lambda n: merged.get(n, F.lit(None).cast(TERM))).value(e)), F.lit(False))
        return Solution(left.df.join(df, on, "left_semi" if kept else "left_anti"), left.certain, left.maybe)

    # -- groups --

    def _ordered(self, patterns: list, known: set[str]) -> list:
        """Most selective first, then always one that shares a variable with what is there."""

        def cost(x: tuple) -> tuple:
            parts = x[1:]
            names = {v.name for v in parts if isinstance(v, Var)}
            fixed = sum(isinstance(v, Term) for v in (x[1], x[3]))
            size = self.counts.get(x[2].value, 0) if isinstance(x[2], Term) else 1 << 62
            return (bool(known) and not names & known, -fixed, isinstance(x[2], Path), size)

        left, out, known = list(patterns), [], set(known)
        while left:
            best = min(left, key=cost)
            left.remove(best)
            out.append(best)
            known |= {v.name for v in best[1:] if isinstance(v, Var)}
        return out

    def _whole(self, patterns: list) -> Solution:
        """Patterns that all read whole predicates, joined as a tree.

        What a subject has is put together before two subjects meet: first a name
        is looked up as a subject, then patterns of one subject meet, and only then
        those that share objects, by all they share. So patterns that close a ring
        narrow the join that is wide. Terms go through the joins as single strings.
        """
        parts = []
        for x in patterns:
            found = self.scan(*x[1:])
            parts.append((Solution(found.df.select(*(packed(_c(n)).alias(n) for n in sorted(found.names))), found.certain, set()), {x[1].name}))

        def cost(i: int, j: int) -> tuple:
            (a, heads), (b, others) = parts[i], parts[j]
            shared = a.names & b.names
            return (not shared, 0 if shared & (heads ^ others) else 1 if shared & heads else 2, -len(shared), i, j)

        while len(parts) > 1:
            i, j = min(((i, j) for i in range(len(parts)) for j in range(i + 1, len(parts))), key=lambda x: cost(*x))
            (a, heads), (b, others) = parts[i], parts.pop(j)
            parts[i] = self.join(a, b), heads | others
        s = parts[0][0]
        return Solution(s.df.select(*(unpacked(_c(n)).alias(n) for n in sorted(s.names))), s.certain, set())

    def group(self, g: Group) -> Solution:
        now: Solution | None = None
        unit = lambda: Solution(self.spark.range(1).select(F.lit(1).alias("_hit")), set(), set())
        waiting: list = []

        def flush() -> None:
            nonlocal now
            if now is None and len(waiting) > 2 and all(isinstance(x[1], Var) and isinstance(x[2], Term) and isinstance(x[3], Var) for x in waiting):
                now = self._whole(waiting if not self.counts else self._ordered(waiting, set()))
                waiting.clear()
                return
            for x in self._ordered(waiting, now.names if now else set()):
                found = self.scan(*x[1:])
                now = found if now is None else self.join(now, found)
            waiting.clear()

        filters = []
        for x in g.elements:
            if x[0] == "triple":
                waiting.append(x)
                continue
            if x[0] == "filter":
                filters.append(x[1])
                continue
            flush()
            if x[0] == "optional":
                now = self.optional(now or unit(), x[1])
            elif x[0] == "minus":
                now = self.minus(now or unit(), self.group(x[1]))
            elif x[0] == "bind":
                if now and x[1] in now.names:
                    raise SparqlError(f"?{x[1]} is bound already")
                now = now or unit()
                now = Solution(now.df.withColumn(x[1], as_term(self.expressions(now).value(x[2]))), now.certain, now.maybe | {x[1]})
            else:
                found = {"values": lambda: self.values(x[1], x[2]), "union": lambda: self.union([self.group(p) for p in x[1]]), "group": lambda: self.group(x[1]), "query": lambda: self.query(x[1])}[x[0]]()
                now = found if now is None else self.join(now, found)
        flush()
        now = now or unit()
        for e in filters:
            for part in _conjuncts(e):
                if part[0] in ("exists", "not_exists"):
                    now = self.exists(now, part[1], part[0] == "exists")
                elif part[0] == "not" and part[1][0] == "exists":
                    now = self.exists(now, part[1][1], False)
                else:
                    now = Solution(now.df.where(as_bool(self.expressions(now).value(part))), now.certain, now.maybe)
        return now

    def expressions(self, s: Solution, aggregates: dict | None = None) -> Expressions:
        return Expressions(lambda n: _c(n) if n in s.names else F.lit(None).cast(TERM), aggregates)

    def values(self, names: list[str], rows: list) -> Solution:
        schema = ", ".join(f"`{n}` {TERM}" for n in names)
        data = [tuple(None if t is None else (t.value, t.kind, t.lang, t.dtype) for t in row) for row in rows]
        maybe = {n for k, n in enumerate(names) if any(r[k] is None for r in rows)}
        return Solution(self.spark.createDataFrame(data, schema), set(names) - maybe, maybe)

    def union(self, parts: list[Solution]) -> Solution:
        names = sorted(set().union(*(p.names for p in parts)))
        certain = set.intersection(*(p.certain for p in parts))
        out = None
        for p in parts:
            df = p.df.select(*(_c(n) if n in p.names else F.lit(None).cast(TERM).alias(n) for n in names)) if names else p.df.select(F.lit(1).alias("_hit"))
            out = df if out is None else out.unionByName(df)
        return Solution(out, certain, set(names) - certain)

    # -- queries --

    def query(self, q: Query) -> Solution:
        s = self.group(q.where)
        aggregates: dict = {}
        grouped = bool(q.group_by or q.having) or any(_has_aggregate(e) for _, e in q.columns if e) or any(_has_aggregate(e) for e, _ in q.order_by)
        if grouped:
            if q.star:
                raise SparqlError("SELECT * can't be grouped")
            s, q = self._grouped(s, q, aggregates)
        made = {n: as_term(self.expressions(s, aggregates if grouped else None).value(e)) for n, e in q.columns if e is not None}
        df = s.df
        for n, c in made.items():
            df = df.withColumn(n, c)
        s = Solution(df, s.certain, s.maybe | set(made))
        if q.order_by and not q.distinct:
            df = df.orderBy(*self._order(s, q, aggregates if grouped else None))
        names = sorted(n for n in s.names if not n.startswith(("_:", "_agg"))) if q.star else [n for n, _ in q.columns]
        for n in names:
            if n not in s.names:
                df = df.withColumn(n, F.lit(None).cast(TERM))
        df = df.select(*(_c(n) for n in names)) if names else df.select(F.lit(1).alias("_hit"))
        if q.distinct:
            df = df.distinct()
            if q.order_by:
                df = df.orderBy(*self._order(Solution(df, s.certain & set(names), set(names)), q, None))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        self.columns = names
        return Solution(df, s.certain & set(names), set(names) - s.certain)

    def _order(self, s: Solution, q: Query, aggregates: dict | None) -> list[Column]:
        """Unbound, blank, names, literals; numbers by value."""
        keys = []
        for e, down in q.order_by:
            t = as_term(self.expressions(s, aggregates).value(e))
            rank = F.when(t.isNull(), 0).when(t["k"] == BLANK, 1).when(t["k"] == URI, 2).otherwise(3)
            n = _numeric(t)
            for c in (rank, n, *(F.when(n.isNull(), t[k]) for k in "vld")):
                keys.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        return keys

    def _grouped(self, s: Solution, q: Query, aggregates: dict) -> tuple[Solution, Query]:
        keys = {}
        for k, (name, e) in enumerate(q.group_by):
            keys[name or f"_:key{k}"] = as_term(self.expressions(s).value(e))
        probe = self.expressions(s, aggregates)
        for e in [e for _, e in q.columns if e] + q.having + [e for e, _ in q.order_by]:
            _visit(e, lambda x: probe.value(x) if x[0] == "aggregate" else None)
        base = s.df.select(*(c.alias(n) for n, c in keys.items()), *(_c(n) for n in s.names if n not in keys))
        inner = Solution(base, s.certain, s.maybe)
        made = [self._aggregate(inner, e).alias(name) for name, e in aggregates.values()] or [F.count("*").alias("_agg")]
        df = base.groupBy(*(_c(n) for n in keys)).agg(*made)
        out = Solution(df, set(keys) & s.certain, set(keys) - s.certain)
        for e in q.having:
            df = df.where(as_bool(self.expressions(out, aggregates).value(e)))
        for n, e in q.columns:
            if e is None and n not in keys:
                raise SparqlError(f"?{n} is neither grouped nor aggregated")
        return Solution(df, out.certain, out.maybe), q

    def _aggregate(self, s: Solution, e: tuple) -> Column:
        _, name, distinct, inner, separator = e
        if inner is None:
            rows = F.struct(*(_c(n) for n in sorted(s.names))) if distinct and s.names else None
            return as_term(("num", (F.count_distinct(rows) if rows is not None else F.count("*")).cast("double")))
        value = self.expressions(s).value(inner)
        t = as_term(value)
        if name == "COUNT":
            return as_term(("num", (F.count_distinct(t) if distinct else F.count(t)).cast("double")))
        if name in ("SUM", "AVG"):
            n = as_number(value)
            total = F.sum_distinct(n) if distinct and name == "SUM" else {"SUM": F.sum, "AVG": F.avg}[name](n)
            return as_term(("num", F.coalesce(total, F.lit(0.0)) if name == "SUM" else total))
        if name == "GROUP_CONCAT":
            v = as_string(value)
            return as_term(("str", F.array_join(F.array_sort(F.collect_set(v) if distinct else F.collect_list(v)), separator)))
        key = F.struct(_numeric(t).alias("n"), t["v"].alias("v"))
        chosen = F.max_by(t, key) if name == "MAX" else F.min_by(t, key)
        return F.when(F.count(t) > 0, chosen)


def _conjuncts(e: tuple) -> list[tuple]:
    return [*_conjuncts(e[1]), *_conjuncts(e[2])] if e[0] == "and" else [e]


def _visit(e, see) -> None:
    if isinstance(e, tuple) and e and isinstance(e[0], str):
        see(e)
        for x in e[1:]:
            _visit(x, see)
    elif isinstance(e, list):
        for x in e:
            _visit(x, see)


def _has(e, ops: tuple[str, ...]) -> bool:
    found = []
    _visit(e, lambda x: found.append(1) if x[0] in ops else None)
    return bool(found)


def _has_aggregate(e) -> bool:
    return _has(e, ("aggregate",))


def _has_exists(e) -> bool:
    return _has(e, ("exists", "not_exists"))


def select(triples: DataFrame, text: str, prefixes: dict[str, str] | None = None, counts: dict[str, int] | None = None, terms: bool = False) -> DataFrame:
    """The rows of a query, a string per variable (null if unbound), in the order of SELECT.

    ``terms``: whole terms instead of their values. Reading and compiling raise
    SparqlError before anything runs.
    """
    q = parse(text, prefixes)
    compiler = Compiler(triples, counts)
    s = compiler.query(q)
    if q.form == "ask":
        return s.df.agg((F.count("*") > 0).alias("answer"))
    return s.df if terms else s.df.select(*(_c(n)["v"].alias(n) for n in compiler.columns))


def predicate_counts(triples: DataFrame, most: int = 10_000) -> dict[str, int]:
    """Triples per predicate, of the commonest at most so many; the order of joins does without the others."""
    return {r.p: r["count"] for r in triples.groupBy("p").count().orderBy(F.col("count").desc(), "p").limit(most).collect()}
