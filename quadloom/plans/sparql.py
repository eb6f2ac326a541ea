"""A subset of SPARQL on the mapping view: SELECT [DISTINCT], FROM, and one basic graph pattern.

Catalyst doesn't invert templates, so this planner does. A constant IRI is taken apart and compared part by
part with a table's constants, prefixes and typed columns: what can't hold it drops out, the rest gets
plain column filters that reach the Parquet scan. Terms made by equal templates are joined on raw columns,
terms that can never be equal are not joined at all, and patterns that meet in the row of a merged table
need no join.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import iri
from quadloom.functions.lexical import RDF, XSD
from quadloom.functions.naming import DEFAULT_NAMESPACES
from quadloom.operators import terms
from quadloom.plans.model import BNODE, IRI, LITERAL, Col, Group, PredicateMap, Table
from quadloom.sources.turtle import unescape

_TOKEN = re.compile(
    r"\s+|#[^\n]*|(?P<iri><[^<>\"{}|^`\\\x00-\x20]*>)|(?P<var>[?$]\w+)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)"
    r"|(?P<blank>_:\w+)|(?P<name>(?:[A-Za-z][\w.-]*)?:[\w%-]*(?:[\w.%-]*[\w%-])?)|(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z]+)|(?P<mark>\^\^|[{}\[\].;,*])"
)


class QueryFault(ValueError):
    """A query outside the subset, or no query at all."""


@dataclass(frozen=True)
class Const:
    kind: str
    value: str
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Query:
    variables: tuple[str, ...]
    distinct: bool
    graphs: tuple[str, ...]
    patterns: tuple[tuple, ...]
    limit: int | None = None


def parse(text: str) -> Query:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise QueryFault(f"no token at {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
    tokens.append(("end", ""))
    prefixes, pos, fresh = dict(DEFAULT_NAMESPACES), 0, 0

    def peek() -> tuple[str, str]:
        return tokens[pos]

    def take(want: str | None = None) -> tuple[str, str]:
        nonlocal pos
        if want is not None and tokens[pos][1].upper() != want:
            raise QueryFault(f"{want} should stand where {tokens[pos][1]!r} does")
        pos += 1
        return tokens[pos - 1]

    def resource(token: tuple[str, str]) -> str:
        if token[0] == "iri":
            return token[1][1:-1]
        prefix, _, local = token[1].partition(":")
        if token[0] != "name" or prefix not in prefixes:
            raise QueryFault(f"no IRI: {token[1]!r}")
        return prefixes[prefix] + local

    def term() -> Const | Var:
        nonlocal fresh
        kind, value = take()
        if kind == "var":
            return Var(value[1:])
        if kind == "blank":
            return Var(f" {value}")  # a blank node of a query is a variable that isn't selected
        if value == "[":
            fresh += 1
            node = Var(f" {fresh}")
            if peek()[1] != "]":
                pairs(node)
            take("]")
            return node
        if kind == "string":
            s = unescape(value[1:-1])
            if peek()[0] == "lang":
                return Const(LITERAL, s, RDF + "langString", take()[1][1:])
            if peek()[1] == "^^":
                take()
                return Const(LITERAL, s, resource(take()))
            return Const(LITERAL, s, XSD + "string")
        if kind == "number":
            return Const(LITERAL, value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if kind == "word" and value in ("true", "false"):
            return Const(LITERAL, value, XSD + "boolean")
        return Const(IRI, resource((kind, value)))

    found: list[tuple] = []

    def pairs(subject) -> None:
        while True:
            if peek() == ("word", "a"):
                take()
                predicate = Const(IRI, RDF + "type")
            else:
                predicate = term()
            while True:
                found.append((subject, predicate, term()))
                if peek()[1] != ",":
                    break
                take()
            if peek()[1] != ";":
                return
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "}", "]"):
                return

    while peek()[1].upper() in ("PREFIX", "BASE"):
        take("PREFIX")
        name = take()[1]
        prefixes[name[:-1]] = resource(take())
    take("SELECT")
    distinct = peek()[1].upper() in ("DISTINCT", "REDUCED") and take()[1].upper() == "DISTINCT"
    names = []
    while peek()[0] == "var" or peek()[1] == "*":
        names.append(take()[1])
    graphs = []
    while peek()[1].upper() == "FROM":
        take()
        graphs.append(resource(take()))
    if peek()[1].upper() == "WHERE":
        take()
    take("{")
    while peek()[1] != "}":
        if peek()[0] == "word" and peek()[1] not in ("a", "true", "false"):
            raise QueryFault(f"{peek()[1]} is outside the subset")
        bare = peek()[1] == "["
        subject = term()
        if not (bare and peek()[1] in (".", "}")):
            pairs(subject)
        if peek()[1] != "}":
            take(".")
    take("}")
    limit = None
    if peek()[1].upper() == "LIMIT":
        take()
        limit = int(take()[1])
    if peek()[0] != "end":
        raise QueryFault(f"{peek()[1]!r} is outside the subset")
    seen = tuple(dict.fromkeys(t.name for p in found for t in p if isinstance(t, Var) and not t.name.startswith(" ")))
    variables = seen if names == ["*"] else tuple(n[1:] for n in names)
    if not variables or set(variables) - set(seen):
        raise QueryFault("a selected variable is in no pattern")
    return Query(variables, distinct, tuple(graphs), tuple(found), limit)


# --- terms of branches -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bound:
    """What a variable is in a branch: a group of columns of that branch."""

    group: Group
    kind: str
    lang: str | None = None
    datatype: str | None = None

    def text(self) -> Column:
        return terms.term(self.group, self.kind)


@dataclass
class Branch:
    df: DataFrame
    bound: dict[str, Bound]
    tables: dict[str, tuple] = field(default_factory=dict)  # table: subject's name, and the alias of its columns
    subjects: list[tuple] = field(default_factory=list)  # variable, table, what it took from others, origin of the predicate


def _renamed(g: Group, alias: str) -> Group:
    return Group(tuple(replace(c, name=alias + c.name) for c in g.columns))


def invert(g: Group, kind: str, value: str) -> Column | bool:
    """The filter under which a group is this term; False if it never is, True if it always is."""
    if kind == IRI:
        wanted = iri.split(value)
    elif kind == BNODE:
        if not re.fullmatch(r"_:b\d+", value):
            return False
        wanted = {"id": value[3:]}
    else:
        wanted = {c.part: value for c in g.columns if c.part in ("langvalue", "litvalue")}
    out: Column | bool = True
    for c in g.columns:
        if c.part not in wanted:
            continue
        v = wanted[c.part]
        if c.virtual:
            if c.value != v:
                return False
            continue
        one = _equals(c, v)
        if one is False:
            return False
        out = one if out is True else out & one
    return out


def _equals(c: Col, v: str | None) -> Column | bool:
    from quadloom.functions import lexical

    x = F.col(f"`{c.name}`")
    if v is None:
        return x.isNull()
    if not v.startswith(c.prefix):
        return False
    rest = v[len(c.prefix) :]
    if c.datatype in ("TEXT", "GRAPH_IRIS", "SCHEME", "HOST"):
        return x == rest
    if c.datatype in ("INTEGER", "BIGINT", "GYEAR"):
        if not re.fullmatch(r"-?\d{1,18}", rest) or (str(int(rest)) != rest if c.datatype != "GYEAR" else f"{'-' if rest[0] == '-' else ''}{abs(int(rest)):04d}" != rest):
            return False
        return x == F.lit(int(rest))
    return lexical.to_lexical(x, c.datatype) == rest


def _shape(b: Bound) -> tuple:
    return tuple((c.part, c.virtual, c.value, c.prefix, c.datatype) for c in b.group.columns)


def apart(a: Bound, b: Bound) -> bool:
    """Whether two terms can never be equal."""
    if a.kind != b.kind or a.lang != b.lang or a.datatype != b.datatype:
        return True
    if a.kind == BNODE:
        return False
    for x in a.group.columns:
        y = b.group.column(x.part)
        if y is None:
            continue
        if x.virtual and y.virtual and x.value != y.value:
            return True
        if x.virtual != y.virtual:
            fixed, open_ = (x, y) if x.virtual else (y, x)
            if fixed.value is not None and not fixed.value.startswith(open_.prefix):
                return True
        elif not x.virtual and not (x.prefix.startswith(y.prefix) or y.prefix.startswith(x.prefix)):
            return True
    return False


def equal(a: Bound, b: Bound) -> Column:
    """The condition of a join on a term: on raw columns if both are made alike."""
    if _shape(a) != _shape(b):
        return a.text() == b.text()
    out = None
    for x, y in zip(a.group.columns, b.group.columns, strict=True):
        if not x.virtual:
            one = F.col(f"`{x.name}`").eqNullSafe(F.col(f"`{y.name}`"))
            out = one if out is None else out & one
    return F.lit(True) if out is None else out


def _branches(tables: list[tuple[Table, DataFrame]], pattern: tuple, graphs: tuple[str, ...], number: int) -> list[Branch]:
    subject, predicate, obj = pattern
    out = []
    for t, df in tables:
        for p in t.predicates:
            if isinstance(predicate, Const) and predicate.value != p.predicate:
                continue
            filters: list[Column] = [F.col(f"`{p.presence}`").isNotNull()] if p.presence else []
            bound: dict[str, Bound] = {}
            alias = f"t{number}_"
            ok = True
            spots = ((subject, Bound(t.subject, t.subject_kind)), (obj, Bound(Group(tuple(c for c in p.objects.columns if c.part != "graph")), p.kind, p.lang, None if p.lang else p.datatype)))
            for want, b in spots:
                if isinstance(want, Const):
                    same = want.kind == b.kind and want.lang == b.lang and (want.lang is not None or b.kind != LITERAL or want.datatype == b.datatype)
                    f = invert(b.group, b.kind, want.value) if same else False
                    ok &= f is not False
                    if not isinstance(f, bool):
                        filters.append(f)
                elif want.name in bound:
                    if apart(bound[want.name], b):
                        ok = False
                    else:
                        filters.append(equal(bound[want.name], b))
                else:
                    bound[want.name] = b
            if graphs:
                c = p.objects.column("graph")
                if c.virtual:
                    ok &= c.value in graphs
                else:
                    filters.append(F.col(f"`{c.name}`").isin([g[len(c.prefix) :] for g in graphs if g.startswith(c.prefix)]))
            if not ok:
                continue
            if isinstance(predicate, Var):
                bound[predicate.name] = Bound(Group(tuple(Col(f"_p{number}_{k}", k, virtual=True, value=v) for k, v in iri.split(p.predicate).items())), IRI)
            rows = df
            for f in filters:
                rows = rows.where(f)
            rows = rows.select(*[F.col(f"`{c}`").alias(alias + c) for c in df.columns])
            unique = t.facts.get("unique") and isinstance(subject, Var)
            out.append(Branch(rows, {k: replace(b, group=_renamed(b.group, alias)) for k, b in bound.items()}, {t.name: (subject.name, alias, filters, p)} if unique else {}, [(subject.name, t.name, t.facts.get("took", ()), p.origin or t.name)] if isinstance(subject, Var) else []))
    return out


def _in_row(a: Branch, b: Branch, number: int) -> Branch | None:
    """Both patterns about one subject in the same table whose subjects are unique: one row serves both."""
    for name, (subject, alias, _, _) in a.tables.items():
        if name in b.tables and b.tables[name][0] == subject:
            _, old, filters, _ = b.tables[name]
            rows = a.df
            for f in filters:
                # the filters name bare columns; here those carry the first pattern's alias
                rows = _aliased_where(rows, f, alias)
            bound = dict(a.bound)
            for v, x in b.bound.items():
                moved = replace(x, group=Group(tuple(replace(c, name=alias + c.name[len(old) :]) for c in x.group.columns)))
                if v in bound and v != subject:
                    if apart(bound[v], moved):
                        return Branch(rows.where(F.lit(False)), bound, a.tables, a.subjects + b.subjects)
                    rows = rows.where(equal(bound[v], moved))
                bound.setdefault(v, moved)
            return Branch(rows, bound, a.tables, a.subjects + b.subjects)
    return None


def _aliased_where(df: DataFrame, f: Column, alias: str) -> DataFrame:
    bare = df.select("*", *[F.col(f"`{c}`").alias(c[len(alias) :]) for c in df.columns if c.startswith(alias)])
    return bare.where(f).select(*df.columns)


def _joined(a: Branch, b: Branch, number: int) -> Branch | None:
    shared = [v for v in b.bound if v in a.bound]
    if any(apart(a.bound[v], b.bound[v]) for v in shared):
        return None
    # a table that took its subjects' rows from another left none of them there or in any other table
    for va, ta, took_a, from_a in a.subjects:
        for vb, tb, took_b, from_b in b.subjects:
            if va == vb and ta != tb and (from_b in took_a or from_a in took_b):
                return None
    if (one := _in_row(a, b, number)) is not None:
        return one
    on = None
    for v in shared:
        c = equal(a.bound[v], b.bound[v])
        on = c if on is None else on & c
    df = a.df.join(b.df, on) if on is not None else a.df.crossJoin(b.df)
    return Branch(df, {**b.bound, **a.bound}, {**b.tables, **a.tables}, a.subjects + b.subjects)


def _order(patterns: tuple[tuple, ...]) -> list[tuple]:
    """Patterns so that each shares a variable with those before it, if any does; constants first."""
    left, out, known = list(patterns), [], set()
    while left:
        names = lambda p: {t.name for t in p if isinstance(t, Var)}
        best = max(left, key=lambda p: (bool(names(p) & known) or not out, sum(isinstance(t, Const) for t in p), -left.index(p)))
        left.remove(best)
        out.append(best)
        known |= names(best)
    return out


def select(spark: SparkSession, tables: list[tuple[Table, DataFrame]], query: str | Query) -> DataFrame:
    """Rows of a query: a string column for each variable (IRI, `_:b` and number, or lexical form).

    Tables loaded hold each quad once, but a triple of several graphs counts for each of them without FROM, and
    once per graph named in FROM; DISTINCT takes that away.
    """
    q = parse(query) if isinstance(query, str) else query
    now: list[Branch] | None = None
    for number, pattern in enumerate(_order(q.patterns)):
        found = _branches(tables, pattern, q.graphs, number)
        now = found if now is None else [j for a in now for b in found if (j := _joined(a, b, number)) is not None]
    out = None
    for b in now or []:
        one = b.df.select(*[b.bound[v].text().alias(v) for v in q.variables])
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"`{v}` string" for v in q.variables))
    out = out.distinct() if q.distinct else out
    return out.limit(q.limit) if q.limit is not None else out


__all__ = ["DataFrame", "PredicateMap", "Query", "QueryFault", "parse", "select"]
