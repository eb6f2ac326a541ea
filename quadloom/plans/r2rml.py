"""R2RML documents: written from descriptions of tables, read back, and evaluated as a view.

A template of IRI parts is emitted where no part can be null. Where one can, a null would take the whole term
away, so the logical table then is a query that puts the term together and leaves a missing part's delimiter out.
Column values go into templates as they are.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import iri
from quadloom.functions.lexical import RDF, RDFS, XSD
from quadloom.plans.catalog import Catalog
from quadloom.plans.model import BNODE, IRI, LITERAL, Col, Group, PredicateMap, Table
from quadloom.sources.lines import QUADS
from quadloom.sources.turtle import Parser, quote

RR = "http://www.w3.org/ns/r2rml#"
#: Terms of the vocabulary; the first line has those that are emitted.
EMITTED = ("TriplesMap", "logicalTable", "tableName", "sqlQuery", "subjectMap", "class", "predicateObjectMap", "predicate", "objectMap", "termType", "template", "column", "constant", "datatype", "language", "graph", "graphMap", "IRI", "BlankNode", "Literal")
OTHERS = ("child", "inverseExpression", "joinCondition", "object", "parent", "parentTriplesMap", "predicateMap", "sqlVersion", "subject", "defaultGraph", "SQL2008")
TYPES = {IRI: RR + "IRI", BNODE: RR + "BlankNode", LITERAL: RR + "Literal"}
_BEFORE = {"user_info": "", "port": ":", "query": "?", "fragment": "#"}
_AFTER = {"scheme": ":", "user_info": "@"}


@dataclass(frozen=True)
class TermMap:
    """One of template, column and constant."""

    kind: str
    template: str | None = None
    column: str | None = None
    constant: str | None = None
    datatype: str | None = None
    language: str | None = None


@dataclass(frozen=True)
class ObjectMap:
    predicate: str
    term: TermMap
    graph: TermMap


@dataclass(frozen=True)
class TriplesMap:
    name: str
    table: str | None
    query: str | None
    subject: TermMap
    classes: tuple[str, ...] = ()
    class_graph: TermMap | None = None
    objects: tuple[ObjectMap, ...] = ()


def brace(s: str) -> str:
    return s.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}")


def _pieces(g: Group) -> list[tuple[Col, str, str]]:
    """Parts that aren't known to be absent, with what stands before and after each."""
    by = {c.part: c for c in g.columns}
    there = [c for c in (by.get(p) for p in iri.PARTS) if c is not None and not (c.virtual and c.value is None)]
    return [(c, ("//" if c.part in ("user_info", "host") and not (c.part == "host" and by["user_info"] in there) else _BEFORE.get(c.part, "")), _AFTER.get(c.part, "")) for c in there]


def _nullable(c: Col, facts: dict) -> bool:
    return not c.virtual and c.part != "scheme_specific_part" and c.name not in facts.get("whole", ())


def template(g: Group) -> str:
    return "".join(brace(a) + (brace(c.value) if c.virtual else brace(c.prefix) + "{" + c.name + "}") + brace(z) for c, a, z in _pieces(g))


def _lexical_sql(c: Col) -> str:
    name = f"`{c.name}`"
    if c.datatype == "GYEAR":
        return f"concat(if({name} < 0, '-', ''), lpad(cast(abs({name}) as string), greatest(4, length(cast(abs({name}) as string))), '0'))"
    return f"cast({name} as string)"


def _literal_sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def iri_sql(g: Group) -> str:
    """The IRI of a group as SQL; what is null leaves its delimiters out too."""
    by = {c.part: c for c in g.columns}
    of = lambda c: _literal_sql(c.value) if c.virtual else f"concat({_literal_sql(c.prefix)}, {_lexical_sql(c)})" if c.prefix else _lexical_sql(c)
    part = lambda p, a, z: "''" if p not in by or (by[p].virtual and by[p].value is None) else f"coalesce(concat({_literal_sql(a)}, {of(by[p])}, {_literal_sql(z)}), '')"
    hier = f"concat('//', {part('user_info', '', '@')}, {part('host', '', '')}, {part('port', ':', '')}, {part('path', '', '')}, {part('query', '?', '')})"
    ssp = by.get("scheme_specific_part")
    middle = hier if ssp is None or (ssp.virtual and ssp.value is None) else of(ssp) if ssp.virtual else f"coalesce({of(ssp)}, {hier})"
    return f"concat({part('scheme', '', ':')}, {middle}, {part('fragment', '#', '')})"


def _term_map(g: Group, kind: str, facts: dict, lang: str | None, datatype: str | None, side: str, queries: dict[str, str]) -> TermMap:
    by = {c.part: c for c in g.columns}
    if kind == BNODE:
        c = by["id"]
        return TermMap(BNODE, template=f"b{c.value}") if c.virtual else TermMap(BNODE, template="b{" + c.name + "}")
    if kind == LITERAL:
        c = by["langvalue"] if lang else by["litvalue"]
        if c.virtual:
            return TermMap(LITERAL, constant=c.value, datatype=datatype, language=lang)
        if c.datatype == "GYEAR" or c.prefix:
            queries[f"{c.name}_lexical"] = f"concat({_literal_sql(c.prefix)}, {_lexical_sql(c)})"
            return TermMap(LITERAL, column=f"{c.name}_lexical", datatype=datatype, language=lang)
        return TermMap(LITERAL, column=c.name, datatype=datatype, language=lang)
    parts = _pieces(g)
    if any(_nullable(c, facts) for c, _, _ in parts):
        queries[f"{side}_iri"] = iri_sql(g)
        return TermMap(IRI, column=f"{side}_iri")
    if all(c.virtual for c, _, _ in parts):
        return TermMap(IRI, constant="".join(a + c.value + z for c, a, z in parts))
    return TermMap(IRI, template=template(g))


def mapping(tables: list[Table]) -> list[TriplesMap]:
    """Triples maps: one for each table, and one more for each predicate that not all of its rows have."""
    out = []
    for t in sorted(tables, key=lambda x: x.name):
        always = [p for p in t.predicates if not p.presence]
        for n, group in enumerate([always, *([p] for p in t.predicates if p.presence)]):
            if not group:
                continue
            queries: dict[str, str] = {}
            subject = _term_map(t.subject, t.subject_kind, t.facts, None, None, "subject", queries)
            classes, class_graph, objects = [], None, []
            for i, p in enumerate(group):
                c = p.objects.column("graph")
                graph = TermMap(IRI, constant=c.value) if c.virtual else TermMap(IRI, template=(brace(c.prefix) + "{" + c.name + "}"))
                term = _term_map(Group(tuple(x for x in p.objects.columns if x.part != "graph")), p.kind, t.facts, p.lang, p.datatype, f"object{i}", queries)
                if p.predicate == RDF + "type" and p.kind == IRI and term.constant is not None and class_graph is None:
                    classes.append(term.constant)
                    class_graph = graph
                else:
                    objects.append(ObjectMap(p.predicate, term, graph))
            query = None
            if queries or group[0].presence:
                more = "".join(f", {sql} AS `{name}`" for name, sql in queries.items())
                query = f"SELECT *{more} FROM `{t.name.lower()}`" + (f" WHERE `{group[0].presence}` IS NOT NULL" if group[0].presence else "")
            out.append(TriplesMap(t.name.lower() + (f"_{n}" if n else ""), None if query else t.name.lower(), query, subject, tuple(classes), class_graph, tuple(objects)))
    return out


# --- Turtle ------------------------------------------------------------------------------------------


def _resource(x: str) -> str:
    for prefix, start in (("rr", RR), ("rdf", RDF), ("rdfs", RDFS), ("xsd", XSD)):
        if x.startswith(start) and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", x[len(start) :]):
            return f"{prefix}:{x[len(start):]}"
    return "<" + re.sub(r'[\x00-\x20<>"{}|^`\\]', lambda m: f"\\u{ord(m[0]):04X}", x) + ">"


def _term_turtle(m: TermMap, with_type: bool = True) -> str:
    if m.constant is not None:
        value = _resource(m.constant) if m.kind == IRI else quote(m.constant) + (f"@{m.language}" if m.language else f"^^{_resource(m.datatype)}" if m.datatype else "")
        return f"[ rr:constant {value} ]"
    out = [f"rr:template {quote(m.template)}"] if m.template is not None else [f"rr:column {quote(m.column)}"]
    if with_type:
        out.append(f"rr:termType {_resource(TYPES[m.kind])}")
    if m.language:
        out.append(f"rr:language {quote(m.language)}")
    elif m.datatype:
        out.append(f"rr:datatype {_resource(m.datatype)}")
    return "[ " + " ; ".join(out) + " ]"


def _graph_turtle(g: TermMap) -> str:
    return f"rr:graph {_resource(g.constant)}" if g.constant is not None else f"rr:graphMap {_term_turtle(g)}"


def to_turtle(maps: list[TriplesMap]) -> str:
    """The document, sorted by the maps' names."""
    out = [f"@prefix {p}: <{s}> ." for p, s in (("rr", RR), ("rdf", RDF), ("rdfs", RDFS), ("xsd", XSD))]
    for m in sorted(maps, key=lambda x: x.name):
        logical = f"[ rr:sqlQuery {quote(m.query)} ]" if m.query else f"[ rr:tableName {quote(m.table)} ]"
        subject = _term_turtle(m.subject)
        if m.classes:
            subject = subject[:-2] + "".join(f" ; rr:class {_resource(c)}" for c in m.classes) + f" ; {_graph_turtle(m.class_graph)} ]"
        lines = ["a rr:TriplesMap", f"rr:logicalTable {logical}", f"rr:subjectMap {subject}"]
        for o in m.objects:
            # the graph stands at the predicate-object map, so it holds for that predicate alone
            lines.append(f"rr:predicateObjectMap [\n    rr:predicate {_resource(o.predicate)} ;\n    rr:objectMap {_term_turtle(o.term)} ;\n    {_graph_turtle(o.graph)}\n  ]")
        out.append(f"\n<#{m.name}> " + " ;\n  ".join(lines) + " .")
    return "\n".join(out) + "\n"


@dataclass
class _Node:
    edges: dict[str, list[tuple]] = field(default_factory=dict)

    def one(self, name: str):
        return next(iter(self.edges.get(RR + name, [])), None)


def from_turtle(text: str) -> list[TriplesMap]:
    """Triples maps of a document, of this writer or another that keeps to the terms above."""
    nodes: dict[str, _Node] = {}
    for _, s, p, *o in Parser(io.BytesIO(text.encode()), base="base:"):
        nodes.setdefault(s, _Node()).edges.setdefault(p, []).append(tuple(o[:4]))

    def value(x):
        return None if x is None else x[1]

    def term_map(n: _Node, default: str) -> TermMap:
        const = n.one("constant")
        kinds = {v: k for k, v in TYPES.items()}
        kind = kinds.get(value(n.one("termType"))) or ({"LITERAL": LITERAL, "IRI": IRI}[const[0]] if const else default if n.one("template") or not (n.one("language") or n.one("datatype") or n.one("column")) else LITERAL)
        dt, lang = value(n.one("datatype")), value(n.one("language"))
        if const is not None and const[0] == "LITERAL":
            dt, lang = None if const[3] else const[2], const[3]
        return TermMap(kind, value(n.one("template")), value(n.one("column")), value(const), dt, lang)

    def graph(n: _Node) -> TermMap | None:
        return TermMap(IRI, constant=value(n.one("graph"))) if n.one("graph") else term_map(nodes[n.one("graphMap")[1]], IRI) if n.one("graphMap") else None

    out = []
    for name, n in nodes.items():
        if n.one("logicalTable") is None:
            continue
        logical, subject = nodes[n.one("logicalTable")[1]], nodes[n.one("subjectMap")[1]]
        everywhere = graph(subject)
        objects = []
        for _, at, *_ in n.edges.get(RR + "predicateObjectMap", []):
            po = nodes[at]
            objects += [ObjectMap(p[1], term_map(nodes[o[1]], IRI), graph(po) or everywhere) for p in po.edges[RR + "predicate"] for o in po.edges[RR + "objectMap"]]
        classes = tuple(c[1] for c in subject.edges.get(RR + "class", []))
        out.append(TriplesMap(name.rpartition("#")[2], value(logical.one("tableName")), value(logical.one("sqlQuery")), term_map(subject, IRI), classes, everywhere, tuple(objects)))
    return sorted(out, key=lambda m: m.name)


# --- evaluation --------------------------------------------------------------------------------------


def _filled(t: str) -> Column:
    pieces = re.split(r"((?<!\\)\{(?:[^{}\\]|\\.)*\})", t)
    plain = lambda s: re.sub(r"\\([\\{}])", r"\1", s)
    return F.concat(*[F.col(f"`{plain(x[1:-1])}`").cast("string") if i % 2 else F.lit(plain(x)) for i, x in enumerate(pieces) if x])


def _value(m: TermMap) -> Column:
    if m.constant is not None:
        return F.lit(m.constant)
    text = _filled(m.template) if m.template is not None else F.col(f"`{m.column}`").cast("string")
    return F.concat(F.lit("_:"), text) if m.kind == BNODE else text


def _queried(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query's rows; the table it names is handed to it."""
    at = re.search(r"FROM `([^`]+)`(?= WHERE |$)", query)
    safe = [x.replace("{", "{{").replace("}", "}}") for x in (query[: at.start()], query[at.end() :])]
    return spark.sql(f"{safe[0]}FROM {{source}}{safe[1]}", source=tables[at[1]])


def evaluate(spark: SparkSession, maps: list[TriplesMap], tables: dict[str, DataFrame]) -> DataFrame:
    """Quads that the maps make of the tables (by lower-case name). A term of a null gives no quad."""
    out = None
    for m in maps:
        source = tables[m.table] if m.table else _queried(spark, m.query, tables)
        made = [(RDF + "type", TermMap(IRI, constant=c), m.class_graph) for c in m.classes] + [(o.predicate, o.term, o.graph) for o in m.objects]
        for p, o, g in made:
            dt = RDF + "langString" if o.language else (o.datatype or XSD + "string") if o.kind == LITERAL else None
            one = source.select(
                F.lit(m.subject.kind).alias("s_kind"), _value(m.subject).alias("s"), F.lit(p).alias("p"), F.lit(o.kind).alias("o_kind"), _value(o).alias("o"),
                F.lit(dt).cast("string").alias("o_dt"), F.lit(o.language).cast("string").alias("o_lang"), (_value(g) if g else F.lit(None).cast("string")).alias("g"),
            ).where("s IS NOT NULL AND o IS NOT NULL")
            out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], QUADS)


def write(catalog: Catalog) -> str:
    return to_turtle(mapping([s.table for s in catalog.tables.values()]))
