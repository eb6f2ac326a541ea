"""Descriptions of tables as RDF, and back: what a load needs in order to go on."""

from __future__ import annotations

import io
import json

from quadloom.functions.lexical import RDF
from quadloom.plans.model import Col, Group, PredicateMap, Table
from quadloom.sources.turtle import Parser, quote

NS = "urn:quadloom:table#"


def _column(c: Col) -> str:
    out = [f"a t:{'ConstantColumn' if c.virtual else 'StoredColumn'}", f"t:name {quote(c.name)}", f"t:part {quote(c.part)}", f"t:type {quote(c.datatype)}"]
    if c.value is not None:
        out.append(f"t:value {quote(c.value)}")
    if c.prefix:
        out.append(f"t:prefix {quote(c.prefix)}")
    return "[ " + " ; ".join(out) + " ]"


def _columns(g: Group) -> str:
    return "( " + " ".join(_column(c) for c in g.columns) + " )"


def to_turtle(tables: list[Table]) -> str:
    out = [f"@prefix t: <{NS}> ."]
    for t in sorted(tables, key=lambda x: x.name):
        lines = [f"[] a t:Table ; t:name {quote(t.name)} ; t:subjectKind {quote(t.subject_kind)} ; t:facts {quote(json.dumps(t.facts, sort_keys=True))} ; t:subject {_columns(t.subject)} ; t:predicates ("]
        for p in t.predicates:
            more = "".join(f" ; t:{k} {quote(v)}" for k, v in (("lang", p.lang), ("datatype", p.datatype), ("presence", p.presence), ("origin", p.origin)) if v is not None)
            lines.append(f"  [ t:predicate {quote(p.predicate)} ; t:kind {quote(p.kind)}{more} ; t:objects {_columns(p.objects)} ]")
        out.append("\n".join(lines) + " ) .")
    return "\n".join(out) + "\n"


def from_turtle(text: str) -> list[Table]:
    nodes: dict[str, dict[str, str]] = {}
    for _, s, p, _, o, *_ in Parser(io.BytesIO(text.encode())):
        nodes.setdefault(s, {})[p.removeprefix(NS)] = o

    def items(at: str) -> list[dict]:
        out = []
        while at != RDF + "nil":
            out.append(nodes[nodes[at][RDF + "first"]])
            at = nodes[at][RDF + "rest"]
        return out

    def group(at: str) -> Group:
        return Group(tuple(Col(c["name"], c["part"], c["type"], c[RDF + "type"] == NS + "ConstantColumn", c.get("value"), c.get("prefix", "")) for c in items(at)))

    out = []
    for n in nodes.values():
        if n.get(RDF + "type") == NS + "Table":
            predicates = tuple(PredicateMap(p["predicate"], group(p["objects"]), p["kind"], p.get("lang"), p.get("datatype"), p.get("presence"), p.get("origin")) for p in items(n["predicates"]))
            out.append(Table(n["name"], group(n["subject"]), n["subjectKind"], predicates, json.loads(n["facts"])))
    return sorted(out, key=lambda t: t.name)
