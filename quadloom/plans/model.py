"""What a table means: immutable descriptions of columns, terms and predicates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quadloom.functions import iri, lexical, naming

IRI, BNODE, LITERAL, TRIPLE = "IRI", "BNODE", "LITERAL", "TRIPLE"


@dataclass(frozen=True)
class Col:
    """A column of a term. `virtual`: it has `value` (or null) in every row and isn't stored.
    `prefix`: stored values lack it."""

    name: str
    part: str
    datatype: str = "TEXT"
    virtual: bool = False
    value: str | None = None
    prefix: str = ""

    def definition(self) -> str:
        return f"{self.name} {self.datatype}"


@dataclass(frozen=True)
class Group:
    """Columns that encode one term, in the order in which they are put together."""

    columns: tuple[Col, ...]

    def physical(self) -> tuple[Col, ...]:
        return tuple(c for c in self.columns if not c.virtual)

    def column(self, part: str) -> Col | None:
        return next((c for c in self.columns if c.part == part), None)

    def swap(self, new: Col) -> Group:
        return Group(tuple(new if c.name == new.name else c for c in self.columns))


@dataclass(frozen=True)
class PredicateMap:
    """`presence`: a row has this predicate only where that stored column isn't null (null: every row has it).
    `origin`: the table that it was merged from."""

    predicate: str
    objects: Group
    kind: str
    lang: str | None = None
    datatype: str | None = None
    presence: str | None = None
    origin: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    subject: Group
    subject_kind: str
    predicates: tuple[PredicateMap, ...]
    facts: dict = field(default_factory=dict, compare=False, hash=False)

    def physical(self) -> list[Col]:
        seen: dict[str, Col] = {}
        for g in (self.subject, *(p.objects for p in self.predicates)):
            seen |= {c.name: c for c in g.physical()}
        return list(seen.values())

    def groups(self) -> list[Group]:
        return [self.subject, *(p.objects for p in self.predicates)]

    def swap(self, new: Col) -> Table:
        return replace(self, subject=self.subject.swap(new), predicates=tuple(replace(p, objects=p.objects.swap(new)) for p in self.predicates))

    def with_facts(self, **facts) -> Table:
        return replace(self, facts={**self.facts, **facts})


def group_for(kind: str, side: str, predicate: str, lang: str | None = None, datatype: str | None = None) -> Group:
    """Columns of a term as loaded. side: subject or object; predicate: its name part."""
    start = f"{side}_{predicate}"
    if kind == IRI:
        return Group(tuple(Col(f"{start}_{p}", p) for p in iri.PARTS))
    if kind == BNODE:
        return Group((Col(f"{start}_id", "id", "BIGINT"),))
    if kind == LITERAL and lang:
        return Group((Col(f"{start}_lang", "lang"), Col(f"{start}_langvalue", "langvalue")))
    if kind == LITERAL:
        dt = naming.datatype_part(datatype or lexical.XSD + "string").lower()
        return Group((Col(f"{start}{dt}_datatype", "datatype"), Col(f"{start}{dt}_litvalue", "litvalue")))
    raise ValueError(f"terms of kind {kind} can't be kept in tables")


def graph_column(kind: str, predicate: str, lang: str | None, datatype: str | None) -> Col:
    # as in group_for, a datatype follows the predicate without a mark between them
    tail = {IRI: "_iri", BNODE: "_bnode"}.get(kind) or ("_lang" if lang else naming.datatype_part(datatype or lexical.XSD + "string").lower() + "_datatype")
    return Col(f"object_{predicate}{tail}_graph", "graph", "GRAPH_IRIS")


def table_name(predicate: str, s_kind: str, o_kind: str, lang: str | None, datatype: str | None) -> str:
    tail = f"_{naming.language_part(lang)}" if lang else f"_{naming.datatype_part(datatype)}" if o_kind == LITERAL and datatype else ""
    return f"{predicate}_{s_kind.lower()}_{o_kind.lower()}{tail}"
