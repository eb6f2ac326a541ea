"""Terms of a described table as columns: encoding quads into parts, and parts back into strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import iri, lexical
from quadloom.plans.model import BNODE, IRI, LITERAL, Col, Group, PredicateMap, Table, graph_column, group_for, table_name


def stored(c: Col, alias: str | None = None) -> Column:
    """What a column stands for, as text: its constant, or what is stored with its prefix put back."""
    if c.virtual:
        return F.lit(c.value).cast("string")
    text = lexical.to_lexical(F.col(f"{alias}.{c.name}" if alias else f"`{c.name}`"), c.datatype)
    return F.concat(F.lit(c.prefix), text) if c.prefix else text


def term(group: Group, kind: str) -> Column:
    """The canonical string of a term: IRI, `_:b` and number, or lexical form."""
    by = {c.part: stored(c) for c in group.columns}
    if kind == IRI:
        return iri.recompose({p: by.get(p, F.lit(None).cast("string")) for p in iri.PARTS})
    if kind == BNODE:
        return F.concat(F.lit("_:b"), by["id"])
    return by["langvalue"] if "langvalue" in by else by["litvalue"]


def graph(p: PredicateMap) -> Column:
    return stored(p.objects.column("graph"))


def new_table(predicate: str, name: str, s_kind: str, o_kind: str, lang: str | None, datatype: str | None) -> Table:
    """Description of the table for one predicate, kind of subject and kind of object, as loaded."""
    objects = group_for(o_kind, "object", name, lang, datatype)
    objects = Group((*objects.columns, graph_column(o_kind, name, lang, datatype)))
    one = PredicateMap(predicate, objects, o_kind, lang, None if o_kind != LITERAL or lang else datatype)
    return Table(table_name(name, s_kind, o_kind, lang, datatype), group_for(s_kind, "subject", name), s_kind, (one,))


def _encode(group: Group, kind: str, value: Column, dt: Column, lang: Column, g: Column | None) -> list[Column]:
    if kind == IRI:
        parts = iri.decompose(value)
    elif kind == BNODE:
        parts = {"id": F.substring(value, 4, 1 << 30).cast("long")}
    else:
        parts = {"lang": lang, "langvalue": value, "datatype": dt, "litvalue": value}
    if g is not None:
        parts["graph"] = g
    return [parts[c.part].alias(c.name) for c in group.columns]


def encode(quads: DataFrame, t: Table) -> DataFrame:
    """Rows of a newly described table for its quads (s, o, o_dt, o_lang, g)."""
    p = t.predicates[0]
    s = _encode(t.subject, t.subject_kind, F.col("s"), F.lit(None), F.lit(None), None)
    return quads.select(*s, *_encode(p.objects, p.kind, F.col("o"), F.col("o_dt"), F.col("o_lang"), F.col("g")))


def quads_of(df: DataFrame, t: Table, p: PredicateMap) -> DataFrame:
    """The quads that a table holds for one of its predicates."""
    rows = df.where(F.col(f"`{p.presence}`").isNotNull()) if p.presence else df
    literal = p.kind == LITERAL
    dt = lexical.RDF + "langString" if p.lang else p.datatype if literal else None
    return rows.select(
        F.lit(t.subject_kind).alias("s_kind"), term(t.subject, t.subject_kind).alias("s"), F.lit(p.predicate).alias("p"), F.lit(p.kind).alias("o_kind"),
        term(p.objects, p.kind).alias("o"), F.lit(dt).cast("string").alias("o_dt"), F.lit(p.lang).cast("string").alias("o_lang"), graph(p).alias("g"),
    )
