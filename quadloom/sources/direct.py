"""Relational tables as quads: a row is a subject, a column a predicate, a categorical column a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.lexical import RDF, XSD
from quadloom.sources.lines import COLUMNS

EX = "http://example.org/"
NAMESPACES = {"ex": EX}


def iri(table: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{EX}{table}#"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def quads(rows: DataFrame, s: Column, p: str, o: Column, g: Column | str, s_kind: str = "IRI", o_kind: str = "IRI", dt: str | None = None, lang: Column | None = None) -> DataFrame:
    """One predicate of each row. A null subject, object or graph gives no quad."""
    literal = o_kind == "LITERAL"
    values = (F.lit(s_kind), s, F.lit(p), F.lit(o_kind), o, F.lit(RDF + "langString" if lang is not None else (dt or XSD + "string") if literal else None).cast("string"), lang if lang is not None else F.lit(None).cast("string"), F.lit(g) if isinstance(g, str) else g)
    return rows.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)]).where("s IS NOT NULL AND o IS NOT NULL AND g IS NOT NULL")


def classes(rows: DataFrame, s: Column, c: Column, g: Column | str, s_kind: str = "IRI") -> DataFrame:
    return quads(rows, s, RDF + "type", F.concat(F.lit(EX), c), g, s_kind)


def customers(t: DataFrame) -> DataFrame:
    s, g = iri("customer", "c_custkey"), EX + "graph/crm"
    return classes(t, s, F.lower("c_mktsegment"), g).unionAll(quads(t, s, EX + "name", F.col("c_name"), g, o_kind="LITERAL"))


def orders(t: DataFrame) -> DataFrame:
    s, g = iri("order", "o_orderkey"), EX + "graph/sales"
    out = classes(t, s, F.concat(F.lit("priority-"), F.substring("o_orderpriority", 1, 1)), g)
    out = out.unionAll(quads(t, s, EX + "date", F.col("o_orderdate").cast("date").cast("string"), g, o_kind="LITERAL", dt=XSD + "date"))
    return out.unionAll(quads(t, s, EX + "placedBy", iri("customer", "o_custkey"), g))


def events(t: DataFrame) -> DataFrame:
    """Users by the kinds of events that they had; each class once."""
    return classes(t, iri("user", "user_id"), F.col("event_type"), EX + "graph").distinct()


def documents(t: DataFrame) -> DataFrame:
    s, g = iri("doc", "doc_id"), F.concat(F.lit(EX + "graph/"), "source")
    return quads(t, s, EX + "text", F.col("text"), g, o_kind="LITERAL", lang=F.col("lang")).unionAll(quads(t, s, EX + "length", F.col("n_chars").cast("string"), g, o_kind="LITERAL", dt=XSD + "integer"))


def pages(t: DataFrame) -> DataFrame:
    return classes(t, F.col("url"), F.lit("Page"), EX + "graph/web")


def conversations(t: DataFrame) -> DataFrame:
    s, g = F.concat(F.lit("_:"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")), EX + "graph/chat"
    return classes(t, s, F.col("role"), g, "BNODE").unionAll(quads(t, s, EX + "said", F.col("text"), g, "BNODE", "LITERAL"))


TABLES = {"customer": customers, "orders": orders, "events": events, "documents": documents, "pages": pages, "conversations": conversations}


def read(spark, sf_dir: str, *names: str) -> DataFrame:
    out = None
    for n in names or TABLES:
        one = TABLES[n](spark.read.parquet(f"{sf_dir}/{n}.parquet"))
        out = one if out is None else out.unionAll(one)
    return out
