"""From quads to tables: one for each predicate, kinds of terms, language and datatype, and one for each class."""

from __future__ import annotations

import posixpath
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions import naming
from quadloom.functions.lexical import RDF
from quadloom.operators import terms
from quadloom.plans.model import Table

KEYS = ("p", "s_kind", "o_kind", "o_lang", "o_dt")
#: A list of keys of more rows is not broadcast.
BROADCAST_KEYS = 100_000
#: Rows of a file. Quads of one predicate are small when compressed; files of the usual size would leave them to a task or two.
FILE_ROWS = 500_000


def partition_counts(quads: DataFrame) -> DataFrame:
    """Quads by predicate, kinds of terms, language and datatype. A language makes the datatype plain, so it's left out."""
    dt = F.when(F.col("o_lang").isNull(), F.col("o_dt"))
    return quads.groupBy("p", "s_kind", "o_kind", "o_lang", dt.alias("o_dt")).agg(F.count(F.lit(1)).alias("n"))


def describe(keys: list[tuple], namespaces: dict[str, str]) -> list[Table]:
    """Descriptions in the order of the keys (p, s_kind, o_kind, lang, datatype); names that meet get a number."""
    out, used = [], set()
    for p, s_kind, o_kind, lang, dt in keys:
        t = terms.new_table(p, naming.sql_name(p, namespaces), s_kind, o_kind, lang, dt)
        name, n = t.name, 1
        while name.lower() in used:
            name, n = f"{t.name}_{n}", n + 1
        used.add(name.lower())
        out.append(replace(t, name=name))
    return out


def _written_apart(df: DataFrame, number: str, to: str) -> None:
    """One folder for each number; rows are spread so that neither a hot number nor many small ones hurt."""
    df.hint("rebalance", number).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy(number).parquet(to)


def partition(spark: SparkSession, quads: DataFrame, root: str, namespaces: dict[str, str]) -> list[tuple[Table, DataFrame]]:
    """Tables of the quads, which are written once, a folder for each table."""
    counted = partition_counts(quads).collect()  # a row a table
    keys = sorted(((r["p"], r["s_kind"], r["o_kind"], r["o_lang"], r["o_dt"]) for r in counted), key=lambda k: tuple(x or "" for x in k))
    sizes = {(r["p"], r["s_kind"], r["o_kind"], r["o_lang"], r["o_dt"]): r["n"] for r in counted}
    if not keys:
        return []
    numbers = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "kp string, ks string, ko string, kl string, kd string, tbl int")
    if len(keys) <= BROADCAST_KEYS:
        numbers = F.broadcast(numbers)
    dt = F.when(F.col("o_lang").isNull(), F.col("o_dt"))
    same = (F.col("p") == F.col("kp")) & (F.col("s_kind") == F.col("ks")) & (F.col("o_kind") == F.col("ko")) & F.col("o_lang").eqNullSafe(F.col("kl")) & dt.eqNullSafe(F.col("kd"))
    _written_apart(quads.join(numbers, same).select("tbl", "s", "o", "o_dt", "o_lang", "g"), "tbl", posixpath.join(root, "quads"))
    made = []
    for i, t in enumerate(describe(keys, namespaces)):
        rows = spark.read.schema("s string, o string, o_dt string, o_lang string, g string").parquet(posixpath.join(root, "quads", f"tbl={i}"))
        made.append((t.with_facts(rows=sizes[keys[i]]), terms.encode(rows, t)))
    return made


def accepts(t: Table) -> dict[str, str | None]:
    """The key that a quad must have to belong to a table as loaded."""
    p = t.predicates[0]
    return {"p": p.predicate, "s_kind": t.subject_kind, "o_kind": p.kind, "o_lang": p.lang, "o_dt": p.datatype}


def accepted(quads: DataFrame, t: Table) -> DataFrame:
    """Quads that belong to a table as loaded; nulls are equal to nulls."""
    for c, v in accepts(t).items():
        if c != "o_dt" or t.predicates[0].lang is None:
            quads = quads.where(F.col(c).eqNullSafe(F.lit(v)))
    return quads


def split_classes(spark: SparkSession, t: Table, df: DataFrame, root: str, namespaces: dict[str, str], used: set[str]) -> list[tuple[Table, DataFrame]]:
    """A table of rdf:type alone as one for each class and graph, whose object columns then are constants."""
    p = t.predicates[0]
    names = [c.name for c in p.objects.physical()]
    if len(t.predicates) != 1 or p.predicate != RDF + "type" or not names:
        return [(t, df)]
    value = terms.term(p.objects, p.kind)
    combos = df.groupBy(*names).agg(F.first(value).alias("class"), F.count(F.lit(1)).alias("n")).collect()  # a row a class
    combos.sort(key=lambda r: (r["class"], *[str(r[n]) for n in names]))
    numbers = spark.createDataFrame([(*[r[n] for n in names], i) for i, r in enumerate(combos)], T.StructType([*df.select(*names).schema.fields, T.StructField("cls", T.IntegerType())]))
    if len(combos) <= BROADCAST_KEYS:
        numbers = F.broadcast(numbers)
    same = None
    for n in names:
        one = df[n].eqNullSafe(numbers[n])
        same = one if same is None else same & one
    to = posixpath.join(root, "classes", t.name)
    subject = [c.name for c in t.subject.physical()]
    from quadloom.operators.rewrites import ROW

    kept = [df[c] for c in subject] or [F.lit(True).alias(ROW)]
    _written_apart(df.join(numbers, same).select("cls", *kept), "cls", to)
    out = []
    schema = df.select(*kept).schema
    for i, r in enumerate(combos):
        name = naming.class_name(r["class"], namespaces, i)
        while name.lower() in used:
            name = f"type_{len(used)}"
        used.add(name.lower())
        objects = p.objects
        for c in p.objects.physical():
            v = r[c.name]
            text = None if v is None else c.prefix + (str(v))
            objects = objects.swap(replace(c, virtual=True, value=text, prefix="", datatype="TEXT"))
        one = replace(t, name=name, predicates=(replace(p, objects=objects),)).with_facts(rows=r["n"])
        out.append((one, spark.read.schema(schema).parquet(f"{to}/cls={i}")))
    return out
