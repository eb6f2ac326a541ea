"""Rewrites of a table's layout: pure functions from (description, rows) to (description, rows).

None changes what quads the table stands for. Which to do is decided from the table's statistics.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import lexical
from quadloom.operators.statistics import Stat, statistics
from quadloom.plans.model import IRI, Col, Table

#: A table must have a column; one whose columns are all constants has this.
ROW = "_row"
STEPS = ("constants", "types", "prefixes")


def _text(c: Col, value) -> str | None:
    if value is None:
        return None
    if c.datatype == "GYEAR":
        return f"{'-' if value < 0 else ''}{abs(value):04d}"
    if c.datatype == "BOOLEAN":
        return "true" if value else "false"
    return str(value)


def decide(t: Table, stats: dict[str, Stat], steps: tuple[str, ...] = STEPS) -> Table:
    """The description after the rewrites: constants leave storage, forms get native types, IRI parts lose common prefixes."""
    iri_columns = {c.name for g, kind in ((t.subject, t.subject_kind), *((p.objects, p.kind) for p in t.predicates)) if kind == IRI for c in g.columns if c.part != "graph"}
    for c in t.physical():
        s = stats[c.name]
        # rows that lack a predicate have nulls, so a presence column that is constant is present in all
        if "constants" in steps and s.constant and s.rows and not (isinstance(s.least, float)):
            value = _text(c, s.least)
            t = t.swap(replace(c, virtual=True, value=None if value is None else c.prefix + value, prefix="", datatype=c.datatype if c.datatype == "MARKER" else "TEXT"))
        elif "types" in steps and s.fits:
            t = t.swap(replace(c, datatype=s.target))
        elif "prefixes" in steps and c.datatype == "TEXT" and c.name in iri_columns and s.common_prefix and s.least != s.most:
            t = t.swap(replace(c, prefix=c.prefix + s.common_prefix))
    virtual = {c.name: c.value for g in t.groups() for c in g.columns if c.virtual}
    predicates = []
    for p in t.predicates:
        if p.presence in virtual:
            if stats[p.presence].present == 0:
                continue  # no row has it
            p = replace(p, presence=None)
        predicates.append(p)
    # a rewrite never makes a null, so what was known to be whole stays so
    whole = sorted({n for n, s in stats.items() if s.present == s.rows} | set(t.facts.get("whole", ())))
    return replace(t, predicates=tuple(predicates)).with_facts(rows=next(iter(stats.values())).rows if stats else t.facts.get("rows"), whole=whole)


def _moved(old: Col, new: Col) -> Column:
    c = F.col(f"`{old.name}`")
    if new.prefix != old.prefix:
        c = F.substring(c, len(new.prefix) - len(old.prefix) + 1, 1 << 30)
    return (lexical.to_native(c, new.datatype) if new.datatype != old.datatype else c).alias(new.name)


def apply(df: DataFrame, old: Table, new: Table) -> DataFrame:
    """Rows of `old` in the layout of `new`: one projection."""
    before = {c.name: c for c in old.physical()}
    kept = new.physical()
    extra = {p.presence for p in new.predicates if p.presence} - {c.name for c in kept}
    return df.select(*([_moved(before[c.name], c) for c in kept] + [F.col(f"`{x}`") for x in sorted(extra)] or [F.lit(True).alias(ROW)]))


def optimise(df: DataFrame, t: Table, steps: tuple[str, ...] = STEPS) -> tuple[Table, DataFrame]:
    """Statistics, decision and projection in one."""
    stats = statistics(df, t)
    if not stats:
        return t, df
    new = decide(t, stats, steps)
    return new, apply(df, t, new)


def set_semantics(df: DataFrame, t: Table) -> DataFrame:
    """A quad once, in the order of the subject's columns, so that row groups have narrow bounds."""
    names = [c.name for c in t.physical()] or df.columns
    order = [f"`{n}`" for n in names]
    return df.distinct().sortWithinPartitions(*order)


def multi_graph_list(quads: DataFrame) -> DataFrame:
    """A triple once, with the sorted list of the graphs that hold it."""
    return quads.groupBy("s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang").agg(F.sort_array(F.collect_set("g")).alias("graphs"))


def without_empty(tables: dict[str, int]) -> list[str]:
    """Names of tables that have rows."""
    return [n for n, rows in tables.items() if rows]


def merge_order(name: str, rows: int) -> tuple:
    """Sorting key: tables of classes first, then small ones, then by name."""
    return (not name.startswith("type_"), rows, name)


def dimension(frames: list[DataFrame], column: str, name: str) -> DataFrame:
    """Distinct values of a part over several tables: the counterpart of an enumeration."""
    out = frames[0].select(F.col(column).alias(name))
    for f in frames[1:]:
        out = out.unionAll(f.select(F.col(column).alias(name)))
    return out.where(F.col(name).isNotNull()).distinct()
