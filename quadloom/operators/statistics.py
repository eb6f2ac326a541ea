"""Two aggregations per table that tell all that the rewrites need to know."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadloom.functions import lexical
from quadloom.plans.model import IRI, Col, Table


@dataclass(frozen=True)
class Stat:
    rows: int
    present: int
    least: object
    most: object
    fits: bool = False  # every form comes back from the type that `target` names
    target: str | None = None
    shortest: int = 0

    @property
    def constant(self) -> bool:
        """One value in all rows, or none in any."""
        return self.present == 0 or (self.present == self.rows and self.least == self.most)

    @property
    def common_prefix(self) -> str:
        """Of a set of strings the longest common prefix is that of the least and the greatest."""
        a, b = self.least or "", self.most or ""
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[:n]


def target_type(t: Table, c: Col) -> str | None:
    """The native type that a text column may get."""
    if c.datatype != "TEXT" or c.prefix:
        return None
    owners = [(t.subject, t.subject_kind, None), *((p.objects, p.kind, p.datatype) for p in t.predicates)]
    for group, kind, datatype in owners:
        if any(x.name == c.name for x in group.columns):
            if kind == IRI and c.part in ("port", "query", "fragment", "path"):
                return "INTEGER"
            if c.part == "litvalue":
                return lexical.NATIVE.get(datatype or "")
    return None


def _same_scale(x):
    return F.min(lexical.scale(x)) == F.max(lexical.scale(x))


def _forms(x: Column, i: int, target: str) -> list[Column]:
    if target == "NUMERIC":  # the scale is kept only if it is one for all
        return [F.max(lexical.scale(x)).alias(f"s{i}"), _same_scale(x).alias(f"q{i}"), *[F.coalesce(F.every(lexical.keeps_form(x, f"NUMERIC:{k}")), F.lit(True)).alias(f"f{i}_{k}") for k in range(7)]]
    return [F.coalesce(F.every(lexical.keeps_form(x, target)), F.lit(True)).alias(f"f{i}")]


def statistics(df: DataFrame, t: Table) -> dict[str, Stat]:
    """Stat by physical column.

    Most columns are constant. Which are is told by comparing all rows with one, which is compiled; the least and the greatest text,
    which aren't, and whether forms come back are asked of the others alone, in a second pass.
    """
    columns = t.physical()
    if not columns:
        return {}
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    one = df.first()
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c.name}`")
        aggs.append(F.count(x).alias(f"c{i}"))
        if c.name in texts:
            aggs.append(F.coalesce(F.every(x.eqNullSafe(F.lit(one[c.name] if one else None).cast("string"))), F.lit(True)).alias(f"e{i}"))
    first = df.agg(*aggs).first()
    targets, aggs = {}, []
    for i, c in enumerate(columns):
        x = F.col(f"`{c.name}`")
        if c.name in texts and first[f"e{i}"]:
            x = F.lit(one[c.name] if one else None).cast("string")
        else:
            aggs += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"m{i}")]
        if (target := target_type(t, c)) is not None:
            targets[i] = target
            aggs += _forms(x, i, target) if first[f"c{i}"] else []
    row = df.agg(*aggs).first().asDict() if aggs else {}
    out = {}
    for i, c in enumerate(columns):
        target, fits, present = targets.get(i), False, first[f"c{i}"]
        if target == "NUMERIC":
            k = row.get(f"s{i}")
            target, fits = f"NUMERIC:{k}", k is not None and k < 7 and bool(row[f"q{i}"]) and row[f"f{i}_{k}"]
        elif target:
            fits = row.get(f"f{i}")
        alone = one[c.name] if one else None
        out[c.name] = Stat(first["n"], present, row.get(f"l{i}", alone), row.get(f"m{i}", alone), bool(fits) and present > 0, target)
    return out
