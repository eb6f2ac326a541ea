"""Merging tables that describe the same subjects, so that a row holds several predicates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators import terms
from quadloom.operators.rewrites import merge_order
from quadloom.plans.model import Col, Group, Table
from quadloom.session import written

KEY = "_subject"
_INTO = "_into"
#: Tables by the bits of a number, and numbers of a subject; more tables are listed.
BITS, WORDS = 62, 4


def keyed(df: DataFrame, t: Table) -> DataFrame:
    return df.withColumn(KEY, terms.term(t.subject, t.subject_kind))


def repeated_subject(df: DataFrame, t: Table) -> DataFrame:
    """One subject that several rows have, if there is any."""
    return keyed(df, t).groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)


def _listed(tables: list[tuple[Table, DataFrame]]) -> tuple[dict[frozenset, int], set[int]]:
    """patterns() of any number of tables: a subject's tables as a list."""
    both = None
    for i, (t, df) in enumerate(tables):
        one = keyed(df, t).select(F.lit(t.subject_kind).alias("kind"), KEY, F.lit(i).alias("i"))
        both = one if both is None else both.unionAll(one)
    per = both.groupBy("kind", KEY, "i").agg(F.count(F.lit(1)).alias("n")).groupBy("kind", KEY).agg(F.sort_array(F.collect_list("i")).alias("of"), F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("i")))).alias("twice"))
    rows = per.groupBy("of", "twice").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a combination of tables
    repeated = {i for r in rows for i in r["twice"]}
    out: dict[frozenset, int] = {}
    for r in rows:
        out[frozenset(r["of"])] = out.get(frozenset(r["of"]), 0) + r["n"]
    return out, repeated


def _repeating(tables: list[tuple[Table, DataFrame]], some: set[int]) -> set[int]:
    """Which of these tables have some subject twice."""
    both = None
    for i in sorted(some):
        one = keyed(tables[i][1], tables[i][0]).select(F.lit(i).alias("i"), KEY)
        both = one if both is None else both.unionAll(one)
    if both is None:
        return set()
    return {r["i"] for r in both.groupBy("i", KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i").distinct().collect()}


def patterns(tables: list[tuple[Table, DataFrame]]) -> tuple[dict[frozenset, int], set[int]]:
    """How many subjects are in exactly which tables, and which tables have some subject twice.

    One shuffle of subjects serves all pairs of tables. A subject's tables are bits of a few numbers, which add up before the shuffle
    and after it; only where subjects have more rows than tables, those tables are looked at again.
    """
    if len(tables) > BITS * WORDS:
        return _listed(tables)
    words = [f"w{k}" for k in range(-(-len(tables) // BITS))]
    both = None
    for i, (t, df) in enumerate(tables):
        one = keyed(df, t).select(F.lit(t.subject_kind).alias("kind"), KEY, *[F.lit(1 << i % BITS if i // BITS == k else 0).cast("long").alias(w) for k, w in enumerate(words)])
        both = one if both is None else both.unionAll(one)
    per = both.groupBy("kind", KEY).agg(F.count(F.lit(1)).alias("n"), *[F.bit_or(w).alias(w) for w in words])
    more = (F.col("n") > sum((F.bit_count(w) for w in words), F.lit(0))).alias("more")
    rows = per.select(*words, more).groupBy(*words, "more").agg(F.count(F.lit(1)).alias("n")).collect()  # a row or two a combination of tables
    out: dict[frozenset, int] = {}
    some: set[int] = set()
    for r in rows:
        of = frozenset(i for i in range(len(tables)) if r[f"w{i // BITS}"] >> i % BITS & 1)
        out[of] = out.get(of, 0) + r["n"]
        some |= of if r["more"] else set()
    return out, _repeating(tables, some)


def decide(tables: list[Table], counts: dict[frozenset, int], repeated: set[int]) -> list[tuple[int, int]]:
    """Pairs (into, from) in the order in which they are merged; replayed on the counts alone.

    A table with a repeated subject is left out, and so is one of constants only, which stores nothing as it is.
    """
    size = {i: sum(n for of, n in counts.items() if i in of) for i in range(len(tables))}
    order = sorted((i for i in range(len(tables)) if i not in repeated and size[i] and tables[i].physical()), key=lambda i: merge_order(tables[i].name, size[i]))
    has = {i: {p.predicate for p in tables[i].predicates} for i in order}
    left = dict(counts)
    out = []
    for a, into in enumerate(order):
        for source in order[a + 1 :]:
            if tables[into].subject_kind != tables[source].subject_kind or has[into] & has[source]:
                continue
            if not any(into in of and source in of for of in left):
                continue
            out.append((into, source))
            has[into] |= has[source]
            new: dict[frozenset, int] = {}
            for of, n in left.items():
                of = of - {source} if into in of and source in of else of
                new[of] = new.get(of, 0) + n
            left = new
    return out


def _joined(into: tuple[Table, DataFrame], source: tuple[Table, DataFrame]) -> tuple[Table, DataFrame]:
    """`into` with the predicates of `source` where it has the subject (a left join)."""
    (t, df), (o, other) = into, source
    taken = {c.name for g in t.groups() for c in g.columns}
    names = {c.name: c.name if c.name not in taken else f"{o.name}_{c.name}" for p in o.predicates for c in p.objects.columns}
    marker = f"object_{o.name}_here"
    columns = [F.col(f"`{c.name}`").alias(names[c.name]) for p in o.predicates for c in p.objects.physical()]
    predicates, mark = [], False
    for p in o.predicates:
        objects = Group(tuple(replace(c, name=names[c.name]) for c in p.objects.columns))
        presence = names.get(p.presence) if p.presence else next((c.name for c in objects.physical() if c.part in ("langvalue", "litvalue", "id")), None)
        if presence is None:
            presence, mark = marker, True
        predicates.append(replace(p, objects=objects, presence=presence, origin=p.origin or o.name))
    # a marker that `source` had from a merge before stays a stored column of its own
    carried = [p.presence for p in o.predicates if p.presence and p.presence not in names]
    predicates = [replace(new, presence=old.presence) if old.presence in carried else new for new, old in zip(predicates, o.predicates, strict=True)]
    right = keyed(other, o).select(F.col(KEY).alias("_other"), *columns, *[F.col(f"`{x}`") for x in dict.fromkeys(carried)], *([F.lit(True).alias(marker)] if mark else []))
    made = keyed(df, t).join(right, F.col(KEY) == F.col("_other"), "left").drop(KEY, "_other")
    # within the rows that have the predicate, its columns have the nulls that they had
    whole = sorted({*t.facts.get("whole", ()), *(names[n] for n in o.facts.get("whole", ()) if n in names)})
    return replace(t, predicates=(*t.predicates, *predicates)).with_facts(whole=whole, took=[*t.facts.get("took", ()), o.name]), made


def _rest(into: tuple[Table, DataFrame], source: tuple[Table, DataFrame]) -> DataFrame:
    """Rows of `source` whose subject `into` doesn't have (an anti join)."""
    subjects = keyed(into[1], into[0]).select(KEY)
    return keyed(source[1], source[0]).join(subjects, KEY, "left_anti").drop(KEY)


def _routed(source: tuple[Table, DataFrame], targets: dict[int, tuple[Table, DataFrame]]) -> DataFrame:
    """Rows of `source` with the position of the first of `targets` that has their subject, null if none has: one join for all."""
    owners = None
    for n, (t, df) in enumerate(targets.values()):
        one = keyed(df, t).select(KEY, F.lit(n).alias(_INTO))
        owners = one if owners is None else owners.unionAll(one)
    owners = owners.groupBy(KEY).agg(F.min(_INTO).alias(_INTO))
    return written(keyed(source[1], source[0]).join(owners, KEY, "left"), "routed")


def merge(tables: list[tuple[Table, DataFrame]]) -> list[tuple[Table, DataFrame]]:
    """Merges what overlaps; what doesn't match stays behind in its own table, and tables left empty go."""
    if len(tables) < 2:
        return tables
    counts, repeated = patterns(tables)
    now = {i: x for i, x in enumerate(tables)}
    pairs = decide([t for t, _ in tables], counts, repeated)
    routed: dict[int, DataFrame] = {}
    for into, source in pairs:
        if source not in routed:
            # a table is merged from before it is merged into, and subjects never change, so all its rows can be routed at once
            routed[source] = _routed(now[source], {i: tables[i] for i, s in pairs if s == source})
            now[source] = (now[source][0], routed[source].where(F.col(_INTO).isNull()).drop(KEY, _INTO))
        part = routed[source].where(F.col(_INTO) == list(i for i, s in pairs if s == source).index(into)).drop(KEY, _INTO)
        now[into] = _joined(now[into], (now[source][0], part))
    left = {i: sum(n for of, n in counts.items() if i in of) for i in now}
    remaining = dict(counts)
    for into, source in pairs:
        for of, n in list(remaining.items()):
            if into in of and source in of:
                del remaining[of]
                remaining[of - {source}] = remaining.get(of - {source}, 0) + n
        left[source] = sum(n for of, n in remaining.items() if source in of)
    return [(t.with_facts(rows=None, unique=i not in repeated), df) for i, (t, df) in now.items() if left[i]]


def full_merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The older way: all rows of both tables by their key columns (a full outer join), nothing stays behind."""
    return left.join(right, on, "full_outer")


def overlap(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """How many rows of `left` have a partner in `right`."""
    return left.join(right.select(on).distinct(), on, "left_semi").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["Col", "decide", "full_merge", "keyed", "merge", "overlap", "patterns", "repeated_subject"]
