"""The graph as a view: a union of projections of tables, one for each predicate of each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.operators import terms
from quadloom.plans.catalog import Catalog
from quadloom.plans.model import Table
from quadloom.sources.lines import QUADS


def view_of(spark: SparkSession, tables: list[tuple[Table, DataFrame]]) -> DataFrame:
    """Quads of all tables. Constants are literals, so a filter on predicate, class or graph prunes whole tables."""
    out = None
    for t, df in tables:
        for p in t.predicates:
            one = terms.quads_of(df, t, p)
            out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], QUADS)


def view(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return view_of(spark, catalog.frames(spark))
