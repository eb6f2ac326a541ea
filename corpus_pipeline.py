"""From raw documents to token files: five stages, each on all that the one before it kept.

A stage is called with (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of `docs`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import decontaminate, fertility, mixture, ngram_join, token_files
from quadloom.llm.common import materialise, shared_dir, small_batches, table


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage with the session's batches bounded from then on: stages follow each other in executors whose heap has grown."""

    @functools.wraps(f)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return bounded


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that a rule rejects go; texts that are null or blank are among them."""
    return fertility.quality_filter(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of similar documents the one of least id stays, of equal ids the one of least text.

    Texts that are null or have no words are in no group and stay; null ids come after others; repeated rows are one group, so one
    of them stays; an empty table gives none.
    """
    return ngram_join.one_of_each(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold an item of the benchmark go.

    Texts that are null or empty hold none and stay, as do repeated rows, each; items that are null, empty or very short are never
    held. With either table empty all documents stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: blocks drawn to the target weights, a row for each document's piece of a block.

    A document drawn twice has rows for each time. A null source counts as the empty one; a text without words is an empty piece
    of a block; repeated rows are documents each; an empty table gives no rows.
    """
    return mixture.mixed_documents(docs)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token files, and for each row where its tokens are.

    Every row has one, in the order of the files: null and empty texts with no tokens, repeated rows one each; an empty table
    gives no rows.
    """
    return token_files.token_files(docs, shared_dir(spark, "corpus-tokens"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_output),
]

#: SQL has neither the tokenisers nor the pseudorandom draws; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of `sf_dir`; none if no document is left. Cases are those of the stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return docs
