"""Session plumbing shared by the operators: tables, the shared folder, files and worker paths."""

from __future__ import annotations

import contextlib
import ctypes
import os
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadloom.llm import textkit

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package where it was found by the driver."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


#: What a batch sent to a worker holds at most, but for a row that is longer; Spark's default is 10,000 rows or 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> str:
    """Bounds the session's batches by BATCH_BYTES: each is held outside the heap by the executor, twice while it grows, and by
    the worker. Spark looks the bound up when a query runs, so it stays; returns what it was."""
    before = spark.conf.get(_BATCH)
    size = int(before.removesuffix("b"))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return before


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent on one machine (tests) a folder of our own is used; on a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.sparkContext.setCheckpointDir(root)
    return posixpath.join(root, f"{what}-{uuid.uuid4().hex}")


#: Whether Spark removes the shuffle files of a query as soon as it has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back. What was shuffled for it is removed."""
    spark = df.sparkSession
    to = shared_dir(spark, what)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(to)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(to)


def carried(docs: DataFrame, **front: Column) -> DataFrame:
    """`front` before all columns of docs, which are called c0, c1, ... so that no name of theirs meets another."""
    return docs.select(*[c.alias(n) for n, c in front.items()], *[docs[f"`{n}`"].alias(f"c{i}") for i, n in enumerate(docs.columns)])


def carried_text(docs: DataFrame, *more: Column) -> tuple[DataFrame, int]:
    """All columns of docs as carried() names them, then `more`, and which of the columns is the text as a string. Only a
    text that isn't one goes along once more, as the last."""
    own, last = docs.columns.index("text"), []
    if docs.schema.fields[own].dataType != StringType():
        own, last = len(docs.columns) + len(more), [docs["text"].cast("string").alias("_text")]
    return docs.select(*[docs[f"`{n}`"].alias(f"c{i}") for i, n in enumerate(docs.columns)], *more, *last), own


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path; what Spark calls file:/x is accepted."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, tmp: str, final: str) -> None:
    """Moves a finished file to its name; a task that ran before may have left the same content there."""
    try:
        fs.move(tmp, final)
    except OSError:
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(final)
        fs.move(tmp, final)


class Lean:
    """A function on batches after whose task the worker gives freed memory back, so that the next one's finds it.
    Tables that the task filled are freed too."""

    def __init__(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> None:
        self.run = run

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.run(batches)
        finally:
            del batches
            textkit.forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc can be asked
                ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    return Lean(run).__call__


def binary_rows(rows: Iterable[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema=schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
