"""Operator 8: flat token-id files with 64-bit document offsets, to be memory-mapped.

Each task tokenises its documents once and writes two files: `part-N.tok`, token ids as little-endian
uint16 one after another, and `part-N.off`, where each document begins, as int64 (one more than
documents). Only the totals per part (one small row a part) are needed to place the parts: their bases
are prefix sums. No token is shuffled.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm import textkit
from quadloom.llm.common import filesystem, lean, prepare, publish, shared_dir, table
from quadloom.llm.tokenizers import VOCABULARIES, byte_bpe_encoder

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("ordinal", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64())])


def _writer(to: str, vocabularies: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        fs, folder = filesystem(to)
        fs.create_dir(folder, recursive=True)
        name = posixpath.join(folder, f"part-{part:05d}")
        tmp = f"{name}.{task.taskAttemptId()}.tmp"
        encoder = byte_bpe_encoder(vocabularies)
        ordinal = position = 0
        offsets = [np.zeros(1, "<i8")]
        with fs.open_output_stream(tmp) as out:
            for batch in batches:
                column = textkit.text(batch.column(1))
                for a, b in textkit.slices(column, textkit.SLICE_BYTES // 2):
                    pieces, first = textkit.chunks(column[a:b])
                    ids, each = encoder.ids(pieces)
                    out.write(ids.astype("<u2", copy=False).tobytes())
                    ends = np.concatenate([[0], np.cumsum(each)])[first]
                    offsets.append(position + ends[1:])
                    rows = [batch.column(0)[a:b].cast(pa.int64()), np.full(b - a, part, np.int32), np.arange(ordinal, ordinal + b - a), position + ends[:-1], np.diff(ends)]
                    position, ordinal = position + int(ends[-1]), ordinal + b - a
                    yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in rows], schema=_SCHEMA)
        with fs.open_output_stream(f"{tmp}.off") as out:
            out.write(np.concatenate(offsets).astype("<i8").tobytes())
        publish(fs, f"{tmp}.off", f"{name}.off")
        publish(fs, tmp, f"{name}.tok")

    return write


def token_files(docs: DataFrame, to: str, vocabularies: str = VOCABULARIES) -> DataFrame:
    """Writes the token files of `docs` (doc_id, text) to `to`; returns one row a document.

    Columns: doc_id, part (number of the file), ordinal (document within the part), token_start (64-bit
    position in the concatenation of all parts), local_start (position in the part's file), n_tokens.

    A null or empty text has 0 tokens and keeps its row; null ids stay null; repeated rows are written
    each time; other columns are not looked at; an empty table gives no rows and no files with tokens.
    A text of any length is written whole. Files are first written under a name of the task attempt and
    renamed, so a repeated task replaces its part by the same content.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = rows.mapInArrow(lean(_writer(to, vocabularies)), "doc_id long, part int, ordinal long, local_start long, n_tokens long")
    index.write.mode("overwrite").parquet(f"{to}/index")
    index = spark.read.parquet(f"{to}/index")
    # one row a file: the window over all of them is as small as the list of files
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("documents").over(before), F.lit(0)).alias("first_document"), "tokens", "documents")
    bases.write.mode("overwrite").parquet(f"{to}/bases")
    bases = spark.read.parquet(f"{to}/bases")
    return index.join(bases.select("part", "base"), "part").select("doc_id", "part", "ordinal", (F.col("base") + F.col("local_start")).alias("token_start"), "local_start", "n_tokens")


class TokenStore:
    """Memory-mapped reader of one part on a local path."""

    def __init__(self, path: str, part: int) -> None:
        name = f"{path.removeprefix('file://')}/part-{part:05d}"
        self.offsets = np.fromfile(f"{name}.off", "<i8") if part is not None else None
        self.tokens = np.memmap(f"{name}.tok", "<u2", "r") if self.offsets[-1] else np.zeros(0, "<u2")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"))
