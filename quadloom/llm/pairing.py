"""What operators 3 and 10 share: keys of documents, and fetching both texts of candidate pairs.

Candidates are pairs of 64-bit keys. Only documents that are in a pair have their text shuffled: a Bloom
filter of the keys, of bounded size, lets the others go while they are scanned; the join after it is exact.
"""

from __future__ import annotations

import functools
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm import textkit
from quadloom.llm.common import filesystem, publish, shared_dir

#: The filter has about 10 bits a key up to this size; beyond, it only lets more documents through.
MOST_BITS = 1 << 29
_PROBES = 4


def packed(columns: list[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


def by_shard(shard: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of the columns grouped by shard, each group as bytes."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    kinds, first = np.unique(shard[order], return_index=True)
    for s, rows in zip(kinds, np.split(order, first[1:]), strict=True):
        yield int(s), packed([c[rows] for c in columns])


def _bits(keys: np.ndarray, n: int) -> Iterator[np.ndarray]:
    for i in range(_PROBES):
        yield textkit.mix(keys.view(np.uint64), 900 + i) % np.uint64(n)


def _part_writer(to: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, some = np.zeros(n // 8, np.uint8), False
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            some |= len(keys) > 0
            for p in _bits(keys, n):
                np.bitwise_or.at(field, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        if some:
            fs, folder = filesystem(to)
            fs.create_dir(folder, recursive=True)
            task = TaskContext.get()
            final = posixpath.join(folder, f"{task.partitionId():05d}.bits")
            tmp = f"{final}.{task.taskAttemptId()}.tmp"
            with fs.open_output_stream(tmp) as out:
                out.write(zlib.compress(field, 1))
            publish(fs, tmp, final)
            yield pa.RecordBatch.from_pydict({"file": [posixpath.join(to, f"{task.partitionId():05d}.bits")]})

    return run


def key_filter(keys: DataFrame) -> tuple[list[str], int]:
    """Writes the Bloom filter of the one column of `keys`: files to be read together, and its bits."""
    spark = keys.sparkSession
    count = keys.count()
    n = min(MOST_BITS, max(1024, 1 << int(10 * max(count, 1)).bit_length()))
    to = shared_dir(spark, "keys")
    files = keys.coalesce(8).mapInArrow(_part_writer(to, n), "file string").collect()
    return sorted(r["file"] for r in files), n


@functools.lru_cache(1)
def _read_filter(files: tuple[str, ...], n: int) -> np.ndarray:
    field = np.zeros(n // 8, np.uint8)
    for name in files:
        fs, path = filesystem(name)
        with fs.open_input_file(path) as f:
            field |= np.frombuffer(zlib.decompress(f.read()), np.uint8)
    return field


def _keeper(files: list[str], n: int):
    names = tuple(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _read_filter(names, n)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.ones(len(keys), bool)
            for p in _bits(keys, n):
                keep &= ((field[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            yield batch.filter(pa.array(keep))

    return run


#: Bits of a document's key that tell about how long its text is, in steps of 2/3 of an octave.
_SIZE_BITS = 5


def document_key() -> Column:
    """Two rows are the same document if they have the same id and text (see the operators' docstrings).

    Keys go up with the size of the text, but for steps of its logarithm, and are hashes within a step.
    """
    most = 1 << _SIZE_BITS
    step = F.least(F.lit(most - 1), F.floor(1.5 * F.log2(F.octet_length("text") + 1))).cast("long") - most // 2
    return F.shiftleft(step, 64 - _SIZE_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text")), _SIZE_BITS))


def with_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with id_a, text_a, id_b, text_b from docs (key, doc_id, text).

    The text of a goes to each of its pairs, so a should be the shorter one; that of b is shuffled once.
    """
    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct()
    files, n = key_filter(keys)
    some = docs.mapInArrow(_keeper(files, n), docs.schema)
    # rows that repeat a document count once
    some = some.join(keys, "key", "left_semi").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    left = some.select(F.col("key").alias("a"), F.col("doc_id").alias("id_a"), F.col("text").alias("text_a"))
    right = some.select(F.col("key").alias("b"), F.col("doc_id").alias("id_b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b")
