"""Operator 7: n-gram language model in a log-frequency Bloom filter, and scores by it.

Counts of 1-, 2- and 3-grams over all documents are quantised to powers of two; an n-gram of level q is
entered q times, as (n-gram, 1) to (n-gram, q). A count is read back by asking for (n-gram, 1), then
(n-gram, 2) and so on until the filter says no. Scores interpolate the conditional probabilities of the
three orders.

N-grams travel as packed arrays of fingerprints, one for each task and shard, so the shuffle has no row
for an n-gram. Each shard of fingerprints makes its own part of the filter and writes it to the shared folder.
Parts that are small together are broadcast; a larger filter is read part by part, each batch of texts
asking one part after another, so that a worker holds one part at a time.
"""

from __future__ import annotations

import functools
import posixpath
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import textkit
from quadloom.llm.common import filesystem, lean, materialise, prepare, publish, shared_dir, shuffle_width, table

ORDERS = 3
#: All n-grams are in the model, also those that occur once.
LEAST_COUNT = 1
BITS_AN_ENTRY = 12
PROBES = 6
#: A filter of more bytes is not broadcast but read part by part.
BROADCAST_BYTES = 64 << 20
WEIGHTS = (0.2, 0.35, 0.45)
_LOW = np.uint64(0xFFFFFFFF)
_TRIMMED = np.uint64((1 << 48) - 1)
#: A part of so many bits or fewer is made with a byte for each.
_WHOLE_BITS = 1 << 26


def _grams(words: textkit.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of its n-grams and the position of their last word."""
    h, doc = words.hash, words.doc
    out = [(textkit.mix(h, 101), np.arange(len(h)))]
    run = h
    for n in range(2, ORDERS + 1):
        if len(h) < n:
            out.append((h[:0], np.zeros(0, np.int64)))
            continue
        run = textkit.mix(run[:-1] * np.uint64(0x9FB21C651E98DF25) ^ h[n - 1 :], n)
        at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
        out.append((textkit.mix(run[at], 100 + n), at + n - 1))
    return out


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.diff(np.append(edge, len(keys)))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


#: Packed counts wait in a worker up to so many n-grams before they are sent on.
_HELD = 4_000_000
_PACKED = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("count", pa.binary())])
_PACKED_SQL = "shard int, n int, once binary, more binary, count binary"


def _trim(keys: np.ndarray) -> bytes:
    """Six bytes of each fingerprint: within a shard they tell n-grams apart as well as eight."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _untrim(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _counter(shards: int):
    def pack(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for n, arrays in enumerate(held, 1):
            if not arrays:
                continue
            keys, counts = _counted(np.concatenate(arrays))
            stops = np.searchsorted(_shard(keys, shards), np.arange(shards + 1).astype(np.uint64))
            for s in range(shards):
                k, c = keys[stops[s] : stops[s + 1]], counts[stops[s] : stops[s + 1]]
                if len(k):
                    rows.append({"shard": s, "n": n, "once": _trim(k[c == 1]), "more": _trim(k[c > 1]), "count": c[c > 1].astype("<u4").tobytes()})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
        size = 0
        for batch in batches:
            column = textkit.text(batch.column(0))
            for a, b in textkit.slices(column):
                for n, (h, _) in enumerate(_grams(textkit.Words(column[a:b]))):
                    held[n].append(h)
                    size += len(h)
                if size > _HELD:
                    yield from pack(held)
                    held, size = [[] for _ in range(ORDERS)], 0
        yield from pack(held)

    return run


def _position(x: np.ndarray, i: int, bits: int) -> np.ndarray:
    a, b = x & _LOW, (x >> np.uint64(32)) | np.uint64(1)
    return (((a + np.uint64(i) * b) & _LOW) * np.uint64(bits)) >> np.uint64(32)


def _positions(h: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    x = textkit.mix(h ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)), 7)
    for i in range(PROBES):
        yield _position(x, i, bits)


def build_part(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of one shard: n-gram fingerprints with their counts, each as 1 + floor(log2(count)) entries."""
    level = np.frexp(counts.astype(float))[1] if len(counts) else np.zeros(0, int)
    bits = min(max(64, int(level.sum()) * BITS_AN_ENTRY), 1 << 32)
    # a byte a bit is set faster than bits in place, while there are not too many
    whole = bits <= _WHOLE_BITS
    field = np.zeros(-(-bits // 8) * (8 if whole else 1), np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        for p in _positions(keys[level >= j] if j > 1 else keys, j, bits):
            if whole:
                field[p.view(np.int64)] = 1
            else:
                np.bitwise_or.at(field, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
    if whole:
        field = np.packbits(field, bitorder="little")
    return np.concatenate([np.frombuffer(np.array([bits], "<u8").tobytes(), np.uint8), field])


def read_levels(part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each fingerprint by repeated membership probes; 0: not in the model."""
    bits, field = np.uint64(part[:8].view("<u8")[0]), part[8:]
    level, alive, j = np.zeros(len(keys), np.int8), np.arange(len(keys)), 1
    while len(alive):
        x = textkit.mix(keys[alive] ^ np.uint64(j * 0x9E3779B97F4A7C15 & (2**64 - 1)), 7)
        # sums of 32 bits wrap as those of _position do
        a, b = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        ok = None
        for i in range(PROBES):
            if i:
                a += b
            p = a.astype(np.uint64)
            p *= bits
            p >>= np.uint64(32)
            at = p.astype(np.uint8) & np.uint8(7)
            p >>= np.uint64(3)
            hit = (field.take(p.view(np.int64)) >> at & np.uint8(1)).view(bool)
            ok = hit if ok is None else ok & hit
            # most n-grams of the first level pass all probes, most of a higher one few
            if np.count_nonzero(ok) < 0.7 * len(ok):
                alive, a, b, ok = alive[ok], a[ok], b[ok], None
        if ok is not None:
            alive = alive[ok]
        level[alive] = j
        j += 1
    return level


def _builder(to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, lists, words = None, [[] for _ in range(2 * ORDERS)], 0
        for batch in batches:
            for row in batch.to_pylist():
                shard = row["shard"]
                for x, c in ((row["once"], None), (row["more"], row["count"])):
                    keys = _untrim(x)
                    lists[row["n"] - 1].append(keys)
                    counts = np.ones(len(keys), np.int64) if c is None else np.frombuffer(c, "<u4").astype(np.int64)
                    lists[ORDERS + row["n"] - 1].append(counts)
        if shard is None:
            return
        kept, distinct = [], 0
        for n in range(ORDERS):
            if lists[n]:
                keys, counts = _added(np.concatenate(lists[n]), np.concatenate(lists[ORDERS + n]))
                lists[n] = lists[ORDERS + n] = []
                if n == 0:
                    words, distinct = int(counts.sum()), len(keys)
                kept.append((keys, counts))
        part = build_part(np.concatenate([k for k, _ in kept]), np.concatenate([c for _, c in kept]))
        fs, folder = filesystem(to)
        fs.create_dir(folder, recursive=True)
        final = posixpath.join(folder, f"{shard:06d}.bits")
        tmp = f"{final}.{TaskContext.get().taskAttemptId()}.tmp"
        with fs.open_output_stream(tmp) as out:
            out.write(part.tobytes())
        publish(fs, tmp, final)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "bytes": [len(part)], "words": [words], "vocabulary": [distinct]}, pa.schema([("shard", pa.int32()), ("bytes", pa.int64()), ("words", pa.int64()), ("vocabulary", pa.int64())]))

    return run


def build_model(docs: DataFrame) -> dict:
    """Counts all documents and writes the filter: its folder, shards, bytes of each, words and vocabulary."""
    spark = docs.sparkSession
    prepare(spark)
    shards = shuffle_width(spark)
    to = shared_dir(spark, "ngrams")
    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(_counter(shards)), _PACKED_SQL)
    parts = packed.repartitionById(shards, F.col("shard")).mapInArrow(lean(_builder(to)), "shard int, bytes long, words long, vocabulary long")
    # one row a shard reaches the driver
    rows = materialise(parts, "ngram-parts").collect()
    return {"folder": to, "shards": shards, "bytes": {r["shard"]: r["bytes"] for r in rows}, "words": sum(r["words"] for r in rows), "vocabulary": sum(r["vocabulary"] for r in rows)}


@functools.lru_cache(1)
def _part(folder: str, shard: int) -> np.ndarray:
    fs, path = filesystem(posixpath.join(folder, f"{shard:06d}.bits"))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def _probabilities(level: list[np.ndarray], words: int, vocabulary: int) -> np.ndarray:
    """Natural logarithm of the interpolated probability of each word; levels stand for 1.5 * 2**(q-1)."""
    c1, c2, c3 = (np.where(x > 0, 1.5 * 2.0 ** (x - 1), 0.0) for x in level[:3])
    before1 = np.concatenate([[0.0], c1[:-1]])
    before2 = np.concatenate([[0.0], c2[:-1]])
    p1 = (c1 + 1) / (words + vocabulary + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(before1 > 0, np.minimum(c2 / before1, 1.0), 0.0)
        p3 = np.where(before2 > 0, np.minimum(c3 / before2, 1.0), 0.0)
    return np.log(WEIGHTS[0] * p1 + WEIGHTS[1] * p2 + WEIGHTS[2] * p3)


def _levels(words: textkit.Words, parts: Iterable[int], shards: int, part: Callable[[int], np.ndarray]) -> list[np.ndarray]:
    """For each order the level of the n-gram that ends at each word. N-grams that are equal are asked for once, each part once."""
    n, grams = len(words.hash), _grams(words)
    keys = np.concatenate([h for h, _ in grams])
    order = np.argsort(keys)
    keys = keys[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    times = np.diff(np.append(np.flatnonzero(head), len(keys)))
    keys = keys[head]
    stops = np.searchsorted(_shard(keys, shards), np.arange(shards + 1).astype(np.uint64))
    keys &= _TRIMMED
    found = np.zeros(len(keys), np.int8)
    for s in parts:
        if stops[s] < stops[s + 1]:
            found[stops[s] : stops[s + 1]] = read_levels(part(s), keys[stops[s] : stops[s + 1]])
    level = np.zeros(ORDERS * n, np.int8)
    level[np.concatenate([at + k * n for k, (_, at) in enumerate(grams)])[order]] = np.repeat(found, times)
    return list(level.reshape(ORDERS, n))


def _scorer(model: dict, sent):
    shards = model["shards"]
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_probability", pa.float64()), ("perplexity", pa.float64())])

    def part(s: int) -> np.ndarray:
        return np.frombuffer(sent.value[s], np.uint8) if sent is not None else _part(model["folder"], s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = textkit.text(batch.column(1)), batch.column(0)
            # read part by part, a filter is better asked for many texts at once, and a part for all orders
            for a, b in textkit.slices(column, textkit.SLICE_BYTES * (1 if sent is not None else 2)):
                words = textkit.Words(column[a:b])
                level = _levels(words, model["bytes"], shards, part)
                total = np.concatenate([[0.0], np.cumsum(_probabilities(level, model["words"], model["vocabulary"]))])
                count = words.counts
                log_p = total[words.first[1:]] - total[words.first[:-1]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    perplexity = np.exp(-log_p / count)
                none = count == 0
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(count.astype(np.int64)), pa.array(np.where(none, 0.0, log_p)), pa.array(perplexity, mask=none)], schema=out)

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_words, log_probability (natural, of the whole text) and perplexity by a model of build_model.

    A text without words (null, empty, only signs) has 0 words, log-probability 0 and no perplexity. Null ids
    stay null, repeated rows are scored each, other columns are ignored, an empty table gives no rows and a model of an
    empty table scores each word alike. Words at the start of a text have no words before them to depend on.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = None
    if sum(model["bytes"].values()) <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast({s: _part(model["folder"], s).tobytes() for s in model["bytes"]})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_scorer(model, sent)), "doc_id long, n_words long, log_probability double, perplexity double")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, build_model(docs))
