"""Operator 2: finds documents that hold benchmark items, also with some words changed, added or lost.

Words are the symbols. A random walk over a window (the embedding of Chakraborty, Goldenberg and Koucky)
copies the current symbol and, by a random bit of step and symbol, stays or moves on; edit distance
between windows becomes Hamming distance between copies. Tables of sampled steps then are an LSH for
Hamming distance. What a table retrieves is verified by exact edit distance between the item and the
document.

Windows are as long as the items are, by powers of two up to MOST_WINDOW. All windows of an item are in the tables, and
of a document those at multiples of half the window, so each copy of an item holds windows that begin at the
same word as one of the item's.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import textkit
from quadloom.llm.common import carried_text, lean, prepare, table

#: An item is held if it can be had from the document's words by edits of so many of its words, as a share.
EDITS = 0.2
#: Items of fewer words are phrases that any text may hold; they are not looked for.
LEAST_WORDS = 4
WALKS = 2
#: Tables for each walk, and the steps that each samples.
TABLES = 8
SAMPLED = 4
#: Longest window. A long item holds many aligned windows of this length, each with few edits.
MOST_WINDOW = 16
#: Bytes of benchmark text for which tables go to the workers at once; more take several passes.
PASS_BYTES = 8 << 20
_SLOTS = 22  # log2 of the bits that are asked before a table is


@dataclass(frozen=True)
class _Index:
    window: int
    stride: int
    steps: int
    samples: tuple  # for each walk and step the tables that take it
    maybe: np.ndarray  # tables x slots
    keys: tuple  # for each table sorted keys
    at: tuple  # and the rows of `where` they stand for
    where: np.ndarray  # item, word of the item


def window_for(words: int) -> int:
    """Window length of an item: the power of two that leaves it at least half a window of room."""
    return 1 << max(0, int(np.floor(np.log2(words * 2 / 3))))


def _samples(window: int, steps: int) -> tuple:
    rng = np.random.default_rng([9, window])
    picked = [[np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False)) for _ in range(TABLES)] for _ in range(WALKS)]
    return tuple(tuple(tuple(t for t in range(TABLES) if j in picked[w][t]) for j in range(steps)) for w in range(WALKS))


def _sign(h: np.ndarray, start: np.ndarray, steps: int, samples: tuple) -> np.ndarray:
    """Keys of the windows beginning at `start`, one row for each walk and table. h must end in filling words."""
    keys = np.zeros((WALKS * TABLES, len(start)), np.uint64)
    for w in range(WALKS):
        # bit j of a word's scrambled hash says whether step j moves on
        bits = [textkit.mix(h, 1000 * w + k) for k in range(-(-steps // 64))]
        pos = start.copy()
        for j in range(steps):
            if samples[w][j]:
                symbol = h[pos]
                for t in samples[w][j]:
                    k = keys[w * TABLES + t]
                    np.multiply(k, np.uint64(0x9E3779B97F4A7C15), out=k)
                    np.bitwise_xor(k, symbol, out=k)
                    np.bitwise_xor(k, k >> np.uint64(31), out=k)
            if j + 1 < steps:
                pos += ((bits[j // 64][pos] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    for i in range(len(keys)):
        keys[i] = textkit.mix(keys[i], i)
    return keys


def _fill(h: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([h, np.zeros(n, np.uint64)])


def _indexes(items: list[np.ndarray]) -> list[_Index]:
    by: dict[int, list[int]] = {}
    for i, h in enumerate(items):
        if len(h) >= LEAST_WORDS:
            by.setdefault(min(window_for(len(h)), MOST_WINDOW), []).append(i)
    out = []
    for window, members in sorted(by.items()):
        steps = max(SAMPLED, int(1.6 * window))
        samples = _samples(window, steps)
        keys, where = [], []
        for i in members:
            start = np.arange(len(items[i]) - window + 1)
            keys.append(_sign(_fill(items[i], steps + 1), start, steps, samples))
            where.append(np.stack([np.full(len(start), i), start], 1))
        keys = np.concatenate(keys, 1)
        order = np.argsort(keys, axis=1)
        maybe = np.zeros((len(keys), 1 << (_SLOTS - 3)), np.uint8)
        for t, k in enumerate(keys):
            slot = k >> np.uint64(64 - _SLOTS)
            np.bitwise_or.at(maybe[t], slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        out.append(_Index(window, max(1, window // 2), steps, samples, maybe, tuple(k[o] for k, o in zip(keys, order, strict=True)), tuple(order), np.concatenate(where)))
    return out


def _candidates(words: textkit.Words, indexes: list[_Index]) -> np.ndarray:
    """Distinct (document, item, word of the slice where the item would begin)."""
    found = []
    for ix in indexes:
        count = words.counts
        n = np.where(count >= 1, np.maximum(1, -(-(count - ix.window + 1) // ix.stride)), 0)
        start = np.repeat(words.first[:-1], n) + textkit.ragged(np.zeros(len(n), np.int64), n) * ix.stride
        doc = np.repeat(np.arange(len(n)), n)
        h = _fill(words.hash, ix.steps + 1)
        keys = _sign(h, start, ix.steps, ix.samples)
        for t in range(len(keys)):
            slot = keys[t] >> np.uint64(64 - _SLOTS)
            hit = np.flatnonzero((ix.maybe[t][slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            lo = np.searchsorted(ix.keys[t], keys[t][hit], "left")
            n_hit = np.searchsorted(ix.keys[t], keys[t][hit], "right") - lo
            row = ix.where[ix.at[t][textkit.ragged(lo, n_hit)]]
            w = np.repeat(hit, n_hit)
            if len(row):
                found.append(np.stack([doc[w], row[:, 0], start[w] - row[:, 1]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def edit_distance_within(item: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of `item` to any run within each row of `parts`, and the end of the first such run."""
    n, width = len(item), parts.shape[1]
    steps = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((len(parts), width + 1), np.int32)
    for i in range(n):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (parts != item[i]), row[:, 1:] + 1, out=new[:, 1:])
        # a word of the document that is left out costs 1: least of all cheaper ways further left
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(1), row.argmin(1)


def _verify(words: textkit.Words, items: list[np.ndarray], found: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, edits, first word of the place in the document) of what is held."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if not len(found):
        return []
    order = np.argsort(found[:, 1], kind="stable")
    found = found[order]
    for i in np.unique(found[:, 1]):
        rows = found[found[:, 1] == i]
        item = items[i]
        most = int(EDITS * len(item))
        width = len(item) + 2 * most + 2
        for a in range(0, len(rows), max(1, 2_000_000 // width)):
            part = rows[a : a + max(1, 2_000_000 // width)]
            begin, end = words.first[part[:, 0]], words.first[part[:, 0] + 1]
            at = (part[:, 2] - most - 1)[:, None] + np.arange(width)
            inside = (at >= begin[:, None]) & (at < end[:, None])
            text = np.where(inside, words.hash[np.clip(at, 0, len(words.hash) - 1)], np.uint64(0))
            # a place that holds the item has all but `most` of its words, whatever their order
            known = np.unique(item)
            near = np.searchsorted(known, text)
            near[near == len(known)] = 0
            likely = np.flatnonzero((known[near] == text).sum(1) >= len(item) - most)
            if not len(likely):
                continue
            part, begin, text = part[likely], begin[likely], text[likely]
            edits, _ = edit_distance_within(item, text)
            for d, e, s, b in zip(part[:, 0], edits, part[:, 2], begin, strict=True):
                if e <= most and (int(e), int(s - b)) < best.get((int(d), int(i)), (most + 1, 0)):
                    best[int(d), int(i)] = (int(e), max(0, int(s - b)))
    return [(d, i, e, s) for (d, i), (e, s) in sorted(best.items())]


def _words_of(texts: list[str]) -> list[np.ndarray]:
    w = textkit.Words(textkit.text(pa.array(texts, pa.string())))
    return [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(texts))]


@functools.lru_cache(1)
def _prepared(texts: tuple[str, ...]) -> tuple[list[np.ndarray], list[_Index]]:
    """Words and tables of the items, made once per worker."""
    items = _words_of(list(texts))
    return items, _indexes(items)


_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("first_word", pa.int64())])


def _search(ids: list, texts: list[str], names: list[str] | None, at: int = 0):
    """Pairs of ids, which come after the text (names is None), or of the rows of the columns `names` those that hold no item. at: where the text is."""
    frozen = tuple(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, made = _prepared(frozen)
        for batch in batches:
            column = textkit.text(batch.column(at))
            rest = batch.select(range(1, 2) if names is None else range(len(names)))
            keep = np.ones(len(column), bool)
            for a, b in textkit.slices(column, textkit.SLICE_BYTES // 2):
                words = textkit.Words(column[a:b])
                held = _verify(words, items, _candidates(words, made))
                if names is not None:
                    keep[[a + r[0] for r in held]] = False
                elif held:
                    yield pa.RecordBatch.from_pydict({"doc_id": rest.column(0).take(pa.array([a + r[0] for r in held])), "item_id": [ids[r[1]] for r in held], "edits": [r[2] for r in held], "item_words": [len(items[r[1]]) for r in held], "first_word": [r[3] for r in held]}, _PAIRS)
            if names is not None:
                yield pa.RecordBatch.from_arrays(rest.columns, names=names).filter(pa.array(keep))

    return run


def _passes(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in parts of at most about PASS_BYTES, each collected on its own."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // PASS_BYTES))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = part.orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, item_words, first_word (about where) for each document and item it holds.

    Null or empty texts hold nothing and null, empty or very short items (LEAST_WORDS) are never held; null
    ids stay null; repeated documents give a row each, repeated items (same id and text) one; other columns are
    ignored; with either table empty there are no rows. Texts are searched whole.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    out = None
    for ids, texts in _passes(items):
        one = rows.mapInArrow(lean(_search(ids, texts, None)), "doc_id long, item_id long, edits int, item_words int, first_word long")
        out = one if out is None else out.unionAll(one)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of `docs` that hold no item, with all their columns; cases as in contaminated()."""
    prepare(docs.sparkSession)
    out = docs
    for ids, texts in _passes(items):
        keyed, at = carried_text(out)
        out = keyed.mapInArrow(lean(_search(ids, texts, docs.columns, at)), docs.schema)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
