"""Operator 3: documents whose sets of word n-grams have a Jaccard similarity of T or more, joined exactly.

Jaccard distance is a metric, which the join uses at three levels:

* Pivots. Of the sets that share a sketch, the one whose min-hashes most others have leads. Sets within RADIUS of a leader that has
  no leader itself are at home in its region, the nearest counting; every other set is the pivot of a region of its own, of radius 0. As
  RADIUS is half of the greatest distance of similar sets, all sets of a region are similar to each other by the
  triangle inequality: a region is never joined with itself, however many sets it has.
* Windows. Sets of two regions can be similar only if their pivots are no farther apart than 1 - T and both radii. Which
  pivots are is found by an inverted index over prefixes: two sets of similarity s have at least prefix_matches() n-grams of
  their prefixes for s in common when n-grams are put in one order, the rare ones first. Only pivots are in that
  index, each with the prefixes that its radius asks for, so a set that many near copies have stands there once.
  A common n-gram's places in two sets tell how many they can have in common at most; where that is too few they aren't counted.
  Where both regions have several sets, each set of one goes to the other if its distance to the pivot there allows it.
  Pivots that may be near are compared in cells of sets that have a leader in common, so a set goes to a cell, not to each pair.
* Regions. For a set that visits a region, the distances to the pivot settle most pairs: they are similar if the two
  distances add up to 1 - T at most, and aren't if they differ by more. The rest is joined on whole sets, in cells of CELL
  home sets and CELL visitors at most, which pivots of their own divide again and again while that saves comparisons.
"""

from __future__ import annotations

import functools
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quadloom.llm import textkit
from quadloom.llm.common import carried_text, filesystem, lean, materialise, prepare, publish, shared_dir, shuffle_width, table
from quadloom.llm.pairing import _bits, _keeper, _read_filter, by_shard, key_filter

WORDS = 2
T = 0.6
THETA = 1 - T
#: Home radius of a region. Sets within it of one pivot are similar to each other if it is at most THETA / 2.
RADIUS = THETA / 2
#: Sketches of a set, of so many min-hashes each; the min-hashes also tell which set stands in the middle of others.
SKETCHES = 5
SKETCH_MINS = 3
MINS = SKETCHES * SKETCH_MINS
#: Similarity of pivots that the index finds: of two regions of radius 0, of one and one that has a radius, of two that have.
LEVELS = (T, T - RADIUS, T - 2 * RADIUS)
#: Home sets, and visitors, of a region that are compared in one task at most.
CELL = 1000
#: So many n-grams of their prefixes have two similar sets in common, and a share of the smaller set's size if that is more.
PREFIX_MATCHES = 4
PREFIX_SHARE = 1 / 16
#: N-grams of so many documents are put last, in order of their number of documents. The bound is doubled
#: until the list of them has at most FREQUENT_BYTES; it decides on the order only, never on results.
FREQUENT = 12
FREQUENT_BYTES = 48 << 20
#: Text whose sets are made at once.
SLICE_BYTES = 1 << 19
#: N-grams, or the index's entries, that a worker holds before it sends them on.
_HELD = 1_000_000
_LEAF = 128
_EPS = 1e-9


def set_keys(fp: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit key of each document's set, the same for equal sets, and the set's size. 0: empty."""
    size = np.bincount(doc, minlength=docs)
    total = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(fp, 11))])
    ends = np.cumsum(size)
    key = textkit.mix(total[ends] - total[ends - size] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 12)
    return np.where(size > 0, key | np.uint64(1), 0).view(np.int64), size


def _packed(fp: np.ndarray, text: bytes) -> bytes:
    """A set as the deflated text that it is made from, or in 6 bytes an element, as fingerprints have 48 bits, where that is less."""
    deflated = zlib.compress(text, 1)
    if len(deflated) < len(fp) * textkit.FP_BITS // 8:
        return b"t" + deflated
    return b"s" + np.ascontiguousarray(fp.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : textkit.FP_BITS // 8]).tobytes()


def _unpacked(column: pa.Array) -> list[np.ndarray | None]:
    """The sets of a column, None for nulls."""
    out: list[np.ndarray | None] = [None] * len(column)
    texts, at = [], []
    for i, x in enumerate(column):
        data = x.as_buffer()
        if data is None:
            continue
        data = memoryview(data)
        if data[:1] == b"t":
            texts.append(zlib.decompress(data[1:]))
            at.append(i)
            continue
        raw = np.frombuffer(data[1:], np.uint8).reshape(-1, textkit.FP_BITS // 8)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, : raw.shape[1]] = raw
        out[i] = full.view("<u8").reshape(-1)
    if texts:
        for a, b, fp, _, _, size in _sets(pa.array(texts, pa.large_binary()).cast(pa.large_string())):
            begin = np.cumsum(size) - size
            for k in range(a, b):
                out[at[k]] = fp[begin[k - a] : begin[k - a] + size[k - a]].copy()
    return out


def _sets(batch_column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    column = textkit.text(batch_column)
    for a, b in textkit.slices(column, SLICE_BYTES):
        fp, doc = textkit.shingle_sets(column[a:b], WORDS)
        key, size = set_keys(fp, doc, b - a)
        yield a, b, fp, doc, key, size


# --- what each document's set is: key, size, sketches -------------------------------------------------

_SUMMARY = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("mins", pa.binary())])
_SUMMARY_SQL = "key long, doc_id long, mins binary"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, fp, _, key, size in _sets(batch.column(1)):
            some = np.flatnonzero(size)
            begin = (np.cumsum(size) - size)[some]
            mins = np.zeros((b - a, MINS), np.uint32)
            if len(some):
                for i in range(MINS):
                    mins[some, i] = np.minimum.reduceat(textkit.mix(fp, 300 + i), begin) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)[a:b], pa.array([x.tobytes() for x in mins], pa.binary())], schema=_SUMMARY)


# --- how many documents have an n-gram: only the frequent ones are kept -------------------------------


def _place(fp: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of a fingerprint, and 32 bits that tell it from others of the shard well enough for an order."""
    x = fp * np.uint64(shards)
    return (x >> np.uint64(textkit.FP_BITS)).astype(np.int64), ((x & textkit.FP_MASK) >> np.uint64(textkit.FP_BITS - 32)).astype(np.uint32)


def _order_key(fp: np.ndarray, shards: int) -> np.ndarray:
    s, low = _place(fp, shards)
    return (s.astype(np.uint64) << np.uint64(32)) | low


def _count(shards: int):
    schema = pa.schema([("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("count", pa.binary())])

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.concatenate(held))
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n, keys = np.diff(np.append(edge, len(keys))), keys[edge]
        stops = np.searchsorted(keys, np.arange(shards + 1).astype(np.uint64) << np.uint64(32))
        rows = []
        for s in range(shards):
            k, c = keys[stops[s] : stops[s + 1]].astype(np.uint32), n[stops[s] : stops[s + 1]]
            if len(k):
                rows.append((s, k[c == 1].tobytes(), k[c > 1].tobytes(), c[c > 1].astype("<u4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for *_, fp, _, _, _ in _sets(batch.column(0)):
                held.append(_order_key(fp, shards))
                total += len(fp)
                if total > _HELD:
                    yield from send(held)
                    held, total = [], 0
        if total:
            yield from send(held)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("sizes", pa.list_(pa.int64()))])
    shard, keys, counts = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            shard = row["shard"]
            once, more = np.frombuffer(row["once"], "<u4"), np.frombuffer(row["more"], "<u4")
            keys += [once, more]
            counts += [np.ones(len(once), np.uint32), np.frombuffer(row["count"], "<u4")]
    if shard is None:
        return
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    total = np.add.reduceat(c, edge)
    many = total >= FREQUENT
    # how many there are of FREQUENT or more documents, of twice as many, and so on
    sizes = [int((total >= FREQUENT << i).sum()) for i in range(28)]
    yield pa.RecordBatch.from_pydict({"shard": [shard], "keys": [k[edge][many].tobytes()], "counts": [total[many].astype("<u4").tobytes()], "sizes": [sizes]}, schema)


def _list_writer(to: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                k, c = np.frombuffer(row["keys"], "<u4"), np.frombuffer(row["counts"], "<u4")
                k, c = k[c >= least], c[c >= least]
                if len(k):
                    fs, folder = filesystem(to)
                    fs.create_dir(folder, recursive=True)
                    final = posixpath.join(folder, f"{row['shard']:08d}.list")
                    tmp = f"{final}.{TaskContext.get().taskAttemptId()}.tmp"
                    with fs.open_output_stream(tmp) as out:
                        out.write(np.array([row["shard"], len(k)], "<u8").tobytes() + k.tobytes() + c.tobytes())
                    publish(fs, tmp, final)
        yield from ()

    return run


def _frequent_list(texts: DataFrame, shards: int) -> str:
    """Writes the frequent n-grams, sorted, with their number of documents, a file for each shard; returns the folder."""
    spark = texts.sparkSession
    counted = texts.select("text").mapInArrow(lean(_count(shards)), "shard int, once binary, more binary, count binary")
    rows = materialise(counted.repartitionById(shards, F.col("shard")).mapInArrow(lean(_frequent), "shard int, keys binary, counts binary, sizes array<long>"), "frequent")
    sizes = rows.select(F.posexplode("sizes")).groupBy("pos").agg(F.sum("col")).collect()
    least = min((FREQUENT << r[0] for r in sizes if 12 * r[1] <= FREQUENT_BYTES), default=FREQUENT)
    to = shared_dir(spark, "frequent-list")
    rows.select("shard", "keys", "counts").mapInArrow(lean(_list_writer(to, least)), "n long").collect()
    return to


@functools.lru_cache(1)
def _read_frequent(name: str) -> tuple[np.ndarray, np.ndarray]:
    fs, folder = filesystem(name)
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for info in sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.path):
        if info.path.endswith(".list"):
            with fs.open_input_file(info.path) as f:
                data = f.read()
            shard, n = np.frombuffer(data, "<u8", 2).tolist()
            keys.append((np.uint64(shard) << np.uint64(32)) | np.frombuffer(data, "<u4", n, 16).astype(np.uint64))
            counts.append(np.frombuffer(data, "<u4", n, 16 + 4 * n))
    return np.concatenate(keys), np.concatenate(counts)


# --- joining a region's sets with those that visit it ----------------------------------------------------


def _inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    grams, begin = np.unique(flat[order], return_index=True)
    return grams, np.append(begin, len(flat)), owner[order]


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common elements of all sets `left` with all sets `right`."""
    grams, begin, owner = _inverted([sets[i] for i in right])
    out = np.zeros((len(left), len(right)), np.int32)
    for row, i in enumerate(left):
        at = np.searchsorted(grams, sets[i])
        at[at == len(grams)] = 0
        at = at[grams[at] == sets[i]]
        out[row] = np.bincount(owner[textkit.ragged(begin[at], begin[at + 1] - begin[at])], minlength=len(right))
    return out


def _similar(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    c = _common(sets, left, right)
    return c / (size[left][:, None] + size[right][None, :] - c)


def join_region(sets: list[np.ndarray], home: np.ndarray, guest: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (home, guest) of similarity T or more, by number of the set, each pair once."""
    return list(zip(*(x.tolist() for x in _region_pairs(sets, home, guest)), strict=True))


def _region_pairs(sets: list[np.ndarray], home: np.ndarray, guest: np.ndarray) -> np.ndarray:
    """Homes and guests of the pairs of join_region()."""
    size = np.array([len(s) for s in sets])
    out = [np.zeros((2, 0), np.int32)]
    todo = [(home, guest)]
    while todo:
        home, guest = todo.pop()
        if not len(home) or not len(guest):
            continue
        if len(home) > _LEAF:
            pivots = home[:: max(1, len(home) // 8)][:8]
            far_home, far_guest = (1 - _similar(sets, size, x, pivots) for x in (home, guest))
            own, near = far_home.argmin(1), far_home.min(1)
            parts, cost = [], 0
            for k in range(len(pivots)):
                inside = own == k
                beside = far_guest[:, k] <= near[inside].max(initial=0) + THETA + _EPS
                parts.append((home[inside], guest[beside]))
                cost += int(inside.sum()) * int(beside.sum())
            if cost < 0.7 * len(home) * len(guest):
                todo += parts
                continue
        for s in range(0, len(home), 256):
            rows = home[s : s + 256]
            x, y = np.nonzero(_similar(sets, size, rows, guest) >= T - _EPS)
            out.append(np.stack([rows[x], guest[y]]).astype(np.int32))
    return np.concatenate(out, 1)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
_PAIR_SQL = "a long, b long, similarity double"
_MET = pa.schema([("home", pa.int64()), ("guest", pa.int64()), ("region", pa.int64())])


def _join_cell(cell: pa.Table) -> pa.Table:
    """Similar pairs of a cell: rows are pivot, part, other part, key, far, at_home and the set."""
    # a stored set may be there several times
    names = {x: i for i, x in enumerate(zip(cell["key"].to_pylist(), cell["at_home"].to_pylist(), strict=True))}
    cell = cell.take(pa.array(sorted(names.values()), pa.int64()))
    key, far, at_home = (cell[c].to_numpy() for c in ("key", "far", "at_home"))
    fps = cell["fps"].combine_chunks() if cell.num_rows else cell["fps"]
    sets = _unpacked(fps)
    home, guest = np.flatnonzero(at_home), np.flatnonzero(~at_home)
    far_home, far_guest = far[home], far[guest]
    # what distances to the pivot settle isn't compared
    low, high = far_home.min(initial=1), far_home.max(initial=0)
    sure = guest[far_guest + high <= THETA + _EPS]
    open_ = guest[(far_guest + high > THETA + _EPS) & (far_guest - high <= THETA + _EPS) & (low - far_guest <= THETA + _EPS)]
    h, g = np.concatenate([np.stack([np.tile(home, len(sure)), np.repeat(sure, len(home))]).astype(np.int32), _region_pairs(sets, home, open_)], 1)
    return pa.table([pa.array(key[h]), pa.array(key[g]), pa.array(np.full(len(h), cell["pivot"][0].as_py() if cell.num_rows else 0, np.int64))], schema=_MET)


# --- which pivots are near each other -------------------------------------------------------------------


def prefix_matches(size: np.ndarray, least: float | np.ndarray = T) -> np.ndarray:
    """How many n-grams beyond the shortest prefix a set of this size adds; two sets of similarity `least` share the lesser of theirs.

    Sets of `size` that are so similar have at least least * size in common; smaller ones can't share more than that.
    """
    return np.minimum(np.maximum(PREFIX_MATCHES, size * PREFIX_SHARE), np.ceil(least * size - _EPS)).astype(np.int64)


def _prefix(size: np.ndarray, least: float) -> np.ndarray:
    return size - np.ceil(least * size - _EPS).astype(np.int64) + prefix_matches(size, least)


def _in_order(fp: np.ndarray, doc: np.ndarray, size: np.ndarray, shards: int, frequent: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of each set, the rare first, then by fingerprint: gram, document, the first level whose prefix has it and its place."""
    often, number = _read_frequent(frequent)
    gram = _order_key(fp, shards)
    rank = np.zeros(len(gram), np.uint64)
    if len(often):
        at = np.searchsorted(often, gram)
        at[at == len(often)] = 0
        rank = np.where(often[at] == gram, number[at], 0).astype(np.uint64)
    order = np.lexsort((fp, rank, doc))
    place = np.arange(len(fp)) - np.repeat(np.cumsum(size) - size, size)
    level = sum((place >= _prefix(size, s)[doc]).astype(np.int8) for s in LEVELS)
    return gram[order], doc, level, place


_POSTING = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("gram", "key", "size", "kind", "place")]])
_POSTING_SQL = "shard int, gram binary, key binary, size binary, kind binary, place binary"
_BIG = 65_535
#: A place in a set is told in so many parts of its size.
_PLACES = 256
#: Pairs that are looked at in one step, that wait to be added up, and that are sent on once so many are added up.
_PAIRS_STEP = 300_000
_PAIRS_HELD = 1_000_000
_PAIRS_SENT = 1_000_000
#: Counts of pairs are added up in so many parts of a shard, one after another.
_SUBS = 16
#: No more n-grams in common are counted or asked for.
_MOST = 255


def _among(field: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    keep = np.ones(len(key), bool)
    for p in _bits(key, n):
        keep &= ((field[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return keep


class _Poster:
    """Makes the index's entries: n-gram, set, its size, and whether it has a radius (bit 2) beside the level."""

    def __init__(self, shards: int, frequent: str, grams: tuple[list[str], int]) -> None:
        self.shards, self.frequent, self.grams = shards, frequent, grams
        self.held, self.total, self.seen = [], 0, set()

    def add(self, fp: np.ndarray, doc: np.ndarray, size: np.ndarray, key: np.ndarray, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        gram, doc, level, place = _in_order(fp, doc, size, self.shards, self.frequent)
        # beyond the first level, a set of no radius meets only n-grams of those that have one
        take = np.flatnonzero((level == 0) | (wide[doc] & (level < 3)))
        more = np.flatnonzero((level == 1) & ~wide[doc])
        more = more[_among(_read_filter(tuple(self.grams[0]), self.grams[1]), self.grams[1], gram[more].view(np.int64))]
        take = np.concatenate([take, more])
        self.held.append([gram[take], key[doc[take]], np.minimum(size[doc[take]], _BIG).astype(np.uint16), (wide[doc[take]] * 4 + level[take]).astype(np.uint8), (place[take] * _PLACES // size[doc[take]]).astype(np.uint8)])
        self.total += len(take)
        if self.total > _HELD:
            yield self.send()

    def send(self) -> pa.RecordBatch:
        gram, *rest = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.total = [], 0
        rows = list(by_shard((gram >> np.uint64(32)).astype(np.int64), [gram.astype(np.uint32), *rest]))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), *[pa.array([r[i] for _, r in rows], pa.binary()) for i in range(5)]], schema=_POSTING)


def _fresh(key: np.ndarray, ok: np.ndarray, seen: set) -> np.ndarray:
    """Numbers of the rows that are ok, each key once in a task."""
    at = np.flatnonzero(ok)
    _, first = np.unique(key[at], return_index=True)
    at = at[np.sort(first)]
    new = [i for i, k in zip(at.tolist(), key[at].tolist(), strict=True) if k not in seen]
    seen.update(key[new].tolist())
    return np.array(new, np.int64)


def _subset(fp: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin = np.cumsum(size) - size
    return fp[textkit.ragged(begin[at], size[at])], np.repeat(np.arange(len(at)), size[at]), size[at]


def _post_texts(poster: tuple, files: list[str], n: int):
    """Entries of the sets of texts, but for those whose keys are in the filter."""
    names = tuple(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, field = _Poster(*poster), _read_filter.__wrapped__(names, n)
        for batch in batches:
            for _, _, fp, _, key, size in _sets(batch.column(0)):
                at = _fresh(key, (size > 0) & ~_among(field, n, key), post.seen)
                yield from post.add(*_subset(fp, size, at), key[at], np.zeros(len(at), bool))
        if post.held:
            yield post.send()

    return run


def _post_sets(poster: tuple):
    """Entries of stored sets: key, whether it has a radius, the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = _Poster(*poster)
        for fp, doc, size, key, wide in _stored_sets(batches):
            yield from post.add(fp, doc, size, key, wide)
        if post.held:
            yield post.send()

    return run


def _stored_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for s in range(0, batch.num_rows, 2000):
            part = batch.slice(s, 2000)
            sets = _unpacked(part.column(2))
            size = np.array([len(x) for x in sets], np.int64)
            yield np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size, part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(bool)


def _wide_grams(shards: int, frequent: str):
    """N-grams of the first two levels of stored sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, doc, size, _, _ in _stored_sets(batches):
            gram, _, level, _ = _in_order(fp, doc, size, shards, frequent)
            yield pa.RecordBatch.from_pydict({"gram": np.unique(gram[level < 2]).view(np.int64)})

    return run


_COUNTED = pa.schema([("shard", pa.int32()), ("sub", pa.int32()), *[(c, pa.binary()) for c in ("a", "b", "n", "need")]])
_COUNTED_SQL = "shard int, sub int, a binary, b binary, n binary, need binary"


def counts_for(size_x: np.ndarray, at_x: np.ndarray, size_y: np.ndarray, at_y: np.ndarray, alike: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether an n-gram at these places (in parts of the size) counts for sets of these sizes, to be `alike` with `need` such n-grams.

    For the sizes of both the prefixes are shorter than for a size alone: if the sets have `both` in common, need of these are
    among the first size - both + need of either. And what they have in common before an n-gram is among
    the first of both, what comes after among the last of both.
    """
    both = np.ceil(alike / (1 + alike) * (size_x + size_y) - 1e-6)
    first = [np.ceil(at * size / _PLACES) for at, size in ((at_x, size_x), (at_y, size_y))]
    last = [np.ceil((at + 1) * size / _PLACES) - 1 for at, size in ((at_x, size_x), (at_y, size_y))]
    most = np.minimum(*last) + 1 + np.minimum(size_x - first[0] - 1, size_y - first[1] - 1)
    return (first[0] < size_x - both + need) & (first[1] < size_y - both + need) & (most >= both)


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    a, b, n, need = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[edge], b[edge], np.minimum(np.add.reduceat(n[order].astype(np.int64), edge), _MOST).astype(np.uint8), need[order[edge]]


def _pair_up(shards: int):
    def send(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        x = textkit.mix(sums[0].view(np.uint64) * np.uint64(31) + sums[1].view(np.uint64)) >> np.uint64(32)
        rows = list(by_shard(((x * np.uint64(shards * _SUBS)) >> np.uint64(32)).astype(np.int64), list(sums)))
        at = np.array([s for s, _ in rows], np.int32)
        return pa.RecordBatch.from_arrays([pa.array(at // _SUBS), pa.array(at % _SUBS), *[pa.array([r[k] for _, r in rows], pa.binary()) for k in range(4)]], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in range(5)]
        for batch in batches:
            for i in range(5):
                held[i] += batch.column(i + 1).to_pylist()
        gram, key, size, kind, place = (np.frombuffer(b"".join(x), t) for x, t in zip(held, ("<u4", "<i8", "<u2", "u1", "u1"), strict=True))
        held.clear()
        if not len(gram):
            return
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        gram, key = gram[order], key[order]
        again = np.lexsort((key, gram))
        gram, key, order = gram[again], key[again], order[again]
        if len(gram):
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])  # equal sets count once
            gram, key, order = gram[new], key[new], order[new]
        size, kind, place = size[order].astype(np.int32), kind[order], place[order].astype(np.int32)
        wide, level = kind >> 2, kind & 3
        levels = np.array(LEVELS)
        sums: list[tuple[np.ndarray, ...]] = []
        waiting, least = 0, _PAIRS_HELD

        def count(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, least
            lo, hi = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            alike = levels[wide[x] + wide[y]]
            ok = np.flatnonzero((lo >= alike * hi - _EPS) | (hi == _BIG))
            x, y, lo, hi, alike = x[ok], y[ok], lo[ok], hi[ok], alike[ok]
            need = prefix_matches(lo, alike)
            ok = np.flatnonzero(counts_for(size[x], place[x], size[y], place[y], alike, need) | (hi == _BIG))
            need = np.minimum(need, _MOST)
            if len(ok):
                a, b = key[x[ok]], key[y[ok]]
                sums.append((np.minimum(a, b), np.maximum(a, b), np.ones(len(ok), np.uint8), need[ok].astype(np.uint8)))
                waiting += len(ok)
                if waiting > least:
                    sums[:] = [_added(sums)]
                    # what is added up is as large again before it is added up once more
                    waiting = 0
                    least = max(_PAIRS_HELD, len(sums[0][0]))
                    if len(sums[0][0]) > _PAIRS_SENT:
                        yield send(sums.pop())
                        least = _PAIRS_HELD

        def each(lead: np.ndarray, start: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """lead[i] with start[i], start[i] + 1 ... (number[i] of them), in steps."""
            ends, i = np.cumsum(number), 0
            while i < len(lead):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS_STEP, "right")))
                yield np.repeat(lead[i:j], number[i:j]), textkit.ragged(start[i:j], number[i:j])
                i = j

        # within the first level all meet
        low = np.flatnonzero(level == 0)
        if len(low):
            begin = np.flatnonzero(np.concatenate([[True], gram[low][1:] != gram[low][:-1]]))
            stop = np.repeat(np.append(begin[1:], len(low)), np.diff(np.append(begin, len(low))))
            at = np.arange(len(low))
            for x, y in each(at, at + 1, stop - at - 1):
                yield from count(low[x], low[y])
        # beyond it only those with a radius meet others
        lead = np.flatnonzero(wide)
        if len(lead):
            begin, stop = np.searchsorted(gram, gram[lead], "left"), np.searchsorted(gram, gram[lead], "right")
            for x, y in each(lead, begin, stop - begin):
                ok = ((level[x] > 0) | (level[y] > 0)) & (wide[y] & (x < y) | (wide[y] == 0) & (level[x] < 2) & (level[y] < 2)).astype(bool)
                yield from count(x[ok], y[ok])
        if sums:
            yield send(_added(sums))

    return run


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with as many n-grams in common as they need; the rows of a part (column 1) lie together."""

    def found(held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        a, b, n, need = _added([tuple(np.frombuffer(b"".join(x), t) for x, t in zip(held, ("<i8", "<i8", "u1", "u1"), strict=True))])
        keep = n >= need
        a, b = a[keep], b[keep]
        for s in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_pydict({"a": a[s : s + 100_000], "b": b[s : s + 100_000]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    part, held = None, [[] for _ in range(4)]
    for batch in batches:
        for sub, *row in zip(*(batch.column(i + 1).to_pylist() for i in range(5)), strict=True):
            if sub != part:
                if part is not None:
                    yield from found(held)
                part, held = sub, [[] for _ in range(4)]
            for to, x in zip(held, row, strict=True):
                to.append(x)
    if part is not None:
        yield from found(held)


def _some_sets(files: list[str], n: int, less: tuple[list[str], int] | None):
    """Sets whose keys are in the filter but not in the filter `less`, each once in a task."""
    names = tuple(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, seen = _read_filter(names, n), set()
        without = _read_filter.__wrapped__(tuple(less[0]), less[1]) if less else None
        for batch in batches:
            column = textkit.text(batch.column(0))
            for a, _, fp, _, key, size in _sets(column):
                keep = (size > 0) & _among(field, n, key)
                if less:
                    keep &= ~_among(without, less[1], key)
                at, begin = _fresh(key, keep, seen), np.cumsum(size) - size
                yield pa.RecordBatch.from_pydict({"key": key[at], "fps": [_packed(fp[begin[i] : begin[i] + size[i]], column[a + i].as_buffer().to_pybytes()) for i in at]}, pa.schema([("key", pa.int64()), ("fps", pa.binary())]))

    return run


def _verify(least: float):
    """Similar pairs of rows sorted by cell: the sets of a cell (pair: false), then its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for batch in (whole.slice(s, 1000) for whole in batches for s in range(0, whole.num_rows, 1000)):
            pair, a, b = (batch.column(i).to_pylist() for i in (1, 2, 3))
            fps, out = _unpacked(batch.column(4)), []
            for i, c in enumerate(batch.column(0).to_pylist()):
                if c != cell:
                    cell, sets = c, {}
                if not pair[i]:
                    sets[a[i]] = fps[i]
                    continue
                p, q = sets[a[i]], sets[b[i]]
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                common = int(np.count_nonzero(q[at] == p))
                alike = common / (len(p) + len(q) - common)
                if alike >= least - _EPS:
                    out.append((a[i], b[i], alike))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PAIR, strict=True)], schema=_PAIR)

    return run


# --- the join -----------------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _needed(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored sets whose keys are among `keys`, and few others; the rest needn't be shuffled to be joined."""
    return sets.mapInArrow(lean(_keeper(*key_filter(keys))), sets.schema)


def _compared(sets: DataFrame, pairs: DataFrame, families: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs of keys (a, b) that reach `least`, from stored sets.

    A cell holds the pairs between two families (or parts of them, or sets without one), so at most 2 * CELL sets.
    """
    of = {k: families.select(F.col("key").alias(k), F.col("family").alias(f"f_{k}")) for k in "ab"}
    pairs = pairs.join(of["a"], "a", "left").join(of["b"], "b", "left")
    f, g = (F.coalesce(f"f_{k}", k) for k in "ab")
    pairs = materialise(pairs.select(F.xxhash64(F.least(f, g), F.greatest(f, g)).alias("cell"), F.lit(True).alias("pair"), "a", "b"), "celled")
    keys = pairs.select("cell", F.col("a").alias("key")).unionAll(pairs.select("cell", "b")).distinct()
    rows = pairs.withColumn("fps", F.lit(None).cast("binary")).unionAll(keys.join(_needed(sets, keys.select("key").distinct()), "key").select("cell", F.lit(False), "key", F.lit(None).cast("long"), "fps"))
    return rows.repartition("cell").sortWithinPartitions("cell", "pair").mapInArrow(lean(_verify(least)), _PAIR_SQL)


class Joined:
    """The join of a table of documents: which sets are similar, told by regions and links between them.

    sets: key and doc_id of each document, key 0 for those without words. classes: key, n documents, their least id.
    homes: key, pivot and distance of sets that are not their own pivot. linked: pairs of keys (a, b), those of equal
    regions left out. whole: (key, region) of sets that are similar to all sets at home in a region they aren't at home in
    themselves. met: (home, guest, region), further pairs of a set at home in a region with one that isn't.
    A pair of sets of different regions is in one of linked, whole and met, once.
    """

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        prepare(spark)
        shards = shuffle_width(spark)
        texts = _texts(docs)
        self.sets = materialise(texts.mapInArrow(lean(_summary), _SUMMARY_SQL), "sets")
        self.texts = texts = texts.select("text")
        self.classes = classes = materialise(self.sets.where("key != 0").dropDuplicates(["key", "doc_id"]).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.first("mins").alias("mins")), "classes")

        # pivots and homes
        part = lambda i, n: F.expr(f"substring(mins, {4 * i + 1}, {4 * n})")
        sketches = classes.select("key", "mins", F.posexplode(F.array(*[part(SKETCH_MINS * i, SKETCH_MINS) for i in range(SKETCHES)])).alias("i", "sketch")).select("key", "mins", F.xxhash64("i", "sketch").alias("sketch"))
        shared = sketches.groupBy("sketch").agg(F.count("*").alias("many")).where("many > 1").select("sketch")
        sketches = materialise(sketches.join(shared, "sketch"), "sketches")
        votes = sketches.groupBy("key").agg(F.first("mins").alias("mins")).select("key", F.posexplode(F.array(*[part(i, 1) for i in range(MINS)])).alias("i", "min"))
        central = votes.join(votes.groupBy("i", "min").agg(F.count("*").alias("n")), ["i", "min"]).groupBy("key").agg(F.sum(F.floor(1000 * F.log2("n"))).alias("votes"))
        sketches = sketches.select("key", "sketch").join(central, "key")
        leaders = sketches.groupBy("sketch").agg(F.max(F.struct("votes", F.col("key").alias("leader"))).alias("top"))
        near = sketches.join(leaders, "sketch").where("key != top.leader").groupBy(F.col("key").alias("a"), F.col("top.leader").alias("b")).agg(F.max("top.votes").alias("votes"))
        near = materialise(near, "near")
        best = near.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("best")).select(F.col("a").alias("key"), F.col("best.b").alias("family"))
        families = best.groupBy("family").agg(F.ceil(F.count("*") / CELL).alias("parts"))
        families = best.join(families, "family").select("key", F.xxhash64("family", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("family"))
        self.families = families = materialise(families, "families")
        keys = near.select(F.col("a").alias("key")).unionAll(near.select("b")).distinct()
        known = key_filter(keys)
        stored = materialise(texts.mapInArrow(lean(_some_sets(*known, None)), "key long, fps binary"), "set-store")
        close = materialise(_compared(stored, near.select("a", "b"), families, 1 - RADIUS), "close")
        roots = close.join(close.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        homes = roots.groupBy("a").agg(F.max(F.struct("similarity", (-F.col("b")).alias("least"))).alias("best"))
        self.homes = homes = materialise(homes.select(F.col("a").alias("key"), (-F.col("best.least")).alias("pivot"), (1 - F.col("best.similarity")).alias("far")), "homes")
        self.regions = regions = materialise(homes.groupBy("pivot").agg(F.max("far").alias("radius"), F.count("*").alias("size")), "regions")

        # which pivots are near each other
        frequent = _frequent_list(texts, shards)
        own = materialise(stored.join(homes.select("key"), "key", "left_anti").join(regions.select(F.col("pivot").alias("key"), F.lit(True).alias("w")), "key", "left").select("key", F.coalesce("w", F.lit(False)).alias("wide"), "fps"), "pivots")
        grams = key_filter(own.where("wide").mapInArrow(lean(_wide_grams(shards, frequent)), "gram long"))
        poster = (shards, frequent, grams)
        entries = texts.mapInArrow(lean(_post_texts(poster, *known)), _POSTING_SQL).unionAll(own.mapInArrow(lean(_post_sets(poster)), _POSTING_SQL))
        raw = entries.repartitionById(shards, F.col("shard")).mapInArrow(lean(_pair_up(shards)), _COUNTED_SQL)
        pairs = materialise(raw.repartitionById(shards, F.col("shard")).sortWithinPartitions("sub").mapInArrow(lean(_enough), "a long, b long"), "pivot-pairs")
        keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct()
        others = texts.mapInArrow(lean(_some_sets(*key_filter(keys), known)), "key long, fps binary")
        stored = stored.unionAll(materialise(others, "set-store"))
        wide = {k: regions.select(F.col("pivot").alias(k), F.col("radius").alias(f"radius_{k}")) for k in "ab"}
        apart = _compared(stored, pairs, families, LEVELS[2]).join(wide["a"], "a", "left").join(wide["b"], "b", "left").select("a", "b", (1 - F.col("similarity")).alias("far"), *[F.coalesce(f"radius_{k}", F.lit(0.0)).alias(f"radius_{k}") for k in "ab"])
        apart = materialise(apart.where(F.col("far") <= THETA + _EPS + F.col("radius_a") + F.col("radius_b")), "apart")

        # sets that visit regions: of two regions with a radius, those of a visit b
        few = apart.where("radius_a = 0 AND radius_b > 0").select(F.col("a").alias("key"), F.col("b").alias("pivot"), "far", F.col("radius_b").alias("radius"))
        few = few.unionAll(apart.where("radius_a > 0 AND radius_b = 0").select("b", "a", "far", "radius_a"))
        both = apart.where("radius_a > 0 AND radius_b > 0")
        few = few.unionAll(both.select("a", "b", "far", "radius_b"))
        going = both.join(homes.select(F.col("key").alias("x"), F.col("pivot").alias("a"), F.col("far").alias("out")), "a").where(F.col("far") - F.col("out") <= THETA + _EPS + F.col("radius_b"))
        going = _compared(stored, going.select(F.col("x").alias("a"), "b"), families, 1 - THETA - RADIUS).join(wide["b"], "b").select(F.col("a").alias("key"), F.col("b").alias("pivot"), (1 - F.col("similarity")).alias("far"), F.col("radius_b").alias("radius"))
        visits = materialise(going.where(F.col("far") <= THETA + _EPS + F.col("radius")).withColumn("at_pivot", F.lit(False)).unionAll(few.where(F.col("far") <= THETA + _EPS + F.col("radius")).withColumn("at_pivot", F.lit(True))), "visits")
        self.linked = apart.where(F.col("far") <= THETA + _EPS).select("a", "b").unionAll(visits.where(~F.col("at_pivot") & (F.col("far") <= THETA + _EPS)).select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        self.whole = visits.where(F.col("far") + F.col("radius") <= THETA + _EPS).select("key", F.col("pivot").alias("region"))

        # what distances to pivots don't settle, in cells
        unsettled = visits.where(F.col("far") + F.col("radius") > THETA + _EPS).select("key", "pivot", "far")
        parts = lambda n: F.ceil(n / CELL).cast("int")
        shape = unsettled.groupBy("pivot").agg(F.count("*").alias("guests")).join(regions, "pivot").select("pivot", parts(F.col("size")).alias("rows"), parts(F.col("guests")).alias("columns"))
        spread = lambda own, other: (F.pmod(F.xxhash64("key"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        mine, every = spread("rows", "columns")
        at_home = homes.join(shape, "pivot").select("pivot", mine.alias("row"), every.alias("column"), "key", "far", F.lit(True).alias("at_home"))
        mine, every = spread("columns", "rows")
        guests = unsettled.join(shape, "pivot").select("pivot", every.alias("row"), mine.alias("column"), "key", "far", F.lit(False).alias("at_home")).select("pivot", "row", "column", "key", "far", "at_home")
        cells = materialise(at_home.unionAll(guests), "cells")
        cells = cells.join(_needed(stored, cells.select("key").distinct()), "key")
        self.met = materialise(cells.groupBy("pivot", "row", "column").applyInArrow(_join_cell, "home long, guest long, region long"), "met")

    def edges(self) -> DataFrame:
        """Pairs of keys (a, b) that connect what is similar, without all pairs of a region."""
        return self.homes.select(F.col("key").alias("a"), F.col("pivot").alias("b")).unionAll(self.linked).unionAll(self.whole.select("key", "region")).unionAll(self.met.select("guest", "region").distinct())

    def links(self) -> DataFrame:
        """key and the number of documents of other keys that those of the key are similar to, where there are any."""
        n = self.classes.select("key", "n")
        weigh = lambda pairs, other: pairs.join(n.withColumnRenamed("key", other), other)
        inside = self.homes.select("key", "pivot").unionAll(self.regions.select(F.col("pivot").alias("key"), "pivot")).join(n, "key")
        total = inside.groupBy("pivot").agg(F.sum("n").alias("total"))
        parts = [inside.join(total, "pivot").select("key", (F.col("total") - F.col("n")).alias("links"))]
        for pairs, a, b in ((self.linked, "a", "b"), (self.linked, "b", "a"), (self.met, "home", "guest"), (self.met, "guest", "home")):
            parts.append(weigh(pairs.select(a, b), b).select(F.col(a).alias("key"), F.col("n").alias("links")))
        # sets that are similar to all at home in a region, but for its pivot, with which they are linked
        homes = self.homes.join(n, "key").select("key", F.col("pivot").alias("region"), "n")
        parts.append(self.whole.join(homes.groupBy("region").agg(F.sum("n").alias("links")), "region").select("key", "links"))
        guests = self.whole.join(n, "key").groupBy("region").agg(F.sum("n").alias("links"))
        parts.append(homes.join(guests, "region").select("key", "links"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out.groupBy("key").agg(F.sum("links").alias("links"))

    def groups(self) -> DataFrame:
        """(key, group): the least key that each key with a similar one is connected to."""
        return components(materialise(self.edges(), "edges"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, links of each document: the class it is in, and how many other documents have a set of word pairs
    whose Jaccard similarity with its own is T or more. similar_pairs() tells which.

    A class holds what is connected by such similarity; its id is the least document id in it. Alone in its class, a
    document has its own id for it and no links. A document of one word has that word for a set; null, empty and
    wordless texts have no set and are alone. Rows with equal id and set are one document. Null ids stay null and
    are a class's id only if it has no other. Other columns are ignored; an empty table gives no rows. Texts
    are read whole.
    """
    joined = Joined(docs)
    group = joined.groups()
    several = joined.classes.select("key", "n", "least").join(group, "key", "left").join(joined.links(), "key", "left").where("n > 1 OR group IS NOT NULL")
    several = several.select("key", "least", F.coalesce("group", "key").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    several = materialise(several, "several")
    named = several.join(several.groupBy("group").agg(F.min("least").alias("class_id")), "group").select("key", "class_id", "links", F.lit(True).alias("many"))
    rows = joined.sets.select("key", "doc_id").distinct().join(named, "key", "left")
    return rows.select("doc_id", F.when(F.col("many"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def similar_pairs(docs: DataFrame) -> DataFrame:
    """doc_a <= doc_b: all pairs of different documents that similar_documents() counts, which may be as many as the square
    of a group's size; cases as there, a null id standing first."""
    joined = Joined(docs)
    members = joined.sets.where("key != 0").select("key", "doc_id").distinct()
    inside = joined.homes.select("key", "pivot").unionAll(joined.regions.select(F.col("pivot").alias("key"), "pivot"))
    x, y = inside.select(F.col("key").alias("a"), "pivot"), inside.select(F.col("key").alias("b"), "pivot")
    keys = x.join(y, "pivot").where("a < b").select("a", "b").unionAll(joined.linked).unionAll(joined.met.select("home", "guest"))
    keys = keys.unionAll(joined.whole.join(joined.homes.select(F.col("key").alias("b"), F.col("pivot").alias("region")), "region").select("key", "b"))
    keys = keys.unionAll(joined.classes.select(F.col("key").alias("a"), F.col("key").alias("b")))
    a, b = (members.select(F.col("key").alias(k), F.col("doc_id").alias(f"doc_{k}")) for k in "ab")
    pairs = keys.join(a, "a").join(b, "b").where("a != b OR NOT doc_a <=> doc_b")
    swap = F.coalesce(F.col("doc_a") > F.col("doc_b"), F.col("doc_b").isNull())
    pairs = pairs.select(F.when(swap, F.col("doc_b")).otherwise(F.col("doc_a")).alias("doc_a"), F.when(swap, F.col("doc_a")).otherwise(F.col("doc_b")).alias("doc_b"))
    return pairs.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(key, group): the least key that each key of `pairs` (a, b) is connected to.

    Each round gives a key the least group of its neighbours, then that group's own group, so that
    distances halve; each round's table is written, and there are about as many rounds as the logarithm of the
    longest chain.
    """
    edges = materialise(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("g")).select(F.col("a").alias("key"), F.col("g").alias("group")), "groups")
    while True:
        near = edges.join(state, edges["b"] == state["key"]).groupBy("a").agg(F.min("group").alias("near"))
        step = state.join(near, state["key"] == near["a"]).select("key", "group", F.least("group", "near").alias("least"))
        jump = state.select(F.col("key").alias("k2"), F.col("group").alias("g2"))
        new = materialise(step.join(jump, step["least"] == jump["k2"], "left").select("key", F.least("least", F.coalesce("g2", "least")).alias("new"), (F.least("least", F.coalesce("g2", "least")) != F.col("group")).alias("moved")), "groups")
        if new.where("moved").isEmpty():
            return state
        state = new.select("key", F.col("new").alias("group"))


def _with_keys(files: list[str], n: int, names: list[str], hit: bool, text: int):
    chosen = tuple(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _read_filter(chosen, n)
        for batch in batches:
            keys = [k for *_, k, _ in _sets(batch.column(text))]
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            maybe = key != 0
            for p in _bits(key, n):
                maybe &= ((field[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            rest = batch.columns[: len(names)]
            rows = pa.RecordBatch.from_arrays([pa.array(key), *rest] if hit else rest, names=["_key", *names] if hit else names)
            yield rows.filter(pa.array(maybe if hit else ~maybe))

    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of `docs` without all but one of each group of similar documents; the least id stays.

    Groups are connected: a document is in the group of any that it is similar to. Equal rows are one group,
    of which one row stays. A row without words (null, empty, signs only) has no group and stays. Ids that are
    null come after others; among rows of the least id, the least text stays. Only rows that may be in a group
    of several are shuffled.
    """
    spark = docs.sparkSession
    joined = Joined(docs)
    # rows that repeat a document count here
    grouped = joined.sets.where("key != 0").groupBy("key").agg(F.count("*").alias("n")).join(joined.groups(), "key", "left")
    several = materialise(grouped.where("n > 1 OR group IS NOT NULL").select("key", F.coalesce("group", "key").alias("group")), "several")
    files, n = key_filter(several.select("key"))
    names = docs.columns
    rows, text = carried_text(docs)
    inner = S.StructType([S.StructField("_key", S.LongType()), *[S.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]])
    alone = rows.mapInArrow(lean(_with_keys(files, n, names, False, text)), docs.schema)
    maybe = rows.mapInArrow(lean(_with_keys(files, n, [f"c{i}" for i in range(len(names))], True, text)), inner)
    maybe = maybe.join(several, maybe["_key"] == several["key"], "left")
    chosen = F.struct(F.col(f"c{names.index('doc_id')}").isNull(), f"c{names.index('doc_id')}", f"c{names.index('text')}", "_tie")
    maybe = maybe.withColumn("_tie", F.monotonically_increasing_id())
    lead = Window.partitionBy("group").orderBy(chosen)
    kept = maybe.where("group IS NOT NULL").withColumn("_nth", F.row_number().over(lead)).where("_nth = 1")
    alone = alone.unionAll(maybe.where("group IS NULL").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]))
    return alone.unionAll(kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
