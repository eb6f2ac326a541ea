"""Whole-column text primitives in numpy: words, fingerprints, shingle sets, vocabulary codes.

All functions take Arrow string arrays and work on their byte buffers, so no Python object is made
per document or word. Columns are cut into slices of a few MB, which bounds the memory of a worker
whatever the size of a batch; a document is never cut, so one that is longer makes a longer slice.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20
#: A set element is a 48-bit fingerprint; 16 bits are left for the document within a slice.
FP_BITS = 48
FP_MASK = U64((1 << FP_BITS) - 1)
MAX_DOCS = 1 << 15

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_pow = _inv = np.ones(1, U64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x + U64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, n or more of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), SLICE_BYTES * 5 // 4)
        a, b = np.full(size, _P & (2**64 - 1), U64), np.full(size, _P_INV, U64)
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def text(column: pa.Array) -> pa.Array:
    """Nulls as empty strings, as one plain array with an own 64-bit offset buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the column and the document offsets into them, starting at 0."""
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about `most` bytes together."""
    _, off = buffers(column)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, "right")) - 1
        b = min(max(b, a + 1), n, a + MAX_DOCS)
        yield a, b
        a = b


class Words:
    """Words of a slice: 64-bit hash, document number, and where each document's words begin.

    A word is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII, in lower case.
    """

    __slots__ = ("ends", "first", "hash", "starts", "text")

    def __init__(self, column: pa.Array, lower: bool = True, hashed: bool = True) -> None:
        if lower:
            column = pc.utf8_lower(column)
        self.text = column
        raw, off = buffers(column)
        word = _WORD[raw]
        before = np.empty_like(word)
        before[1:], before[:1] = word[:-1], False
        inner = off[:-1][off[:-1] < len(raw)]
        before[inner] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[:-1], after[-1:] = word[1:], False
        inner = off[1:][off[1:] > 0] - 1
        after[inner] = False
        ends = np.flatnonzero(word & ~after) + 1
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, off)
        self.hash = None
        if hashed:
            up, down = powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, U64)
            np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
            self.hash = mix((total[ends] - total[starts]) * down[starts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and word position of every run of n words.

    A document of 1 to n-1 words has the one shingle of all its words; one without words has none.
    """
    h, total = words.hash, len(words.hash)
    doc = words.doc
    if total >= n:
        s = np.zeros(total - n + 1, U64)
        for j in range(n):
            s = (s ^ h[j : total - n + 1 + j]) * U64(0xFF51AFD7ED558CCD)
            s ^= s >> U64(29)
        pos = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
        out, where = mix(s[pos]), doc[pos]
    else:
        out, where, pos = np.zeros(0, U64), np.zeros(0, doc.dtype), np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i, d in enumerate(short):
            s = U64(len(h[words.first[d] : words.first[d + 1]]))
            for x in h[words.first[d] : words.first[d + 1]]:
                s = mix(np.array([s ^ x], U64))[0]
            extra[i] = s
        out, where, pos = np.concatenate([out, extra]), np.concatenate([where, short]), np.concatenate([pos, words.first[short]])
    return out, where, pos


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles of each document of a slice, ascending: (fingerprint, document)."""
    h, doc, _ = shingles(Words(column), n)
    key = np.sort((doc.astype(U64) << U64(FP_BITS)) | (h >> U64(64 - FP_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & FP_MASK, (key >> U64(FP_BITS)).astype(np.int64)


def chunks(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cuts documents into pieces at which the tokenisers' own pattern always cuts too.

    A cut is before a single space or line end between two bytes that are not white space, and after
    such a line end. No token of the pattern of textkit's tokenisers crosses such a place, so the
    tokens of a document are those of its pieces, one after another. Returns the pieces and the
    number of the first piece of each document.
    """
    raw, off = buffers(column)
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        solid = ~_SPACE[raw]
        follow = solid & ((raw < 0x80) | (raw >= 0xC3)) & ~((raw >= 0xE1) & (raw <= 0xE3))
        lone = np.zeros(n, bool)
        lone[1:-1] = solid[:-2] & follow[2:]
        space, line = lone & (raw == 32), lone & (raw == 10)
        cut[:-1] |= space | line
        cut[1:] |= line
    cut[off] = True
    edges = np.flatnonzero(cut)
    if not n:
        edges = np.zeros(1, np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces, np.searchsorted(edges, off)


class Encoder:
    """Token ids by pieces: each distinct piece goes to the tokeniser once per task and is then looked up.

    The table of known pieces is bounded; it is emptied when full, which costs time but never changes ids.
    """

    _all: weakref.WeakSet[Encoder] = weakref.WeakSet()

    def __init__(self, encode: Callable[[list[str]], list], dtype: type, most: int = 300_000) -> None:
        self.encode, self.dtype, self.most, self.known = encode, np.dtype(dtype), most, {}
        Encoder._all.add(self)

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of ids of each piece."""
        if not len(pieces):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > self.most:
            self.known.clear()
        new = [x for x in names if x not in self.known]
        if new:
            for x, t in zip(new, self.encode([x.decode("utf-8", "replace") if isinstance(x, bytes) else x for x in new]), strict=True):
                self.known[x] = np.asarray(t, self.dtype).tobytes()
        parts = [self.known[x] for x in names]
        flat = np.frombuffer(b"".join(parts), self.dtype)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        each = size[codes]
        return flat[ragged(start[codes], each)], each


def forget() -> None:
    """Empties the tables that a task filled. A stage may leave idle workers beside those of the next, each with its own."""
    global _pow, _inv
    _pow = _inv = np.ones(1, U64)
    for x in Encoder._all:
        x.known = {}


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i]+size[i]-1 for all i, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)
