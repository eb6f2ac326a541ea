"""Operator 1: finds licence notices and texts in documents.

Templates are short notices and longer licence texts. Documents are cut into overlapping windows, for
each class of template lengths of a size that holds any template of the class whole. A window retrieves
the templates with which it shares a band of min-hashes; exact containment of the template's shingles
in the window then decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import textkit
from quadloom.llm.common import lean, prepare, table

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_FREE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: (licence, text). Several texts may stand for one licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD", _BSD),
    ("BSD", "Released under the BSD License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL),
    ("MPL-2.0", _MPL),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", _FREE),
    ("proprietary", "All rights reserved."),
)
SHINGLE_WORDS = 2
#: Share of a template's shingles that a window must hold.
CONTAINMENT = 0.8
#: Min-hashes; the bands are all their pairs, so two equal min-hashes retrieve.
HASHES = 16
#: Beyond so many templates the work is done in several passes over the documents, each with a part of them.
TEMPLATES_A_PASS = 2_000


def collision_probability(jaccard: float, hashes: int = HASHES) -> float:
    """How likely a window and a template of this similarity share a band."""
    return 1 - (1 - jaccard) ** hashes - hashes * jaccard * (1 - jaccard) ** (hashes - 1)


@dataclass(frozen=True)
class _Class:
    window: int
    stride: int
    number: np.ndarray  # of each template
    sets: tuple  # sorted shingles of each
    mins: np.ndarray  # templates x hashes


def _mins(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([[textkit.mix(s, k + 1).min() for k in range(HASHES)] for s in sets], np.uint64)


def _classes(texts: list[str]) -> list[_Class]:
    """Templates by length, each class a quarter wider than the one before; windows overlap by the longest."""
    column = textkit.text(pa.array(texts, pa.string()))
    h, doc, _ = textkit.shingles(textkit.Words(column), SHINGLE_WORDS)
    sets = {d: np.unique(h[doc == d]) for d in range(len(texts))}
    size = {d: int((doc == d).sum()) for d in sets}
    out, left = [], sorted((n, d) for d, n in size.items() if n)
    while left:
        group = [(n, d) for n, d in left if n <= max(left[0][0] + 1, left[0][0] * 1.25)]
        left = left[len(group) :]
        longest = group[-1][0]
        stride = max(1, longest // 4)
        of = [d for _, d in group]
        out.append(_Class(longest + stride, stride, np.array(of), tuple(sets[d] for d in of), _mins([sets[d] for d in of])))
    return out


def _window_mins(value: np.ndarray, window: int, stride: int) -> np.ndarray:
    """Least value of each window; windows begin at multiples of the stride and may run off the end."""
    blocks = np.minimum.reduceat(value, np.arange(0, len(value), stride))
    steps = -(-window // stride)
    padded = np.concatenate([blocks, np.full(steps - 1, np.iinfo(np.uint64).max, np.uint64)])
    out = padded[: len(blocks)].copy()
    for j in range(1, steps):
        np.minimum(out, padded[j : j + len(blocks)], out=out)
    return out


def _scan(column: pa.Array, classes: list[_Class]) -> list[tuple[int, int, float, int, int]]:
    """(document, template, containment, first word, words) of the best matches that don't overlap."""
    h, doc, pos = textkit.shingles(textkit.Words(column), SHINGLE_WORDS)
    if not len(h):
        return []
    order = np.argsort(doc, kind="stable") if np.any(doc[1:] < doc[:-1]) else slice(None)
    h, doc, pos = h[order], doc[order], pos[order]
    base = np.searchsorted(doc, np.arange(doc[-1] + 2))
    found: dict[int, list] = {}
    hits = [[[] for _ in c.number] for c in classes]
    for k in range(HASHES):
        value = textkit.mix(h, k + 1)
        for ci, c in enumerate(classes):
            least = _window_mins(value, c.window, c.stride)
            for t in range(len(c.number)):
                at = np.flatnonzero(least == c.mins[t, k])
                if len(at):
                    hits[ci][t].append(at)
    for ci, c in enumerate(classes):
        # windows end at a multiple of the stride at the earliest, so they reach at least as far as said
        reach = -(-c.window // c.stride) * c.stride
        for t, lists in enumerate(hits[ci]):
            if not lists:
                continue
            at, times = np.unique(np.concatenate(lists), return_counts=True)
            goal = c.sets[t]
            for w in at[times >= 2] * c.stride:
                # a window of the slice may touch several documents; each is looked at for itself
                end = min(w + reach, len(h))
                for d in range(doc[w], doc[end - 1] + 1):
                    a, b = max(w, base[d]), min(end, base[d + 1])
                    i = np.searchsorted(goal, h[a:b])
                    i[i == len(goal)] = 0
                    same = np.flatnonzero(goal[i] == h[a:b])
                    share = len(np.unique(i[same])) / len(goal)
                    if share >= CONTAINMENT:
                        found.setdefault(d, []).append((-share, -len(goal), int(c.number[t]), int(pos[a + same[0]]), int(pos[a + same[-1]])))
    out = []
    for d, matches in found.items():
        taken: list[tuple[int, int]] = []
        for share, _, t, a, b in sorted(set(matches)):
            if all(b + SHINGLE_WORDS <= x or y + SHINGLE_WORDS <= a for x, y in taken):
                taken.append((a, b))
                out.append((d, t, -share, a, b - a + SHINGLE_WORDS))
    return out


def _finder(templates: tuple, numbers: list[int]):
    classes = _classes([t for _, t in templates])
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("containment", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = textkit.text(batch.column(1)), batch.column(0)
            for a, b in textkit.slices(column):
                piece = column[a:b]
                rows = _scan(piece, classes)
                if not rows:
                    continue
                start = textkit.Words(piece, hashed=False).first
                rows.sort(key=lambda r: (r[0], r[3]))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": ids.take(pa.array([a + r[0] for r in rows])), "license": [templates[r[1]][0] for r in rows], "template": [numbers[r[1]] for r in rows], "containment": [r[2] for r in rows], "first_word": [r[3] - int(start[r[0]]) for r in rows], "n_words": [r[4] for r in rows]}, schema
                )

    return run


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each place in a document that holds a template: doc_id, license, template (its number),
    containment, first_word and n_words of the place.

    Of matches that overlap the one with most containment stays, then the longer, then the first template.
    Null and empty texts match nothing; a null id is kept in the rows of its document; repeated rows match
    each for itself; other columns are ignored; an empty table or no template gives no rows. A template without
    words is never found. Texts are scanned whole. Templates beyond TEMPLATES_A_PASS take a pass each so many,
    and matches are then chosen within a pass only.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, license string, template int, containment double, first_word long, n_words long"
    passes = [list(range(i, min(i + TEMPLATES_A_PASS, len(templates)))) for i in range(0, len(templates), TEMPLATES_A_PASS)] or [[]]
    out = None
    for part in passes:
        one = rows.mapInArrow(lean(_finder(tuple(templates[i] for i in part), part)), schema)
        out = one if out is None else out.unionAll(one)
    return out


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
