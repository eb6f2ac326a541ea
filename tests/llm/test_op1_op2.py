"""Licence scan and decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import make, prose, words

from quadloom.llm import decontaminate, licenses, textkit


def _shingles(w):
    return {tuple(w[i : i + licenses.SHINGLE_WORDS]) for i in range(max(1, len(w) - licenses.SHINGLE_WORDS + 1))} if w else set()


def _best(doc, template):
    """Greatest containment of a template in any window of the words it may spread over."""
    goal, w = _shingles(words(template)), words(doc)
    n = len(words(template)) + 2
    return max((len(goal & _shingles(w[i : i + n])) / len(goal) for i in range(max(1, len(w) - n + 1))), default=0.0)


def test_licenses_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {(r["doc_id"], r["license"]) for r in licenses.license_scan(docs).collect()}
    short = [(lic, t) for lic, t in licenses.TEMPLATES]
    sure = set()
    for r in docs.select("doc_id", "text").collect():
        for lic, t in short:
            if set(words(t)) <= set(words(r["text"])) and _best(r["text"], t) == 1:
                sure.add((r["doc_id"], lic))
    sure_docs, found_docs = {d for d, _ in sure}, {d for d, _ in found}
    assert sure_docs and len(sure_docs & found_docs) >= 0.9 * len(sure_docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in licenses.license_scan(docs).collect():
        assert licenses.CONTAINMENT <= r["containment"] <= 1
        near = words(texts[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words"]]
        assert len(_shingles(near) & _shingles(words(licenses.TEMPLATES[r["template"]][1]))) / len(_shingles(words(licenses.TEMPLATES[r["template"]][1]))) >= licenses.CONTAINMENT - 1e-9


def test_planted_licenses_are_found_with_changes(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for i, (lic, t) in enumerate(licenses.TEMPLATES):
        w = t.split()
        if len(w) > 40:
            for _ in range(len(w) // 40):
                w[rng.randrange(len(w))] = "changed"
        rows.append((i, prose(i, rng.randint(0, 900)) + " " + " ".join(w) + " " + prose(i + 99, rng.randint(0, 900))))
        want.add((i, lic))
    rows += [(1000 + i, prose(500 + i, 2000)) for i in range(20)]
    got = {(r["doc_id"], r["license"]) for r in licenses.license_scan(make(spark, rows)).collect()}
    assert len(want & got) >= 0.95 * len(want) and not {d for d, _ in got if d >= 1000}


def test_bands_collide():
    assert licenses.collision_probability(0.8) > 0.999 and licenses.collision_probability(0.5) > 0.99


def test_licenses_odd(spark, odd, nothing):
    assert licenses.license_scan(nothing).count() == 0 and licenses.license_scan(odd).count() == 0
    assert licenses.license_scan(odd, ()).count() == 0
    twice = make(spark, [(None, "All rights reserved."), (3, "All rights reserved."), (3, "All rights reserved."), (4, "x All rights reserved. y All rights reserved.")])
    rows = licenses.license_scan(twice).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 3), (False, 3), (False, 4), (False, 4), (True, 0)]


def test_contamination_against_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(docs, items).collect()}
    texts, want = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    hashed = {d: decontaminate._words_of([t or ""])[0] for d, t in texts.items()}
    for r in items.collect():
        item = decontaminate._words_of([r["text"] or ""])[0]
        if len(item) < decontaminate.LEAST_WORDS:
            continue
        for d, h in hashed.items():
            if len(h):
                e = int(decontaminate.edit_distance_within(item, h[None, :])[0][0])
                if e <= int(decontaminate.EDITS * len(item)):
                    want[d, r["item_id"]] = e
    assert want and set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(want[k] == e for k, e in got.items())


def test_contamination_with_edits(spark):
    rng = random.Random(3)
    items = [(i, prose(100 + i, n)) for i, n in enumerate([8, 12, 20, 33, 50, 64, 90, 150, 300] * 4)]
    docs, want = [], set()
    for i, (k, t) in enumerate(items):
        w = t.split()
        for _ in range(int(0.1 * len(w))):
            at, how = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + 1] = [["new"], [], [w[at], "more"]][how]
        docs.append((i, prose(50_000 + i, rng.randint(0, 500)) + " " + " ".join(w) + " " + prose(70_000 + i, rng.randint(0, 500))))
        want.add((i, k))
    clean = [(1000 + i, prose(9000 + i, 400)) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(make(spark, docs + clean), bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    kept = {r["doc_id"] for r in decontaminate.decontaminate(make(spark, docs + clean), bench).collect()}
    assert kept == {d for d, _ in docs + clean} - {d for d, _ in got} and {d for d, _ in clean} <= kept


@pytest.mark.parametrize("share", [0.15, 0.2])
@pytest.mark.parametrize("length", [48, 96, 192, 400])
def test_candidates_with_many_edits(share, length):
    """Long items are found as surely as short ones, up to the edits that the operator promises."""
    rng = random.Random(length)
    items = [prose(20_000 + length + i, length) for i in range(40)]
    docs = []
    for i, t in enumerate(items):
        w = t.split()
        for _ in range(int(share * len(w))):
            at, how = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + 1] = [["new"], [], [w[at], "more"]][how]
        docs.append(" ".join([prose(30_000 + i, rng.randint(0, 200)), *w, prose(40_000 + i, 100)]))
    hashes = decontaminate._words_of(items)
    made = textkit.Words(textkit.text(pa.array(docs)))
    found = decontaminate._verify(made, hashes, decontaminate._candidates(made, decontaminate._indexes(hashes)))
    assert sum(d == i for d, i, _, _ in found) >= 0.9 * len(items)


def test_edit_distance():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 15))
        assert decontaminate.edit_distance_within(a.astype(np.uint64), b[None, :].astype(np.uint64))[0][0] == plain(list(a), list(b))


def test_contamination_odd(spark, odd, nothing):
    items = spark.createDataFrame([(1, prose(3, 200)), (1, prose(3, 200)), (2, None), (3, ""), (4, "word"), (None, prose(2, 300))], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"] or -1) for r in decontaminate.contaminated(odd, items).collect())
    assert got == [(-1, -1), (-1, 1), (5, 1), (5, 1), (6, 1)]
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    assert decontaminate.contaminated(nothing, items).count() == 0 and decontaminate.contaminated(odd, items.where("false")).count() == 0
    assert decontaminate.decontaminate(odd, items.where("false")).count() == odd.count()


@pytest.mark.parametrize("words_", [4, 7, 8, 50, 300])
def test_windows_fit_items(words_):
    w = decontaminate.window_for(words_)
    assert w <= words_ < 4 * w


def test_words_by_buffers():
    texts = ["Héllo, Wörld 42", "", "a-b_c", "杭州 x"]
    w = textkit.Words(textkit.text(pa.array(texts)))
    assert list(w.counts) == [len(words(t)) for t in texts]
