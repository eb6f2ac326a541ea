"""The Jaccard join and the shared passages against brute force."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
from conftest_llm import make, prose, words
from pyspark.sql import functions as F

from quadloom.llm import ngram_join, passages, textkit
from quadloom.llm.common import materialise
from quadloom.llm.pairing import document_key, with_texts


def _set(text):
    w = words(text)
    n = ngram_join.WORDS
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def _all_pairs(rows):
    """Similarity of all pairs of documents (a < b) that reach T."""
    sets = [(i, _set(t)) for i, t in rows]
    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    common = {}
    for ks in by.values():
        for a, b in itertools.combinations(ks, 2):
            common[a, b] = common.get((a, b), 0) + 1
    out = {}
    for (a, b), c in common.items():
        s = c / (len(sets[a][1]) + len(sets[b][1]) - c)
        if s >= ngram_join.T and sets[a][0] != sets[b][0]:
            out[tuple(sorted((sets[a][0], sets[b][0])))] = s
    return out


def _groups(ids, pairs):
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def _edited(text, share, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(int(share * len(w))):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def _corpus():
    rows = [(i, prose(i, 40 + 7 * i % 300)) for i in range(150)]
    n = 1000
    for k, (size, share) in enumerate(((60, 0.03), (40, 0.1), (5, 0.0), (25, 0.15), (2, 0.05), (3, 0.2))):
        text = prose(7000 + k, 120 + 60 * k)
        for j in range(size):
            rows.append((n, _edited(text, share * j / size, n)))
            n += 1
    return rows


def _check(rows, docs):
    """All pairs are told and no others; classes are what they connect; links are their numbers."""
    want = set(_all_pairs(rows))
    got = {(r["doc_a"], r["doc_b"]) for r in ngram_join.similar_pairs(docs).collect()}
    assert got == want
    group = _groups([i for i, _ in rows], want)
    links = dict.fromkeys(group, 0)
    for pair in want:
        for i in pair:
            links[i] += 1
    assert sorted(map(tuple, ngram_join.similar_documents(docs).collect())) == sorted((i, group[i], links[i]) for i in group)


def test_join_against_brute_force(spark):
    rows = _corpus()
    _check(rows, make(spark, rows))


def test_join_over_the_small_table(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    _check([(r["doc_id"], r["text"] or "") for r in docs.collect()], docs)


def test_near_copies_are_at_home_in_regions(spark):
    joined = ngram_join.Joined(make(spark, _corpus()))
    # of the copies a part has so few words changed that it is within the radius of its pivot
    assert joined.homes.count() + joined.regions.count() > 40 and joined.met.count() + joined.whole.count() > 0


def test_small_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 3)
    rows = _corpus()
    _check(rows, make(spark, rows))


def test_without_regions(spark, monkeypatch):
    """With a radius that no copy reaches, every set is its own pivot."""
    monkeypatch.setattr(ngram_join, "RADIUS", -1.0)
    monkeypatch.setattr(ngram_join, "LEVELS", (0.6, 0.6, 0.6))
    rows = _corpus()
    _check(rows, make(spark, rows))


def test_regions_divide_exactly():
    rng = np.random.default_rng(4)
    base = [np.sort(rng.choice(5000, 60, replace=False)) for _ in range(6)]
    sets = []
    for _ in range(700):
        s = set(base[rng.integers(6)].tolist())
        s -= set(rng.choice(sorted(s), rng.integers(0, 25), replace=False).tolist())
        sets.append(np.array(sorted(s | set(rng.integers(0, 5000, rng.integers(0, 8)).tolist())), np.uint64))
    home, guest = np.arange(500), np.arange(500, 700)
    got = ngram_join.join_region(sets, home, guest)
    want = set()
    for i in home:
        for j in guest:
            c = len(np.intersect1d(sets[i], sets[j]))
            if c / (len(sets[i]) + len(sets[j]) - c) >= ngram_join.T - 1e-9:
                want.add((i, j))
    assert set(got) == want and len(want) > 1000 and len(got) == len(want)


def test_prefixes_share_enough():
    """Two sets of similarity T or more have as many n-grams of their prefixes in common as is asked for."""
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = rng.choice(100_000, n, replace=False)
        keep = x[: max(1, int(n * rng.uniform(0.2, 1)))]
        y = np.concatenate([keep, rng.choice(np.arange(100_000, 200_000), int(rng.integers(0, n // 3 + 1)), replace=False)])
        c = len(keep)
        for least in ngram_join.LEVELS:
            if c / (len(x) + len(y) - c) >= least:
                cut = [np.sort(s)[: int(ngram_join._prefix(np.array([len(s)]), least)[0])] for s in (x, y)]
                assert len(np.intersect1d(*cut)) >= ngram_join.prefix_matches(np.array([min(len(x), len(y))]), least)[0]


def test_places_leave_enough_to_count():
    """Of two sets of similarity T or more as many n-grams count, at whatever places they are, as are asked for."""
    rng = np.random.default_rng(9)
    for _ in range(600):
        n = int(rng.integers(1, 900))
        x = rng.choice(100_000, n, replace=False)
        keep = x[: max(1, int(n * rng.uniform(0.2, 1)))]
        y = np.concatenate([keep, rng.integers(0, 100_000 if rng.random() < 0.5 else 100, int(rng.integers(0, n // 3 + 1)))])
        x, y = np.unique(x), np.unique(y)
        both = np.intersect1d(x, y)
        for least in ngram_join.LEVELS:
            if len(both) / (len(x) + len(y) - len(both)) >= least:
                size = [np.full(len(both), len(s)) for s in (x, y)]
                at = [np.searchsorted(s, both) * ngram_join._PLACES // len(s) for s in (x, y)]
                need = ngram_join.prefix_matches(np.minimum(*size), least)
                posted = [np.searchsorted(s, both) < ngram_join._prefix(np.array([len(s)]), least)[0] for s in (x, y)]
                ok = ngram_join.counts_for(size[0], at[0], size[1], at[1], np.full(len(both), least), need)
                assert (ok & posted[0] & posted[1]).sum() >= need[0]


def _entries(sets):
    """What the index's task of the only shard is given of sets (in the order of n-grams)."""
    rows = [[], [], [], [], []]
    for key, s in enumerate(sets, 1):
        s = s[: int(ngram_join._prefix(np.array([len(s)]), ngram_join.T)[0])], len(s)
        for to, v in zip(rows, (s[0], np.full(len(s[0]), key), np.full(len(s[0]), s[1]), np.zeros(len(s[0])), np.arange(len(s[0])) * ngram_join._PLACES // s[1]), strict=True):
            to.append(v)
    data = [np.concatenate(r).astype(t).tobytes() for r, t in zip(rows, ("<u4", "<i8", "<u2", "u1", "u1"), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], schema=ngram_join._POSTING)


def test_pairs_are_sent_in_pieces_of_bounded_size(monkeypatch):
    """However many pairs a task of the index has, it holds and sends a bounded number at once, and all are added up."""
    monkeypatch.setattr(ngram_join, "_PAIRS_STEP", 500)
    monkeypatch.setattr(ngram_join, "_PAIRS_HELD", 1000)
    monkeypatch.setattr(ngram_join, "_PAIRS_SENT", 1000)
    rng = np.random.default_rng(3)
    base = np.sort(rng.choice(10_000, 60, replace=False))
    sets = [np.unique(np.concatenate([rng.choice(base, 55, replace=False), rng.choice(10_000, 5)])) for _ in range(120)]
    sent = list(ngram_join._pair_up(1)(iter([_entries(sets)])))
    size = [sum(len(x) // 8 for x in b.column(2).to_pylist()) for b in sent]
    assert len(sent) > 3 and max(size) < 4000
    rows = pa.Table.from_batches(sent).sort_by("sub")
    got = {p for b in ngram_join._enough(iter(rows.to_batches())) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)}
    want = {(i + 1, j + 1) for i, j in itertools.combinations(range(120), 2) if len(c := np.intersect1d(sets[i], sets[j])) / (len(sets[i]) + len(sets[j]) - len(c)) >= ngram_join.T}
    assert len(want) > 1000 and want <= got


def test_one_of_each(spark):
    rows = [*_corpus(), (5000, ""), (5001, "?!"), (5002, "word"), (5003, "word")]
    docs = make(spark, rows)
    kept = ngram_join.one_of_each(docs)
    group = _groups([i for i, _ in rows], _all_pairs(rows))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, g in group.items() if i == g)


def test_join_odd(spark, odd, nothing):
    pairs = {(r["doc_a"], r["doc_b"]) for r in ngram_join.similar_pairs(odd).collect()}
    assert pairs == {(5, 6), (None, 5), (None, 6), (7, 8)}
    rows = [tuple(r) for r in ngram_join.similar_documents(odd).collect()]
    # the documents without id are a wordless one, one on its own, and one in the class of 5
    assert sorted(rows, key=str) == sorted([*((i, i, 0) for i in (1, 2, 3, 4, 9, 10)), (5, 5, 2), (6, 5, 2), (None, 5, 2), (7, 7, 1), (8, 7, 1), (None, None, 0), (None, None, 0)], key=str)
    kept = ngram_join.one_of_each(odd).collect()
    # nulls, blank and wordless rows stay; of documents 5, 5, 6 and one without id the first stays, of 7 and 8 the first
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 9, 10)] + [(True, 0)] * 3
    assert ngram_join.similar_documents(nothing).count() == ngram_join.similar_pairs(nothing).count() == ngram_join.one_of_each(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1002), (1001, 1002)], "a long, b long")
    got = {r["key"]: r["group"] for r in ngram_join.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == got[1002] == 1000


# --- operator 10 ---------------------------------------------------------------------------------------


def _tree(value, least):
    """Windows by definition: for each token the longest run around it in which it is the least, the first of equals."""
    out = set()
    for c, v in enumerate(value):
        if v == 0:
            continue
        a = c
        while a > 0 and value[a - 1] > v and value[a - 1] != 0:
            a -= 1
        z = c
        while z + 1 < len(value) and value[z + 1] >= v and value[z + 1] != 0:
            z += 1
        if z - a + 1 >= least:
            out.add((c, a, z))
    return out


def test_compact_windows_against_the_definition():
    rng = np.random.default_rng(2)
    for _ in range(300):
        value = rng.integers(1, rng.integers(2, 200), rng.integers(0, 120)).astype(np.uint64)
        if rng.random() < 0.5 and len(value):
            value[rng.integers(0, len(value), rng.integers(0, 4))] = 0
        least = int(rng.integers(1, 40))
        got = passages.compact_windows(value, least)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == _tree(value.tolist(), least)


def _planted():
    rng, rows, members = random.Random(6), [], {}
    for p in range(12):
        text = prose(300 + p, rng.choice([60, 80, 150, 400]))
        for _ in range(rng.choice([2, 3, 8, 30])):
            d = len(rows)
            body = _edited(text, rng.choice([0, 0, 0.02]), d)
            rows.append((d, prose(8000 + 2 * d, rng.randint(0, 300)) + " " + body + " " + prose(8001 + 2 * d, rng.randint(0, 300))))
            members.setdefault(p, []).append(d)
    rows += [(2000 + i, prose(60_000 + i, 300)) for i in range(60)]
    return rows, members


def _rows(df):
    """Rows as pairs with the lesser key first; each has its counterpart."""
    rows = [(r["doc_id"], r["other"]["doc_id"], *r["passage"], r["other"]["first"], r["other"]["end"], r["alike"]) for r in df.collect()]
    assert {(b, a, *y, *x, s) for a, b, *p, s in rows for x, y in [(p[:2], p[2:])]} == set(rows)
    return rows


def test_planted_passages_are_connected(spark):
    rows, members = _planted()
    found = _rows(passages.shared_passages(make(spark, rows)))
    texts = {i: words(t) for i, t in rows}
    for x, y, first_a, end_a, first_b, end_b, alike in found:
        a, b = texts[x][first_a:end_a], texts[y][first_b:end_b]
        assert min(len(a), len(b)) >= passages.LEAST_WORDS and alike >= passages.ALIKE
        assert len(set(a) & set(b)) >= 0.7 * len(set(a))
    assert not any(i >= 2000 for r in found for i in r[:2])
    group = _groups([i for i, _ in rows], [tuple(sorted(r[:2])) for r in found])
    good = total = 0
    for ds in members.values():
        roots = [group[d] for d in ds]
        good += max(roots.count(x) for x in roots)
        total += len(ds)
    assert good >= 0.95 * total


def test_passages_over_the_small_table(spark, sf):
    """By brute force over all runs: each pair of documents with a run of 55 words in common is told, each such word lies in a passage."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    n, seen, size = 55, {}, {}
    for r in docs.collect():
        w = words(r["text"])
        size[r["doc_id"]] = len(w)
        for i in range(len(w) - n + 1):
            seen.setdefault(hash(tuple(w[i : i + n])), set()).add((r["doc_id"], i))
    want, places = set(), {}
    for at in seen.values():
        for x, y in itertools.combinations(sorted({d for d, _ in at}), 2):
            want.add((x, y))
        if len({d for d, _ in at}) > 1:
            for d, i in at:
                places.setdefault(d, set()).update(range(i, i + n))
    found = passages.shared_passages(docs).cache()
    pairs = {(r["doc_a"], r["doc_b"]) for r in passages.through_others(found).collect()}
    assert len(want) > 100 and want <= pairs
    covered = {}
    for r in _rows(found):
        covered.setdefault(r[0], set()).update(range(r[2], r[3]))
    for d, at in places.items():
        assert len(at - covered.get(d, set())) <= 0.02 * len(at)
    rows = _rows(found)
    for r in rows:
        for o in rows:
            assert r is o or r[:2] != o[:2] or not (o[2] <= r[2] and r[3] <= o[3] and o[4] <= r[4] and r[5] <= o[5])


def _covered(spark, rows):
    """By document the words that lie in reported passages."""
    out = {}
    for d, _, first, end, *_ in _rows(passages.shared_passages(make(spark, rows))):
        out.setdefault(d, set()).update(range(first, end))
    return out


def test_long_near_copies_and_passages_of_long_documents(spark):
    """Common runs that lie elsewhere by chance take nothing from a passage."""
    rows = []
    for k, n in enumerate((5000, 8000, 20_000)):
        w = prose(400 + k, n).split()
        for at in range(0, n // 2, 700):  # phrases that come again further on
            w[n - 600 - at // 8 : n - 597 - at // 8] = w[at : at + 3]
        text = " ".join(w)
        rows += [(10 * k, text), (10 * k + 1, _edited(text, 0.03, k))]
    shared = prose(450, 200)
    rows += [(100, f"{prose(451, 6000)} {shared} {prose(452, 3000)}"), (101, f"{prose(453, 500)} {shared} {prose(454, 9000)}")]
    got, size = _covered(spark, rows), {i: len(words(t)) for i, t in rows}
    for i, _ in rows[:-2]:
        assert len(got.get(i, ())) >= 0.95 * size[i]
    assert got[100] >= set(range(6000, 6200)) and got[101] >= set(range(500, 700))


def test_passages_that_repeat_within_a_document(spark):
    """Each copy is reported, at whatever shift it lies."""
    rows, want = [], {}
    for k in range(12):
        text = prose(500 + k, 60 + 5 * k)
        n = 60 + 5 * k
        rows.append((2 * k, f"{prose(600 + k, 100)} {text} {prose(620 + k, 30 * (k % 3))} {text} {prose(640 + k, 50)} {text}"))
        rows.append((2 * k + 1, f"{text} {text} {prose(660 + k, 80)}" if k % 2 else f"{prose(680 + k, 40)} {text}"))
        second = 100 + n + 30 * (k % 3)
        want[2 * k] = {x for at in (100, second, second + n + 50) for x in range(at, at + n)}
        want[2 * k + 1] = set(range(2 * n)) if k % 2 else set(range(40, 40 + n))
    got = _covered(spark, rows)
    for i, places in want.items():
        assert got.get(i, set()) >= places


def test_edited_passages_are_linked():
    """Of pairs of documents that share a passage with words replaced, left out and put in, hardly any has no link."""
    rng, texts = random.Random(5), []
    for k in range(500):
        w, v = prose(100 + k, rng.choice([52, 60, 80, 150])).split(), []
        share = rng.choice([0.06, 0.1, 0.13, 0.16])
        for x in w:
            r = rng.random()
            v += [f"n{rng.randrange(10**6)}"] if r < 0.6 * share else [] if r < 0.8 * share else [x, f"n{rng.randrange(10**6)}"] if r < share else [x]
        texts += [f"{prose(9000 + 20_000 * i + k, 80)} {' '.join(x)} {prose(19_000 + 20_000 * i + k, 80)}" for i, x in enumerate((w, v))]
    alike = {k for k, _ in passages.alike_passages(*(textkit.Words(textkit.text(pa.array(texts[i::2]))) for i in range(2)))}
    links = set()
    for out in passages._windows(1)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])])):
        for a, b, sides in zip(*(out.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if not sides:
                links |= {tuple(sorted(x)) for x in zip(*(np.frombuffer(y, "<i8").tolist() for y in (a, b)), strict=True)}
    missed = [k for k in alike if (2 * k, 2 * k + 1) not in links]
    assert len(alike) > 400 and len(missed) <= 0.01 * len(alike)


def test_passages_odd(spark, odd, nothing):
    rows = _rows(passages.shared_passages(odd))
    assert {r[:2] for r in rows} <= {(a, b) for a in (5, 6, None) for b in (5, 6, None) if a != b}
    assert {r[0] for r in rows} == {5, 6, None}
    assert passages.shared_passages(nothing).count() == 0


def test_shingles_are_those_of_plain_words():
    texts = ["a b a b c", "x", "", "Ä ö, Ä"]
    fp, doc = textkit.shingle_sets(textkit.text(pa.array(texts)), 2)
    assert [int((doc == i).sum()) for i in range(4)] == [len(_set(t)) for t in texts]


def test_the_shorter_text_of_linked_documents_travels(spark):
    passage = prose(60_001, 80)
    docs = make(spark, [(i, prose(61_000 + i, 150 * (1 << i % 4)) + " " + passage, "en") for i in range(32)])
    keyed = docs.select(document_key().alias("key"), "doc_id", "text")
    size = {r["key"]: len(r["text"]) for r in keyed.collect()}
    assert len(size) == 32
    ordered = [size[k] for k in sorted(size)]
    assert all(x <= 1.6 * y for i, x in enumerate(ordered) for y in ordered[i:])
    keys = sorted(size)
    pairs = spark.createDataFrame([(keys[0], k) for k in keys[1:]], "a long, b long")
    both = with_texts(keyed, pairs).select("a", "b", "text_a", "text_b").collect()
    assert sorted((r["a"], r["b"]) for r in both) == [(keys[0], k) for k in keys[1:]]
    assert all((len(r["text_a"]), len(r["text_b"])) == (size[r["a"]], size[r["b"]]) for r in both)
    rows = passages.shared_passages(docs).collect()
    assert {r["doc_id"] for r in rows} == set(range(32))


def test_sets_are_stored_small():
    column = textkit.text(pa.array([prose(62_000, 400), "", "word", "杭州西湖 " * 3 + "。".join(chr(0x4E00 + i * 37 % 8000) for i in range(500)), prose(62_001, 5)]))
    sets = [textkit.shingle_sets(column[i : i + 1], ngram_join.WORDS)[0] for i in range(len(column))]
    stored = [ngram_join._packed(s, column[i].as_buffer().to_pybytes()) for i, s in enumerate(sets)]
    assert len(stored[0]) < 5 * len(sets[0]) and all(len(x) <= 1 + 6 * len(s) for x, s in zip(stored, sets, strict=True))
    back = ngram_join._unpacked(pa.array([*stored, None], pa.binary()))
    assert back.pop() is None and all((x == y).all() and len(x) == len(y) for x, y in zip(back, sets, strict=True))


def test_what_a_table_was_shuffled_for_is_removed(spark):
    def files():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length()

    before = files()
    table = materialise(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and {r["k"]: r["count"] for r in table.collect()} == dict.fromkeys(range(10), 100)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_equal_texts_of_pairs_are_taken_apart_once_and_stretches_are_all_found(monkeypatch):
    passage = prose(5, 80)
    hub = f"{prose(6, 60)} {passage} {prose(7, 40)}"
    others = [f"{prose(100 + i, 30 + i)} {passage} {prose(200 + i, 20)}" for i in range(12)] + ["", "word", hub, prose(8, 200)]
    n = len(others)
    taken = []
    whole = textkit.Words

    def recorded(column, *rest):
        taken.extend(column.to_pylist())
        return whole(column, *rest)

    monkeypatch.setattr(textkit, "Words", recorded)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array([hub] * n, pa.string()), pa.array(range(1, n + 1)), pa.array(others, pa.string())], names=list("abcd"))
    rows = pa.Table.from_batches(passages._verifier(iter([batch])), passages._PAIRED_OUT).to_pylist()
    assert taken.count(hub) == 2 and len(taken) == n + 1
    one = [whole(textkit.text(pa.array([x], pa.string()))) for x in (hub, *others)]
    by_pair = [(i + 1, *r) for i in range(n) for _, r in passages.alike_passages(one[0], one[i + 1])]
    assert [tuple(r.values())[1:] for r in rows] == by_pair and {r[0] for r in by_pair} == {*range(1, 13), 15}
    rng = np.random.default_rng(3)
    for _ in range(100):
        x, y = (textkit.mix(rng.integers(0, rng.integers(1, 30), rng.integers(0, 40)).astype(np.uint64)) for _ in range(2))
        same = {(i, j) for i in range(len(x)) for j in range(len(y)) if x[i] == y[j]}
        first = sorted((i, j) for i, j in same if (i - 1, j - 1) not in same)
        size = [next(k for k in range(1, 50) if (i + k, j + k) not in same) for i, j in first]
        assert [tuple(map(int, s)) for s in zip(*passages._stretches(x, y), strict=True)] == [(*f, k) for f, k in zip(first, size, strict=True)]
