"""WARC files by round trips, pseudonyms by their inverse, the language model against exact counts."""

import datetime
import gzip
import io
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import make, prose, words
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import ngram_model, pseudonyms, textkit, warc
from quadloom.llm.common import shared_dir

PAGES = "page_id long, url string, html string, file string, status string"


def _record(i, body):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _run(data):
    out = io.BytesIO()
    return list(warc.normalise_file(io.BytesIO(data), out)), out.getvalue()


def test_each_record_is_a_member_of_its_own():
    bodies = [b"", b"x" * 700_000, b"WARC/1.0\r\n\r\n", bytes(range(256)) * 9]
    rows, out = _run(gzip.compress(b"".join(_record(i, b) for i, b in enumerate(bodies))))
    assert [r[-1] for r in rows] == ["ok"] * 4
    for (n, offset, length, *_), b in zip(rows, bodies, strict=True):
        assert gzip.decompress(out[offset : offset + length]) == _record(n, b)
    assert sum(r[2] for r in rows) == len(out)


def test_damaged_streams():
    whole = b"".join(_record(i, prose(i, 400).encode()) for i in range(5))
    packed = gzip.compress(whole)
    rows, _ = _run(packed[: len(packed) * 2 // 3])
    assert rows[-1][-1] == "truncated" and all(r[-1] == "ok" for r in rows[:-1]) and len(rows) > 1
    rows, _ = _run(gzip.compress(whole + b"garbage here"))
    assert [r[-1] for r in rows] == ["ok"] * 5 + ["garbage"]
    rows, out = _run(gzip.compress(whole + b"noise WARC/ no record\r\n" + b"\0" * 600_000 + b"\n" + whole))
    assert [r[-1] for r in rows] == ["ok"] * 5 + ["garbage"] + ["ok"] * 5 and rows[5][6] == 600_024
    assert [gzip.decompress(out[r[1] : r[1] + r[2]]) for r in rows[6:]] == [_record(i, prose(i, 400).encode()) for i in range(5)]
    long = b"http://a/" + b"b" * 700_000
    rows, _ = _run(gzip.compress(b"WARC/1.0\r\nWARC-Target-URI: " + long + b"\r\nContent-Length: 2\r\n\r\nxy\r\n\r\n"))
    assert [(r[5], r[6], r[-1]) for r in rows] == [(long.decode(), 2, "ok")]
    assert _run(gzip.compress(b""))[0] == [] and _run(b"")[0] == []
    rows, _ = _run(b"".join(gzip.compress(_record(i, b"y")) for i in range(3)))
    assert [r[-1] for r in rows] == ["ok"] * 3


def test_pages_come_back(spark):
    rows = [(1, "http://a/%20", "<p>é</p>", "f", "s"), (2, None, "x", None, None), (None, "http://b", "", None, None), (3, "http://c", None, None, None), (1, "http://a/%20", "<p>é</p>", "f", "s"), (4, "u", "z" * 2_000_000, None, None), (None, None, None, None, None)]
    files = warc.write_monoliths(spark.createDataFrame(rows, PAGES).coalesce(2), shared_dir(spark, "w"))
    index = warc.normalise(files.unionAll(files), shared_dir(spark, "n"))
    assert index.count() == len(rows)
    back = sorted(map(str, map(tuple, warc.read_records(index).collect())))
    assert back == sorted(str(r[:3]) for r in rows)
    for r in index.groupBy("file").agg({"length": "sum"}).collect():
        path = r["file"].removeprefix("file://")
        spots = np.fromfile(path + ".idx", "<i8").reshape(-1, 2)
        assert spots[:, 1].sum() == r[1] == len(open(path, "rb").read())
    empty = warc.write_monoliths(spark.createDataFrame([], PAGES), shared_dir(spark, "w"))
    assert warc.normalise(empty, shared_dir(spark, "n")).count() == 0


def test_files_of_one_name(spark):
    a, b = (warc.write_monoliths(spark.createDataFrame([(i, f"u{i}", f"page {i}")], "page_id long, url string, html string").coalesce(1), shared_dir(spark, "w")) for i in (1, 2))
    index = warc.normalise(a.unionAll(b), shared_dir(spark, "n"))
    assert index.select("file").distinct().count() == 2
    assert sorted(map(tuple, warc.read_records(index).collect())) == [(1, "u1", "page 1"), (2, "u2", "page 2")]


def test_op5_covers_all_pages(spark, sf):
    got = warc.op5_warc_normalise(spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert got.where("status = 'ok'").select("page_id").exceptAll(pages.select("page_id")).count() == 0 and got.count() == pages.count()


# --- operator 6 ----------------------------------------------------------------------------------------

KEY = pseudonyms._secret("test")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**12), st.data())
def test_permutation_has_its_inverse(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = pseudonyms.permute(x, size, KEY, b"t")
    assert 0 <= y < size and pseudonyms.permute(y, size, KEY, b"t", back=True) == x


def test_permutation_is_one_to_one():
    assert sorted(pseudonyms.permute(i, 777, KEY, b"a") for i in range(777)) == list(range(777))


VALUES = {
    "card": ["4111 1111 1111 1111", "5500-0000-0000-0004"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], "ssn": ["123-45-6789"], "phone": ["(555) 234-5678", "+1 212 555 2368", "+49 170 1234567"],
    "date": ["1984-02-29", "29.02.1984", "12/31/1999", "31/12/1999"], "ip": ["192.168.0.1"], "mail": ["jane.doe42@example.org"],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_values_keep_their_format(kind, value):
    new, n = pseudonyms.pseudonymise(f"It is {value}, they said.", KEY)
    got = new.removeprefix("It is ").removesuffix(", they said.")
    assert n == 1 and got != value
    # numbers of an address have as many digits as they need
    assert kind == "ip" or len(got) == len(value)
    assert kind == "ip" or re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", got)) == re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", value))
    assert pseudonyms.pseudonymise(got, KEY)[1] == 1  # valid itself
    assert pseudonyms.pseudonymise(f"Again {value}", KEY)[0] == f"Again {got}"
    assert pseudonyms.pseudonymise(value, pseudonyms._secret("other"))[0] != got
    if kind == "card":
        d = re.sub(r"\D", "", got)
        assert pseudonyms.luhn(d[:-1]) == int(d[-1])
    if kind == "date" and got[4] == "-":
        datetime.date.fromisoformat(got)


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "DE00 3704 0044 0532 0130 00", "000-12-3456", "999.1.1.1", "2023-02-30", "plain words", "", "1234567", "version 1.2.3"])
def test_what_is_not_valid_stays(text):
    assert pseudonyms.pseudonymise(text, KEY) == (text, 0)


@pytest.mark.parametrize(
    ("text", "n", "rest"),
    [
        ("4111111111111111 123", 1, " 123"), ("4111 1111 1111 1111 12/27", 1, " 12/27"), ("4111111111111111 192.168.10.7", 2, None), ("123 4111111111111111", 1, None),
        ("4111 1111 1111 1112 5500-0000-0000-0004", 1, None), ("DE89 3704 0044 0532 0130 00 123", 1, " 123"), ("4111111111111111 1984-02-29", 2, None),
    ],
)
def test_values_beside_other_numbers(text, n, rest):
    new, got = pseudonyms.pseudonymise(text, KEY)
    assert got == n and (rest is None or new.endswith(rest))
    for value in ("4111111111111111", "4111 1111 1111 1111 ", "192.168.10.7", "5500-0000-0000-0004", "DE89 3704 0044 0532 0130 00", "1984-02-29"):
        assert value not in new


def test_pseudonyms_link_documents(spark, odd, nothing):
    docs = make(spark, [(1, "mail a.b@c.org and card 4111111111111111"), (2, "x 4111111111111111 y"), (None, "4111111111111111"), (2, "x 4111111111111111 y"), (3, "none"), (4, "w " * 100_000 + "4111111111111111")])
    rows = pseudonyms.pseudonymise_documents(docs).collect()
    cards = {m for r in rows for m in re.findall(r"4\d{15}", r["text"])}
    assert len(cards) == 1 and "4111111111111111" not in cards and [r["n_values"] for r in rows] == [2, 1, 1, 1, 0, 1]
    same = pseudonyms.pseudonymise_documents(odd).collect()
    assert [(r["doc_id"], r["text"]) for r in same] == [(r["doc_id"], r["text"]) for r in odd.collect()] and all(r["n_values"] == 0 for r in same)
    assert pseudonyms.pseudonymise_documents(nothing).count() == 0


def test_all_documents_come_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = 0
    spark.conf.set(pseudonyms.KEY_SETTING, "tests")
    for r in pseudonyms.op6_pseudonyms(spark, sf).collect():
        assert (r["text"], r["n_values"]) == pseudonyms.pseudonymise(texts[r["doc_id"]], pseudonyms._secret("tests"))
        changed += r["text"] != texts[r["doc_id"]]
    assert changed > 0
    spark.conf.unset(pseudonyms.KEY_SETTING)
    again = [{r["doc_id"]: r["text"] for r in pseudonyms.op6_pseudonyms(spark, sf).collect()} for _ in range(2)]
    # without a key of one's own nobody can tell what stands for what
    assert again[0] != again[1] and again[0].keys() == texts.keys()


# --- operator 7 ----------------------------------------------------------------------------------------


def _counts(texts):
    out = [Counter(), Counter(), Counter()]
    for t in texts:
        w = words(t)
        for n in range(1, 4):
            out[n - 1].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return out


def _level(c, n):
    return 0 if c == 0 or (n > 1 and c < ngram_model.LEAST_COUNT) else 1 + int(math.log2(c))


def _score(text, counts, total, vocabulary):
    """The same formula on exact counts, quantised."""
    w, out = words(text), 0.0
    c = lambda g: (lambda q: 1.5 * 2.0 ** (q - 1) if q else 0.0)(_level(counts[len(g) - 1][g], len(g)))
    for i in range(len(w)):
        p1 = (c((w[i],)) + 1) / (total + vocabulary + 1)
        p2 = min(c(tuple(w[i - 1 : i + 1])) / c((w[i - 1],)), 1) if i and c((w[i - 1],)) else 0.0
        p3 = min(c(tuple(w[i - 2 : i + 1])) / c(tuple(w[i - 2 : i])), 1) if i > 1 and c(tuple(w[i - 2 : i])) else 0.0
        out += math.log(ngram_model.WEIGHTS[0] * p1 + ngram_model.WEIGHTS[1] * p2 + ngram_model.WEIGHTS[2] * p3)
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_scores_against_exact_counts(spark, sf, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ngram_model, "BROADCAST_BYTES", 0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = _counts(texts.values())
    model = ngram_model.build_model(docs)
    assert model["words"] == sum(counts[0].values()) and model["vocabulary"] == len(counts[0])
    rows, near = ngram_model.score(docs, model).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        want = _score(texts[r["doc_id"]], counts, model["words"], model["vocabulary"])
        assert r["n_words"] == len(words(texts[r["doc_id"]]))
        near += abs(r["log_probability"] - want) <= 0.02 * abs(want) + 1e-6
        if r["n_words"]:
            assert abs(r["perplexity"] - math.exp(-r["log_probability"] / r["n_words"])) < 1e-6 * r["perplexity"]
    assert near >= 0.98 * len(rows)  # false positives of the filter may move a few


def test_an_ngram_that_occurs_once_is_in_the_model(spark):
    docs = make(spark, [(1, "one two three four"), (2, "five six seven"), (3, "one two")])
    model = ngram_model.build_model(docs)
    seen, unseen = (ngram_model.score(make(spark, [(1, t)]), model).first()["log_probability"] for t in ("two three four", "two four three"))
    assert seen > unseen + 1


def test_filter_never_forgets_and_seldom_invents():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 48, 20_000).astype(np.uint64))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 1 << 20).astype(np.int64)
    part = ngram_model.build_part(keys, counts)
    level = ngram_model.read_levels(part, keys)
    want = np.frexp(counts.astype(float))[1]
    assert (level >= want).all() and (level == want).mean() > 0.98
    other = rng.integers(1 << 49, 1 << 50, 20_000).astype(np.uint64)
    assert (ngram_model.read_levels(part, other) > 0).mean() < 0.02


def test_scores_odd(spark, odd, nothing):
    rows = ngram_model.score(odd, ngram_model.build_model(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["perplexity"] is None) == (r["n_words"] == 0)
    assert ngram_model.score(nothing, ngram_model.build_model(odd)).count() == 0
    flat = ngram_model.score(make(spark, [(1, "a b c")]), ngram_model.build_model(nothing)).collect()
    assert flat[0]["n_words"] == 3 and flat[0]["log_probability"] < 0.0 or flat[0]["perplexity"] > 0


def test_grams_stay_within_documents():
    w = textkit.Words(textkit.text(pa.array(["a b c", "d e", ""])))
    assert [len(h) for h, _ in ngram_model._grams(w)] == [5, 3, 1]


def test_model_is_asked_once_for_each_ngram_of_a_slice(monkeypatch):
    shards = 5
    column = textkit.text(pa.array([prose(1, 400, 50), None, "one", prose(1, 400, 50), "?!", "one two", prose(2, 300, 50)], pa.string()))
    words = textkit.Words(column)
    every = np.concatenate([h for h, _ in ngram_model._grams(words)])
    kinds, counts = np.unique(every, return_counts=True)
    of = ngram_model._shard(kinds, shards)
    trim = kinds & np.uint64((1 << 48) - 1)
    parts = {s: ngram_model.build_part(trim[of == s], counts[of == s]) for s in range(shards)}
    monkeypatch.setattr(ngram_model, "_WHOLE_BITS", 0)
    assert all((ngram_model.build_part(trim[of == s], counts[of == s]) == p).all() for s, p in parts.items())
    asked = []
    read = ngram_model.read_levels
    monkeypatch.setattr(ngram_model, "read_levels", lambda part, keys: asked.append(len(keys)) or read(part, keys))

    class Sent:
        value = {s: p.tobytes() for s, p in parts.items()}

    model = {"folder": "", "shards": shards, "bytes": {s: len(p) for s, p in parts.items()}, "words": len(words.hash), "vocabulary": 50}
    ids = pa.array(range(len(column)), pa.int64())
    rows = pa.Table.from_batches(ngram_model._scorer(model, Sent)(iter([pa.RecordBatch.from_arrays([ids, column], names=["doc_id", "text"])])))
    assert sum(asked) == len(kinds) < len(every) and len(asked) == shards
    # as if each n-gram was asked for by itself
    level = [np.zeros(len(words.hash), np.int8) for _ in range(ngram_model.ORDERS)]
    for n, (h, at) in enumerate(ngram_model._grams(words)):
        for key, place in zip(h, at, strict=True):
            level[n][place] = read(parts[int(ngram_model._shard(np.array([key]), shards)[0])], np.array([key & np.uint64((1 << 48) - 1)]))[0]
    p = ngram_model._probabilities(level, len(words.hash), 50)
    assert np.allclose(rows["log_probability"].to_numpy(), [p[a:b].sum() for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    assert rows["n_words"].to_pylist() == words.counts.tolist() and rows["perplexity"].null_count == 2
    assert not len(list(ngram_model._levels(textkit.Words(column[4:5]), parts, shards, lambda s: parts[s]))[0])
