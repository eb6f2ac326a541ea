"""Quality rules, token files and mixing: against the tokenisers alone, and by exact round trips."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import make, prose

from quadloom.llm import fertility, mixture, textkit, token_files
from quadloom.llm.common import shared_dir
from quadloom.llm.tokenizers import byte_bpe, pieces


def _plain(text):
    """Figures of one text by the vocabulary itself, word by word."""
    model, ids = pieces(), []
    for w in text.split():
        ids += model.encode(w)
    n = len(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0
    return len(text) / max(1, n), sum(model.is_byte(i) for i in ids) / max(1, n), entropy, n


def test_figures_against_the_vocabulary(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = fertility.quality_features(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        cpt, share, entropy, n = _plain(texts[r["doc_id"]])
        assert r["n_tokens"] == n and abs(r["chars_per_token"] - cpt) < 1e-9 and abs(r["fallback_share"] - share) < 1e-9 and abs(r["token_entropy"] - entropy) < 1e-6


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = fertility.quality_filter(docs).select("doc_id").distinct()
    good = labels.where("quality = 1").join(docs.select("doc_id"), "doc_id").select("doc_id").distinct()
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.98 * good.count()


def test_bands_reject(spark):
    rows = [(1, prose(1, 300)), (2, "a" * 2000), (3, "the " * 500), (4, "☃☄★" * 300), (5, "short text"), (6, None), (7, " \n"), (8, "x7 q9 " * 300)]
    reasons = {r["doc_id"]: r["reason"] for r in fertility.quality_features(make(spark, [(i, t, "xx") for i, t in rows])).collect()}
    assert reasons[5] is None and reasons[6] == reasons[7] == "no token" and reasons[3] == "entropy"
    assert all(reasons[i] for i in (2, 3, 4, 8))
    kept = {r["doc_id"] for r in fertility.quality_filter(make(spark, [(i, t, "xx") for i, t in rows])).collect()}
    assert kept == {i for i, r in reasons.items() if r is None}


def test_scripts():
    t = textkit.text(pa.array(["hello", "привет мир", "杭州市人民", "123 !?", "", None]))
    assert list(fertility._scripts(t)) == ["latin", "cyrillic", "cjk", "other", "other", "other"]


def test_quality_odd(spark, odd, nothing):
    assert fertility.quality_features(odd).count() == odd.count()
    kept = fertility.quality_filter(odd)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3})
    assert fertility.quality_filter(nothing).count() == 0 and fertility.quality_features(nothing).count() == 0


# --- operator 8 ----------------------------------------------------------------------------------------


def _read_back(df, to):
    """Tokens of each row, through the memory-mapped files."""
    stores = {}
    for r in df.collect():
        s = stores.setdefault(r["part"], token_files.TokenStore(to, r["part"]))
        ids = s[r["ordinal"]]
        assert len(ids) == r["n_tokens"] and s.offsets[r["ordinal"]] == r["local_start"]
        yield r, ids.tolist()


def test_token_files_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    to = shared_dir(spark, "tokens")
    df = token_files.token_files(docs, to)
    texts, enc, rows = {r["doc_id"]: r["text"] for r in docs.collect()}, byte_bpe(), []
    for r, ids in _read_back(df, to):
        assert ids == enc.encode_ordinary(texts[r["doc_id"]])
        rows.append(r)
    assert len(rows) == len(texts)
    # bases are prefix sums: documents in order lie one behind another
    rows.sort(key=lambda r: (r["part"], r["ordinal"]))
    at = 0
    for r in rows:
        assert r["token_start"] == at
        at += r["n_tokens"]


def test_token_files_odd(spark, odd, nothing):
    to = shared_dir(spark, "tokens")
    df = token_files.token_files(odd, to)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, byte_bpe().decode(ids)) for r, ids in _read_back(df, to)))
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert token_files.token_files(nothing, shared_dir(spark, "tokens")).count() == 0


def test_a_repeated_write_gives_the_same_files(spark):
    docs = make(spark, [(i, prose(i, 50)) for i in range(20)]).coalesce(2)
    to = shared_dir(spark, "tokens")
    one = sorted(map(tuple, token_files.token_files(docs, to).collect()))
    assert one == sorted(map(tuple, token_files.token_files(docs, to).collect()))


@pytest.mark.parametrize("text", ["", " ", "a\n\nb", "don't we'll\n x", "é  ü\t\n 杭州 x", "12 34\r\n56 ", "a b 　 c"])
def test_cuts_never_change_tokens(text):
    chunks, first = textkit.chunks(textkit.text(pa.array([text, text + " tail"])))
    assert b"".join(chunks.to_pylist()).decode() == text + text + " tail"
    enc, got = byte_bpe(), []
    for c in chunks.to_pylist()[: first[1]]:
        got += enc.encode_ordinary(c.decode())
    assert got == enc.encode_ordinary(text)


# --- operator 9 ----------------------------------------------------------------------------------------


def _corpus(spark):
    rows = [(i, prose(i, 10 + 37 * i % 900), "en", f"s{i % 3}") for i in range(400)] + [(1000 + i, prose(5000 + i, 120), "en", "tiny") for i in range(3)]
    return make(spark, rows).repartition(6)


def _n_tokens(text):
    return len(textkit.chunks(textkit.text(pa.array([text])))[0])


def test_blocks_hold_all_and_only_the_documents(spark):
    docs = _corpus(spark)
    blocks, counts = mixture.pack(docs, 256)
    rows = blocks.collect()
    sizes = {}
    for r in counts.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["n"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {s: sorted(r["block_index"] for r in rows if r["source"] == s) for s in sizes} == {s: list(range(n)) for s, n in sizes.items()}
    short = Counter(r["source"] for r in rows if r["n_tokens"] < 256)
    assert all(n <= 1 for n in short.values()) and all(r["n_tokens"] <= 256 for r in rows)
    found = {}
    for r in rows:
        assert sum(_n_tokens(p["text"]) for p in r["pieces"] if p["text"]) == r["n_tokens"]
        for p in r["pieces"]:
            found.setdefault(p["doc_id"], []).append(p["text"])
            assert p["source"] == r["source"] and p["n_chars"] == len(p["text"]) and p["group"] == "g"
    assert set(found) == set(texts)
    for d, parts in found.items():
        # pieces of a document are its text, cut; few enough to try by their places in it
        assert sum(map(len, parts)) == len(texts[d]) and all(x in texts[d] for x in parts)


def test_mix_follows_the_weights(spark):
    docs = _corpus(spark)
    rows = mixture.mix_sources(docs, {"s0": 3.0, "s1": 1.0}, 128, shard_slots=64, total_blocks=1600).collect()
    n = Counter(r["source"] for r in rows)
    assert len(rows) == 1600 and set(n) == {"s0", "s1"} and abs(n["s0"] / 1600 - 0.75) < 0.05
    assert len({(r["shard"], r["slot"]) for r in rows}) == 1600 and max(r["slot"] for r in rows) == 63
    per = Counter((r["source"], r["block_index"]) for r in rows)
    for s in n:
        uses = [c for (x, _), c in per.items() if x == s]
        assert max(uses) - min(uses) <= 1  # no block a third time before all had a second
        assert {r["round"] for r in rows if r["source"] == s} == set(range(max(uses)))


def test_default_weights_even_out():
    w = mixture.target_weights({"a": 1000, "b": 10, "c": 0}, None)
    assert abs(sum(w.values()) - 1) < 1e-12 and 1000 / 1010 > w["a"] > 0.5 and "c" not in w


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations(n):
    one = mixture.permute(np.arange(n), n, 12345)
    assert sorted(one.tolist()) == list(range(n))
    assert n < 60 or (one != np.arange(n)).mean() > 0.9


def test_mixed_documents_keep_columns(spark):
    docs = _corpus(spark)
    out = mixture.mixed_documents(docs, total_blocks=50, block_tokens=128)
    assert out.dtypes == docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] in texts[r["doc_id"]] for r in out.collect())


def test_mix_odd(spark, odd, nothing):
    rows = mixture.mix_sources(odd).collect()
    assert len(rows) >= 2
    out = mixture.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() > 0
    assert mixture.mix_sources(nothing).count() == 0 and mixture.mixed_documents(nothing).count() == 0
    assert mixture.mix_sources(odd, {"absent": 1.0}).count() == 0
    blocks, _ = mixture.pack(odd, 1024)
    packed = sorted((p["doc_id"] is None, p["doc_id"] or 0) for r in blocks.collect() for p in r["pieces"] if p["doc_id"] != 9)
    assert packed == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect() if r["doc_id"] != 9)
