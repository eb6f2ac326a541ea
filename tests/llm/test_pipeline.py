"""The pipeline: each stage's contract, odd rows through all of them, and the whole against its parts by hand."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from conftest_llm import SCHEMA, prose
from pyspark.sql import functions as F

from quadloom.llm import decontaminate, fertility, mixture, ngram_join, textkit
from quadloom.llm.common import carried_text, lean
from quadloom.llm.tokenizers import VOCABULARIES, byte_bpe


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_keeps_the_columns_and_its_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if i < 4:
            assert out.dtypes == docs.dtypes
        if i < 3:
            kept.append({r["doc_id"] for r in out.collect()})
        now = out
    ids = {r["doc_id"] for r in docs.collect()}
    reasons = {r["doc_id"]: r["reason"] for r in fertility.quality_features(docs).collect()}
    assert kept[0] == {d for d, r in reasons.items() if r is None}
    pairs = [(r["doc_a"], r["doc_b"]) for r in ngram_join.similar_pairs(docs.where(docs["doc_id"].isin(list(kept[0])))).collect()]
    group = {i: i for i in kept[0]}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    assert kept[1] == {i for i in kept[0] if root(i) == i}
    held = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert kept[2] == kept[1] - held and ids >= kept[2] and kept[2]


def test_run_writes_what_was_mixed(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "part", "ordinal", "token_start", "local_start", "n_tokens"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    mixed = mixture.mixed_documents(docs).collect()
    # the draw depends on how rows lie in files, the number of tokens and of blocks hardly; every document drawn is one that stayed
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    enc = byte_bpe()
    want = sum(len(enc.encode_ordinary(r["text"] or "")) for r in mixed)
    assert abs(sum(r["n_tokens"] for r in rows) - want) <= 0.1 * want
    rows.sort(key=lambda r: (r["part"], r["ordinal"]))
    assert [r["token_start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))][: len(rows)]


def test_odd_rows_pass_every_stage(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        now = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, sf)
            assert i == 4 or out.columns == docs.columns
            out.collect()
            now = out
        for _, stage in corpus_pipeline.STAGES:  # each on its own as well
            stage(spark, docs, sf).collect()


def test_clean_documents_stay(spark, sf):
    rows = [(i, prose(40_000 + i, 80 + i), "xx", "s", None, 1, 2, 3, 4, "x", "g") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:3]:
        assert Counter(r["doc_id"] for r in stage(spark, docs, sf).collect()) == Counter(range(60))


def test_workers_hold_a_text_once(spark):
    docs = spark.createDataFrame([(i, prose(41_000 + i, 900), "en") for i in range(3)], "doc_id long, text string, lang string")
    rows, at = carried_text(docs)
    assert (rows.columns, at) == (["c0", "c1", "c2"], 1)
    rows, at = carried_text(docs.withColumn("text", F.encode("text", "utf-8")))
    assert at == 3 and rows.dtypes[1][1] == "binary" and rows.dtypes[3][1] == "string"
    # what stays of a large batch is sent on by slices
    texts = [prose(41_100 + i, 4000) for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 200})
    run = fertility._rows(["text", "lang"], 0, 1, range(2), VOCABULARIES, {k: (0.0, 99.0, 1.0, 0.0) for k in fertility.BANDS}, True)
    out = list(run(iter([batch])))
    assert len(out) > 1 and sum((b.column(0).to_pylist() for b in out), []) == texts


def test_workers_forget_what_a_task_filled():
    encoder = textkit.Encoder(lambda xs: [[len(x)] for x in xs], np.uint16)
    task = lean(lambda batches: ((encoder.ids(b)[0].tolist(), len(encoder.known), len(textkit.powers(9)[0])) for b in batches))
    ((ids, known, powers),) = task(iter([pa.array([b"a", b"bc"])]))
    assert ids == [1, 2] and known == 2 and powers >= 9
    assert not encoder.known and len(textkit._pow) == len(textkit._inv) == 1
    assert encoder.ids(pa.array([b"bc"]))[0].tolist() == [2]


def test_stages_bound_the_batches_that_workers_get(spark, sf):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("ab cd " * 1000).alias("text")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64())})

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        each = [r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect()]
        assert sum(each) >= 3000 * 6000 and max(each) <= 5 << 20


def test_quality_rules_take_a_large_batch_in_small_slices(spark, monkeypatch):
    texts = [prose(i, 700) for i in range(40)] + [prose(99, 120_000), "", None] + [prose(i, 700) for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * len(texts)), "doc_id": pa.array(range(len(texts)), pa.int64())})
    run = fertility._rows(["doc_id", *[f"f{i}" for i in range(6)]], 0, 1, range(2, 3), VOCABULARIES, fertility.BANDS, False)
    seen = []
    features = fertility._features
    monkeypatch.setattr(fertility, "_features", lambda column, v: seen.append(np.diff(textkit.buffers(column)[1])) or features(column, v))
    small = pa.Table.from_batches(run([batch]))
    # a document isn't cut
    assert sum(map(len, seen)) == len(texts) and all(len(x) == 1 or x.sum() <= 512 << 10 for x in seen)
    monkeypatch.setattr(fertility, "_features", features)
    monkeypatch.setattr(textkit, "slices", lambda column, most=0: iter([(0, len(column))]))
    assert small.equals(pa.Table.from_batches(run([batch])))
