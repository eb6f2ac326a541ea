"""Operator 4: quality rules on how a public vocabulary takes a text.

Per document: characters per token, share of tokens that are byte fallbacks, and the entropy of its
tokens, as a share of that of as many different tokens (1,024 at most). White space is no token here. A document is rejected if one of them
leaves the band of its language; a language without bands has those of its script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm import textkit
from quadloom.llm.common import carried_text, lean, prepare, table
from quadloom.llm.tokenizers import VOCABULARIES, byte_pieces, piece_encoder

#: Characters per token from, to; most byte-fallback share; entropy share from. The language bands were
#: set from the documents labelled good at sf0.1, of which they leave out about 1 in 300; the script
#: bands are wider.
BANDS = {
    "en": (2.20, 3.60, 0.08, 0.645),
    "de": (2.20, 3.60, 0.08, 0.630),
    "fr": (1.95, 3.40, 0.08, 0.625),
    "es": (1.90, 3.40, 0.08, 0.635),
    "latin": (1.50, 5.50, 0.15, 0.50),
    "cyrillic": (1.20, 5.50, 0.20, 0.45),
    "cjk": (0.40, 2.50, 0.60, 0.40),
    "other": (0.30, 6.00, 0.80, 0.40),
}
#: Under so many tokens the three figures say nothing; such a document is kept if it has any token.
LEAST_TOKENS = 40
#: Entropy is set against that of so many different tokens at most: beyond, it no longer grows with length.
EVEN_TOKENS = 1024
_VOCABULARY = 32_000
#: Text judged at once. Words, ids and histograms of a slice take many times its size in a worker.
_SLICE = textkit.SLICE_BYTES // 4
_FEATURES = "chars_per_token double, fallback_share double, token_entropy double, n_tokens long, script string, reason string"


def _entropy(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Entropy in bits of each document's ids, with one histogram for a few documents at a time."""
    n = len(first) - 1
    out, step = np.zeros(n), 32
    for a in range(0, n, step):
        b = min(n, a + step)
        size = np.diff(first[a : b + 1])
        if not size.sum():
            continue
        key = np.repeat(np.arange(b - a), size) * _VOCABULARY + ids[first[a] : first[b]]
        seen = np.bincount(key, minlength=(b - a) * _VOCABULARY)
        at = np.flatnonzero(seen)
        c = seen[at].astype(float)
        part = np.bincount(at // _VOCABULARY, c * np.log2(c), b - a)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[a:b] = np.where(size > 0, np.log2(size) - part / size, 0.0)
    return np.maximum(out, 0.0)


def _scripts(column: pa.Array) -> np.ndarray:
    """The script of most of a text's characters, told from the lead bytes of UTF-8."""
    raw, off = textkit.buffers(column)
    kind = np.zeros(256, np.int8)
    kind[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 1
    kind[[*range(0xD0, 0xD4)]] = 2
    kind[[*range(0xE3, 0xEE)]] = 3
    kind[[*range(0xCA, 0xD0), *range(0xD4, 0xE3), *range(0xEE, 0xF8)]] = 4
    of = kind[raw]
    tally = np.zeros((5, len(off) - 1), np.int64)
    for k in range(1, 5):
        total = np.concatenate([[0], np.cumsum(of == k)])
        tally[k] = total[off[1:]] - total[off[:-1]]
    names = np.array(["other", "latin", "cyrillic", "cjk", "other"], object)
    return names[np.where(tally.sum(0) > 0, tally.argmax(0), 0)]


def _features(column: pa.Array, vocabularies: str) -> tuple[np.ndarray, ...]:
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(column))
    begin = words.offsets.to_numpy()
    values = words.values
    blank = np.asarray(pc.equal(pc.binary_length(values), 0)) if len(values) else np.zeros(0, bool)
    ids, each = piece_encoder(vocabularies).ids(values)
    each = np.where(blank, 0, each)
    first = np.concatenate([[0], np.cumsum(each)])[begin]
    tokens = np.diff(first)
    is_byte = np.concatenate([[0], np.cumsum(byte_pieces(vocabularies)[ids])])
    chars = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    some = np.maximum(tokens, 1)
    return chars / some, (is_byte[first[1:]] - is_byte[first[:-1]]) / some, _entropy(ids, first), tokens


def _judge(cpt, share, entropy, tokens, script, lang, bands) -> list[str | None]:
    most = np.log2(np.maximum(2, np.minimum(tokens, EVEN_TOKENS)))
    even = entropy / most
    key = [x if x in bands else s for x, s in zip(lang, script, strict=True)]
    band = np.array([bands[k] for k in key], float).reshape(-1, 4)
    reason = np.full(len(cpt), None, object)
    long = tokens >= LEAST_TOKENS
    reason[long & (even < band[:, 3])] = "entropy"
    reason[long & (share > band[:, 2])] = "byte fallback"
    reason[long & (cpt > band[:, 1])] = "long tokens"
    reason[long & (cpt < band[:, 0])] = "short tokens"
    reason[tokens == 0] = "no token"
    return reason


def _rows(names: list[str], text: int, lang: int, rest: range, vocabularies: str, bands: dict, filtering: bool):
    """text, lang, rest: which columns hold what is judged, and which come out, as the first of `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = textkit.text(batch.column(text))
            langs = batch.column(lang).to_pylist()
            own = batch.select(rest)
            out = []
            for a, b in textkit.slices(column, _SLICE):
                cpt, share, entropy, tokens = _features(column[a:b], vocabularies)
                script = _scripts(column[a:b])
                reason = _judge(cpt, share, entropy, tokens, script, langs[a:b], bands)
                if filtering:
                    yield pa.RecordBatch.from_arrays(own.slice(a, b - a).columns, names=names).filter(pa.array([x is None for x in reason], pa.bool_()))
                else:
                    out.append(pa.table([pa.array(cpt), pa.array(share), pa.array(entropy), pa.array(tokens.astype(np.int64)), pa.array(script, pa.string()), pa.array(reason, pa.string())], names=[f"f{i}" for i in range(6)]))
            if out:
                yield from pa.table([*own.columns, *pa.concat_tables(out).columns], names=names).combine_chunks().to_batches()

    return run


def _inputs(docs: DataFrame) -> list:
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return [docs["text"].cast("string").alias("_text"), lang.alias("_lang")]


def quality_features(docs: DataFrame, vocabularies: str = VOCABULARIES, bands: dict = BANDS) -> DataFrame:
    """doc_id and source of every document with its figures and `reason` (null: it is kept).

    A null, empty or blank text has no token and is rejected for that. A null or unknown language is
    judged by script. Repeated rows are judged each for itself, null ids stay null, other columns are
    ignored, an empty table gives no rows. Texts are read whole.
    """
    prepare(docs.sparkSession)
    rest = T.StructType([T.StructField("doc_id", T.LongType())])
    schema = T.StructType([*rest.fields, *T._parse_datatype_string(_FEATURES).fields])
    rows = docs.select(*_inputs(docs), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(lean(_rows(schema.names, 0, 1, range(2, 3), vocabularies, bands, False)), schema)


def quality_filter(docs: DataFrame, vocabularies: str = VOCABULARIES, bands: dict = BANDS) -> DataFrame:
    """Rows of `docs` that no rule rejects, with all their columns; cases as in quality_features."""
    prepare(docs.sparkSession)
    rows, text = carried_text(docs, _inputs(docs)[1])
    n = len(docs.columns)
    return rows.mapInArrow(lean(_rows(docs.columns, text, n, range(n), vocabularies, bands, True)), docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_features(table(spark, sf_dir, "documents"))
