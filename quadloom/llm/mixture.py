"""Operator 9: mixes sources to target weights, by blocks of equal numbers of tokens.

Documents of a source are packed, one after another, into blocks of a fixed number of tokens (a token
is a word with the space before it, so the text of a block is exactly what its documents hold). Each
output shard draws how many of its slots every source gets from a multinomial distribution; a slot is
mapped through a pseudorandom permutation of the source's block numbers, so a source gives each block
once before it gives any a second time; a join by block number fetches the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadloom.llm import textkit
from quadloom.llm.common import carried, lean, materialise, prepare, table

BLOCK_TOKENS = 1_024
SHARD_SLOTS = 512
#: Without given weights a source weighs as its share of tokens to this power: under 1 it evens sources out.
TEMPERATURE = 0.7
SEED = 17
_FAN_IN = 256


def _pieces_type(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField("source", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("pieces", T.ArrayType(schema))]
    )


def _cut(column: pa.Array, start: np.ndarray, block: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cuts each document where its source's stream passes a multiple of `block`.

    start: how many tokens of the stream come before each document. Returns the pieces' texts, of which
    document each is, and its tokens; a document without tokens is one empty piece.
    """
    raw, off = textkit.buffers(column)
    parts, first = textkit.chunks(column)
    edges = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1) if len(parts) else np.zeros(1, np.int64)
    tokens = np.diff(first)
    into = start % block
    inner = np.where(tokens > 0, (into + tokens - 1) // block - into // block, 0)
    doc = np.repeat(np.arange(len(tokens)), inner + 1)
    nth = textkit.ragged(np.zeros(len(tokens), np.int64), inner + 1)
    begin = np.where(nth == 0, 0, nth * block - into[doc])
    size = np.append(begin[1:], 0)
    last = nth == inner[doc]
    size = np.where(last, tokens[doc], size) - begin
    at = edges[np.minimum(first[doc] + begin, len(edges) - 1)]
    offsets = np.append(at, off[-1]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(doc), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
    return texts, doc, size


def _packer(schema: pa.Schema, text_at: int, chars_at: int, block: int, final: bool):
    piece = pa.struct(list(schema))
    out_schema = pa.schema([("source", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("pieces", pa.list_(piece))])

    def rows(source: str, part: int, seq: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, pieces: pa.Array) -> pa.RecordBatch:
        n = len(seq)
        return pa.RecordBatch.from_arrays([pa.array([source] * n, pa.string()), pa.array(np.full(n, part, np.int32)), pa.array(seq), pa.array(tokens), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: dict[str, list] = {}  # source: pieces of its open block
        filled: dict[str, int] = {}  # and their tokens
        count: dict[str, int] = {}
        for batch in batches:
            texts = textkit.text(batch.column(0))
            names = batch.column(1).to_numpy(zero_copy_only=False)
            rest = batch.select(range(2, batch.num_columns))
            for a, b in textkit.slices(texts):
                which, code = np.unique(names[a:b].astype(str), return_inverse=True)
                column = texts[a:b]
                tokens = np.diff(textkit.chunks(column)[1])
                order = np.argsort(code, kind="stable")
                run_up = np.cumsum(tokens[order]) - tokens[order]
                begins = np.searchsorted(code[order], np.arange(len(which)))
                open_now = np.array([filled.get(s, 0) for s in which])
                start = np.empty(b - a, np.int64)
                start[order] = run_up - run_up[begins][code[order]] + open_now[code[order]]
                cut, doc, size = _cut(column, start, block)
                by = np.argsort(code[doc], kind="stable")
                arrays = [c.take(pa.array(a + doc[by])) for c in rest.columns]
                cut = cut.take(pa.array(by))
                arrays[text_at] = cut.cast(pa.string())
                if chars_at >= 0:
                    arrays[chars_at] = pc.utf8_length(cut).cast(schema.field(chars_at).type)
                made = pa.StructArray.from_arrays(arrays, fields=list(schema))
                size, bounds = size[by], np.searchsorted(code[doc][by], np.arange(len(which) + 1))
                for k, source in enumerate(which):
                    lo, hi = bounds[k], bounds[k + 1]
                    all_pieces = pa.concat_arrays([*waiting.pop(source, []), made[lo:hi]])
                    had = len(all_pieces) - (hi - lo)
                    # tokens of the pieces that waited are known as a sum; they all lie in the open block
                    ends = filled.get(source, 0) + np.cumsum(size[lo:hi])
                    full = int(ends[-1] // block) if hi > lo else 0
                    stops = had + np.searchsorted(ends, np.arange(1, full + 1) * block) + 1
                    if full:
                        edge = np.concatenate([[0], stops])
                        seq = count.get(source, 0) + np.arange(full)
                        yield rows(str(source), part, seq, np.full(full, block), edge, all_pieces[: stops[-1]])
                        count[source] = count.get(source, 0) + full
                    waiting[source] = [all_pieces[stops[-1] if full else 0 :]]
                    filled[source] = int(ends[-1] % block) if hi > lo else filled.get(source, 0)
        for source, lists in waiting.items():
            pieces = pa.concat_arrays(lists)
            if len(pieces):
                seq = count.get(source, 0) if final else -1
                yield rows(str(source), part, np.array([seq]), np.array([filled[source]]), np.array([0, len(pieces)]), pieces)

    return run


def pack(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Blocks of every source: source, block_index from 0 without gaps, n_tokens, pieces (rows of `docs`);
    and how many blocks (n) of how many tokens each source has by level and part.

    Each task packs what it has; what is left over, less than a block for each task and source, is packed
    again in fewer tasks, until one task is left. Only then a block may be short, one for each source.
    """
    spark = docs.sparkSession
    schema = docs.schema
    fields = list(to_arrow_schema(schema))
    arrow = pa.schema(fields)
    names = docs.columns
    chars = names.index("n_chars") if "n_chars" in names and isinstance(schema["n_chars"].dataType, T.IntegralType) else -1
    source = F.coalesce(docs["source"].cast("string"), F.lit("")) if "source" in names else F.lit("")
    left, made, level, width = docs, None, 0, 0
    while True:
        keyed = carried(left, text=left["text"].cast("string"), source=source) if level == 0 else left
        packed = materialise(keyed.mapInArrow(lean(_packer(arrow, names.index("text"), chars, block_tokens, width == 1)), _pieces_type(schema)), "blocks").withColumn("level", F.lit(level))
        made = packed.where("seq >= 0") if made is None else made.unionByName(packed.where("seq >= 0"))
        if width == 1:
            break
        width = max(1, (packed.agg(F.max("part")).first()[0] or 0) // _FAN_IN)
        tails = packed.where("seq < 0").select("part", "source", F.explode("pieces").alias("p"))
        # tails of one source meet in one task, up to _FAN_IN of them
        left = tails.repartition(width, "source", F.floor(F.col("part") / _FAN_IN)) if width > 1 else tails.coalesce(1)
        left = left.select(F.col("p.text").cast("string").alias("text"), "source", *[F.col("p")[c].alias(f"c{i}") for i, c in enumerate(names)])
        level += 1
    counts = made.groupBy("source", "level", "part").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that its size is known and the blocks needn't be shuffled to join it while it is small
    bases = materialise(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    placed = made.join(bases.select("source", "level", "part", "base"), ["source", "level", "part"])
    return placed.select("source", (F.col("base") + F.col("seq")).alias("block_index"), "n_tokens", "pieces"), bases


def _mix(x: int, seed: int) -> int:
    return int(textkit.mix(np.array([x], np.uint64), seed)[0])


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at i: a Feistel network, walked until within the range."""
    if n < 2:
        return np.zeros_like(i)
    w = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << w) - 1)
    out = i.astype(np.uint64)
    todo = np.arange(len(i))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(w), x & mask
        for r in range(6):
            a, b = b, a ^ (textkit.mix(b ^ np.uint64(key), r + 1) & mask)
        out[todo] = (a << np.uint64(w)) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def target_weights(tokens: dict[str, int], weights: dict[str, float] | None, temperature: float = TEMPERATURE) -> dict[str, float]:
    """Weights of the sources that have tokens, adding up to 1; sources not named in `weights` have 0."""
    raw = {s: (weights.get(s, 0.0) if weights is not None else float(n) ** temperature) for s, n in tokens.items() if n > 0}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()} if total > 0 else {}


def _draw(sources: list[str], weights: list[float], slots: int, total: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(slots, total - shard * slots)
                drawn = np.random.default_rng([seed, shard]).multinomial(n, weights)
                some = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_pydict({"shard": [shard] * len(some), "source": [sources[i] for i in some], "n": drawn[some].tolist()}, pa.schema([("shard", pa.int64()), ("source", pa.string()), ("n", pa.int64())]))

    return run


def _place(blocks: dict[str, int], seed: int):
    out = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source", pa.string()), ("block_index", pa.int64()), ("round", pa.int64())])
    salt = {s: _mix(i + 1, seed) for i, s in enumerate(sorted(blocks))}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("source")
        shard = group["shard"][0].as_py()
        source, index, rounds = [], [], []
        for s, n, base in zip(group["source"].to_pylist(), group["n"].to_pylist(), group["base"].to_pylist(), strict=True):
            draw = base + np.arange(n)
            nth = draw // blocks[s]
            at = np.empty(n, np.int64)
            for r in np.unique(nth):
                at[nth == r] = permute(draw[nth == r] % blocks[s], blocks[s], salt[s] ^ _mix(int(r), seed + 1))
            source += [s] * n
            index.append(at)
            rounds.append(nth)
        slot = np.random.default_rng([seed, shard, 1]).permutation(len(source)).astype(np.int32)
        return pa.table([pa.array(np.full(len(source), shard)), pa.array(slot), pa.array(source, pa.string()), pa.array(np.concatenate(index)), pa.array(np.concatenate(rounds))], schema=out)

    return run


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, total_blocks: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """shard, slot, source, block_index, round, n_tokens, pieces: as many blocks as there are, in the target mix.

    `round` counts how often the source had been used up before; `pieces` are rows of `docs` whose text is
    the part that lies in the block. total_blocks: another number of slots than there are blocks.
    Null sources are the source ''; a null or empty text makes a piece without tokens, which stays beside its
    neighbours; null ids stay; repeated rows are packed each; extra columns go along in the pieces;
    long texts run over many blocks; an empty table, or weights that name no source, gives no rows. The
    result depends on the order of rows within partitions but is the same for the same partitions and seed.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks, counts = pack(docs, block_tokens)
    # one row a source reaches the driver
    stats = {r["source"]: (r["n"], r["tokens"]) for r in counts.groupBy("source").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    target = target_weights({s: t for s, (_, t) in stats.items()}, weights, temperature)
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("block_index", T.LongType()), T.StructField("round", T.LongType())])
    total = (sum(n for n, _ in stats.values()) if total_blocks is None else total_blocks) if target else 0
    shards = math.ceil(total / shard_slots)
    names = sorted(target)
    counts = spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(lean(_draw(names, [target[s] for s in names], shard_slots, total, seed)), "shard long, source string, n long")
    counts = materialise(counts, "draws")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    slots = based.groupBy("shard").applyInArrow(_place({s: stats[s][0] for s in names}, seed), schema)
    # both sides are spread by block; the slots, without texts, are the side that is hashed
    return blocks.join(slots.hint("shuffle_hash"), ["source", "block_index"]).select("shard", "slot", "source", "block_index", "round", "n_tokens", "pieces")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of `docs`: one for each piece of a document in a slot, its text and n_chars those of the piece.

    A document that lies in one block, drawn once, comes out as it is; cases as in mix_sources.
    """
    pieces = mix_sources(docs, **options).select(F.explode("pieces").alias("p"))
    return pieces.select(*[F.col("p")[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("shard", "slot", "source", "block_index", "round", "n_tokens", F.col("pieces.doc_id").alias("doc_ids"), F.array_join("pieces.text", "").alias("text"))
