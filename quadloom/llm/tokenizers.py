"""The public vocabularies, opened once per worker process."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

from quadloom.llm.textkit import Encoder

#: Folder of the vocabulary files; every operator takes it as a parameter.
VOCABULARIES = "/opt/tokenizers"
END_OF_TEXT = 50256
#: How the rank files split text before merging, as their public description gives it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def byte_bpe(folder: str = VOCABULARIES, name: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def byte_bpe_encoder(folder: str = VOCABULARIES, name: str = "byte_bpe_50k.tiktoken") -> Encoder:
    enc = byte_bpe(folder, name)
    return Encoder(lambda xs: [enc.encode_ordinary(x) for x in xs], np.uint16)


@functools.cache
def pieces(folder: str = VOCABULARIES, name: str = "piece_bpe_32k.model"):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))


@functools.cache
def piece_encoder(folder: str = VOCABULARIES, name: str = "piece_bpe_32k.model") -> Encoder:
    model = pieces(folder, name)
    # words are more than a byte vocabulary's pieces, and most of them are rare
    return Encoder(lambda xs: model.encode(xs, num_threads=1), np.uint16, 60_000)


@functools.cache
def byte_pieces(folder: str = VOCABULARIES, name: str = "piece_bpe_32k.model") -> np.ndarray:
    """Which ids of the piece vocabulary stand for single bytes."""
    model = pieces(folder, name)
    return np.array([model.is_byte(i) for i in range(model.vocab_size())])
