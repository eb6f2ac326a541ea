"""Compressed byte streams by file name."""

from __future__ import annotations

import bz2
import gzip
import lzma
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs

#: What Spark's text reader inflates itself.
SPARK_READS = ("", "gz", "bz2")
EXTENSIONS = ("gz", "bz2", "xz", "lz4", "zstd", "zst")


def codec(name: str) -> str:
    """Extension of the codec that a file name ends in, or ''."""
    last = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return last if last in EXTENSIONS else ""


def without_codec(name: str) -> str:
    """The file name without the extension of its codec."""
    c = codec(name)
    return name[: -len(c) - 1] if c else name


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def open_stream(uri: str) -> BinaryIO:
    """The inflated bytes of a file of any file system that Arrow knows."""
    fs, path = locate(uri)
    raw, c = fs.open_input_file(path), codec(uri)
    if c == "gz":
        return gzip.GzipFile(fileobj=raw, mode="rb")
    if c == "bz2":
        return bz2.BZ2File(raw)
    if c == "xz":
        return lzma.LZMAFile(raw)
    if c:
        return pa.CompressedInputStream(raw, "lz4" if c == "lz4" else "zstd")
    return raw
