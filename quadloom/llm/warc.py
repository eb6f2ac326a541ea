"""Operator 5: normaliser of WARC files that were gzipped as one stream.

A file whose records share one gzip member can only be read from its start. The normaliser inflates
such a file once, as a stream, writes every record as a gzip member of its own, and notes where each
member begins, so that any record can then be read alone.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import filesystem, materialise, prepare, publish, shared_dir, table

_PIECE = 1 << 18
_INDEX = "file string, record_no long, offset long, length long, record_id string, warc_type string, target_uri string, block_bytes long, block_md5 string, status string"
_INDEX_ARROW = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("block_bytes", pa.int64()), ("block_md5", pa.string()), ("status", pa.string())])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _record(page_id, url, html) -> bytes:
    block = b"" if html is None else _HTTP + html.encode()
    head = ["WARC/1.0", "WARC-Type: " + ("metadata" if html is None else "response"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else f"WARC-Target-URI: {url}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _monolith(to: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = filesystem(to)
        fs.create_dir(folder, recursive=True)
        name = f"pages-{task.partitionId():05d}.warc.gz"
        tmp, n = posixpath.join(folder, f"{name}.{task.taskAttemptId()}.tmp"), 0
        with fs.open_output_stream(tmp) as out:
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(squeeze.compress(_record(*row)))
                    n += 1
            out.write(squeeze.flush())
        publish(fs, tmp, posixpath.join(folder, name))
        yield pa.RecordBatch.from_pydict({"file": [posixpath.join(to, name)], "records": [n]}, pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return write


def write_monoliths(pages: DataFrame, to: str) -> DataFrame:
    """One whole-file gzip WARC for each partition of `pages` (page_id, url, html); rows (file, records).

    A null html gives a metadata record without block, a null url none of that header, a null id an
    empty one; repeated rows are repeated records.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return materialise(rows.mapInArrow(_monolith(to), "file string, records long"), "monoliths")


class _Inflated(io.RawIOBase):
    """The bytes of all members of a gzip stream, up to where it ends or can't be read on; then `cut` says which."""

    def __init__(self, source) -> None:
        self.source, self.inflate, self.left, self.begun, self.cut = source, zlib.decompressobj(31), b"", False, False

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.cut:
            if not self.left:
                self.left = self.source.read(_PIECE)
                if not self.left:
                    self.cut = self.begun
                    return 0
            if self.inflate.eof:
                # zeros may fill up a file behind its last member
                self.left = self.left.lstrip(b"\0")
                if not self.left:
                    continue
                self.inflate, self.begun = zlib.decompressobj(31), False
            try:
                data = self.inflate.decompress(self.left, len(into))
            except zlib.error:
                self.cut = True
                return 0
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.begun = not self.inflate.eof
            if data:
                into[: len(data)] = data
                return len(data)
        return 0


def _line(source: io.BufferedReader) -> bytes:
    """The next line, however long it is; empty at the end."""
    line = source.readline(_PIECE)
    if len(line) < _PIECE or line.endswith(b"\n"):
        return line
    pieces = [line]
    while pieces[-1] and not pieces[-1].endswith(b"\n"):
        pieces.append(source.readline(_PIECE))
    return b"".join(pieces)


def _skip(source: io.BufferedReader, line: bytes) -> tuple[int, bytes]:
    """Goes on from a line that begins no record to the next one that does: bytes left out, and that line or nothing."""
    skipped = 0
    while line and not line.startswith(b"WARC/"):
        skipped += len(line)
        while line and not line.endswith(b"\n"):  # in pieces, for what isn't text may have no lines
            line = source.readline(_PIECE)
            skipped += len(line)
        line = source.readline(_PIECE)
    return skipped, line


def normalise_file(source, out) -> Iterator[tuple]:
    """Rewrites one stream; yields (record_no, offset, length, id, type, uri, bytes, md5, status).

    Records go to `out` piece by piece, so none is held whole. What lies between records is left out and gives a row `garbage`
    with its bytes. A record that the stream ends in is kept as far as it goes, as a member of its own, under status `truncated`.
    """
    raw = _Inflated(source)
    inflated = io.BufferedReader(raw, _PIECE)
    offset = n = 0
    while True:
        line = inflated.readline(_PIECE)
        while line in (b"\r\n", b"\n"):
            line = inflated.readline(_PIECE)
        if line and not line.startswith(b"WARC/"):
            skipped, line = _skip(inflated, line)
            yield n, offset, 0, None, None, None, skipped, None, "garbage"
            n += 1
        if not line:
            if raw.cut:
                yield n, offset, 0, None, None, None, 0, None, "truncated"
            return
        squeeze, digest, length = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.md5(usedforsecurity=False), 0

        def put(data: bytes) -> int:
            out.write(data)
            return len(data)

        fields, status = {}, "ok"
        while line not in (b"\r\n", b"\n"):
            length += put(squeeze.compress(line))  # noqa: B023
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
            line = _line(inflated)
            if not line:
                status = "truncated"
                break
        length += put(squeeze.compress(b"\r\n"))
        said = fields.get("content-length", "0")
        left, size = int(said) if said.isdigit() and status == "ok" else 0, 0
        while left:
            piece = inflated.read(min(left, _PIECE))
            if not piece:
                status = "truncated"
                break
            digest.update(piece)
            length += put(squeeze.compress(piece))
            left -= len(piece)
            size += len(piece)
        length += put(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
        yield n, offset, length, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), size, digest.hexdigest(), status
        offset, n = offset + length, n + 1
        if status != "ok":
            return


def rewritten_name(path: str) -> str:
    """Name of the rewritten file: that of the file, after a hash of its whole path, so that no two files meet."""
    return f"{hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()}-{posixpath.basename(path)}"


def _normaliser(to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if name is None:
                    continue
                fs, path = filesystem(name)
                into, folder = filesystem(to)
                into.create_dir(folder, recursive=True)
                made = rewritten_name(name)
                final = posixpath.join(folder, made)
                tmp, spots = f"{final}.{attempt}.tmp", []
                with fs.open_input_file(path) as source, into.open_output_stream(tmp) as out:
                    rows = []
                    for r in normalise_file(source, out):
                        rows.append(dict(zip(_INDEX_ARROW.names, (posixpath.join(to, made), *r), strict=True)))
                        spots += [(r[1], r[2])] if r[-1] == "ok" else []
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, _INDEX_ARROW)
                            rows = []
                with into.open_output_stream(f"{tmp}.idx") as out:
                    out.write(np.array(spots, "<i8").tobytes())
                publish(into, f"{tmp}.idx", f"{final}.idx")
                publish(into, tmp, final)
                yield pa.RecordBatch.from_pylist(rows, _INDEX_ARROW)

    return run


def normalise(files: DataFrame, to: str) -> DataFrame:
    """Rewrites the files named in column `file`, each by one task; returns the offset index.

    Beside each rewritten file lies `<file>.idx`, pairs of int64 (offset, length); the rows returned
    are also kept as the Parquet table `<to>/index`. Files of one name in different folders stay apart. A stream that ends
    within a record gives all whole records and a row of status `truncated`; where it holds something else than a
    record, a row `garbage`, and it is read on from the next line that begins one. Files of several members, empty files and records without block are read
    like any other. A file named twice is rewritten once; null names and other columns are ignored. A file is
    written under a name of the attempt and renamed, so repeated tasks agree.
    """
    spark = files.sparkSession
    prepare(spark)
    names = files.select(F.col("file").cast("string").alias("file")).distinct()
    # a file is the unit of work: as many partitions as files, up to what a stage can well hold
    n = max(1, min(names.count(), 20_000))
    names.repartition(n, "file").mapInArrow(_normaliser(to), _INDEX).write.mode("overwrite").parquet(f"{to}/index")
    return spark.read.parquet(f"{to}/index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
    for batch in batches:
        rows, opened = [], {}
        for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name not in opened:
                fs, path = filesystem(name)
                opened[name] = fs.open_input_file(path)
            opened[name].seek(offset)
            record = gzip.decompress(opened[name].read(length))
            head, _, rest = record.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            page = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
            html = None if fields["WARC-Type"] == "metadata" else rest[: int(fields["Content-Length"])][len(_HTTP) :].decode()
            rows.append({"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "html": html})
        for f in opened.values():
            f.close()
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(index: DataFrame) -> DataFrame:
    """The pages behind rows of the index (file, offset, length), each read by seeking to its member."""
    prepare(index.sparkSession)
    at = index.where("status = 'ok'").select("file", "offset", "length")
    return at.mapInArrow(_read, "page_id long, url string, html string")


def op5_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_monoliths(table(spark, sf_dir, "pages"), shared_dir(spark, "warc-whole"))
    index = normalise(files, shared_dir(spark, "warc"))
    return index.select(F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).cast("long").alias("page_id"), *index.columns)


def warc_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rewritten files hold, read record by record through the index."""
    files = write_monoliths(table(spark, sf_dir, "pages"), shared_dir(spark, "warc-whole"))
    pages = read_records(normalise(files, shared_dir(spark, "warc")))
    return pages.select("page_id", "url", F.md5(F.encode("html", "UTF-8")).alias("html_md5"), F.octet_length("html").cast("long").alias("html_bytes"))


READ_BACK_SQL = "SELECT page_id, url, md5(html) AS html_md5, CAST(strlen(html) AS BIGINT) AS html_bytes FROM pages"
