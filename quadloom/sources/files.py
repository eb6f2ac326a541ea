"""RDF files and manifests as quads."""

from __future__ import annotations

import codecs as codecs_of_text
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.naming import DEFAULT_NAMESPACES
from quadloom.session import prepare
from quadloom.sources import codecs, lines, rdfxml, turtle

FORMATS = {"nt": "lines", "nq": "lines", "ntriples": "lines", "nquads": "lines", "ttl": "turtle", "turtle": "turtle", "trig": "turtle", "rdf": "xml", "rdfs": "xml", "owl": "xml", "xml": "xml"}
_ARROW = pa.schema([(c, pa.string()) for c in lines.COLUMNS])
_BATCH = 8_192


class ManifestFault(ValueError):
    """A manifest line that isn't a path, a tab and a graph IRI."""


class FormatFault(ValueError):
    """A file whose name tells no RDF format."""


def format_of(path: str) -> str:
    name = codecs.without_codec(path.rsplit("/", 1)[-1])
    try:
        return FORMATS[name.rsplit(".", 1)[-1].lower()]
    except KeyError:
        raise FormatFault(f"the name of {path} tells no RDF format") from None


def read_manifest(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, graph IRI) of each line that isn't blank."""
    out = []
    for row in spark.read.text(path).collect():  # a list of files
        if not row["value"].strip():
            continue
        fields = row["value"].split("\t")
        if len(fields) != 2 or not all(f.strip() for f in fields):
            raise ManifestFault(f"no path, tab and graph: {row['value']!r}")
        out.append((fields[0].strip(), fields[1].strip()))
    return out


def _open(kind: str, path: str):
    return (turtle if kind == "turtle" else rdfxml).Parser(codecs.open_stream(path), base="" if kind == "turtle" else path, scope=path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, graph, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = []
            for quad in _open(kind, path):
                rows.append((*quad[:7], graph if quad[7] is None else quad[7]))
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=_ARROW)


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, graph in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with codecs.open_stream(path) as stream:
                rest = b""
                while piece := stream.read(1 << 20):
                    *whole, rest = (rest + piece).split(b"\n")
                    if whole:
                        yield pa.RecordBatch.from_pydict({"value": [x.decode("utf-8", "replace") for x in whole], "path": [path] * len(whole), "graph": [graph] * len(whole)})
                if rest:
                    yield pa.RecordBatch.from_pydict({"value": [rest.decode("utf-8", "replace")], "path": [path], "graph": [graph]})


def _one_task_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A file that can't be split is a task."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def read_files(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """Quads of all files; each statement without a graph gets its file's.

    N-Triples and N-Quads, plain or gz or bz2, are split and parsed in the JVM; under other codecs they are
    inflated by a task each and then parsed alike. Turtle, TriG and RDF/XML are parsed as streams, a task each.
    A syntax fault in those fails the read: nothing is left out in silence.
    """
    prepare(spark)
    parts: list[DataFrame] = []
    by_graph: dict[str, list[str]] = {}
    inflate, parse = [], []
    for path, graph in files:
        kind = format_of(path)
        if kind != "lines":
            parse.append((path, graph, kind))
        elif codecs.codec(path) in codecs.SPARK_READS:
            by_graph.setdefault(graph, []).append(path)
        else:
            inflate.append((path, graph))
    for graph, paths in sorted(by_graph.items()):
        text = spark.read.text(paths)
        parts.append(lines.parse_lines(text.select("value", F.col("_metadata.file_path").alias("path")), F.lit(graph), F.col("path")))
    if inflate:
        text = _one_task_each(spark, inflate, "path string, graph string").mapInArrow(_inflate, "value string, path string, graph string")
        parts.append(lines.parse_lines(text, F.col("graph"), F.col("path")))
    if parse:
        parts.append(_one_task_each(spark, parse, "path string, graph string, kind string").mapInArrow(_parse, lines.QUADS))
    if not parts:
        return spark.createDataFrame([], lines.QUADS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_DECLARED = re.compile(r"(?im)^\s*@?prefix\s+([\w.-]*):\s*<([^>]*)>|xmlns:([\w.-]+)\s*=\s*[\"']([^\"']*)[\"']")
#: Text is searched in pieces, which overlap by as much as a declaration may be long.
_PIECE, _OVERLAP = 1 << 20, 1 << 13


def declared_namespaces(stream) -> Iterator[tuple[str, str]]:
    """Prefix and IRI of each declaration anywhere in a stream, each pair once."""
    seen, kept, decode = set(), "", codecs_of_text.getincrementaldecoder("utf-8")("replace")
    while True:
        data = stream.read(_PIECE)
        kept += decode.decode(data, not data)
        for m in _DECLARED.finditer(kept):
            pair = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
            if pair not in seen:
                seen.add(pair)
                yield pair
        if not data:
            return
        # cut at a line end, so that a line's begin is one in the next piece too
        cut = kept.rfind("\n", 0, max(0, len(kept) - _OVERLAP))
        kept = kept[cut + 1 :] if cut >= 0 else kept[-2 * _OVERLAP :]


def harvest_namespaces(spark: SparkSession, files: list[tuple[str, str]]) -> dict[str, str]:
    """Prefixes that Turtle and RDF/XML files declare anywhere; the given ones win, then the first file."""
    prepare(spark)
    some = [(p, format_of(p)) for p, _ in files if format_of(p) != "lines"]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(declared_namespaces(codecs.open_stream(path)))
                yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "prefix": [a for a, _ in found], "iri": [b for _, b in found]}, pa.schema([("path", pa.string()), ("prefix", pa.string()), ("iri", pa.string())]))

    out = dict(DEFAULT_NAMESPACES)
    if some:
        rows = _one_task_each(spark, some, "path string, kind string").mapInArrow(heads, "path string, prefix string, iri string").distinct().orderBy("path", "prefix", "iri")
        for r in rows.collect():  # declarations only
            if r["prefix"] and r["iri"]:
                out.setdefault(r["prefix"], r["iri"])
    return out


def normalise_blank_nodes(quads: DataFrame) -> DataFrame:
    """Blank node labels, which belong to their file, as numbers that are dense and don't depend on the order of files' rows."""
    from quadloom.session import dense_numbers

    labels = quads.where("s_kind = 'BNODE'").select(F.col("s").alias("label")).unionAll(quads.where("o_kind = 'BNODE'").select("o"))
    ids = dense_numbers(labels, ["label"])
    s = ids.select(F.col("label").alias("_ls"), F.col("id").alias("_is"))
    o = ids.select(F.col("label").alias("_lo"), F.col("id").alias("_io"))
    is_s, is_o = (F.col(k).eqNullSafe("BNODE") for k in ("s_kind", "o_kind"))
    # quads without blank nodes aren't shuffled; where one term is none, a value that no label has spreads the rows
    other = F.concat(F.lit("\u0000"), F.xxhash64("s", "p", "o").cast("string"))
    some = quads.where(is_s | is_o).withColumn("_ks", F.when(is_s, F.col("s")).otherwise(other)).withColumn("_ko", F.when(is_o, F.col("o")).otherwise(other))
    joined = some.join(s, F.col("_ks") == F.col("_ls"), "left").join(o, F.col("_ko") == F.col("_lo"), "left")
    name = lambda i, c: F.coalesce(F.concat(F.lit("_:b"), F.col(i).cast("string")), F.col(c)).alias(c)
    named = joined.select("s_kind", name("_is", "s"), "p", "o_kind", name("_io", "o"), "o_dt", "o_lang", "g")
    return named.unionAll(quads.where(~(is_s | is_o)).select(*named.columns))
