"""The load: twelve steps from a manifest to an improved layout and its mapping, resumable after each."""

from __future__ import annotations

import contextlib
import posixpath
import sys
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import layout, merge, rewrites
from quadloom.plans import catalog as cat
from quadloom.plans import description, r2rml
from quadloom.plans.catalog import Catalog
from quadloom.sources import files
from quadloom.sources.codecs import locate

STEPS = ("parse", "graphs", "optimise", "mapping", "merge", "mapping", "optimise again", "mapping", "schemes", "hosts", "clustering", "compaction")
#: Exit codes of the command line.
NO_FORMAT, NO_DATABASE, NO_FILE, BAD_MANIFEST, FAILED = 1, 2, 5, 7, 9


def put_text(uri: str, text: str) -> None:
    fs, path = locate(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(text.encode())


def load_quads(spark: SparkSession, quads: DataFrame, root: str, namespaces: dict[str, str]) -> Catalog:
    """Step 0 for quads that are a DataFrame already."""
    made = layout.partition(spark, quads, posixpath.join(root, "raw"), namespaces)
    return Catalog(root, namespaces=namespaces).renewed(made, step=0)


def _split(spark: SparkSession, c: Catalog, tables: list) -> list:
    used = {n.lower() for n in c.tables}
    out = []
    for t, df in tables:
        out += layout.split_classes(spark, t, df, posixpath.join(c.root, f"v{c.version + 1}-classes"), c.namespaces, used)
    return out


def _dimension(spark: SparkSession, c: Catalog, part: str) -> Catalog:
    """Values of a part of IRIs in all tables, subjects too, as a table of its own beside the others."""
    frames = []
    for t, df in c.frames(spark):
        for g in t.groups():
            col = g.column(part)
            if col is not None and not col.virtual:
                frames.append(df.select(F.concat(F.lit(col.prefix), F.col(f"`{col.name}`").cast("string")).alias(part)))
    if frames:
        rewrites.dimension(frames, part, part).orderBy(part).write.mode("overwrite").parquet(posixpath.join(c.root, f"dim-{part}"))
    return c


def _dictionary(spark: SparkSession, c: Catalog) -> Catalog:
    """The graphs with dense numbers, in the order of their IRIs. Tables keep the IRI, which Parquet encodes as a number itself."""
    from quadloom.session import dense_numbers

    frames, constants = [], set()
    for t, df in c.frames(spark):
        for p in t.predicates:
            col = p.objects.column("graph")
            if col.virtual:
                constants.add(col.value)
            else:
                frames.append(df.select(F.concat(F.lit(col.prefix), F.col(f"`{col.name}`")).alias("iri")))
    frames.append(spark.createDataFrame([(v,) for v in sorted(constants)], "iri string"))
    dense_numbers(rewrites.dimension(frames, "iri", "iri"), ["iri"]).write.mode("overwrite").parquet(posixpath.join(c.root, "dim-graphs"))
    predicates = sorted({p.predicate for s in c.tables.values() for p in s.table.predicates})
    spark.createDataFrame(list(enumerate(predicates)), "id long, iri string").write.mode("overwrite").parquet(posixpath.join(c.root, "dim-predicates"))
    return c


def _optimised(c: Catalog, spark: SparkSession, tables: list, steps: tuple[str, ...]) -> list:
    from concurrent.futures import ThreadPoolExecutor

    def one(x):
        t, df = rewrites.optimise(x[1], x[0], steps)
        return t, rewrites.set_semantics(df, t)

    with ThreadPoolExecutor(cat.PARALLEL) as pool:
        return list(pool.map(one, tables))


def _compacted(c: Catalog, spark: SparkSession) -> list:
    """Tables in files of about the advisory partition size, rows in ranges of the subject where it has columns."""
    made = []
    for t, df in c.frames(spark):
        keys = [f"`{x.name}`" for x in t.subject.physical()]
        made.append((t, df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df.hint("rebalance")))
    return made


def copy_to(spark: SparkSession, c: Catalog, root: str) -> Catalog:
    """A compacted copy of all tables, with their mapping and dictionaries, below another root; it stands alone."""
    if posixpath.normpath(root) == posixpath.normpath(c.root):
        raise ValueError("a copy needs a root of its own")
    new = Catalog(root, {}, c.namespaces, c.step, 0).renewed(_compacted(c, spark))
    for name in ("dim-graphs", "dim-predicates"):
        with contextlib.suppress(AnalysisException):  # made by the first step
            spark.read.parquet(posixpath.join(c.root, name)).write.mode("overwrite").parquet(posixpath.join(root, name))
    tables = [s.table for s in new.tables.values()]
    put_text(posixpath.join(root, "r2rml.ttl"), r2rml.write(new))
    put_text(posixpath.join(root, "description.ttl"), description.to_turtle(tables))
    return new


def run_step(spark: SparkSession, c: Catalog, step: int) -> Catalog:
    if step == 1:
        c = _dictionary(spark, c)
    elif step in (2, 6):
        # types are looked at once: what merging brings together had its types before
        steps = rewrites.STEPS if step == 2 else ("constants", "prefixes")
        tables = _split(spark, c, c.frames(spark))
        c = c.renewed(_optimised(c, spark, tables, steps))
    elif step in (3, 5, 7):
        put_text(posixpath.join(c.root, "r2rml.ttl"), r2rml.write(c))
    elif step == 4:
        c = c.renewed(merge.merge(c.frames(spark)))
    elif step in (8, 9):
        c = _dimension(spark, c, "scheme" if step == 8 else "host")
    elif step == 10:
        # the counterpart of an index: rows in ranges of the subject, whose bounds the files' footers hold
        made = []
        for t, df in c.frames(spark):
            keys = [f"`{x.name}`" for x in t.subject.physical()]
            unique = merge.repeated_subject(df, t).isEmpty()
            made.append((t.with_facts(unique=unique), df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df))
        c = c.renewed(made)
    elif step == 11:
        c = c.renewed(_compacted(c, spark))
    c = replace(c, step=step).saved()
    put_text(posixpath.join(c.root, "description.ttl"), description.to_turtle([s.table for s in c.tables.values()]))
    return c


def load(spark: SparkSession, manifest: list[tuple[str, str]], root: str, step: int = 0, last: int = len(STEPS) - 1) -> Catalog:
    """All steps (step 0), or one step on what an earlier load left. Parsing is left out if it was done before."""
    if step:
        return run_step(spark, cat.load(root), step)
    if cat.exists(root):
        c = cat.load(root)
    else:
        quads = files.normalise_blank_nodes(files.read_files(spark, manifest))
        c = load_quads(spark, quads, root, files.harvest_namespaces(spark, manifest))
    for n in range(c.step + 1, last + 1):
        c = run_step(spark, c, n)
    return c


def main(argv: list[str]) -> int:
    """MANIFEST ROOT [STEP]: loads; `query ROOT SPARQL`: prints rows as tab-separated text."""
    if len(argv) < 2:
        print(main.__doc__, file=sys.stderr)
        return NO_FILE
    spark = SparkSession.builder.appName("quadloom").getOrCreate()
    try:
        if argv[0] == "query":
            from quadloom.plans import sparql

            if not cat.exists(argv[1]):
                return NO_DATABASE
            rows = sparql.select(spark, cat.load(argv[1]).frames(spark), argv[2])
            print("\t".join(rows.columns))
            for r in rows.toLocalIterator():
                print("\t".join("" if v is None else v for v in r))
            return 0
        step = int(argv[2]) if len(argv) > 2 else 0
        if step and not cat.exists(argv[1]):
            return NO_DATABASE
        load(spark, [] if step else files.read_manifest(spark, argv[0]), argv[1], step)
        return 0
    except files.ManifestFault as e:
        print(e, file=sys.stderr)
        return BAD_MANIFEST
    except files.FormatFault as e:
        print(e, file=sys.stderr)
        return NO_FORMAT
    except Exception as e:
        print(e, file=sys.stderr)
        return FAILED
