"""A catalog: descriptions of tables and the versions of their Parquet folders.

Versions are immutable. A rewrite writes new folders and a new description; the file `catalog.json` names the
current one and is replaced last, so a load that breaks off leaves the version before it whole.
"""

from __future__ import annotations

import json
import posixpath
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quadloom.functions import lexical
from quadloom.plans.model import Col, Group, PredicateMap, Table
from quadloom.sources.codecs import locate

#: Tables whose jobs run at the same time; each alone would leave a cluster idle.
PARALLEL = 8


@dataclass(frozen=True)
class Stored:
    table: Table
    path: str


@dataclass(frozen=True)
class Catalog:
    root: str
    tables: dict[str, Stored] = field(default_factory=dict)
    namespaces: dict[str, str] = field(default_factory=dict)
    step: int = 0
    version: int = 0

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        stored = self.tables[name]
        return spark.read.schema(schema_of(stored.table)).parquet(stored.path)

    def frames(self, spark: SparkSession) -> list[tuple[Table, DataFrame]]:
        return [(self.tables[n].table, self.read(spark, n)) for n in sorted(self.tables)]

    def renewed(self, made: list[tuple[Table, DataFrame]], step: int | None = None) -> Catalog:
        """Writes these tables as the next version."""
        version = self.version + 1

        def write(one: tuple[Table, DataFrame]) -> tuple[str, Stored]:
            table, df = one
            path = posixpath.join(self.root, f"v{version}", table.name)
            df.write.mode("overwrite").parquet(path)
            return table.name, Stored(table, path)

        with ThreadPoolExecutor(PARALLEL) as pool:
            tables = dict(pool.map(write, made))
        if len(tables) != len(made):
            raise ValueError("two tables have one name")
        return replace(self, tables=tables, version=version, step=self.step if step is None else step).saved()

    def saved(self) -> Catalog:
        fs, path = locate(posixpath.join(self.root, "catalog.json"))
        fs.create_dir(posixpath.dirname(path), recursive=True)
        with fs.open_output_stream(path + ".tmp") as out:
            out.write(json.dumps(self.plain(), indent=1).encode())
        try:
            fs.move(path + ".tmp", path)  # at once, where the file system can replace a file
        except OSError:
            if fs.get_file_info(path).type.name == "NotFound":
                raise
            # until the new one has its name, the old one can be found under another
            fs.copy_file(path, path + ".old")
            fs.delete_file(path)
            fs.move(path + ".tmp", path)
        return self

    def plain(self) -> dict:
        return {"step": self.step, "version": self.version, "namespaces": self.namespaces, "tables": [{"path": s.path, "table": asdict(s.table)} for _, s in sorted(self.tables.items())]}


def _group(x: dict) -> Group:
    return Group(tuple(Col(**c) for c in x["columns"]))


def table_from(x: dict) -> Table:
    predicates = tuple(PredicateMap(**{**p, "objects": _group(p["objects"])}) for p in x["predicates"])
    return Table(x["name"], _group(x["subject"]), x["subject_kind"], predicates, x.get("facts") or {})


def _current(root: str) -> tuple:
    """File system and path of the description: under its name, or where replacing it broke off, under the old one's."""
    fs, path = locate(posixpath.join(root, "catalog.json"))
    there = fs.get_file_info(path).type.name == "File"
    return (fs, path) if there or fs.get_file_info(path + ".old").type.name != "File" else (fs, path + ".old")


def exists(root: str) -> bool:
    fs, path = _current(root)
    return fs.get_file_info(path).type.name == "File"


def load(root: str) -> Catalog:
    fs, path = _current(root)
    with fs.open_input_file(path) as f:
        x = json.loads(f.read())
    tables = {t["table"]["name"]: Stored(table_from(t["table"]), t["path"]) for t in x["tables"]}
    return Catalog(root, tables, x["namespaces"], x["step"], x["version"])


def schema_of(t: Table) -> T.StructType:
    fields = [T.StructField(c.name, T._parse_datatype_string(lexical.spark_type(c.datatype))) for c in t.physical()]
    known = {f.name for f in fields}
    fields += [T.StructField(p.presence, T.BooleanType()) for p in t.predicates if p.presence and p.presence not in known]
    return T.StructType(fields or [T.StructField("_row", T.BooleanType())])


# --- listing: what a database's own catalog tables would say -------------------------------------------


def list_tables(spark: SparkSession, c: Catalog) -> DataFrame:
    rows = [(n, s.table.subject_kind, len(s.table.predicates), s.table.facts.get("rows")) for n, s in sorted(c.tables.items())]
    return spark.createDataFrame(rows, "table_name string, subject_kind string, predicates int, rows long")


def list_columns(spark: SparkSession, c: Catalog) -> DataFrame:
    rows = [(n, col.name, col.datatype, i) for n, s in sorted(c.tables.items()) for i, col in enumerate(s.table.physical())]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")
