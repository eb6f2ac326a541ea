"""Each registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quadloom import queries


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    want = db.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), names)


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["type"] and df.count() == 5


def test_registry_lives_without_the_other_subpackage():
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('quadloom.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'mapping_view' in e.queries() and not any(q.startswith('op') for q in e.queries()) and set(e.oracle_sql()) == set(e.queries())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
