"""What must not grow with the tables: work done again for each part, column or line."""

import os

from pyspark.sql import functions as F

from quadloom.functions import iri, lexical
from quadloom.functions.lexical import RDF, XSD
from quadloom.operators import layout, merge, statistics, terms
from quadloom.session import shared_folder
from quadloom.sources import lines


def _rows(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_iri_is_matched_once_and_kept_whole(spark):
    values = ["http://h:80\n", "http://[::1]\n", "http://u@h:8/p?q#f#g", "http://@h", "urn:x#", "//h/p", "", "http://h:80x/"]
    df = _rows(spark, values)
    parts = iri.decompose(F.col("v"))
    assert "regexp_extract" not in _plan(df.select(*[c.alias(p) for p, c in parts.items()]))
    got = df.select("v", *[c.alias(p) for p, c in parts.items()], iri.recompose(parts).alias("back")).collect()
    assert [r["back"] for r in got] == values
    assert all(iri.split(r["v"]) == {p: r[p] for p in iri.PARTS} for r in got)


def test_forms_that_no_type_has_are_not_cast(spark):
    values = ["/path", "7", "07", "2147483648", "-2147483648", "99999999999", "-0", None]
    kept = _rows(spark, values).select(lexical.keeps_form(F.col("v"), "INTEGER").alias("i"), lexical.keeps_form(F.col("v"), "GYEAR").alias("g")).collect()
    assert [r["i"] for r in kept] == [False, True, False, False, True, False, False, True]
    assert [r["g"] for r in kept] == [False, False, False, False, True, False, False, True]
    # a failed cast costs an exception, so it is behind a look at the form
    assert "RLIKE" in _plan(_rows(spark, values).select(lexical.keeps_form(F.col("v"), "INTEGER")))


def test_a_table_of_many_rows_has_many_files(spark, monkeypatch):
    monkeypatch.setattr(layout, "FILE_ROWS", 10)
    quads = spark.range(100).select(F.lit("IRI").alias("s_kind"), F.concat(F.lit("urn:"), "id").alias("s"), F.lit("urn:p").alias("p"), F.lit("IRI").alias("o_kind"), F.lit("urn:o").alias("o"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"), F.lit("urn:g").alias("g"))
    root = shared_folder(spark, "growth")
    (_, df), = layout.partition(spark, quads, root, {})
    files = [f for f in os.listdir(root.removeprefix("file://") + "/quads/tbl=0") if f.endswith(".parquet")]
    assert len(files) >= 10 and df.count() == 100


def test_statistics_of_constants_and_others(spark):
    t = terms.new_table("urn:p", "p", "IRI", "LITERAL", None, XSD + "int")
    q = spark.createDataFrame([(f"http://e/7#{i}", v, XSD + "int", None, "urn:g") for i, v in enumerate(["3", "3", "5"])], "s string, o string, o_dt string, o_lang string, g string")
    s = statistics.statistics(terms.encode(q, t), t)
    assert s["subject_p_path"] == statistics.Stat(3, 3, "/7", "/7", False, "INTEGER") and s["subject_p_query"] == statistics.Stat(3, 0, None, None, False, "INTEGER")
    assert s["subject_p_fragment"] == statistics.Stat(3, 3, "0", "2", True, "INTEGER") and s["object_pxsd_int_litvalue"] == statistics.Stat(3, 3, "3", "5", True, "INTEGER")
    empty = statistics.statistics(terms.encode(q.where("s = ''"), t), t)
    assert all((x.rows, x.present, x.least, x.fits) == (0, 0, None, False) for x in empty.values())


def _tables(spark, n):
    out = []
    for i in range(n):
        t = terms.new_table(f"urn:p{i}", f"p{i}", "IRI", "IRI", None, None)
        rows = [(f"http://e/x#{k}", "urn:o", None, None, "urn:g") for k in {i % 3, 7}] + ([("http://e/x#7", "urn:o2", None, None, "urn:g")] if i == 1 else [])
        out.append((t, terms.encode(spark.createDataFrame(rows, "s string, o string, o_dt string, o_lang string, g string"), t)))
    return out


def test_patterns_by_bits_are_those_by_lists(spark, monkeypatch):
    tables = _tables(spark, 5)
    want = merge._listed(tables)
    assert want[1] == {1} and want[0][frozenset(range(5))] == 1
    monkeypatch.setattr(merge, "BITS", 2)  # several numbers
    assert merge.patterns(tables) == want
    monkeypatch.setattr(merge, "WORDS", 1)  # too many tables
    assert merge.patterns(tables) == want


def test_a_filter_does_not_parse_a_line_again(spark):
    df = _rows(spark, [r'<a> <b> "x\"y"@en <g> .', '<a> <b> "x .', "<a> <b> _:c.", '<a> <b> "1"^^<d> .'], "value")
    q = lines.parse_lines(df, F.lit("urn:g"), F.lit("s")).where("s_kind = 'IRI' AND o_kind = 'LITERAL'")
    assert "Generate" in _plan(q)  # what is above it is made from parts that were found once
    assert sorted((r["o"], r["o_dt"], r["o_lang"], r["g"]) for r in q.collect()) == [("1", "d", None, "urn:g"), ('x"y', RDF + "langString", "en", "g")]
    assert [r["value"] for r in lines.rejects(df).collect()] == ['<a> <b> "x .']
