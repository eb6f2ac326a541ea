"""IRIs, names and literals: nothing is lost."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.functions import iri, lexical, naming

IRIS = [
    "http://example.org/a/b?q=1#f", "http://example.org", "http://example.org/", "http://u:p@h.org:8080/x", "http://u@h/", "https://[::1]:80/p", "urn:x:y", "urn:isbn:123#frag",
    "mailto:a@b.c", "file:///a/b", "http://a_b.c/x", "http://h/p%20q", "http://h?q", "http://h#f", "http://h/?", "http://h/#", "http://h:/x", "relative/path", "", "#f", "a b", "http://h/\n", "x:", "杭州:x", "http://杭州/路?问#答", "http://@h/",
]


def test_decompose_and_back(spark):
    df = spark.createDataFrame([(x,) for x in IRIS], "x string")
    parts = iri.decompose(F.col("x"))
    for r in df.select("x", iri.recompose(parts).alias("y"), *[c.alias(p) for p, c in parts.items()]).collect():
        assert r["y"] == r["x"]
        assert {p: r[p] for p in iri.PARTS} == iri.split(r["x"]), r["x"]
        # characters of a host-less IRI aren't kept twice
        assert (r["scheme_specific_part"] is None) != (r["host"] is None)


def test_null_iri(spark):
    df = spark.createDataFrame([(None,)], "x string")
    assert list(df.select(*iri.decompose(F.col("x")).values()).first()) == [None] * 9


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text("ahtp:/?#@[]%._ 0", max_size=30), st.from_regex(r"[a-z]+://([a-z]*@)?[a-z.]+(:[0-9]*)?(/[a-z]*)?(\?[a-z]*)?(#[a-z]*)?", fullmatch=True)))
def test_split_and_join(x):
    assert iri.join(iri.split(x)) == x


def test_gyear_is_four_digits_with_its_sign(spark):
    years = [0, 9, 99, 100, 999, 1000, -1, -10, -100, -999, -1000, 12345, None]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    assert [r[0] for r in df.select(lexical.gyear(F.col("y"))).collect()] == ["0000", "0009", "0099", "0100", "0999", "1000", "-0001", "-0010", "-0100", "-0999", "-1000", "12345", None]


@pytest.mark.parametrize(("form", "datatype", "kept"), [("7", "INTEGER", True), ("07", "INTEGER", False), ("+7", "INTEGER", False), ("x", "INTEGER", False), ("2147483648", "INTEGER", False), ("2147483648", "BIGINT", True), ("true", "BOOLEAN", True), ("1", "BOOLEAN", False), ("2023-06-23", "DATE", True), ("2023-6-23", "DATE", False), ("1.50", "NUMERIC:2", True), ("1.5", "NUMERIC:2", False), ("0099", "GYEAR", True), ("99", "GYEAR", False), (None, "INTEGER", True)])
def test_a_type_is_right_only_if_the_form_comes_back(spark, form, datatype, kept):
    df = spark.createDataFrame([(form,)], "x string")
    assert df.select(lexical.keeps_form(F.col("x"), datatype)).first()[0] is kept


def test_names():
    ns = {"ex": "http://example.org/", "exa": "http://example.org/a/"}
    assert naming.sql_name(lexical.XSD + "gYear", ns) == "xsd_gyear"
    assert naming.sql_name("http://example.org/a/Name", ns) == "exa_name"  # the longest fits
    assert naming.sql_name("http://example.org/b", ns) == "ex_b"
    for odd in ("http://other.org/x-y", "http://example.org/a-b", "http://example.org/a b"):
        assert re.fullmatch(r"[0-9A-Za-z_]+", naming.sql_name(odd, ns))
    assert naming.sql_name("http://example.org/a-b", ns) != naming.sql_name("http://example.org/a_b", ns)
    assert naming.class_name("http://example.org/Dog", ns, 1) == "type_ex_Dog"
    assert naming.class_name("urn:dog", ns, 3) == "type_type_3"
    assert naming.language_part("en-UK") == "en_UK"
