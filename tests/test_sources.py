"""Readers of RDF files: each format against what it says, and all against each other."""

import bz2
import gzip
import io
import lzma

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadloom.functions.lexical import RDF, XSD
from quadloom.sources import codecs, database, files, lines, rdfxml, turtle

EX = "http://example.org/"


def parse(text, **options):
    return list(turtle.Parser(io.BytesIO(text.encode()), **options))


def test_turtle():
    q = parse(
        """@prefix ex: <http://example.org/> . # comment
        PREFIX x: <http://x.org/>
        @base <http://base.org/d/> .
        ex:a a ex:C ; ex:p "s" , 'it''s'@en-GB , \"\"\"long "quoted"
        text\"\"\" ; ex:n 1 , -1.5 , 1e3 , true , "2020"^^<http://www.w3.org/2001/XMLSchema#gYear> ;; .
        <rel> ex:q [ ex:r ( 1 ex:b ) ] , _:l .
        _:l ex:s "esc\\t\\u0041\\U0001F600\\\\n" .
        x:with\\-dash ex:p ex:dot.ted .
        [ ex:t ex:u ] .
        """.replace("'it''s'", "'its'"),
        scope="f",
    )
    o = [(r[3], r[4], r[5], r[6]) for r in q if r[1] == EX + "a"]
    assert ("IRI", EX + "C", None, None) in o and ("LITERAL", "its", RDF + "langString", "en-GB") in o
    assert any('long "quoted"' in x[1] for x in o)
    assert {(x[1], x[2]) for x in o} >= {("1", XSD + "integer"), ("-1.5", XSD + "decimal"), ("1e3", XSD + "double"), ("true", XSD + "boolean"), ("2020", XSD + "gYear")}
    assert any(r[1] == "http://base.org/d/rel" for r in q)
    assert [r[4] for r in q if r[2] == EX + "s"] == ["esc\tA😀\\n"]
    assert any(r[1] == "http://x.org/with-dash" and r[4] == EX + "dot.ted" for r in q)
    assert sum(r[2] == RDF + "first" for r in q) == 2 and sum(r[4] == RDF + "nil" for r in q) == 1
    assert len({r[1] for r in q if r[2] == EX + "t"}) == 1


def test_trig():
    q = parse("@prefix e: <http://example.org/> . e:a e:p e:b . e:g { e:a e:p e:c . e:d e:p e:f } GRAPH <urn:h> { e:x e:p 1 . } { e:y e:p 2 }")
    assert [(r[1][-1], r[7]) for r in q] == [("a", None), ("a", EX + "g"), ("d", EX + "g"), ("x", "urn:h"), ("y", None)]


def test_tokens_do_not_depend_on_pieces():
    text = '@prefix e: <http://example.org/> .\n' + "".join(f'e:s{i} e:p "v {i} \\" é", {i}.5, e:o{i}. e:s{i} e:q """a\n"{i}" b""", "".\n' for i in range(200))
    whole = parse(text)
    kinds = list(turtle.tokens(io.BytesIO(text.encode()), 1 << 20))
    for piece in (7, 64, 1000):
        assert list(turtle.tokens(io.BytesIO(text.encode()), piece)) == kinds
    assert len(whole) == 1000


@pytest.mark.parametrize("bad", ["<a> <b> .", "x:a x:b x:c .", "<a> <b> \"open .", "<a> <b> <c>"])
def test_faults_are_raised(bad):
    with pytest.raises(turtle.SyntaxFault):
        parse(bad)


def test_rdfxml():
    text = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{RDF}" xmlns:e="{EX}" xml:base="http://b.org/d" xml:lang="en">
    <e:C rdf:about="x" e:attr="v"><e:p rdf:resource="#y"/><e:q rdf:datatype="{XSD}int">5</e:q><e:r>hi</e:r>
      <e:n><rdf:Description rdf:nodeID="k"><e:m xml:lang="">plain</e:m></rdf:Description></e:n>
      <e:res rdf:parseType="Resource"><e:in>1</e:in></e:res><e:list rdf:parseType="Collection"><e:D rdf:ID="i"/></e:list><e:xml rdf:parseType="Literal"><b>t</b></e:xml><e:em e:z="w"/><e:st rdf:ID="stmt">s</e:st></e:C>
    <rdf:Bag rdf:nodeID="k"><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Bag></rdf:RDF>"""
    q = list(rdfxml.Parser(io.BytesIO(text.encode()), scope="f"))
    by = {r[2]: r for r in q if r[1] == "http://b.org/x"}
    assert by[RDF + "type"][4] == EX + "C" and by[EX + "attr"][4:7] == ("v", RDF + "langString", "en")
    assert by[EX + "p"][4] == "http://b.org/d#y" and by[EX + "q"][4:6] == ("5", XSD + "int")
    assert by[EX + "n"][4] == "_:f/k" and [r[5] for r in q if r[2] == EX + "m"] == [XSD + "string"]
    assert [r[4] for r in q if r[2] in (RDF + "_1", RDF + "_2")] == ["one", "two"]
    assert by[EX + "xml"][5] == RDF + "XMLLiteral" and any(r[2] == EX + "in" for r in q) and any(r[2] == EX + "z" for r in q)
    assert {r[2] for r in q if r[1] == "http://b.org/d#stmt"} == {RDF + x for x in ("subject", "predicate", "object", "type")}
    assert any(r[1] == "http://b.org/d#i" and r[4] == EX + "D" for r in q)


NT = [
    "<http://e/a> <http://e/p> <http://e/b> .",
    '_:x <http://e/p> "quote \\" back\\\\slash \\t \\u00e9 \\U0001F600 \\\' tab\t" <http://e/g> .',
    '<http://e/a> <http://e/p> "hi"@en-GB . # "comment" .',
    '<http://e/a> <http://e/p> "5"^^<http://www.w3.org/2001/XMLSchema#int> _:g .',
    "", "# only a comment", "not a statement", '<http://e/\\u0061> <http://e/p> "" .',
]


def test_lines(spark):
    df = spark.createDataFrame([(x,) for x in NT], "value string")
    q = lines.parse_lines(df, F.lit("urn:default"), F.lit("s")).collect()
    assert len(q) == 5 and lines.rejects(df).count() == 1
    assert [r["g"] for r in q] == ["urn:default", "http://e/g", "urn:default", "_:s/g", "urn:default"]
    assert q[1]["s"] == "_:s/x" and q[1]["o"] == "quote \" back\\slash \t é 😀 ' tab\t"
    assert (q[2]["o"], q[2]["o_lang"], q[2]["o_dt"]) == ("hi", "en-GB", RDF + "langString")
    assert q[3]["o_dt"] == XSD + "int" and q[4]["s"] == "http://e/a" and q[4]["o"] == ""


def test_a_very_long_literal(spark):
    long = "x\\n\\\"y " * 200_000
    df = spark.createDataFrame([(f'<http://e/a> <http://e/p> "{long}" .',)], "value string")
    assert lines.parse_lines(df, F.lit("g"), F.lit("s")).select(F.length("o")).first()[0] == len('x\n"y ') * 200_000


def _pack(name, data):
    return {"": bytes, "gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}[codecs.codec(name)](data)


@pytest.mark.parametrize("ext", ["", ".gz", ".bz2", ".xz", ".lz4", ".zst"])
@pytest.mark.parametrize("kind", ["nt", "ttl"])
def test_codecs(spark, tmp_path, ext, kind):
    name = str(tmp_path / f"d.{kind}{ext}")
    data = "".join(f'<http://e/s{i}> <http://e/p> "v{i}" .\n' for i in range(500)).encode()
    if ext in (".lz4", ".zst"):
        with pa.OSFile(name, "wb") as raw, pa.CompressedOutputStream(raw, "lz4" if ext == ".lz4" else "zstd") as out:
            out.write(data)
    else:
        with open(name, "wb") as f:
            f.write(_pack(name, data))
    q = files.read_files(spark, [(name, "urn:g")])
    assert q.columns == list(lines.COLUMNS)
    assert q.where("g = 'urn:g' AND o_kind = 'LITERAL'").select("s", "o").distinct().count() == 500


def test_names_of_files():
    assert codecs.without_codec("a/b.ttl.gz") == "a/b.ttl" and codecs.without_codec("b.nt") == "b.nt"
    with pytest.raises(files.FormatFault):
        files.format_of("x.csv.gz")


def test_manifest(spark, tmp_path):
    m = tmp_path / "m.tsv"
    m.write_text("a.nt\turn:g\n\nb.ttl\turn:h\n")
    assert files.read_manifest(spark, str(m)) == [("a.nt", "urn:g"), ("b.ttl", "urn:h")]
    m.write_text("a.nt urn:g\n")
    with pytest.raises(files.ManifestFault):
        files.read_manifest(spark, str(m))


def test_blank_nodes_belong_to_their_file(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.nt").write_text("_:x <http://e/p> _:y .\n_:x <http://e/p> <http://e/o> .\n")
    q = files.read_files(spark, [(str(tmp_path / f"{n}.nt"), f"urn:{n}") for n in "ab"])
    one = files.normalise_blank_nodes(q)
    assert one.select("s").distinct().count() == 2 and one.where("o_kind = 'BNODE'").select("o").distinct().count() == 2
    assert sorted(r[0] for r in one.select("s").unionAll(one.where("o_kind = 'BNODE'").select("o")).distinct().collect()) == ["_:b0", "_:b1", "_:b2", "_:b3"]


def test_harvest(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix foo: <http://foo/> .\n@prefix rdf: <http://wrong/> .\n")
    ns = files.harvest_namespaces(spark, [(str(tmp_path / "a.ttl"), "urn:g")])
    assert ns["foo"] == "http://foo/" and ns["rdf"] == RDF


def test_harvest_beyond_the_beginning(spark, tmp_path):
    filler = "".join(f"<http://e/{i}> <http://e/p> <http://e/o> .\n" for i in range(60_000))
    (tmp_path / "a.ttl").write_text(f"@prefix one: <http://one/> .\n{filler}PREFIX two: <http://two/>\n{filler}")
    ns = files.harvest_namespaces(spark, [(str(tmp_path / "a.ttl"), "urn:g")])
    assert ns["one"] == "http://one/" and ns["two"] == "http://two/"


def test_quads_without_blank_nodes_are_not_shuffled(spark):
    rows = [("IRI", f"http://e/{i}", "http://e/p", "IRI", "http://e/o", None, None, "g") for i in range(50)] + [("BNODE", "_:x", "http://e/p", "LITERAL", "1", None, None, "g"), ("IRI", "http://e/s", "http://e/p", "BNODE", "_:x", None, None, "g")]
    quads = spark.createDataFrame(rows, "s_kind string, s string, p string, o_kind string, o string, o_dt string, o_lang string, g string")
    out = files.normalise_blank_nodes(quads)
    assert out.count() == 52 and out.where("s = '_:b0' OR o = '_:b0'").count() == 2 and out.where("s LIKE '_:x'").count() == 0


def test_tables_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = [(i, f"name {i}") for i in range(100)]
    spark.createDataFrame(rows, "ID long, NAME string").write.format("jdbc").options(url=url, dbtable="PEOPLE", **options).save()
    whole = database.read_table(spark, url, "PEOPLE", options=options)
    parts = database.read_table(spark, url, "PEOPLE", "ID", 4, options)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == rows
    assert parts.rdd.getNumPartitions() == 4 and parts.where("ID < 7").count() == 7
    spark.createDataFrame([], "ID long, NAME string").write.format("jdbc").options(url=url, dbtable="NOBODY", **options).save()
    assert database.read_table(spark, url, "NOBODY", "ID", 4, options).count() == 0
