"""The load from files: golden layouts, and the graph at each step."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quadloom.functions.lexical import RDF, RDFS, XSD
from quadloom.functions.naming import DEFAULT_NAMESPACES
from quadloom.operators import layout, merge, rewrites, statistics, terms
from quadloom.plans import catalog, description, loader, r2rml, sparql, view
from quadloom.sources import files, lines

G = "http://example.org/graph"


def iri(x):
    return f"<{x}>"


#: Fifteen statements about three classes of RDF itself.
SMALL = [
    *[(iri(RDF + a), iri(RDF + "type"), iri(RDF + b)) for a, b in (("Bag", "Alt"), ("Alt", "Bag"), ("Alt", "Alt"), ("List", "Alt"), ("List", "Bag"))],
    *[(iri(RDF + a), iri(RDFS + "label"), o) for a, o in (
        ("Alt", f'"true"^^<{XSD}boolean>'), ("Alt", f'"false"^^<{XSD}boolean>'), ("List", f'"false"^^<{XSD}boolean>'), ("Alt", '"杭州市"@cz'), ("Bag", '"杭州"@cz'),
        ("Alt", '"lala"@en-UK'), ("Alt", '"lala lala"@en-UK'), ("Alt", f'"2023-06-23"^^<{XSD}date>'), ("Alt", f'"2023-06-22"^^<{XSD}date>'), ("Alt", "_:1"))],
]
TWO_CLASSES = [(iri(f"https://example.org/i{i}"), iri(RDF + "type"), iri(f"https://example.org/{'odd' if i % 2 == 0 else 'even'}")) for i in range(1, 100)]
LABELLED = TWO_CLASSES + [(iri(f"https://example.org/i{i}"), iri(RDFS + "label"), f'"{i}"^^<{XSD}int>') for i in range(1, 100)]


def manifest(folder, statements):
    path = folder / "in.nt"
    path.write_text("".join(" ".join(x) + " .\n" for x in statements))
    return [(str(path), G)]


def graph(df):
    return sorted(map(tuple, df.select(*[F.coalesce(F.col(c), F.lit("-")).alias(c) for c in lines.COLUMNS]).collect()))


def select(spark, c, q):
    return sparql.select(spark, c.frames(spark), q)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("small")
    files_ = manifest(root, SMALL)
    return files_, str(root / "db"), loader.load(spark, files_, str(root / "db"), last=0)


def test_loaded_tables(spark, small):
    _, _, c = small
    assert set(c.tables) == {"rdf_type_iri_iri", "rdfs_label_iri_literal_cz", "rdfs_label_iri_literal_en_UK", "rdfs_label_iri_literal_xsd_boolean", "rdfs_label_iri_literal_xsd_date", "rdfs_label_iri_bnode"}
    types = c.read(spark, "rdf_type_iri_iri")
    assert types.count() == 5 and types.agg(F.count_distinct("object_rdf_type_fragment")).first()[0] == 2
    assert [x for x in types.columns if x.startswith("subject")] == [f"subject_rdf_type_{p}" for p in ("scheme", "scheme_specific_part", "authority", "user_info", "host", "port", "path", "query", "fragment")]
    assert c.read(spark, "rdfs_label_iri_literal_cz").columns[-3:] == ["object_rdfs_label_lang", "object_rdfs_label_langvalue", "object_rdfs_label_lang_graph"]
    assert c.read(spark, "rdfs_label_iri_literal_xsd_date").columns[-3:] == ["object_rdfs_labelxsd_date_datatype", "object_rdfs_labelxsd_date_litvalue", "object_rdfs_labelxsd_date_datatype_graph"]
    assert c.read(spark, "rdfs_label_iri_bnode").dtypes[-2] == ("object_rdfs_label_id", "bigint")


def test_every_step_keeps_the_graph(spark, small):
    files_, root, c = small
    want = graph(files.normalise_blank_nodes(files.read_files(spark, files_)))
    assert graph(view.view(spark, c)) == want and len(want) == 15
    for step in range(1, len(loader.STEPS)):
        c = loader.load(spark, files_, root, step)
        assert graph(view.view(spark, c)) == want, step
        maps = r2rml.from_turtle(r2rml.write(c))
        assert maps == r2rml.mapping([s.table for s in c.tables.values()])
        assert graph(r2rml.evaluate(spark, maps, {t.name.lower(): df for t, df in c.frames(spark)})) == want, step
        back = description.from_turtle(description.to_turtle([s.table for s in c.tables.values()]))
        assert back == sorted((s.table for s in c.tables.values()), key=lambda t: t.name)
        assert catalog.load(root).plain() == c.plain()
        if step == 4:
            # the golden layout after merging
            assert c.read(spark, "type_rdf_Bag").count() == 2
            for n in ("type_rdf_Alt", "type_rdf_Bag"):
                df = c.read(spark, n)
                assert sorted(df.columns) == ["object_rdfs_label_langvalue", "subject_rdf_type_fragment"]
                assert df.agg(F.count("object_rdfs_label_langvalue")).first()[0] == 1
            assert "rdfs_label_iri_literal_cz" not in c.tables
    assert {r["table_name"] for r in catalog.list_tables(spark, c).where(F.upper("table_name").like("TYPE%")).collect()} == {"type_rdf_Alt", "type_rdf_Bag"}
    assert catalog.list_columns(spark, c).where("table_name = 'type_rdf_Bag'").orderBy("column_name").first()["column_name"] == "object_rdfs_label_langvalue"


@pytest.mark.parametrize("statements", [TWO_CLASSES, LABELLED], ids=["types", "labels"])
def test_classes_by_sparql(spark, tmp_path, statements):
    c = loader.load(spark, manifest(tmp_path, statements), str(tmp_path / "db"))
    got = select(spark, c, f"SELECT DISTINCT ?type FROM <{G}> WHERE {{[] a ?type}}")
    assert sorted(r[0] for r in got.collect()) == ["https://example.org/even", "https://example.org/odd"]
    assert sum(n.upper().startswith("TYPE") for n in c.tables) == 2
    assert select(spark, c, "SELECT DISTINCT ?type FROM <urn:none> WHERE {[] a ?type}").count() == 0
    assert select(spark, c, "SELECT ?t WHERE {<https://example.org/i7> a ?t}").collect() == [("https://example.org/even",)]
    if statements is LABELLED:
        both = select(spark, c, f"SELECT ?s ?n WHERE {{?s a <https://example.org/odd> ; <{RDFS}label> ?n}}")
        assert sorted(map(tuple, both.collect())) == sorted((f"https://example.org/i{i}", str(i)) for i in range(2, 100, 2))
        # predicates of one row of a merged table meet without a join
        assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()
        assert select(spark, c, f"PREFIX xsd: <{XSD}> SELECT ?s WHERE {{?s rdfs:label \"07\"^^xsd:int}}").count() == 0
        assert select(spark, c, f"PREFIX xsd: <{XSD}> SELECT ?s WHERE {{?s rdfs:label \"7\"^^xsd:int}}").collect() == [("https://example.org/i7",)]


def test_what_a_query_cannot_meet_is_not_read(spark, tmp_path):
    c = loader.load(spark, manifest(tmp_path, TWO_CLASSES), str(tmp_path / "db"))
    plan = lambda q: select(spark, c, q)._jdf.queryExecution().executedPlan().toString()
    assert plan("SELECT ?s WHERE {?s a <https://example.org/odd>}").count("FileScan") == 1
    assert "FileScan" not in plan("SELECT ?t WHERE {<http://elsewhere.org/i7> a ?t}")
    assert "EqualTo(" in plan("SELECT ?t WHERE {<https://example.org/i7> a ?t}")


def _literals(spark, values, datatype):
    t = terms.new_table("urn:p", "p", "IRI", "LITERAL", None, datatype)
    q = spark.createDataFrame([(f"http://example.org/x#{i}", v, datatype, None, G) for i, v in enumerate(values)], "s string, o string, o_dt string, o_lang string, g string")
    return t, terms.encode(q, t)


def _paths(spark, values):
    t = terms.new_table("urn:p", "p", "IRI", "IRI", None, None)
    q = spark.createDataFrame([("http://s", f"http://example.org/{v}", None, None, G) for v in values], "s string, o string, o_dt string, o_lang string, g string")
    new = terms.encode(q, t).withColumn("object_p_path", F.substring("object_p_path", 2, 99))
    return t, new


@pytest.mark.parametrize(("values", "kind"), [([str(i) for i in range(100)], "INTEGER"), ([f"0{i}" for i in range(100)], "TEXT"), ([*map(str, range(100)), "A"], "TEXT"), (["01", "1"], "TEXT")])
def test_numeric_paths(spark, values, kind):
    t, df = _paths(spark, values)
    new, rows = rewrites.optimise(df, t, ("types",))
    assert new.predicates[0].objects.column("path").datatype == kind
    assert sorted(r[0] for r in rows.select(terms.stored(new.predicates[0].objects.column("path"))).collect()) == sorted(values)


@pytest.mark.parametrize(("values", "datatype", "kind"), [([f"000{i}" for i in range(10)], "gYear", "GYEAR"), (["-1000", "-0100", "-0010", "0100", "0999"], "gYear", "GYEAR"), (["1", "true"], "boolean", "TEXT"), (["false", "true"], "boolean", "BOOLEAN"), (["1.50", "2.25"], "decimal", "NUMERIC:2"), (["1.5", "2.25"], "decimal", "TEXT"), (["12345678901234567890", "1"], "integer", "NUMERIC:0"), (["2023-01-01", "2023-12-31"], "date", "DATE"), (["1.0", "2.5"], "double", "DOUBLE"), (["x", "2"], "int", "TEXT"), (["2020-01-01T00:00:00", "2021-01-01T00:00:00"], "dateTime", "TEXT")])
def test_literal_types_keep_forms(spark, values, datatype, kind):
    t, df = _literals(spark, values, XSD + datatype)
    new, rows = rewrites.optimise(df, t)
    assert new.predicates[0].objects.column("litvalue").datatype == kind
    assert sorted(r["o"] for r in view.view_of(spark, [(new, rows)]).collect()) == sorted(values)


def test_constants_and_prefixes(spark):
    t, df = _literals(spark, ["a", "b", "b"], XSD + "string")
    stats = statistics.statistics(df, t)
    assert stats["subject_p_host"].constant and stats["subject_p_query"].constant and not stats["subject_p_fragment"].constant
    new = rewrites.decide(t, stats)
    assert [c.name for c in new.physical()] == ["subject_p_fragment", "object_pxsd_string_litvalue"]
    assert statistics.Stat(2, 2, "abc", "abd").common_prefix == "ab" and statistics.Stat(2, 2, "ab", "abd").common_prefix == "ab"
    assert statistics.Stat(0, 0, None, None).constant and not statistics.Stat(2, 1, "a", "a").constant


def test_a_table_of_constants_keeps_its_statement(spark, tmp_path):
    c = loader.load(spark, manifest(tmp_path, [TWO_CLASSES[0], TWO_CLASSES[0]]), str(tmp_path / "db"))
    assert view.view(spark, c).count() == 1
    assert len(r2rml.from_turtle(r2rml.write(c))[0].classes) == 1


def test_one_triple_in_two_graphs(spark):
    rows = [("IRI", "http://example.org/2", RDF + "type", "IRI", "http://example.org/1", None, None, f"http://example.org/{g}Graph") for g in ("zero", "one")]
    q = spark.createDataFrame(rows, lines.QUADS)
    made = layout.partition(spark, q, _shared(spark), DEFAULT_NAMESPACES)
    assert view.view_of(spark, made).count() == 2
    assert rewrites.multi_graph_list(q).collect()[0]["graphs"] == ["http://example.org/oneGraph", "http://example.org/zeroGraph"]


def _shared(spark):
    from quadloom.session import shared_folder

    return shared_folder(spark, "test")


def test_equal_names_of_classes_in_two_graphs(spark):
    rows = [("IRI", f"urn:s{i}", RDF + "type", "IRI", "http://example.org/C", None, None, f"urn:g{i % 2}") for i in range(6)]
    (t, df), = layout.partition(spark, spark.createDataFrame(rows, lines.QUADS), _shared(spark), {"ex": "http://example.org/"})
    made = layout.split_classes(spark, t, df, _shared(spark), {"ex": "http://example.org/"}, set())
    assert len({t.name for t, _ in made}) == 2 and sorted(map(tuple, view.view_of(spark, made).collect())) == sorted(rows)


def test_merge_decisions():
    def table(name, *predicates):
        t = terms.new_table("urn:x", name, "IRI", "IRI", None, None)
        return replace(t, name=name, predicates=tuple(replace(t.predicates[0], predicate=p) for p in predicates))

    a, b, c = table("type_A", "t"), table("x", "p"), table("y", "p")
    counts = {frozenset({0, 1, 2}): 3, frozenset({1}): 1, frozenset({0}): 2, frozenset({2}): 9}
    assert merge.decide([a, b, c], counts, set()) == [(0, 1)]  # c has a predicate that a then has
    assert merge.decide([a, b, c], counts, {1}) == [(0, 2)]  # b repeats a subject
    assert merge.decide([a, b], {frozenset({0}): 2, frozenset({1}): 2}, set()) == []
    assert sorted(["zz", "type_b", "a"], key=lambda n: rewrites.merge_order(n, {"zz": 1, "type_b": 9, "a": 1}[n])) == ["type_b", "a", "zz"]
    assert rewrites.without_empty({"a": 0, "b": 2}) == ["b"]


def test_empty_input(spark, tmp_path):
    (tmp_path / "e.nt").write_text("# nothing\n")
    c = loader.load(spark, [(str(tmp_path / "e.nt"), G)], str(tmp_path / "db"))
    assert view.view(spark, c).count() == 0 and select(spark, c, "SELECT ?s WHERE {?s ?p ?o}").count() == 0


@pytest.mark.parametrize("bad", ["SELECT ?x WHERE {?s ?p ?o}", "ASK {?s ?p ?o}", "SELECT ?s WHERE {?s ?p ?o FILTER(?o)}", "SELECT ?s WHERE {?s nope:p ?o}", "SELECT ?s {?s ?p ?o} ORDER BY ?s"])
def test_queries_outside_the_subset(bad):
    with pytest.raises(sparql.QueryFault):
        sparql.parse(bad)


def test_command_line(spark, tmp_path, capsys):
    m = tmp_path / "m.tsv"
    m.write_text("\t".join(manifest(tmp_path, TWO_CLASSES[:4])[0]) + "\n")
    db = str(tmp_path / "db")
    assert loader.main([str(m), db, "3"]) == loader.NO_DATABASE
    assert loader.main([str(m), db]) == 0
    assert loader.main(["query", db, "SELECT DISTINCT ?t {?s a ?t}"]) == 0
    assert sorted(capsys.readouterr().out.split()) == ["https://example.org/even", "https://example.org/odd", "t"]
    m.write_text("nonsense\n")
    assert loader.main([str(m), str(tmp_path / "x")]) == loader.BAD_MANIFEST
    m.write_text("a.csv\turn:g\n")
    assert loader.main([str(m), str(tmp_path / "y")]) == loader.NO_FORMAT
    assert loader.main([]) == loader.NO_FILE
