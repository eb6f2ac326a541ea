"""The registered queries of the engine's own operators, and the SQL that says the same of the source tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import iri, lexical, naming
from quadloom.functions.lexical import RDF, XSD
from quadloom.operators import layout, merge, rewrites, statistics, terms
from quadloom.plans import catalog as cat
from quadloom.plans import description, loader, r2rml, sparql, view
from quadloom.session import dense_numbers, shared_folder
from quadloom.sources import direct, files, lines
from quadloom.sources.direct import EX

_NS = {**naming.DEFAULT_NAMESPACES, **direct.NAMESPACES}
_EX = f"'{EX}'"
_loaded: dict[tuple, cat.Catalog] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loaded(spark: SparkSession, sf_dir: str, *names: str, last: int = 7) -> cat.Catalog:
    """The catalog of these tables after the load's steps; made once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, names, last)
    if key not in _loaded:
        root = shared_folder(spark, "catalog")
        c = loader.load_quads(spark, files.normalise_blank_nodes(direct.read(spark, sf_dir, *names)), root, _NS)
        for n in range(1, last + 1):
            c = loader.run_step(spark, c, n)
        _loaded[key] = c
    return _loaded[key]


def _select(spark: SparkSession, sf_dir: str, query: str, *names: str) -> DataFrame:
    return sparql.select(spark, loaded(spark, sf_dir, *names).frames(spark), f"PREFIX ex: <{EX}> {query}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- IRIs, names and literals --------------------------------------------------------------------------

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#@:]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PART_NAMES = ("scheme", "user_info", "host", "port", "path", "query", "fragment")


@query("SELECT page_id, " + ", ".join(f"nullif(regexp_extract(url, '{_URL}', {i}), '') AS {p}" for i, p in enumerate(_PART_NAMES, 1)) + " FROM pages")
def iri_decompose(spark, sf_dir):
    parts = iri.decompose(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", *[parts[p].alias(p) for p in _PART_NAMES])


@query("SELECT page_id, url FROM pages")
def iri_recompose(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", iri.recompose(iri.decompose(F.col("url"))).alias("url"))


@query(f"SELECT DISTINCT event_type, 'ex_' || lower(event_type) AS short, lower(to_base64(encode({_EX} || event_type))) AS coded FROM events")
def naming_parts(spark, sf_dir):
    names = naming.name_parts(F.concat(F.lit(EX), "event_type"), "ex", EX)
    return _table(spark, sf_dir, "events").select("event_type", *[c.alias(n) for n, c in names.items()]).distinct()


@query("SELECT o_orderkey, lpad(CAST(year(o_orderdate) AS VARCHAR), 4, '0') AS gyear, CAST(o_orderdate AS DATE) AS day FROM orders")
def gyear(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", lexical.gyear(F.year("o_orderdate")).alias("gyear"), lexical.to_native(F.date_format("o_orderdate", "yyyy-MM-dd"), "DATE").alias("day"))


@query("SELECT doc_id, TRY_CAST(CAST(n_chars AS VARCHAR) AS INTEGER) AS as_int, TRY_CAST(text AS INTEGER) AS text_as_int, true AS kept, TRY_CAST(text AS INTEGER) IS NOT NULL AND CAST(TRY_CAST(text AS INTEGER) AS VARCHAR) = text AS text_kept FROM documents")
def literal_typing(spark, sf_dir):
    n, t = F.col("n_chars").cast("string"), F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", lexical.to_native(n, "INTEGER").alias("as_int"), lexical.to_native(t, "INTEGER").alias("text_as_int"), lexical.keeps_form(n, "INTEGER").alias("kept"), lexical.keeps_form(t, "INTEGER").alias("text_kept"))


# --- dictionaries, blank nodes and partitions ----------------------------------------------------------


@query(f"SELECT {_EX} || 'graph/' || source AS iri, row_number() OVER (ORDER BY {_EX} || 'graph/' || source) - 1 AS id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def dictionary_encode(spark, sf_dir):
    return dense_numbers(direct.documents(_table(spark, sf_dir, "documents")).select(F.col("g").alias("iri")), ["iri"])


@query("SELECT DISTINCT '_:' || conv_id || '/' || turn AS label, dense_rank() OVER (ORDER BY '_:' || conv_id || '/' || turn) - 1 AS id FROM conversations WHERE text IS NOT NULL OR role IS NOT NULL")
def bnode_normalize(spark, sf_dir):
    return dense_numbers(direct.read(spark, sf_dir, "conversations").select(F.col("s").alias("label")), ["label"])


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS graph_id FROM documents WHERE source IS NOT NULL")
def graph_enum(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source")
    return docs.join(dense_numbers(docs, ["source"], "graph_id"), "source").select("doc_id", "graph_id")


_ALL = f"""
SELECT 'IRI' AS s_kind, {_EX} || 'customer#' || c_custkey AS s, '{RDF}type' AS p, 'IRI' AS o_kind, {_EX} || lower(c_mktsegment) AS o, CAST(NULL AS VARCHAR) AS o_dt, CAST(NULL AS VARCHAR) AS o_lang, {_EX} || 'graph/crm' AS g FROM customer
UNION ALL SELECT 'IRI', {_EX} || 'customer#' || c_custkey, {_EX} || 'name', 'LITERAL', c_name, '{XSD}string', NULL, {_EX} || 'graph/crm' FROM customer
UNION ALL SELECT 'IRI', {_EX} || 'order#' || o_orderkey, '{RDF}type', 'IRI', {_EX} || 'priority-' || o_orderpriority[1], NULL, NULL, {_EX} || 'graph/sales' FROM orders
UNION ALL SELECT 'IRI', {_EX} || 'order#' || o_orderkey, {_EX} || 'date', 'LITERAL', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '{XSD}date', NULL, {_EX} || 'graph/sales' FROM orders
UNION ALL SELECT 'IRI', {_EX} || 'order#' || o_orderkey, {_EX} || 'placedBy', 'IRI', {_EX} || 'customer#' || o_custkey, NULL, NULL, {_EX} || 'graph/sales' FROM orders
UNION ALL SELECT DISTINCT 'IRI', {_EX} || 'user#' || user_id, '{RDF}type', 'IRI', {_EX} || event_type, NULL, NULL, {_EX} || 'graph' FROM events
UNION ALL SELECT 'IRI', {_EX} || 'doc#' || doc_id, {_EX} || 'text', 'LITERAL', text, '{RDF}langString', lang, {_EX} || 'graph/' || source FROM documents
UNION ALL SELECT 'IRI', {_EX} || 'doc#' || doc_id, {_EX} || 'length', 'LITERAL', CAST(n_chars AS VARCHAR), '{XSD}integer', NULL, {_EX} || 'graph/' || source FROM documents
UNION ALL SELECT 'IRI', url, '{RDF}type', 'IRI', {_EX} || 'Page', NULL, NULL, {_EX} || 'graph/web' FROM pages
UNION ALL SELECT 'BNODE', '_:' || conv_id || '/' || turn, '{RDF}type', 'IRI', {_EX} || role, NULL, NULL, {_EX} || 'graph/chat' FROM conversations
UNION ALL SELECT 'BNODE', '_:' || conv_id || '/' || turn, {_EX} || 'said', 'LITERAL', text, '{XSD}string', NULL, {_EX} || 'graph/chat' FROM conversations"""
_QUADS = f"(SELECT * FROM ({_ALL}) WHERE s IS NOT NULL AND o IS NOT NULL AND g IS NOT NULL)"
_NUMBERED = f"(SELECT * REPLACE (CASE WHEN s_kind = 'BNODE' THEN '_:b' || (dense_rank() OVER (PARTITION BY s_kind ORDER BY s) - 1) ELSE s END AS s) FROM {_QUADS})"


@query(f"SELECT * FROM {_QUADS}")
def direct_mapping(spark, sf_dir):
    return direct.read(spark, sf_dir)


@query(f"SELECT * FROM {_NUMBERED}")
def bnode_quads(spark, sf_dir):
    return files.normalise_blank_nodes(direct.read(spark, sf_dir))


@query(f"SELECT p, s_kind, o_kind, o_lang, CASE WHEN o_lang IS NULL THEN o_dt END AS o_dt, count(*) AS n FROM {_QUADS} GROUP BY ALL")
def sog_partition_counts(spark, sf_dir):
    return layout.partition_counts(direct.read(spark, sf_dir))


@query(f"SELECT s, o, g FROM {_QUADS} WHERE p = {_EX} || 'text' AND s_kind = 'IRI' AND o_kind = 'LITERAL' AND o_lang = 'de'")
def acceptance(spark, sf_dir):
    t = terms.new_table(EX + "text", "ex_text", "IRI", "LITERAL", "de", None)
    return layout.accepted(direct.read(spark, sf_dir), t).select("s", "o", "g")


@query(f"SELECT * FROM {_QUADS} WHERE s_kind = 'IRI'")
def line_round_trip(spark, sf_dir):
    """All quads without blank nodes as N-Quads lines, and parsed again."""
    return lines.parse_lines(lines.to_lines(direct.read(spark, sf_dir).where("s_kind = 'IRI'")), F.lit("urn:none"), F.lit("x"))


# --- rewrites ------------------------------------------------------------------------------------------


def _customer_table(spark, sf_dir, predicate: str = "name"):
    q = direct.customers(_table(spark, sf_dir, "customer")).where(F.col("p") == EX + predicate)
    t = terms.new_table(EX + predicate, f"ex_{predicate}", "IRI", "LITERAL", None, XSD + "string")
    return t, terms.encode(q, t)


def _split(spark, sf_dir):
    root = shared_folder(spark, "split")
    (t, df), = layout.partition(spark, direct.read(spark, sf_dir, "events"), root, _NS)
    return layout.split_classes(spark, t, df, root, _NS, set())


@query("SELECT 'type_ex_' || event_type AS table_name, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def type_split_counts(spark, sf_dir):
    out = None
    for t, df in _split(spark, sf_dir):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.name).alias("table_name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"SELECT DISTINCT 'type_ex_' || event_type AS table_name, {_EX} || 'user#' || user_id AS s, {_EX} || event_type AS class FROM events")
def type_split_rows(spark, sf_dir):
    out = None
    for t, df in _split(spark, sf_dir):
        one = df.select(F.lit(t.name).alias("table_name"), terms.term(t.subject, "IRI").alias("s"), terms.term(t.predicates[0].objects, "IRI").alias("class"))
        out = one if out is None else out.unionAll(one)
    return out


def _stat_rows(spark, sf_dir) -> list[tuple]:
    t, df = _customer_table(spark, sf_dir)
    stats = statistics.statistics(df, t)
    return [(c.part if c in t.subject.columns else "object_" + c.part, stats[c.name]) for c in t.physical()]


_SUBJECT_PARTS = " UNION ALL ".join(
    [f"SELECT '{p}' AS part, true AS is_constant, {v} AS value" for p, v in (("scheme", "'http'"), ("scheme_specific_part", "NULL"), ("authority", "NULL"), ("user_info", "NULL"), ("host", "'example.org'"), ("port", "NULL"), ("path", "'/customer'"), ("query", "NULL"))]
    + ["SELECT 'fragment', count(DISTINCT c_custkey) = 1, CASE WHEN count(DISTINCT c_custkey) = 1 THEN CAST(min(c_custkey) AS VARCHAR) END FROM customer", f"SELECT 'object_datatype', true, '{XSD}string'", f"SELECT 'object_graph', true, {_EX} || 'graph/crm'"]
    + ["SELECT 'object_litvalue', count(DISTINCT c_name) = 1, CASE WHEN count(DISTINCT c_name) = 1 THEN min(c_name) END FROM customer"]
)


@query(_SUBJECT_PARTS)
def constant_columns(spark, sf_dir):
    rows = [(p, s.constant, str(s.least) if s.constant and s.least is not None else None) for p, s in _stat_rows(spark, sf_dir)]
    return spark.createDataFrame(rows, "part string, is_constant boolean, value string")


@query("SELECT 'fragment' AS part, bool_and(CAST(TRY_CAST(CAST(c_custkey AS VARCHAR) AS INTEGER) AS VARCHAR) = CAST(c_custkey AS VARCHAR)) AS fits FROM customer UNION ALL SELECT x, false FROM (VALUES ('path'), ('port'), ('query')) v(x)")
def numeric_iri_part(spark, sf_dir):
    rows = [(p, s.fits) for p, s in _stat_rows(spark, sf_dir) if s.target == "INTEGER"]
    return spark.createDataFrame(rows, "part string, fits boolean")


_PREFIX = "(SELECT substring(lo, 1, coalesce((SELECT max(i) FROM range(1, 500) r(i) WHERE i <= least(length(lo), length(hi)) AND substring(lo, 1, i) = substring(hi, 1, i)), 0)) AS prefix FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}))"


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, prefix FROM {_PREFIX.format(c=c, t=t)}" for c, t in (("c_name", "customer"), ("s_name", "supplier"), ("url", "pages"))))
def common_prefix(spark, sf_dir):
    rows = []
    for c, t in (("c_name", "customer"), ("s_name", "supplier"), ("url", "pages")):
        r = _table(spark, sf_dir, t).agg(F.min(c), F.max(c)).first()
        rows.append((c, statistics.Stat(1, 1, r[0], r[1]).common_prefix))
    return spark.createDataFrame(rows, "name string, prefix string")


@query(f"SELECT page_id, substring(url, length(prefix) + 1) AS rest FROM pages, {_PREFIX.format(c='url', t='pages')}")
def strip_prefix(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    r = pages.agg(F.min("url"), F.max("url")).first()
    return pages.select("page_id", F.substring("url", len(statistics.Stat(1, 1, r[0], r[1]).common_prefix) + 1, 1 << 30).alias("rest"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def set_semantics(spark, sf_dir):
    t = replace(terms.new_table(EX + "line", "ex_line", "IRI", "IRI", None, None), subject=terms.Group(()), predicates=())
    return rewrites.set_semantics(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), t)


def _users(spark, sf_dir):
    t = _table(spark, sf_dir, "events")
    return direct.classes(t, direct.iri("user", "user_id"), F.lit("User"), F.concat(F.lit(EX + "graph/"), "event_type"))


@query(f"SELECT {_EX} || 'user#' || user_id AS s, {_EX} || 'User' AS o, string_agg(g, ' ' ORDER BY g) AS graphs FROM (SELECT DISTINCT user_id, {_EX} || 'graph/' || event_type AS g FROM events) GROUP BY user_id")
def multi_graph_list(spark, sf_dir):
    return rewrites.multi_graph_list(_users(spark, sf_dir)).select("s", "o", F.array_join("graphs", " ").alias("graphs"))


@query(f"SELECT {_EX} || 'user#' || user_id AS s, count(DISTINCT event_type) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def graph_multiplicity(spark, sf_dir):
    return _users(spark, sf_dir).groupBy("s").agg(F.count_distinct("g").alias("n")).where("n > 1")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def uniqueness_probe(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- merging -------------------------------------------------------------------------------------------


def _people(spark, sf_dir):
    """Two tables about people: who had events, and customers with their class."""
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    a = direct.quads(users, direct.iri("person", "user_id"), EX + "active", F.lit("true"), EX + "graph", o_kind="LITERAL", dt=XSD + "boolean")
    c = _table(spark, sf_dir, "customer")
    b = direct.classes(c, direct.iri("person", "c_custkey"), F.lower("c_mktsegment"), EX + "graph")
    ta = terms.new_table(EX + "active", "ex_active", "IRI", "LITERAL", None, XSD + "boolean")
    tb = terms.new_table(RDF + "type", "rdf_type", "IRI", "IRI", None, None)
    return (ta, terms.encode(a, ta)), (tb, terms.encode(b, tb))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events) SEMI JOIN customer ON user_id = c_custkey")
def overlap_count(spark, sf_dir):
    a, b = (merge.keyed(df, t) for t, df in _people(spark, sf_dir))
    return merge.overlap(a, b, merge.KEY)


@query(f"SELECT {_EX} || 'person#' || user_id AS s, 'true' AS active, {_EX} || lower(c_mktsegment) AS class FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN customer ON user_id = c_custkey")
def merge_matched(spark, sf_dir):
    t, df = merge._joined(*_people(spark, sf_dir))
    p, q = t.predicates
    return df.select(terms.term(t.subject, "IRI").alias("s"), terms.term(p.objects, p.kind).alias("active"), F.when(F.col(f"`{q.presence}`").isNotNull(), terms.term(q.objects, "IRI")).alias("class"))


@query(f"SELECT {_EX} || 'person#' || c_custkey AS s, {_EX} || lower(c_mktsegment) AS class FROM customer ANTI JOIN events ON user_id = c_custkey")
def merge_remainder(spark, sf_dir):
    into, source = _people(spark, sf_dir)
    return merge._rest(into, source).select(terms.term(source[0].subject, "IRI").alias("s"), terms.term(source[0].predicates[0].objects, "IRI").alias("class"))


@query(f"SELECT coalesce({_EX} || 'person#' || user_id, {_EX} || 'person#' || c_custkey) AS s, CASE WHEN user_id IS NOT NULL THEN 'true' END AS active, {_EX} || lower(c_mktsegment) AS class FROM (SELECT DISTINCT user_id FROM events) FULL JOIN customer ON user_id = c_custkey")
def merge_full_outer(spark, sf_dir):
    (ta, a), (tb, b) = _people(spark, sf_dir)
    left = merge.keyed(a, ta).select(F.col(merge.KEY).alias("s"), terms.term(ta.predicates[0].objects, "LITERAL").alias("active"))
    right = merge.keyed(b, tb).select(F.col(merge.KEY).alias("s"), terms.term(tb.predicates[0].objects, "IRI").alias("class"))
    return merge.full_merge(left, right, ["s"])


@query(f"SELECT {_EX} || 'person#' || user_id AS s, {_EX} || 'active' AS p, 'true' AS o FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT {_EX} || 'person#' || c_custkey, '{RDF}type', {_EX} || lower(c_mktsegment) FROM customer")
def merge_view(spark, sf_dir):
    """What two merged tables stand for is what they stood for apart."""
    return view.view_of(spark, merge.merge(list(_people(spark, sf_dir)))).select("s", "p", "o")


# --- dimensions, view, mapping and queries -------------------------------------------------------------


@query("SELECT DISTINCT regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme FROM pages WHERE url IS NOT NULL UNION SELECT 'http'")
def scheme_dim(spark, sf_dir):
    frames = [direct.read(spark, sf_dir, n).select(iri.decompose(F.col(c))["scheme"].alias("x")) for n, c in (("pages", "s"), ("customer", "s"), ("pages", "o"))]
    return rewrites.dimension(frames, "x", "scheme")


@query(f"SELECT DISTINCT regexp_extract(url, '{_URL}', 3) AS host FROM pages WHERE url IS NOT NULL UNION SELECT 'example.org'")
def host_dim(spark, sf_dir):
    frames = [direct.read(spark, sf_dir, n).select(iri.decompose(F.col(c))["host"].alias("x")) for n, c in (("pages", "s"), ("customer", "s"), ("pages", "o"))]
    return rewrites.dimension(frames, "x", "host")


@query(f"SELECT DISTINCT * FROM {_NUMBERED}")
def mapping_view(spark, sf_dir):
    """All quads, out of the tables that the load's rewrites and merging made of them."""
    return view.view(spark, loaded(spark, sf_dir))


@query(f"SELECT DISTINCT * FROM {_NUMBERED}")
def whole_load_copy(spark, sf_dir):
    """All quads after every step of the load, from a compacted copy below another root that was opened anew."""
    c = loader.copy_to(spark, loaded(spark, sf_dir, last=len(loader.STEPS) - 1), shared_folder(spark, "copy"))
    return view.view(spark, cat.load(c.root))


@query(f"SELECT p, o_kind, g, count(*) AS n FROM (SELECT DISTINCT * FROM {_QUADS}) GROUP BY ALL")
def mapping_view_counts(spark, sf_dir):
    return view.view(spark, loaded(spark, sf_dir)).groupBy("p", "o_kind", "g").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT * FROM {_NUMBERED}")
def r2rml_view(spark, sf_dir):
    """All quads by evaluating the mapping that was written and read back."""
    c = loaded(spark, sf_dir)
    maps = r2rml.from_turtle(r2rml.write(c))
    return r2rml.evaluate(spark, maps, {t.name.lower(): df for t, df in c.frames(spark)})


@query(f"SELECT DISTINCT * FROM {_NUMBERED}")
def description_view(spark, sf_dir):
    """All quads by descriptions that were written as RDF and read back."""
    c = loaded(spark, sf_dir)
    tables = description.from_turtle(description.to_turtle([s.table for s in c.tables.values()]))
    return view.view_of(spark, [(t, c.read(spark, t.name)) for t in tables])


@query("SELECT 'type_ex_' || lower(c_mktsegment) AS table_name, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'type_ex_' || event_type, count(DISTINCT user_id) FROM events GROUP BY ALL")
def catalog_class_tables(spark, sf_dir):
    c = loaded(spark, sf_dir, "customer", "events")
    sizes = {n: c.read(spark, n).count() for n in c.tables}
    rows = cat.list_tables(spark, c).where(F.upper("table_name").like("TYPE%")).collect()
    return spark.createDataFrame([(r["table_name"], sizes[r["table_name"]]) for r in rows], "table_name string, n long")


@query(f"SELECT DISTINCT {_EX} || event_type AS type FROM events WHERE user_id IS NOT NULL")
def sparql_distinct_types(spark, sf_dir):
    return _select(spark, sf_dir, f"SELECT DISTINCT ?type FROM <{EX}graph> WHERE {{[] a ?type}}", "events")


@query(f"SELECT {_EX} || 'customer#' || c_custkey AS c, c_name AS name, {_EX} || lower(c_mktsegment) AS type FROM customer")
def sparql_bgp_join(spark, sf_dir):
    return _select(spark, sf_dir, "SELECT ?c ?name ?type WHERE { ?c a ?type ; ex:name ?name }", "customer", "orders")


@query(f"SELECT {_EX} || 'order#' || o_orderkey AS o, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def sparql_path_join(spark, sf_dir):
    return _select(spark, sf_dir, "SELECT ?o ?day ?name WHERE { ?o ex:placedBy ?c ; ex:date ?day . ?c ex:name ?name }", "customer", "orders")


@query(f"SELECT '{RDF}type' AS p, {_EX} || lower(c_mktsegment) AS o FROM customer WHERE c_custkey = 7 UNION ALL SELECT {_EX} || 'name', c_name FROM customer WHERE c_custkey = 7")
def sparql_point_lookup(spark, sf_dir):
    return _select(spark, sf_dir, "SELECT ?p ?o WHERE { <http://example.org/customer#7> ?p ?o }", "customer", "orders")


@query(f"SELECT {_EX} || 'order#' || o_orderkey AS o FROM orders WHERE o_custkey = 7")
def sparql_object_lookup(spark, sf_dir):
    return _select(spark, sf_dir, f"SELECT ?o FROM <{EX}graph/sales> WHERE {{ ?o ex:placedBy <{EX}customer#7> }}", "customer", "orders")
