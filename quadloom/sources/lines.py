"""N-Triples and N-Quads, parsed line by line in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.lexical import RDF, XSD

_RESOURCE = r"(<[^>]*>|_:[^\s<>\"]+)"
#: A statement up to its object, and the rest: after a literal's closing quote, or from another object on.
_HEAD = rf"^\s*{_RESOURCE}\s*(<[^>]*>)\s*"
_END = rf"\s*{_RESOURCE}?\s*\.\s*(?:#.*)?$"
_AFTER = rf"^(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>]*)>)?{_END}"
_OBJECT = rf"^{_RESOURCE}{_END}"
SKIPPED = r"^\s*(?:#.*)?$"
QUADS = "s_kind string, s string, p string, o_kind string, o string, o_dt string, o_lang string, g string"
COLUMNS = ("s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang", "g")


def _plain(line: Column) -> Column:
    """Escaped backslashes and quotes by their numbers: then a literal ends at the next quote, which needs no backtracking."""
    return F.replace(F.replace(line, F.lit("\\\\"), F.lit("\\u005C")), F.lit('\\"'), F.lit("\\u0022"))


def _wide(text: Column) -> Column:
    """\\UXXXXXXXX as one or two \\uXXXX."""
    parts = F.split(text, r"\\U")

    def swap(x: Column) -> Column:
        n = F.conv(F.substring(x, 1, 8), 16, 10).cast("long")
        hex4 = lambda v: F.concat(F.lit("\\u"), F.lpad(F.hex(v), 4, "0"))
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.concat(F.when(n < 0x10000, hex4(n)).otherwise(F.concat(hex4(high), hex4(low))), F.substring(x, 9, 1 << 30))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), swap), ""))


def unescape(text: Column) -> Column:
    """The string that an escaped form stands for; forms without a backslash pass untouched."""
    # with pairs of backslashes out of the way, every other one begins an escape
    one = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\\u005C")), F.lit("\\'"), F.lit("'"))
    one = F.when(F.contains(one, F.lit("\\U")), _wide(one)).otherwise(one)
    whole = F.from_json(F.concat(F.lit('{"x":"'), one, F.lit('"}')), "x string", {"allowUnquotedControlChars": "true"})["x"]
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def _term(raw: Column, scope: Column) -> tuple[Column, Column]:
    blank = raw.startswith("_:")
    inner = F.substring(raw, 2, F.length(raw) - 2)
    return F.when(blank, "BNODE").when(raw != "", "IRI"), F.when(blank, F.concat(F.lit("_:"), scope, F.lit("/"), F.substring(raw, 3, 1 << 30))).when(raw != "", unescape(inner))


def _parted(lines: DataFrame) -> DataFrame:
    """With what is before the object (`_head`), a literal's text, and what follows, or the object and what follows; `_text` is null without a literal.

    A literal is found by its quotes, so that long ones are met by no expression. Each part is made once: behind a generator no filter takes
    the making of its columns along.
    """
    steps = (
        lambda v: F.struct(v.alias("_plain"), F.regexp_extract(v, rf"({_HEAD})", 1).alias("_head")),
        lambda x: F.struct(x["_head"].alias("_head"), F.substring(x["_plain"], F.length(x["_head"]) + 1, F.lit(1 << 30)).alias("_rest")),
        lambda x: F.struct(x["_head"].alias("_head"), x["_rest"].alias("_rest"), F.when(x["_rest"].startswith('"'), F.substring_index(F.substring(x["_rest"], 2, 1 << 30), '"', 1)).alias("_text")),
        # without a closing quote nothing follows, which is no statement
        lambda x: F.struct(x["_head"].alias("_head"), x["_text"].alias("_text"), F.when(x["_text"].isNull(), x["_rest"]).otherwise(F.substring(x["_rest"], F.length(x["_text"]) + 3, F.lit(1 << 30))).alias("_after")),
    )
    parts = F.array(_plain(F.col("value")))
    for f in steps:
        parts = F.transform(parts, f)
    return lines.select("*", F.inline(parts))


def _statement() -> Column:
    return (F.col("_head") != "") & F.when(F.col("_text").isNull(), F.col("_after").rlike(_OBJECT)).otherwise(F.col("_after").rlike(_AFTER))


def parse_lines(lines: DataFrame, graph: Column, scope: Column) -> DataFrame:
    """Quads of the column `value`. A line that has no graph gets `graph`; blank node labels belong to `scope`.

    Blank and comment lines are skipped; a line that is no statement is dropped here and counted by rejects().
    """
    get = lambda c, pattern, i: F.coalesce(F.regexp_extract(c, pattern, i), F.lit(""))
    is_literal = F.col("_text").isNotNull()
    s_kind, s = _term(get("_head", _HEAD, 1), scope)
    p = get("_head", _HEAD, 2)
    r_kind, r = _term(get("_after", _OBJECT, 1), scope)
    lang, dt = get("_after", _AFTER, 1), get("_after", _AFTER, 2)
    _, g = _term(F.when(is_literal, get("_after", _AFTER, 3)).otherwise(get("_after", _OBJECT, 2)), scope)
    return _parted(lines).where(_statement()).select(
        s_kind.alias("s_kind"), s.alias("s"), unescape(F.substring(p, 2, F.length(p) - 2)).alias("p"),
        F.when(is_literal, "LITERAL").otherwise(r_kind).alias("o_kind"), F.when(is_literal, unescape(F.col("_text"))).otherwise(r).alias("o"),
        F.when(is_literal, F.when(lang != "", RDF + "langString").when(dt != "", unescape(dt)).otherwise(XSD + "string")).alias("o_dt"),
        F.when(is_literal & (lang != ""), lang).alias("o_lang"), F.coalesce(g, graph).alias("g"),
    )


def rejects(lines: DataFrame) -> DataFrame:
    """Lines that are neither a statement nor blank nor a comment."""
    return _parted(lines).where(~_statement() & ~F.col("value").rlike(SKIPPED)).select(*lines.columns)


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_lines(quads: DataFrame) -> DataFrame:
    """N-Quads lines of quads, for a text sink."""
    res = lambda kind, c: F.when(F.col(kind) == "BNODE", F.concat(F.lit("_:b"), F.hex(F.encode(F.substring(c, 3, 1 << 30), "UTF-8")))).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt") == XSD + "string", "").otherwise(F.concat(F.lit("^^<"), "o_dt", F.lit(">")))
    obj = F.when(F.col("o_kind") == "LITERAL", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)).otherwise(res("o_kind", "o"))
    return quads.select(F.concat_ws(" ", res("s_kind", "s"), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.concat(F.lit("<"), "g", F.lit(">")), F.lit(".")).alias("value"))
