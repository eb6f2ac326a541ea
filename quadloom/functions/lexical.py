"""Native types for lexical forms, adopted only where no form is lost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
#: Logical type by datatype IRI. Everything else, xsd:dateTime among it, stays text.
NATIVE = {
    XSD + "int": "INTEGER", XSD + "integer": "NUMERIC", XSD + "long": "BIGINT", XSD + "decimal": "NUMERIC", XSD + "boolean": "BOOLEAN",
    XSD + "double": "DOUBLE", XSD + "float": "FLOAT", XSD + "date": "DATE", XSD + "gYear": "GYEAR",
}
SPARK = {
    "TEXT": "string", "INTEGER": "int", "BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double", "FLOAT": "float", "DATE": "date", "GYEAR": "int",
    "GRAPH_IRIS": "string", "SCHEME": "string", "HOST": "string", "MARKER": "boolean",
}


def spark_type(datatype: str) -> str:
    """NUMERIC carries its scale: NUMERIC:2 is decimal(38,2)."""
    return f"decimal(38,{datatype.partition(':')[2] or 0})" if datatype.startswith("NUMERIC") else SPARK[datatype]


def gyear(year: Column) -> Column:
    """Four digits at least, with the sign before them."""
    text = F.abs(year.cast("long")).cast("string")
    return F.concat(F.when(year < 0, "-").otherwise(""), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def to_native(c: Column, datatype: str) -> Column:
    """Null where the form has no value of the type."""
    return F.try_cast(c, spark_type(datatype)) if hasattr(F, "try_cast") else c.try_cast(spark_type(datatype))


def to_lexical(c: Column, datatype: str) -> Column:
    return gyear(c) if datatype == "GYEAR" else c.cast("string")


#: Forms that may come back from a type as they were; a cast of any other costs an exception.
_FORMS = {
    "INTEGER": r"^-?[0-9]{1,10}$", "BIGINT": r"^-?[0-9]{1,19}$", "GYEAR": r"^-?[0-9]{4,10}$", "NUMERIC": r"^-?[0-9]{1,38}(?:\.[0-9]+)?$",
    "BOOLEAN": "^(?:true|false)$", "DATE": r"^[+-]?[0-9]{4,7}-[0-9]{2}-[0-9]{2}$", "DOUBLE": "^(?:-?[0-9][0-9.E-]*|NaN|-?Infinity)$", "FLOAT": "^(?:-?[0-9][0-9.E-]*|NaN|-?Infinity)$",
}
_MOST = {"INTEGER": "2147483647", "GYEAR": "2147483647", "BIGINT": "9223372036854775807"}


def _likely(c: Column, datatype: str) -> Column:
    """True for all forms that the type keeps, and for few that it has no value for."""
    out = c.rlike(_FORMS[datatype.partition(":")[0]])
    if (most := _MOST.get(datatype)) is None:
        return out
    digits = F.ltrim(c, F.lit("-"))
    return out & ((F.length(digits) < len(most)) | (digits <= most) | (c == f"-{most[:-1]}8"))


def keeps_form(c: Column, datatype: str) -> Column:
    """Whether this form, or null, comes back from the type as it was."""
    return c.isNull() | F.coalesce(F.when(_likely(c, datatype), to_lexical(to_native(c, datatype), datatype) == c), F.lit(False))


def scale(c: Column) -> Column:
    """Digits after the point of a decimal form."""
    return F.when(F.instr(c, ".") > 0, F.length(c) - F.instr(c, ".")).otherwise(0)
