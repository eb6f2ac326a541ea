"""Names of tables and columns for IRIs."""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions.lexical import RDF, RDFS, XSD

GEO = "http://www.opengis.net/ont/geosparql#"
CORE = (("xsd", XSD), ("rdf", RDF), ("geo", GEO))
DEFAULT_NAMESPACES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD}


def clean(name: str) -> str:
    """`name` as an identifier; if that changes it, a hash keeps different names apart."""
    out = re.sub(r"[^0-9A-Za-z_]", "_", name)
    return out if out == name else f"{out}_{hashlib.blake2b(name.encode(), digest_size=3).hexdigest()}"


def sql_name(iri: str, namespaces: dict[str, str]) -> str:
    """Prefix and local name in lower case, by the longest namespace that fits; else the IRI in base 64."""
    for prefix, start in CORE:
        if iri.startswith(start) and len(iri) > len(start):
            return clean(f"{prefix}_{iri[len(start):].lower()}")
    fitting = sorted((-len(start), prefix) for prefix, start in namespaces.items() if start and iri.startswith(start))
    if fitting:
        prefix = fitting[0][1]
        return clean(f"{prefix}_{iri[len(namespaces[prefix]):]}".lower())
    return clean(base64.b64encode(iri.encode()).decode().lower())


def class_name(iri: str, namespaces: dict[str, str], n: int) -> str:
    """Table name of a class: the local name keeps its case."""
    fitting = sorted((-len(start), prefix) for prefix, start in {**dict(CORE), **namespaces}.items() if start and iri.startswith(start))
    return clean(f"type_{fitting[0][1]}_{iri[-fitting[0][0]:]}") if fitting else f"type_type_{n}"


def language_part(lang: str) -> str:
    return clean(lang.replace("-", "_"))


def datatype_part(datatype: str) -> str:
    for prefix, start in CORE:
        if datatype.startswith(start):
            return clean(f"{prefix}_{datatype[len(start):]}")
    return "dt_" + hashlib.blake2b(datatype.encode(), digest_size=4).hexdigest()


def name_parts(iri: Column, prefix: str, namespace: str) -> dict[str, Column]:
    """The same rules on a column of IRIs: name within a namespace, and its base 64 form outside."""
    inside = iri.startswith(namespace)
    return {"short": F.when(inside, F.concat(F.lit(prefix + "_"), F.lower(F.substring(iri, len(namespace) + 1, 1 << 30)))), "coded": F.lower(F.base64(F.encode(iri, "UTF-8")))}
