"""IRIs as nine nullable parts, on columns and on plain strings, without loss.

An IRI with a host is kept as scheme, user_info, host, port, path, query and fragment. Any other, such as
`urn:x:y` or `file:///a`, is kept as scheme, scheme_specific_part and fragment. So no character is kept twice,
and recompose(decompose(iri)) is the iri for every string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("scheme", "scheme_specific_part", "authority", "user_info", "host", "port", "path", "query", "fragment")
_WHOLE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?([^#]*)(#.*)?$"
_HIER = r"(?s)^//(?:([^/?#@]*)@)?([^/?#@:\[\]]+|\[[^\]/?#]*\])(:[0-9]*)?((?:/[^?#]*)?)(\?[^#]*)?\Z"


#: Both at once: scheme, user, host, port, path, query, the part of an IRI with a scheme but no host, all of one without a scheme, fragment.
_PARTED = r"(?s)\A(?:([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#@]*@)?([^/?#@:\[\]]+|\[[^\]/?#]*\])(:[0-9]*)?((?:/[^?#]*)?)(\?[^#]*)?(?=#|\z)|([^#]*))|([^#]*))(#.*)?\z"


def _null(c: Column) -> Column:
    return F.when(c != "", c)


def decompose(iri: Column) -> dict[str, Column]:
    """Columns by part; all null for a null IRI. Escapes are kept as they are written.

    One match for all parts: no part but the last can hold a #, so that they can stand in one string until it is split.
    """
    parts = F.split(F.regexp_replace(iri, _PARTED, "$1#$2#$3#$4#$5#$6#$7$8#$9"), "#", 8)
    get = lambda i: F.get(parts, F.lit(i))
    # what precedes a part tells an empty one from none
    after = lambda c: F.when(c != "", F.substring(c, 2, 1 << 30))
    return {
        "scheme": _null(get(0)),
        "scheme_specific_part": F.when(get(2) == "", get(6)),
        "authority": F.lit(None).cast("string"),
        "user_info": F.when(get(1) != "", F.substring_index(get(1), "@", 1)),
        "host": _null(get(2)),
        "port": after(get(3)),
        "path": _null(get(4)),
        "query": after(get(5)),
        "fragment": after(get(7)),
    }


def recompose(p: dict[str, Column]) -> Column:
    """The IRI of parts of any type; a part that is null leaves its delimiter out too."""
    s = {k: c.cast("string") for k, c in p.items()}
    none = F.lit("")
    hier = F.concat(F.lit("//"), F.coalesce(F.concat(s["user_info"], F.lit("@")), none), s["host"], F.coalesce(F.concat(F.lit(":"), s["port"]), none), F.coalesce(s["path"], none), F.coalesce(F.concat(F.lit("?"), s["query"]), none))
    return F.concat(F.coalesce(F.concat(s["scheme"], F.lit(":")), none), F.coalesce(s["scheme_specific_part"], hier), F.coalesce(F.concat(F.lit("#"), s["fragment"]), none))


def split(iri: str) -> dict[str, str | None]:
    """decompose() of one string, for constants in a query."""
    scheme, rest, fragment = re.match(_WHOLE, iri).groups()
    out = dict.fromkeys(PARTS)
    out["scheme"], out["fragment"] = scheme, None if fragment is None else fragment[1:]
    m = re.match(_HIER, rest) if scheme is not None else None
    if m is None:
        out["scheme_specific_part"] = rest
    else:
        user, host, port, path, query = m.groups()
        out |= {"user_info": user, "host": host, "port": port and port[1:], "path": path or None, "query": None if query is None else query[1:]}
    return out


def join(p: dict[str, str | None]) -> str:
    """recompose() of plain strings."""
    ssp = p["scheme_specific_part"]
    if ssp is None:
        ssp = "//" + (p["user_info"] + "@" if p["user_info"] is not None else "") + p["host"]
        ssp += (":" + p["port"] if p["port"] is not None else "") + (p["path"] or "") + ("?" + p["query"] if p["query"] is not None else "")
    return (p["scheme"] + ":" if p["scheme"] is not None else "") + ssp + ("#" + p["fragment"] if p["fragment"] is not None else "")
