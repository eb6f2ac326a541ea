"""RDF/XML, parsed as a stream of elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urljoin
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from quadloom.functions.lexical import RDF, XSD

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = f"{{{RDF}}}"
_SYNTAX = {_R + x for x in ("ID", "about", "nodeID", "resource", "datatype", "parseType", "aboutEach", "bagID")}


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class Parser:
    """Quads of one file. Repeated IDs and unusual names are let pass."""

    def __init__(self, stream: BinaryIO, base: str = "", scope: str = "") -> None:
        self.stream, self.base, self.scope, self.fresh = stream, base, scope, 0
        self.prefixes: dict[str, str] = {}
        self.out: list[tuple] = []

    def blank(self, label: str | None = None) -> tuple[str, str]:
        if label is None:
            self.fresh += 1
            label = f"genid-{self.fresh}"
        return "BNODE", f"_:{self.scope}/{label}"

    def resolve(self, ref: str, base: str) -> str:
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref) or not base:
            return ref
        return base.partition("#")[0] if ref == "" else urljoin(base, ref)

    def __iter__(self) -> Iterator[tuple]:
        depth, root, base, lang = 0, None, self.base, None
        for event, e in ElementTree.iterparse(self.stream, ("start", "end", "start-ns")):
            if event == "start-ns":
                self.prefixes.setdefault(*e)
                continue
            if event == "start":
                if depth == 0:
                    root = e
                    base, lang = e.get(_XML + "base", base), e.get(_XML + "lang")
                depth += 1
                continue
            depth -= 1
            # a node below the root is whole: its statements go out and its memory is given back
            if (depth == 1 and root.tag == _R + "RDF") or (depth == 0 and root.tag != _R + "RDF"):
                self.node(e, base, lang)
                yield from self.out
                self.out.clear()
                e.clear()
                root.clear()

    def emit(self, s: tuple, p: str, o: tuple, reify: str | None = None) -> None:
        o = (*o, None, None)[:4]
        self.out.append((*s, p, *o, None))
        if reify is not None:
            r = ("IRI", reify)
            for part, value in (("subject", s), ("predicate", ("IRI", p)), ("object", o)):
                self.out.append((*r, RDF + part, *(*value, None, None)[:4], None))
            self.out.append((*r, RDF + "type", "IRI", RDF + "Statement", None, None, None))

    def node(self, e: ElementTree.Element, base: str, lang: str | None) -> tuple[str, str]:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if (about := e.get(_R + "about")) is not None:
            s = ("IRI", self.resolve(about, base))
        elif (id_ := e.get(_R + "ID")) is not None:
            s = ("IRI", self.resolve("#" + id_, base))
        else:
            s = self.blank(e.get(_R + "nodeID"))
        if e.tag != _R + "Description":
            self.emit(s, RDF + "type", ("IRI", _name(e.tag)))
        self.attributes(s, e, base, lang)
        nth = 0
        for child in e:
            p = _name(child.tag)
            if child.tag == _R + "li":
                nth += 1
                p = f"{RDF}_{nth}"
            self.property(s, p, child, base, lang)
        return s

    def attributes(self, s: tuple, e: ElementTree.Element, base: str, lang: str | None) -> bool:
        some = False
        for k, v in e.attrib.items():
            if k in _SYNTAX or k.startswith(_XML) or not k.startswith("{"):
                continue
            some = True
            o = ("IRI", self.resolve(v, base)) if k == _R + "type" else ("LITERAL", v, RDF + "langString", lang) if lang else ("LITERAL", v, XSD + "string")
            self.emit(s, _name(k), o)
        return some

    def property(self, s: tuple, p: str, e: ElementTree.Element, base: str, lang: str | None) -> None:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang) or None
        reify = self.resolve("#" + e.get(_R + "ID"), base) if e.get(_R + "ID") is not None else None
        kind = e.get(_R + "parseType")
        if kind == "Resource":
            node = self.blank()
            self.emit(s, p, node, reify)
            for child in e:
                self.property(node, _name(child.tag), child, base, lang)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in e]
            nodes = [self.blank() for _ in items]
            self.emit(s, p, nodes[0] if nodes else ("IRI", RDF + "nil"), reify)
            for i, (n, item) in enumerate(zip(nodes, items, strict=True)):
                self.emit(n, RDF + "first", item)
                self.emit(n, RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else ("IRI", RDF + "nil"))
        elif kind is not None:
            inner = escape(e.text or "") + "".join(ElementTree.tostring(c, "unicode") for c in e)
            self.emit(s, p, ("LITERAL", inner, RDF + "XMLLiteral"), reify)
        elif len(e):
            self.emit(s, p, self.node(e[0], base, lang), reify)
        elif e.get(_R + "resource") is not None or e.get(_R + "nodeID") is not None:
            o = ("IRI", self.resolve(e.get(_R + "resource"), base)) if e.get(_R + "resource") is not None else self.blank(e.get(_R + "nodeID"))
            self.emit(s, p, o, reify)
            self.attributes(o, e, base, lang)
        elif any(k not in _SYNTAX and not k.startswith(_XML) and k.startswith("{") for k in e.attrib):
            o = self.blank()
            self.emit(s, p, o, reify)
            self.attributes(o, e, base, lang)
        else:
            dt = e.get(_R + "datatype")
            text = e.text or ""
            self.emit(s, p, ("LITERAL", text, self.resolve(dt, base)) if dt else ("LITERAL", text, RDF + "langString", lang) if lang else ("LITERAL", text, XSD + "string"), reify)
