"""Turtle and TriG, parsed as a stream of tokens."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urljoin

from quadloom.functions.lexical import RDF, XSD

#: (s_kind, s, p, o_kind, o, o_dt, o_lang, g); g is None outside graph blocks.
Quad = tuple
_NAME = r"(?:[^\s\x00-\x2c\x2e/:;<=>?@\[\]\\^`{|}~]|\\[_~.\-!$&'()*+,;=/?#@%]|%[0-9A-Fa-f]{2}|-)"
_TOKEN = re.compile(
    r"(?P<skip>[ \t\r\n]+|\#[^\n]*)"
    r"|(?P<iri><[^<>\"{}|^`\x00-\x20]*>)"
    r'|(?P<long>"""(?:(?:"|"")?(?:[^"\\]|\\.))*"""' + r"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')"
    # two quotes are an empty string only if no third follows: that would begin a long one
    r'|(?P<string>"(?:[^"\\\n\r]|\\.)+"|""(?!")|\'(?:[^\'\\\n\r]|\\.)+\'|\'\'(?!\'))'
    r"|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)"
    r"|(?P<blank>_:[^\s\x00-\x2c:;<=>?@\[\]\\^`{|}~]*[^\s\x00-\x2e:;<=>?@\[\]\\^`{|}~])"
    rf"|(?P<name>(?:[^\W\d_][\w.\-]*)?:(?:(?:{_NAME}|[:.])*(?:{_NAME}|:))?)"
    r"|(?P<number>[+-]?(?:[0-9]+(?:\.[0-9]*)?[eE][+-]?[0-9]+|\.[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))"
    r"|(?P<word>[A-Za-z]+)"
    r"|(?P<mark>\^\^|[.;,\[\](){}])",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class SyntaxFault(ValueError):
    """A place that the grammar does not allow."""


def unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SHORT.get(m[3], m[3]), s)


def tokens(stream: BinaryIO, piece: int = 1 << 17) -> Iterator[tuple[str, str]]:
    """Kinds and texts of tokens; a token that touches the end of what was read waits for more."""
    decode, held, over = codecs.getincrementaldecoder("utf-8-sig")("replace"), "", False
    while not over:
        data = stream.read(piece)
        over = not data
        held += decode.decode(data, over)
        at, n = 0, len(held)
        while at < n:
            m = _TOKEN.match(held, at)
            if m is None or (m.end() >= n - 3 and not over):
                if over or n - at > 1 << 26:
                    raise SyntaxFault(f"no token at {held[at : at + 40]!r}")
                break
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m.group()
        held = held[at:]


class Parser:
    """Quads of one file. Prefixes that it declares are left in `prefixes`."""

    def __init__(self, stream: BinaryIO, base: str = "", scope: str = "") -> None:
        self.tokens, self.base, self.scope, self.prefixes = tokens(stream), base, scope, {}
        self.held: tuple[str, str] | None = None
        self.fresh, self.graph, self.out = 0, None, []

    def peek(self) -> tuple[str, str]:
        if self.held is None:
            self.held = next(self.tokens, ("end", ""))
        return self.held

    def take(self, want: str | None = None) -> tuple[str, str]:
        token, self.held = self.peek(), None
        if want is not None and token[1] != want:
            raise SyntaxFault(f"{want!r} should stand where {token[1]!r} does")
        return token

    def blank(self, label: str | None = None) -> tuple[str, str]:
        if label is None:
            self.fresh += 1
            label = f"genid-{self.fresh}"
        return "BNODE", f"_:{self.scope}/{label}"

    def iri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            ref = unescape(text[1:-1])
            return ref if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref) else urljoin(self.base, ref) if self.base else ref
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxFault(f"the prefix {prefix!r} is not declared")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SyntaxFault(f"an IRI should stand where {text!r} does")

    def __iter__(self) -> Iterator[Quad]:
        while self.peek()[0] != "end":
            self.statement()
            yield from self.out
            self.out.clear()

    def statement(self) -> None:
        kind, text = self.peek()
        if text.lower() in ("@prefix", "prefix") and kind in ("at", "word"):
            self.take()
            name = self.take()[1]
            self.prefixes[name[:-1]] = self.iri(self.take())
            self.close(text)
        elif text.lower() in ("@base", "base") and kind in ("at", "word"):
            self.take()
            self.base = self.iri(self.take())
            self.close(text)
        elif text == "}":
            self.take()
            self.graph = None
        elif text == "{" or (kind == "word" and text.upper() == "GRAPH"):
            if self.take()[1] != "{":
                self.graph = self.term(False)[1]
                self.take("{")
        else:
            self.triples()

    def close(self, text: str) -> None:
        if text.startswith("@"):
            self.take(".")

    def triples(self) -> None:
        bare = self.peek()[1] == "["
        subject = self.term(False)
        if self.peek()[1] == "{":  # a graph's name
            self.take()
            self.graph = subject[1]
            return
        if not (bare and self.peek()[1] in (".", "}")):
            self.pairs(subject)
        if self.peek()[1] == "}":
            return
        self.take(".")

    def pairs(self, subject: tuple) -> None:
        while True:
            token = self.take()
            predicate = RDF + "type" if token == ("word", "a") else self.iri(token)
            while True:
                self.emit(subject, predicate, self.term(True))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                if self.peek()[1] in (".", "]", "}", ";"):
                    continue
                break
            else:
                return

    def emit(self, subject: tuple, predicate: str, obj: tuple) -> None:
        kind, value, dt, lang = (*obj, None, None)[:4]
        self.out.append((*subject[:2], predicate, kind, value, dt, lang, self.graph))

    def term(self, literal: bool) -> tuple:
        kind, text = self.take()
        if kind in ("iri", "name"):
            return "IRI", self.iri((kind, text))
        if kind == "blank":
            return self.blank(text[2:])
        if text == "[" and kind == "mark":
            node = self.blank()
            if self.peek()[1] != "]":
                self.pairs(node)
            self.take("]")
            return node
        if text == "(" and kind == "mark":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term(True))
            self.take()
            return self.collection(items)
        if not literal:
            raise SyntaxFault(f"a subject should stand where {text!r} does")
        if kind in ("string", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return "LITERAL", value, RDF + "langString", self.take()[1][1:]
            if self.peek()[1] == "^^":
                self.take()
                return "LITERAL", value, self.iri(self.take())
            return "LITERAL", value, XSD + "string"
        if kind == "number":
            return "LITERAL", text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")
        if kind == "word" and text in ("true", "false"):
            return "LITERAL", text, XSD + "boolean"
        raise SyntaxFault(f"a term should stand where {text!r} does")

    def collection(self, items: list[tuple]) -> tuple:
        nodes = [self.blank() for _ in items]
        for i, (node, item) in enumerate(zip(nodes, items, strict=True)):
            self.emit(node, RDF + "first", item)
            self.emit(node, RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else ("IRI", RDF + "nil"))
        return nodes[0] if nodes else ("IRI", RDF + "nil")


def quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
