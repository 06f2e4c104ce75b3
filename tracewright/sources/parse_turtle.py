"""Parser of Turtle and TriG: text to quads. Collections are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.catalog import XSD
from ..operators.triples import RDF

_TOKEN = re.compile(
    r"""\s*(?:\#[^\n]*\s*)*(?:
      (?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    | (?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    | (?P<double>[+-]?(?:[0-9]+\.[0-9]*|\.?[0-9]+)[eE][+-]?[0-9]+)
    | (?P<decimal>[+-]?[0-9]*\.[0-9]+)
    | (?P<integer>[+-]?[0-9]+(?![\w:]))
    | (?P<blank>_:[\w][\w.-]*(?<!\.))
    | (?P<name>(?:[^\W\d_][\w.-]*(?<!\.))?:(?:(?:[\w:%]|\\[_~.!$&'()*+,;=/?\#@%-]|[.-](?=[\w:%\\.-]*[\w:%\\-]))*))
    | (?P<word>[A-Za-z]+)
    | (?P<mark>\^\^|[.;,\[\]{}()])
    )""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def _unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), s)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while m := _TOKEN.match(text, at):
        yield m.lastgroup, m[m.lastgroup]
        at = m.end()
    if re.sub(r"\#[^\n]*", "", text[at:]).strip():
        raise ValueError(f"cannot read {text[at : at + 30]!r}")


_END = ("end", "")


class _Reader:
    """Reads a text token by token; quads are those of the statement at hand."""

    def __init__(self, text: str):
        self.tokens, self.prefixes, self.base, self.graph, self.n = _tokens(text), {}, "", None, 0
        self.ahead, self.after = next(self.tokens, _END), next(self.tokens, _END)
        self.quads: list[tuple] = []
        self.graphs: list[str] = []
        # labels of nodes without one are none that the text has
        self.stem = "anon"
        while f"_:{self.stem}" in text:
            self.stem += "x"

    def peek(self) -> tuple[str, str]:
        return self.ahead

    def next(self) -> tuple[str, str]:
        token, self.ahead, self.after = self.ahead, self.after, next(self.tokens, _END)
        return token

    def made(self) -> list[tuple]:
        out, self.quads = self.quads, []
        return out

    def want(self, mark: str) -> None:
        if self.next()[1] != mark:
            raise ValueError(f"{mark} is missing")

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            uri = _unescape(text[1:-1])
            return uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else self.base + uri
        prefix, _, local = text.partition(":")
        if kind != "name" or prefix not in self.prefixes:
            raise ValueError(f"unknown name {text!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def document(self) -> Iterator[tuple]:
        """The quads, as they are read."""
        while self.peek()[0] != "end":
            kind, text = self.peek()
            low = text.lower()
            if kind in ("lang", "word") and low in ("@prefix", "prefix", "@base", "base"):
                self.next()
                if low.endswith("prefix"):
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.iri(*self.next())
                else:
                    self.base = self.iri(*self.next())
                if low.startswith("@"):
                    self.want(".")
            elif kind == "word" and low == "graph":
                self.next()
                yield from self.block(self.iri(*self.next()))
            elif text == "{":
                yield from self.block(None)
            elif kind in ("iri", "name") and self.after[1] == "{":
                yield from self.block(self.iri(*self.next()))
            else:
                self.statement()
                self.want(".")
                yield from self.made()

    def block(self, graph: str | None) -> Iterator[tuple]:
        self.want("{")
        self.graph = graph
        self.graphs += [] if graph is None else [graph]
        while self.peek()[1] != "}":
            self.statement()
            if self.peek()[1] == ".":
                self.next()
            yield from self.made()
        self.want("}")
        self.graph = None

    def statement(self) -> None:
        alone = self.peek()[1] == "["
        subject = self.term()
        if not (alone and self.peek()[1] in (".", "}")):
            self.properties(subject)

    def properties(self, subject: tuple) -> None:
        while True:
            kind, text = self.next()
            predicate = RDF + "type" if (kind, text) == ("word", "a") else self.iri(kind, text)
            while True:
                self.quads.append((self.graph, subject, predicate, self.term()))
                if self.peek()[1] != ",":
                    break
                self.next()
            more = False
            while self.peek()[1] == ";":
                more = self.next()
            if not more or self.peek()[1] in (".", "]", "}"):
                return

    def term(self) -> tuple:
        kind, text = self.next()
        if text == "[" and kind == "mark":
            self.n += 1
            node = ("blank", f"{self.stem}{self.n}", None, None)
            if self.peek()[1] != "]":
                self.properties(node)
            self.want("]")
            return node
        if kind in ("text", "long"):
            lex = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "lang":
                return ("literal", lex, None, self.next()[1][1:])
            if self.peek()[1] == "^^":
                self.next()
                return ("literal", lex, self.iri(*self.next()), None)
            return ("literal", lex, XSD + "string", None)
        if kind in ("double", "decimal", "integer"):
            return ("literal", text, XSD + kind, None)
        if kind == "word" and text in ("true", "false"):
            return ("literal", text, XSD + "boolean", None)
        if kind == "blank":
            return ("blank", text[2:], None, None)
        return ("iri", self.iri(kind, text), None, None)


def turtle(text: str) -> tuple[list[tuple], dict[str, str]]:
    """(quads, prefixes); a quad is (graph or None, subject, predicate, object), a term (kind, lex, datatype, lang)."""
    reader = _Reader(text)
    return list(reader.document()), reader.prefixes


def read_through(text: str) -> Iterator[tuple[str, tuple]]:
    """("quad", quad) as they are read, at the end ("prefix", (number, prefix, uri))."""
    reader = _Reader(text)
    for quad in reader.document():
        yield "quad", quad
    for i, (prefix, uri) in enumerate(reader.prefixes.items()):
        yield "prefix", (i, prefix, uri)


def graph_names(text: str) -> list[str]:
    """Names of the graphs of a text, those without statements, too."""
    reader = _Reader(text)
    for _ in reader.document():
        pass
    return list(dict.fromkeys(reader.graphs))


def terms(text: str) -> Iterator[dict]:
    """Quads as rows for a DataFrame."""
    keys = ("kind", "lex", "datatype", "lang")
    for graph, s, p, o in turtle(text)[0]:
        yield {"graph": graph, "s": dict(zip(keys, s)), "p": p, "o": dict(zip(keys, o))}
