"""A small reader of Turtle: enough for mapping documents (no collections of graphs, no variables)."""

from __future__ import annotations

import re
from itertools import count
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKENS = re.compile(
    r"""(?P<skip>(?:\s|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s))|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:.%~-]|\\.)*(?:[\w:%~-]|\\.))?)|(?P<word>a\b|true\b|false\b)|(?P<sign>[\[\]();,.])""",
    re.S | re.X,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class Iri(str):
    """An absolute or relative IRI."""


class Blank(str):
    """A blank node."""


class Literal(str):
    """A literal's lexical form; its language and datatype are not needed here."""


class TurtleError(ValueError):
    pass


def _unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


class Graph:
    """Triples by subject and predicate, and the base in force at the end."""

    def __init__(self):
        self.triples: dict[str, dict[str, list[str]]] = {}
        self.base = ""

    def add(self, s: str, p: str, o: str) -> None:
        self.triples.setdefault(s, {}).setdefault(p, []).append(o)

    def all(self, s: str, *predicates: str) -> list[str]:
        found = self.triples.get(s, {})
        return [o for p in predicates for o in found.get(p, ())]

    def one(self, s: str, *predicates: str) -> str | None:
        return next(iter(self.all(s, *predicates)), None)


class _Reader:
    def __init__(self, text: str):
        self.graph, self.prefixes, self.fresh = Graph(), {}, count()
        self.tokens: list[tuple[str, str, int]] = []
        at, line = 0, 1
        while at < len(text):
            m = _TOKENS.match(text, at)
            if m is None:
                raise TurtleError(f"line {line}: unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], line))
            line += m[0].count("\n")
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "", self.tokens[-1][2] if self.tokens else 1)

    def take(self, value: str | None = None) -> tuple[str, str, int]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise TurtleError(f"line {token[2]}: expected {value or 'more'}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token

    def read(self) -> Graph:
        while self.peek()[0] != "end":
            if self.peek()[0] == "directive":
                self.directive()
                continue
            bare = self.peek()[1] == "["
            subject = self.node()
            if not (bare and self.peek()[1] == "."):
                self.predicates(subject)
            self.take(".")
        return self.graph

    def directive(self) -> None:
        word = self.take()[1]
        if word.lower().endswith("prefix"):
            name = self.take()[1]
            self.prefixes[name.rstrip(":")] = self.iri(self.take()[1])
        else:
            self.graph.base = self.iri(self.take()[1])
        if word.startswith("@"):
            self.take(".")

    def iri(self, token: str) -> Iri:
        value = _unescape(token[1:-1])
        return Iri(urljoin(self.graph.base, value) if self.graph.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else value)

    def predicates(self, subject: str) -> None:
        while True:
            predicate = self.node()
            self.graph.add(subject, predicate, self.node())
            while self.peek()[1] == ",":
                self.take(",")
                self.graph.add(subject, predicate, self.node())
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take(";")
            if self.peek()[1] in (".", "]"):
                return

    def node(self) -> str:
        kind, token, line = self.take()
        if kind == "iri":
            return self.iri(token)
        if kind == "name":
            prefix, _, local = token.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"line {line}: unknown prefix {prefix!r}")
            return Iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "blank":
            return Blank(token)
        if kind == "word" and token == "a":
            return Iri(RDF + "type")
        if kind in ("word", "number"):
            return Literal(token)
        if kind in ("text", "long"):
            n = 3 if kind == "long" else 1
            value = Literal(_unescape(token[n:-n]))
            if self.peek()[0] == "lang":
                self.take()
            elif self.peek()[0] == "type":
                self.take()
                self.node()
            return value
        if token == "[":
            blank = Blank(f"_:b{next(self.fresh)}")
            if self.peek()[1] != "]":
                self.predicates(blank)
            self.take("]")
            return blank
        if token == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            head: str = Iri(RDF + "nil")
            for item in reversed(items):
                cell = Blank(f"_:b{next(self.fresh)}")
                self.graph.add(cell, RDF + "first", item)
                self.graph.add(cell, RDF + "rest", head)
                head = cell
            return head
        raise TurtleError(f"line {line}: unexpected {token!r}")


def read_turtle(text: str) -> Graph:
    return _Reader(text).read()
