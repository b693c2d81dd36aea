"""A reader of Turtle documents: prefixes, bases, predicate and object lists, blank nodes, collections, literals."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<uri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
    |(?P<short>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<mark>[;,.\[\]()])
    |(?P<blank>_:[\w-]+(?:\.[\w-]+)*)
    |(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w:%-]|\\[-_~.!$&'()*+,;=/?\#@%])*(?:\.+(?:[\w:%-]|\\.)+)*|[A-Za-z]+)""",
    re.X | re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.S)


class Document:
    """One document's triples: (s, p, o, kind, datatype, language)."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {text[at : at + 30]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.blanks, self.found = 0, {}, "", 0, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if wanted is not None and text != wanted:
            raise ValueError(f"{wanted!r} expected, {text!r} found")
        self.at += 1
        return kind, text

    def resolve(self, uri: str) -> str:
        uri = unescaped(uri)
        return uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else self.base + uri

    def expand(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def blank(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def node(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.take()
        if kind == "uri":
            return self.resolve(text[1:-1]), "uri", None, None
        if kind == "blank":
            return text, "blank", None, None
        if kind in ("long", "short"):
            value, datatype, lang = unescaped(text[3:-3] if kind == "long" else text[1:-1]), None, None
            if self.peek()[0] == "at":
                lang = self.take()[1][1:]
            elif self.peek()[0] == "type":
                self.take()
                datatype = self.node()[0]
            return value, "literal", datatype, lang
        if kind == "number":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return text, "literal", XSD + name, None
        if text == "[":
            me = self.blank()
            if self.peek()[1] != "]":
                self.properties(me)
            self.take("]")
            return me, "blank", None, None
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            nodes = [self.blank() for _ in items] + [RDF + "nil"]
            for i, item in enumerate(items):
                self.found.append((nodes[i], RDF + "first", *item))
                self.found.append((nodes[i], RDF + "rest", nodes[i + 1], "blank" if i + 1 < len(items) else "uri", None, None))
            return nodes[0], "blank" if items else "uri", None, None
        if text in ("true", "false"):
            return text, "literal", XSD + "boolean", None
        if kind == "name" and text == "a":
            return RDF + "type", "uri", None, None
        if kind == "name" and ":" in text:
            return self.expand(text), "uri", None, None
        raise ValueError(f"no node: {text!r}")

    def properties(self, subject: str) -> None:
        while True:
            p = self.node()[0]
            self.found.append((subject, p, *self.node()))
            while self.peek()[1] == ",":
                self.take()
                self.found.append((subject, p, *self.node()))
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return

    def triples(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower().lstrip("@") in ("prefix", "base") and (kind == "at" or kind == "name"):
                self.take()
                if text.lower().endswith("prefix"):
                    name = self.take()[1]
                    self.prefixes[name.rstrip(":")] = self.resolve(self.take()[1][1:-1])
                else:
                    self.base = self.take()[1][1:-1]
                if text.startswith("@"):
                    self.take(".")
                continue
            bracketed = text == "["
            subject = self.node()[0]
            if not (bracketed and self.peek()[1] == "."):
                self.properties(subject)
            self.take(".")
        return self.found


COLUMNS = ["path", "s", "p", "o", "o_kind", "o_datatype", "o_lang", "error"]


def parsed(files: DataFrame) -> DataFrame:
    """Triples of (path, text) rows; a text that is no Turtle gives one row with its ``error`` and no triple."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    rows += [(path, *t, None) for t in Document(text or "").triples()]
                except (ValueError, IndexError) as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    return files.select("path", "text").mapInPandas(read, ", ".join(f"{c} string" for c in COLUMNS))
