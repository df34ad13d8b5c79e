"""A parser for GraphQL query documents: operations, variables, arguments, aliases, fragments, @skip and @include."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from ..errors import QueryError

_TOKEN = re.compile(
    r'(?P<skip>[\s,﻿]+|#[^\n]*)|(?P<block>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<string>"(?:[^"\\\n]|\\.)*")'
    r"|(?P<float>-?(?:0|[1-9]\d*)(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+))|(?P<int>-?(?:0|[1-9]\d*))"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<mark>\.\.\.|[!$()\[\]{}:=@|&])"
)


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class EnumValue:
    name: str


@dataclass
class Field:
    name: str
    alias: str
    args: dict[str, object] = field(default_factory=dict)
    directives: dict[str, dict[str, object]] = field(default_factory=dict)
    selections: list = field(default_factory=list)


@dataclass
class Spread:
    """A fragment: named, or inline with an optional type condition."""

    name: str | None
    on: str | None = None
    directives: dict[str, dict[str, object]] = field(default_factory=dict)
    selections: list = field(default_factory=list)


@dataclass
class Operation:
    kind: str
    name: str | None
    variables: dict[str, object]
    required: set[str]
    selections: list
    types: dict[str, tuple[object, bool]] = field(default_factory=dict)  # of the declared variables


@dataclass
class Document:
    operations: list[Operation]
    fragments: dict[str, Spread]


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup or "", m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self, value: str | None = None) -> bool:
        return value is None or (self.tokens[self.at][1] == value and self.tokens[self.at][0] in ("mark", "name"))

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v = self.tokens[self.at]
        if (value is not None and v != value) or (kind is not None and k != kind):
            raise QueryError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def maybe(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def value(self) -> object:
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return int(text)
        if kind == "float":
            return float(text)
        if kind == "string":
            return json.loads(text)
        if kind == "block":
            return text[3:-3].strip("\n")
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(text, EnumValue(text))
        if text == "$":
            return Variable(self.take(kind="name"))
        if text == "[":
            out = []
            while not self.maybe("]"):
                out.append(self.value())
            return out
        if text == "{":
            obj = {}
            while not self.maybe("}"):
                name = self.take(kind="name")
                self.take(":")
                obj[name] = self.value()
            return obj
        raise QueryError(f"expected a value, found {text or 'the end'}")

    def arguments(self) -> dict[str, object]:
        out: dict[str, object] = {}
        if self.maybe("("):
            while not self.maybe(")"):
                name = self.take(kind="name")
                self.take(":")
                out[name] = self.value()
        return out

    def directives(self) -> dict[str, dict[str, object]]:
        out = {}
        while self.maybe("@"):
            name = self.take(kind="name")
            out[name] = self.arguments()
        return out

    def selections(self) -> list:
        self.take("{")
        out: list = []
        while not self.maybe("}"):
            if self.maybe("..."):
                if self.tokens[self.at][0] == "name" and not self.peek("on"):
                    out.append(Spread(self.take(kind="name"), directives=self.directives()))
                else:
                    on = self.take(kind="name") if self.maybe("on") else None
                    out.append(Spread(None, on, self.directives(), self.selections()))
                continue
            name = alias = self.take(kind="name")
            if self.maybe(":"):
                name = self.take(kind="name")
            f = Field(name, alias, self.arguments(), self.directives())
            if self.peek("{"):
                f.selections = self.selections()
            out.append(f)
        return out

    def type(self) -> tuple[object, bool]:
        """The name of a type, or a list of one of its items; and whether null is excluded."""
        if self.maybe("["):
            kind: object = [self.type()]
            self.take("]")
        else:
            kind = self.take(kind="name")
        return kind, self.maybe("!")

    def document(self) -> Document:
        operations, fragments = [], {}
        while self.tokens[self.at][0] != "end":
            if self.maybe("fragment"):
                name = self.take(kind="name")
                self.take("on")
                on = self.take(kind="name")
                fragments[name] = Spread(name, on, self.directives(), self.selections())
                continue
            kind, name, variables, required, types = "query", None, {}, set(), {}
            if not self.peek("{"):
                kind = self.take(kind="name")
                if self.tokens[self.at][0] == "name":
                    name = self.take(kind="name")
                if self.maybe("("):
                    while not self.maybe(")"):
                        self.take("$")
                        var = self.take(kind="name")
                        self.take(":")
                        types[var] = self.type()
                        if self.maybe("="):
                            variables[var] = self.value()
                        elif types[var][1]:
                            required.add(var)
                self.directives()
            if kind != "query":
                raise QueryError(f"only queries are supported, not {kind}")
            operations.append(Operation(kind, name, variables, required, self.selections(), types))
        return Document(operations, fragments)


def parse(text: str) -> Document:
    return _Parser(text).document()
