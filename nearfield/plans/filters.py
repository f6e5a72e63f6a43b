"""The metadata filter language, compiled to Catalyst columns.

    or   := and (OR and)*
    and  := not (AND not)*
    not  := NOT not | '(' or ')' | field [operator literal]

Operators are = != <> < <= > >=; literals are 'text' (a doubled quote stands for one), numbers, true and false; keywords
are read in any case; a field is a name or a dotted path.  Comparisons are two-valued: a missing, null or uncastable field
makes a comparison false, so NOT of it is true.  The literal chooses the type: a number compares as double, a text as
text, a boolean as boolean; a bare field is true if it reads as true.  An empty filter keeps everything.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FilterParseError

_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)*)|(?P<op><=|>=|!=|<>|=|<|>)|(?P<paren>[()]))")
_KEYWORDS = {"and", "or", "not", "true", "false"}


@dataclass(frozen=True)
class Compare:
    field: str
    op: str | None  # None: a bare field
    literal: str | float | bool | None


@dataclass(frozen=True)
class Not:
    part: Node


@dataclass(frozen=True)
class Both:
    op: str  # "and" or "or"
    parts: tuple[Node, ...]


Node = Compare | Not | Both


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise FilterParseError(f"at {at}: {text[at:at + 20]!r}")
        kind = found.lastgroup or ""
        value = found[kind]
        if kind == "name" and value.lower() in _KEYWORDS:
            kind, value = "keyword", value.lower()
        out.append((kind, value))
        at = found.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.rest = tokens(text)
        self.depth = 0

    def peek(self) -> tuple[str, str]:
        return self.rest[0] if self.rest else ("end", "")

    def take(self) -> tuple[str, str]:
        if not self.rest:
            raise FilterParseError("unexpected end")
        return self.rest.pop(0)

    def chain(self, op: str, part) -> Node:
        parts = [part()]
        while self.peek() == ("keyword", op):
            self.take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else Both(op, tuple(parts))

    def either(self) -> Node:
        return self.chain("or", lambda: self.chain("and", self.negation))

    def negation(self) -> Node:
        self.depth += 1
        if self.depth > 200:
            raise FilterParseError("nested too deeply")
        try:
            kind, value = self.take()
            if (kind, value) == ("keyword", "not"):
                return Not(self.negation())
            if (kind, value) == ("paren", "("):
                inner = self.either()
                if self.take() != ("paren", ")"):
                    raise FilterParseError("expected )")
                return inner
            if kind != "name":
                raise FilterParseError(f"expected a field, found {value!r}")
            if self.peek()[0] != "op":
                return Compare(value, None, None)
            op = self.take()[1].replace("<>", "!=")
            return Compare(value, op, self.literal())
        finally:
            self.depth -= 1

    def literal(self) -> str | float | bool:
        kind, value = self.take()
        if kind == "text":
            return value[1:-1].replace("''", "'")
        if kind == "number":
            return float(value)
        if kind == "keyword" and value in ("true", "false"):
            return value == "true"
        raise FilterParseError(f"expected a literal, found {value!r}")


def parse(text: str | None) -> Node | None:
    """The syntax tree; None for no filter."""
    if text is None or not text.strip():
        return None
    parser = _Parser(text)
    tree = parser.either()
    if parser.rest:
        raise FilterParseError(f"unexpected {parser.rest[0][1]!r}")
    return tree


Promoted = Mapping[str, Column | tuple[Column, str]]


def _typed(promoted: Promoted | None, field: str, literal: str | float | bool | None) -> Column | None:
    """The promoted column of a field where it says the same as the JSON text, by its type and that of the literal."""
    own = (promoted or {}).get(field)
    if own is None or isinstance(own, Column):
        return own
    column, kind = own
    if kind == "string" or (isinstance(literal, float) and kind != "boolean") or (isinstance(literal, bool | None) and kind == "boolean"):
        return column
    return None


def compiled(node: Node | None, metadata: Column, promoted: Promoted | None = None, under_not: bool = False) -> Column | None:
    """A boolean column for ``where``.  Fields in ``promoted`` are read from typed columns, which Parquet can skip by.

    A promoted column, alone or with its SQL type, holds what ``try_cast`` makes of the JSON text.  With its type it is
    used only where it answers as the text does: 5 stored as a double is not the text '5'.
    Outside NOT a null is as good as false, and the bare comparison can be pushed down to the scan; under NOT it is made
    false.
    """
    if node is None:
        return None
    if isinstance(node, Not):
        return ~compiled(node.part, metadata, promoted, True)
    if isinstance(node, Both):
        out = None
        for part in node.parts:
            column = compiled(part, metadata, promoted, under_not)
            out = column if out is None else (out & column if node.op == "and" else out | column)
        return out
    own = _typed(promoted, node.field, node.literal)
    value = own if own is not None else F.get_json_object(metadata, "$." + node.field)
    known = (lambda c: F.coalesce(c, F.lit(False))) if under_not else (lambda c: c)
    if node.op is None:
        return known(value.try_cast("string").try_cast("boolean"))
    if isinstance(node.literal, bool):
        value = value.try_cast("string").try_cast("boolean")
    elif isinstance(node.literal, float):
        value = value.try_cast("double")  # nothing to do where the column is one
    else:
        value = value.cast("string")
    other = F.lit(node.literal)
    made = {"=": lambda: value == other, "!=": lambda: value != other, "<": lambda: value < other, "<=": lambda: value <= other, ">": lambda: value > other, ">=": lambda: value >= other}[node.op]()
    return known(made)


def filter_column(text: str | None, metadata: Column, promoted: Promoted | None = None) -> Column | None:
    return compiled(parse(text), metadata, promoted)
