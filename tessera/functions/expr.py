"""The prefix expression language: text to a typed tree to a Spark Column.

``+ (a, b)``, ``um (a)``, ``[att]``, ``int[1]``, ``double[1.5]``, ``bool[true]``, ``string[x]``. Characters that begin
nothing are skipped, so white space and stray brackets are legal. Types are checked before Spark sees anything, and every
comparison gets operands of one type: ints, else doubles, else texts. A column of dates or times is its days' text
(``yyyy-MM-dd``); compared with a day of four-digit year, it's compared as a date, which gives the same and can be pushed
down to the scan.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.types import BOOL, DATED, DOUBLE, INT, STRING, EngineError, TypeMismatch, day, to_double, to_text

BINARY = ("!=", "==", "||", "&&", "+", "-", "*", "/", ">", "<")
LEX = re.compile(r"(?P<literal>int|double|bool|string)?\[(?P<value>[^\]]*)\]|(?P<aggregate>sum|avg|cnt)\s*\(|(?P<op>!=|==|\|\||&&|um|[-+*/><!])", re.S)


class Expr(NamedTuple):
    """op: one of BINARY, um, !, att, int, double, bool, string, sum, avg; value for leaves."""

    op: str
    args: tuple[Expr, ...] = ()
    value: object = None

    def __str__(self) -> str:
        if self.op == "att":
            return f"[{self.value}]"
        if self.op == DOUBLE:
            return f"double[{self.value:.6f}]"
        if self.op == BOOL:
            return f"bool[{'true' if self.value else 'false'}]"
        if self.op in (INT, STRING):
            return f"{self.op}[{self.value}]"
        if self.op in ("sum", "avg"):
            return f"{self.op}({self.args[0]})"
        return f"{self.op} ({', '.join(map(str, self.args))})"

    def atts(self) -> set[str]:
        return {self.value} if self.op == "att" else set().union(*(a.atts() for a in self.args))

    def aggregates(self) -> list[Expr]:
        return [self] if self.op in ("sum", "avg") else [x for a in self.args for x in a.aggregates()]


def parse(text: str) -> Expr:
    """The tree of the first expression in the text."""
    at = 0

    def one() -> Expr:
        nonlocal at
        m = LEX.search(text, at)
        if not m:
            raise EngineError(f"the expression ends too early: {text!r}")
        at = m.end()
        if m["aggregate"]:
            raise EngineError(f"{m['aggregate']} is no scalar operation: {text!r}")
        if m["value"] is not None:
            return leaf(m["literal"], m["value"])
        if m["op"] in ("um", "!"):
            return Expr(m["op"], (one(),))
        left = one()
        return Expr(m["op"], (left, one()))

    def leaf(kind: str | None, value: str) -> Expr:
        if kind is None:
            return Expr("att", value=value)
        try:
            return Expr(kind, value={"int": int, "double": float, "bool": "true".__eq__, "string": str}[kind](value))
        except ValueError as error:
            raise EngineError(f"{kind}[{value}] is no {kind}") from error

    return one()


def kind(e: Expr, schema: Mapping[str, str]) -> str:
    """The type of an expression over columns of these types; TypeMismatch if an operation doesn't take its operands."""
    if e.op == "att":
        if e.value not in schema:
            raise EngineError(f"no column {e.value}; there are {', '.join(schema)}")
        return schema[e.value]
    if e.op in (INT, DOUBLE, BOOL, STRING):
        return e.op
    own = [kind(a, schema) for a in e.args]
    numbers = all(k in (INT, DOUBLE) for k in own)
    if e.op in ("-", "*", "/", "um", "+") and numbers:
        return INT if all(k == INT for k in own) else DOUBLE
    if e.op == "+":
        return STRING
    if e.op in ("||", "&&", "!") and all(k == BOOL for k in own) or e.op in (">", "<", "==", "!="):
        return BOOL
    if e.op == "sum" and numbers:
        return own[0]
    if e.op == "avg" and numbers:
        return DOUBLE
    raise TypeMismatch(f"{e.op} doesn't take {' and '.join(own)}: {e}")


def column(e: Expr, schema: Mapping[str, str], inner: Mapping[Expr, Column] | None = None) -> Column:
    """The Spark Column. inner: columns that stand for some subexpressions, such as computed aggregates."""
    kind(e, schema)  # all errors come before any column is made
    return _column(e, schema, inner or {})


def _column(e: Expr, schema: Mapping[str, str], inner: Mapping[Expr, Column]) -> Column:
    if e in inner:
        return inner[e]
    if e.op == "att":
        own = F.col(f"`{e.value}`")
        return day(own) if e.value in _dated(schema) else own
    if (found := _by_day(e, schema, inner)) is not None:
        return found
    if e.op in (INT, DOUBLE, BOOL, STRING):
        if e.op == INT:
            return F.lit(e.value).cast("int" if -(1 << 31) <= e.value < 1 << 31 else "bigint")
        return F.lit(e.value)
    own, kinds = [_column(a, schema, inner) for a in e.args], [kind(a, schema) for a in e.args]
    if e.op in ("sum", "avg"):
        return F.sum(own[0]) if e.op == "sum" else F.avg(own[0])
    if e.op == "um":
        return -own[0]
    if e.op == "!":
        return ~own[0]
    if e.op in ("||", "&&"):
        return own[0] | own[1] if e.op == "||" else own[0] & own[1]
    a, b = own
    if all(k == INT for k in kinds):
        if e.op == "/":
            return F.call_function("div", a, b).cast(_wider(e, schema))
    elif all(k in (INT, DOUBLE) for k in kinds):
        a, b = to_double(a, kinds[0]), to_double(b, kinds[1])
    elif not (e.op in ("==", "!=") and kinds == [BOOL, BOOL]):
        a, b = to_text(a, kinds[0]), to_text(b, kinds[1])
        if e.op == "+":
            return F.concat(a, b)
    return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "/": a.__truediv__, ">": a.__gt__, "<": a.__lt__, "==": a.__eq__, "!=": a.__ne__}[e.op](b)


def _dated(schema: Mapping[str, str]) -> frozenset[str]:
    return getattr(schema, "dated", frozenset())


def day_of(text: str) -> datetime.date | None:
    """The day that a text names as the engine would print it."""
    try:
        found = datetime.date.fromisoformat(text)
    except ValueError:
        return None
    return found if found.isoformat() == text and found < datetime.date.max else None


def compared(column: Column, sign: str, value: datetime.date) -> Column:
    """A comparison of the text of a date or time with a day, as one of dates."""
    first, next_ = F.lit(value), F.lit(value + datetime.timedelta(days=1))
    if sign in ("==", "!="):
        same = (column >= first) & (column < next_)
        return same if sign == "==" else ~same
    return column >= next_ if sign == ">" else column < first


def _by_day(e: Expr, schema: Mapping[str, str], inner: Mapping[Expr, Column]) -> Column | None:
    """A comparison of dated columns with each other or with a day; None for all else."""
    if e.op not in (">", "<", "==", "!="):
        return None
    dated = [a.op == "att" and a.value in _dated(schema) and a not in inner for a in e.args]
    a, b = e.args
    if all(dated):
        x, y = (F.col(f"`{i.value}`").cast("date") for i in e.args)
        return {">": x > y, "<": x < y, "==": x == y, "!=": x != y}[e.op]
    sign = e.op
    if dated[1]:
        a, b, sign = b, a, {">": "<", "<": ">"}.get(e.op, e.op)
    if any(dated) and b.op == STRING and (value := day_of(b.value)):
        return compared(F.col(f"`{a.value}`"), sign, value)
    return None


def _wider(e: Expr, schema: Mapping[str, str]) -> str:
    """Integer division stays 32 bits wide unless a column may be wider; ``schema`` may map names to 'int' only."""
    wide = getattr(schema, "wide", frozenset())
    return "bigint" if e.atts() & wide else "int"


class Columns(dict):
    """Types of a table's columns, which of the ints are 64 bits wide, and which of the strings are dates or times."""

    def __init__(self, *tables) -> None:
        from tessera.functions.types import schema_of

        super().__init__()
        fields = [f for df in tables for f in df.schema.fields]
        for df in tables:
            self.update(schema_of(df))
        self.wide = frozenset(f.name for f in fields if f.dataType.typeName() == "long")
        self.dated = frozenset(f.name for f in fields if isinstance(f.dataType, DATED))


def compiled(text: str | Expr, schema: Mapping[str, str]) -> tuple[Column, str]:
    """The column and type of an expression's text."""
    e = parse(text) if isinstance(text, str) else text
    return column(e, schema), kind(e, schema)


def predicate(text: str | Expr, schema: Mapping[str, str]) -> Column | None:
    """A filter; None if it's the constant true."""
    e = parse(text) if isinstance(text, str) else text
    if kind(e, schema) != BOOL:
        raise TypeMismatch(f"a predicate must be a bool: {e}")
    return None if e == Expr(BOOL, value=True) else column(e, schema)
