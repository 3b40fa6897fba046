"""Tokens of the SQL dialect: the longest match wins, and of equals the kind that comes first.

Kept as users know them: identifiers may hold a hyphen, a number with a fraction may have a sign of its own (so ``1 -2`` is
two numbers), strings are double-quoted with escapes left as they are. Keywords are case-insensitive, TABLE included.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from tessera.functions.types import EngineError

#: The dialect's keywords and the forms of its tokens.
KEYWORDS = frozenset("SELECT FROM WHERE GROUP BY AS AND NOT ON OR SUM AVG CREATE TABLE BPLUSTREE INT DOUBLE STRING BOOL".split())
KINDS = (
    ("INTEGER", re.compile(r"[0-9]+")),
    ("DBL", re.compile(r"[+-]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?")),
    ("IDENTIFIER", re.compile(r"[A-Za-z][A-Za-z0-9_-]*")),
    ("STR", re.compile(r'"(?:\\.|[^"\\])*"', re.S)),
    ("SIGN", re.compile(r"[=<>+\-/*,().]")),
)


class SqlError(EngineError):
    """Text that isn't a statement of the dialect."""


class Token(NamedTuple):
    kind: str  # a keyword, a sign, INTEGER, DBL, IDENTIFIER, STR or END
    text: str
    line: int


def tokens(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        if text[at] in " \t\n":
            line += text[at] == "\n"
            at += 1
            continue
        found = [(len(m[0]), -i, kind, m[0]) for i, (kind, pattern) in enumerate(KINDS) if (m := pattern.match(text, at))]
        if not found:
            raise SqlError(f"error at line {line}: invalid character at {text[at]}")
        size, _, kind, own = max(found)
        if kind == "IDENTIFIER" and own.upper() in KEYWORDS:
            kind = own.upper()
        elif kind == "SIGN":
            kind = own
        out.append(Token(kind, own, line))
        line += own.count("\n")
        at += size
    return [*out, Token("END", "", line)]
