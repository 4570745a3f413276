"""Tokens of statements: words, operators, numbers and quoted strings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidemark.errors import QueryError

WORD, SIGN, NUMBER, TEXT = "word", "sign", "number", "text"

_TOKEN = re.compile(r"\s*(?:(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<number>-?[0-9]+)|'(?P<text>[^']*)'|(?P<sign>[-+*/%^&|!~<>=:?.@#$,;()\[\]{}]))")


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int

    def is_word(self, *words: str) -> bool:
        return self.kind == WORD and self.value.upper() in words

    def is_sign(self, sign: str) -> bool:
        return self.kind == SIGN and self.value == sign


def tokens(statement: str) -> list[Token]:
    """Brackets are single tokens; keywords are words in any case; strings have no escapes."""
    found, at = [], 0
    end = len(statement.rstrip())
    while at < end:
        match = _TOKEN.match(statement, at)
        if not match:
            raise QueryError(f"Invalid query near {statement[at:].strip()!r}")
        kind = match.lastgroup
        found.append(Token(kind, match[kind], match.start(kind)))
        at = match.end()
    return found
