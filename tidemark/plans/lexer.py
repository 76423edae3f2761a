"""Tokens of both query languages."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that can't be understood, with the place."""


@dataclass(frozen=True)
class Token:
    """kind: word, number, text, op or end."""

    kind: str
    text: str
    at: int


_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<text>'[^']*'|"[^"]*")
    |(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![A-Za-z0-9_.:]))
    |(?P<word>[A-Za-z0-9_][A-Za-z0-9_.:\-]*)
    |(?P<op>=~|!~|!=|<>|>=|<=|[=<>(){}\[\],*+\-/])""",
    re.X,
)
MOST_QUERY = 65_536


def tokens(text: str) -> list[Token]:
    if len(text) > MOST_QUERY:
        raise QueryError("query too long")
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            word = m[0][1:-1] if m.lastgroup == "text" else m[0]
            out.append(Token(m.lastgroup, word, at))
        at = m.end()
    return [*out, Token("end", "", at)]


class Cursor:
    """Reads tokens one after another; words compare without case."""

    def __init__(self, text: str):
        self.tokens, self.i = tokens(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.now
        self.i = min(self.i + 1, len(self.tokens) - 1)
        return t

    def sees(self, *words: str) -> bool:
        return self.now.kind != "text" and self.now.text.lower() in words

    def accept(self, *words: str) -> bool:
        if self.sees(*words):
            self.take()
            return True
        return False

    def expect(self, *words: str) -> Token:
        if not self.sees(*words):
            self.fail(" or ".join(words))
        return self.take()

    def kind(self, *kinds: str) -> Token:
        if self.now.kind not in kinds:
            self.fail(" or ".join(kinds))
        return self.take()

    def fail(self, wanted: str) -> None:
        raise QueryError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")
