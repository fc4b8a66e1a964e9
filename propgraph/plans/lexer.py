"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass


class CypherError(ValueError):
    """A query that cannot be read or resolved."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, string, int, float, param, op, end
    text: str
    line: int

    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|//[^\n]*|/\*.*?\*/)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<int>\d+)
    |(?P<name>[^\W\d]\w*)
    |(?P<quoted>`(?:[^`]|``)*`)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<param>\$\w+)
    |(?P<op><=|>=|<>|!=|=~|\.\.|\+=|[-+*/%^=<>()\[\]{},.:;|])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def tokens(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"line {line}: unexpected {text[at]!r}")
        kind, got = m.lastgroup, m[0]
        if kind == "string":
            got = re.sub(r"\\u([0-9a-fA-F]{4})|\\(.)", lambda e: chr(int(e[1], 16)) if e[1] else _ESCAPES.get(e[2], e[2]), got[1:-1], flags=re.S)
        elif kind == "quoted":
            got = got[1:-1].replace("``", "`")
        elif kind == "param":
            got = got[1:]
        if kind != "space":
            out.append(Token(kind, got, line))
        line += m[0].count("\n")
        at = m.end()
    return [*out, Token("end", "", line)]
