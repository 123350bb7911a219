"""A tokenizer for brace languages that knows strings, templates, comments and regular expressions."""

from __future__ import annotations

import re
from typing import NamedTuple

_STEP = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?(?:\"\"\"|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`)
    |(?P<word>[^\W\d]?[$\w][$\w]*|\$)|(?P<mark>=>|\.\.\.|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: Words after which a slash starts a regular expression rather than a division.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


class Token(NamedTuple):
    kind: str  # word, string, mark
    text: str
    at: int
    depth: int  # open brackets around it
    line: int


def _template_end(source: str, i: int) -> int:
    """Offset behind the template literal whose backtick is at i, nested ones included."""
    i += 1
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif source.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(source) and depth:
                if source[i] == "`":
                    i = _template_end(source, i)
                    continue
                depth += (source[i] == "{") - (source[i] == "}")
                i += 1
        else:
            i += 1
    return i


def tokenize(source: str, java: bool = False) -> list[Token]:
    out: list[Token] = []
    i = depth = line = 0
    while i < len(source):
        if not java and source[i] == "/" and not source.startswith(("//", "/*"), i):
            last = out[-1] if out else None
            if last is None or (last.kind == "mark" and last.text not in ")]}") or last.text in _BEFORE_REGEX:
                m = _REGEX.match(source, i)
                if m:
                    out.append(Token("string", m[0], i, depth, line))
                    i = m.end()
                    continue
        m = _STEP.match(source, i)
        kind, text = m.lastgroup, m[0]
        if kind == "text" and not java:
            m = re.compile(r'""').match(source, i)
            kind, text = "string", m[0]
        if kind == "template":
            text = source[i : _template_end(source, i)] if not java else text
            kind = "string"
        if kind == "mark" and text in ")]}":
            depth = max(0, depth - 1)
        if kind not in ("space", "comment"):
            out.append(Token("string" if kind == "text" else kind, text, i, depth, line))
        if kind == "mark" and text in "([{":
            depth += 1
        line += text.count("\n")
        i += len(text)
    return out


def unquoted(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'`" else text
