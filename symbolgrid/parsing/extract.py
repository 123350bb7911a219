"""Importable symbols and re-exports of one source file, by language.

Every extractor returns ``Extraction``; exports are dicts of the symbol columns, re-exports dicts
of from_path, names (None for everything) and is_type_only.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

from symbolgrid.model import CLASS, DEFAULT_EXPORT, ENUM, FUNCTION, INNER_CLASS, INTERFACE, NAMESPACE, TYPE_ALIAS, TYPE_ONLY, VARIABLE
from symbolgrid.parsing.tokens import Token, tokenize, unquoted


@dataclass
class Extraction:
    exports: list[dict] = field(default_factory=list)
    re_exports: list[dict] = field(default_factory=list)
    file_qualifier: str | None = None
    status: str = "parsed"

    def add(self, name: str, kind: int, flags: int = 0, parent: str | None = None, line: int = 0, col: int = 0) -> None:
        self.exports.append({"name": name, "kind": kind, "flags": flags, "parent_qualifier": parent, "line": line, "col": col})


# -- Python ---------------------------------------------------------------------------------------


def _public(found: Extraction, listed: list[str] | None) -> Extraction:
    """Only what ``__all__`` lists, or without one what has no leading underscore."""
    if listed is None:
        found.exports = [e for e in found.exports if not e["name"].startswith("_")]
    else:
        found.exports = [e for e in found.exports if e["name"] in set(listed)]
    return found


def python_symbols(source: str, respect_all: bool = True) -> Extraction:
    """Top-level names; text that does not parse goes through the line patterns instead."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return python_lines(source, respect_all)
    found, listed = Extraction(), None
    for node in tree.body:
        where = {"line": node.lineno - 1, "col": node.col_offset}
        match node:
            case ast.Assign(targets=[ast.Name(id="__all__")], value=value) | ast.AnnAssign(target=ast.Name(id="__all__"), value=value):
                items = value.elts if isinstance(value, ast.List | ast.Tuple) else []
                listed = (listed or []) + [x.value for x in items if isinstance(x, ast.Constant) and isinstance(x.value, str)]
            case ast.Assign(targets=[ast.Name(id=name), *_]) | ast.AnnAssign(target=ast.Name(id=name)):
                found.add(name, VARIABLE, **where)
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name):
                found.add(name, FUNCTION, **where)
            case ast.ClassDef(name=name):
                found.add(name, CLASS, **where)
            case ast.ImportFrom(module=module, names=names, level=level):
                items = [{"exported_name": a.asname or a.name, "source_name": a.name if a.asname else None} for a in names]
                star = any(a.name == "*" for a in names)
                found.re_exports.append({"from_path": "." * level + (module or ""), "names": None if star else items, "is_type_only": False})
    return _public(found, listed if respect_all else None)


#: Words that an assignment pattern must not take for a name.
KEYWORDS = frozenset(
    "from import if elif else while for with try except finally return raise yield pass break continue global nonlocal "
    "assert del lambda not and or in is True False None class def async await".split()
)
#: A unit of text: what a fence at the start of a line encloses, with the rest of the line it ends
#: on, or else one line. Java's and Python's patterns agree on it.
UNIT = r"""(?:\"\"\"[\s\S]*?(?:\"\"\"[^\n]*|\Z)|'''[\s\S]*?(?:'''[^\n]*|\Z)|[^\n]*)(?:\n|\Z)"""
#: Code of a unit: everything up to a hash sign outside quotes; a backslash guards what follows it.
CODE = r"""(?:[^#'"\\]|\\[\s\S]|\\$|'(?:[^'\\]|\\[\s\S])*(?:'|\\?$)|"(?:[^"\\]|\\[\s\S])*(?:"|\\?$))*"""
#: A head: the word that declares, the name, and what follows it.
HEAD = r"(?:(class|def|async\s+def)\s+)?([A-Za-z_]\w*)\s*([\s\S]*)"
_UNIT, _CODE, _HEAD = re.compile(UNIT), re.compile(CODE), re.compile(HEAD)


def code_part(line: str) -> str:
    """The line up to its first ``#`` outside quotes."""
    return _CODE.match(line)[0]


def assigns(rest: str) -> bool:
    """Whether what follows a name gives it a value, with or without an annotation between."""
    return rest.startswith("=") or (rest.startswith(":") and "=" in rest)


def listed_names(rest: str) -> list[str] | None:
    """Strings of the bracketed list that is assigned on one line; None if there is none."""
    value = rest.removeprefix("=").lstrip()
    inner, closed, _ = re.sub(r"[\])]", "\0", value[1:], count=1).partition("\0")
    if not rest.startswith("=") or value[:1] not in ("[", "(") or not closed:
        return None
    return re.findall(r"['\"]([^'\"]+)['\"]", inner)


def python_lines(source: str, respect_all: bool = True) -> Extraction:
    """Heads of units that start a line without indent; tolerates any text."""
    found, listed, line = Extraction(status="fallback"), None, 0
    for unit in _UNIT.findall(source):
        number, line = line, line + unit.count("\n")
        if unit[:1] in (" ", "\t", "#", "\n", "'", '"', ""):
            continue
        head = _HEAD.match(code_part(unit).strip())
        if head is None:
            continue
        declares, name, rest = head.groups()
        if declares:
            found.add(name, CLASS if declares == "class" else FUNCTION, line=number)
        elif name == "__all__":
            listed = listed_names(rest) if listed_names(rest) is not None else listed
        elif assigns(rest) and name not in KEYWORDS:
            found.add(name, VARIABLE, line=number)
    return _public(found, listed if respect_all else None)


# -- TypeScript and JavaScript ----------------------------------------------------------------------

_DECLARES = {"class": CLASS, "function": FUNCTION, "interface": INTERFACE, "enum": ENUM, "namespace": NAMESPACE, "module": NAMESPACE, "type": TYPE_ALIAS}
_ENDS_NAME = {"=", ":", ",", ";", "!"}


class _Script:
    def __init__(self, source: str):
        self.tokens, self.found = tokenize(source), Extraction()

    def text(self, i: int) -> str:
        return self.tokens[i].text if i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind == "word" and not self.text(i)[0].isdigit()

    def run(self) -> Extraction:
        for i, t in enumerate(self.tokens):
            if t.depth == 0 and t.kind == "word" and t.text == "export" and self.text(i - 1 if i else len(self.tokens)) != ".":
                self.statement(i + 1)
        return self.found

    def statement(self, i: int) -> None:
        flags = 0
        if self.text(i) == "default":
            flags, i = DEFAULT_EXPORT, i + 1
        if self.text(i) == "declare":
            i += 1
        if self.declaration(i, flags):
            return
        if flags:
            after = self.text(i + 1)
            if self.is_name(i) and (after in ("", ";") or self.tokens[i + 1].line > self.tokens[i].line):
                self.add(i, VARIABLE, flags)
            return
        typed = self.text(i) == "type"
        i += typed
        if self.text(i) == "{":
            self.clause(i, typed)
        elif self.text(i) == "*":
            named = self.text(i + 1) == "as"
            j = i + (3 if named else 1)
            if self.text(j) == "from":
                names = [{"exported_name": unquoted(self.text(i + 2)), "source_name": None}] if named else None
                self.re_export(j + 1, names, typed)

    def add(self, i: int, kind: int, flags: int = 0) -> None:
        t = self.tokens[i]
        self.found.add(t.text, kind, flags, line=t.line)

    def re_export(self, i: int, names: list | None, typed: bool) -> None:
        self.found.re_exports.append({"from_path": unquoted(self.text(i)), "names": names, "is_type_only": typed})

    def declaration(self, i: int, flags: int) -> bool:
        word = self.text(i)
        if word in ("abstract", "async"):
            i, word = i + 1, self.text(i + 1)
        if word == "const" and self.text(i + 1) == "enum":
            i, word = i + 1, "enum"
        if word in ("const", "let", "var"):
            self.declarators(i + 1, flags)
            return True
        if word not in _DECLARES:
            return False
        j = i + 1 + (self.text(i + 1) == "*")
        if word in ("type", "namespace", "module", "interface", "enum") and not self.is_name(j):
            return word == "module"
        if word == "type" and self.text(j + 1) not in ("=", "<"):
            return False
        if self.is_name(j) and self.text(j) not in ("extends", "implements"):
            kind = _DECLARES[word]
            self.add(j, kind, flags | (TYPE_ONLY if kind in (INTERFACE, TYPE_ALIAS) else 0))
        return True

    def declarators(self, i: int, flags: int) -> None:
        """Plain names of ``a = 1, b: T, c``; patterns bring none."""
        base = self.tokens[i].depth if i < len(self.tokens) else 0
        expect, angles, typing = True, 0, False
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.depth < base or (t.depth == base and (t.text == ";" or t.text in ("export", "import"))):
                return
            if expect:
                if self.is_name(i):
                    nxt = self.text(i + 1)
                    if nxt in _ENDS_NAME or nxt in ("", "in", "of") or self.tokens[i + 1].line > t.line:
                        self.add(i, VARIABLE, flags)
                expect = False
            elif t.depth == base:
                if t.text == ":":
                    typing = True
                elif t.text == "=" and angles == 0:
                    typing = False
                elif t.text == "<" and (typing or (i and self.tokens[i - 1].kind == "word" and self.tokens[i - 1].at + len(self.text(i - 1)) == t.at)):
                    angles += 1
                elif t.text == ">" and angles:
                    angles -= 1
                elif t.text == "," and angles == 0:
                    expect, typing = True, False
            i += 1

    def clause(self, i: int, typed: bool) -> None:
        items, i = [], i + 1
        while i < len(self.tokens) and self.text(i) != "}":
            if self.text(i) == "type" and self.text(i + 1) not in (",", "}", "as"):
                i += 1
            name, where = unquoted(self.text(i)), self.tokens[i]
            i += 1
            alias = None
            if self.text(i) == "as":
                alias, i = unquoted(self.text(i + 1)), i + 2
            if name not in (",", ""):
                items.append((name, alias, where))
            i += self.text(i) == ","
        if self.text(i + 1) == "from":
            self.re_export(i + 2, [{"exported_name": a or n, "source_name": n if a else None} for n, a, _ in items], typed)
            return
        for name, alias, where in items:
            self.found.add(alias or name, VARIABLE, TYPE_ONLY if typed else 0, line=where.line)


def script_symbols(source: str) -> Extraction:
    return _Script(source).run()


# -- Java -------------------------------------------------------------------------------------------

_JAVA_TYPES = {"class": CLASS, "record": CLASS, "interface": INTERFACE, "enum": ENUM}


def _type_at(tokens: list[Token], i: int) -> tuple[int, int] | None:
    """Kind and place of the name if a type declaration's keyword is at i."""
    word = tokens[i].text
    if word not in _JAVA_TYPES or i + 1 >= len(tokens) or tokens[i + 1].kind != "word":
        return None
    if word == "record" and (i + 2 >= len(tokens) or tokens[i + 2].text not in ("(", "<")):
        return None
    return _JAVA_TYPES[word], i + 1


def java_symbols(source: str, include_inner: bool = True) -> Extraction:
    """Public top-level types, and inside them the types that are both public and static."""
    tokens, found = tokenize(source, java=True), Extraction()

    def members(i: int, depth: int, parent: str | None) -> None:
        modifiers: set[str] = set()
        while i < len(tokens) and tokens[i].depth >= depth:
            t = tokens[i]
            if t.depth > depth or t.text == "}":
                modifiers = set() if t.text == "}" else modifiers
                i += 1
                continue
            if t.text == "package" and depth == 0 and parent is None:
                j = i + 1
                while j < len(tokens) and tokens[j].text != ";":
                    j += 1
                found.file_qualifier = "".join(x.text for x in tokens[i + 1 : j]) or None
                i = j
            kind = _type_at(tokens, i)
            if kind is None:
                if t.text == ";":
                    modifiers = set()
                elif t.kind == "word":
                    modifiers.add(t.text)
                i += 1
                continue
            name = tokens[kind[1]]
            annotation = tokens[i].text == "interface" and i and tokens[i - 1].text == "@"
            j = kind[1]
            while j < len(tokens) and not (tokens[j].text == "{" and tokens[j].depth == depth):
                j += 1
            if "public" in modifiers and (parent is None or "static" in modifiers):
                found.add(name.text, INTERFACE if annotation else kind[0], INNER_CLASS if parent else 0, parent, line=name.line)
                if include_inner:
                    members(j + 1, depth + 1, f"{parent}.{name.text}" if parent else name.text)
            modifiers = set()
            i = j + 1
            while i < len(tokens) and tokens[i].depth > depth:
                i += 1

    members(0, 0, None)
    return found


def extract(lang: str, source: str, respect_all: bool = True, include_inner: bool = True) -> Extraction:
    """By language; whatever goes wrong in one file is a status, not an error of the job."""
    try:
        if lang == "python":
            return python_symbols(source, respect_all)
        if lang == "java":
            return java_symbols(source, include_inner)
        return script_symbols(source)
    except Exception:  # one broken file must not end the scan of all
        return Extraction(status="failed")
