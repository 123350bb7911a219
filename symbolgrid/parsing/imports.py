"""Import statements of a source file, and the edits that add one more import to it.

An edit is (start, stop, text): replace that range of the source. No edit is needed where the name
is already there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from symbolgrid.model import DEFAULT_EXPORT, MODULE_IMPORT, TYPE_ONLY
from symbolgrid.parsing.extract import code_part
from symbolgrid.parsing.tokens import Token, tokenize, unquoted

Edit = tuple[int, int, str]


# -- TypeScript and JavaScript ----------------------------------------------------------------------


@dataclass
class Named:
    opened: int  # offset of the brace
    closed: int
    items: list[tuple[str, str, int]] = field(default_factory=list)  # imported, local, end


@dataclass
class ScriptImport:
    start: int
    stop: int
    module: str
    module_start: int
    type_only: bool = False
    default: str | None = None
    default_end: int = 0
    namespace: str | None = None
    named: Named | None = None

    def locals(self) -> list[str]:
        names = [x for x in (self.default, self.namespace) if x]
        return names + [local for _, local, _ in (self.named.items if self.named else [])]


def _blanked(source: str) -> str:
    """The source with a byte-order mark and a ``#!`` line as blanks, offsets unchanged."""
    out = " " + source[1:] if source.startswith("﻿") else source
    m = re.match(r"\s?#![^\n]*", out)
    return " " * m.end() + out[m.end() :] if m else out


def script_imports(source: str) -> list[ScriptImport]:
    """The imports at the top; the first other statement that is no directive ends them."""
    tokens, out, i = tokenize(_blanked(source)), [], 0
    end = Token("mark", "", len(source), 0, -1)
    at = lambda k: tokens[k] if k < len(tokens) else end
    while i < len(tokens):
        t = at(i)
        if t.kind == "string" and (at(i + 1).text == ";" or at(i + 1).line != t.line):
            i += 1 + (at(i + 1).text == ";")  # a directive
            continue
        if t.text == ";":
            i += 1
            continue
        if t.text != "import" or at(i + 1).text in ("(", "."):
            break
        found, i = ScriptImport(t.at, 0, "", 0), i + 1
        if at(i).text == "type" and at(i + 1).text != "from" and at(i + 1).text != ",":
            found.type_only, i = True, i + 1
        if at(i).kind == "word" and at(i).text != "from" or at(i + 1).text == "from" and at(i).kind == "word":
            found.default, found.default_end = at(i).text, at(i).at + len(at(i).text)
            i += 1
        if at(i).text == ",":
            i += 1
        if at(i).text == "*":
            found.namespace, i = at(i + 2).text, i + 3
        elif at(i).text == "{":
            named, i = Named(at(i).at, 0), i + 1
            while at(i).text not in ("}", ""):
                if at(i).text == "type" and at(i + 1).text not in (",", "}", "as"):
                    i += 1
                name = at(i)
                last, local = name, unquoted(name.text)
                if at(i + 1).text == "as":
                    last, local, i = at(i + 2), at(i + 2).text, i + 2
                named.items.append((unquoted(name.text), local, last.at + len(last.text)))
                i += 1
                i += at(i).text == ","
            named.closed = at(i).at
            found.named, i = named, i + 1
        if at(i).text == "from":
            i += 1
        if at(i).kind != "string":
            break
        found.module, found.module_start = unquoted(at(i).text), at(i).at
        found.stop = at(i).at + len(at(i).text)
        i += 1
        if at(i).text == ";" and at(i).line == at(i - 1).line:
            found.stop, i = at(i).at + 1, i + 1
        out.append(found)
    return out


def _indent(source: str, offset: int) -> str:
    return re.match(r"[ \t]*", source[source.rfind("\n", 0, offset) + 1 :])[0]


def _with_named(source: str, named: Named, name: str) -> str:
    """The braces of an import with one more name, in the layout they have."""
    inner = source[named.opened + 1 : named.closed]
    if not named.items:
        if "\n" not in inner:
            return f"{{ {name} }}"
        close = _indent(source, named.closed)
        return f"{{\n{close}  {name},\n{close}}}"
    end = named.items[-1][2]
    before, after = source[named.opened + 1 : end], source[end : named.closed]
    comma = "," in re.sub(r"//[^\n]*|/\*.*?\*/", "", after, flags=re.S)
    if "\n" not in inner:
        return f"{{{inner.rstrip()}{'' if comma else ','} {name} }}"
    first = re.search(r"\n([ \t]*)\S", inner)
    indent, close = (first[1] if first else "  "), _indent(source, named.closed)
    return f"{{{before}{'' if comma else ','}{after.rstrip()}\n{indent}{name}{',' if comma else ''}\n{close}}}"


def script_insert_at(source: str, imports: list[ScriptImport]) -> int:
    """Behind the last import's line, or below what must stay on top of a file."""
    if imports:
        m = re.compile(r"[ \t]*\n?").match(source, imports[-1].stop)
        return m.end()
    m = re.compile(r"﻿?(?:#![^\n]*(?:\n|\Z))?(?:[^\S\n]*(?:(?://|/\*|\*|'use |\"use )[^\n]*)?(?:\n|(?=\Z)(?<=[^\n])))*").match(source)
    return m.end()


def script_edits(source: str, name: str, module: str, flags: int = 0, type_imports: str = "auto") -> list[Edit]:
    """Add ``name`` of ``module``: as a namespace, a default or a named import; types by policy
    (auto: types only as types, always, never)."""
    if not module:
        return []
    imports = script_imports(source)
    place = script_insert_at(source, imports)
    if flags & MODULE_IMPORT:
        taken = any(name in s.locals() for s in imports)
        return [] if taken else [(place, place, f"import * as {name} from '{module}';\n")]
    typed = type_imports == "always" or (type_imports == "auto" and bool(flags & TYPE_ONLY))
    same = [s for s in imports if s.module == module]
    if flags & DEFAULT_EXPORT:
        for s in same:
            if s.type_only:
                continue
            if s.default is None and s.named is not None:
                at = s.start + len("import")
                return [(at, at, f" {name},")]
            break
    else:
        if any(name in s.locals() for s in same):
            return []
        for s in same:
            if s.type_only == typed and s.named is not None:
                text = source[s.start : s.named.opened] + _with_named(source, s.named, name) + source[s.named.closed + 1 : s.stop]
                return [(s.start, s.stop, text)]
        for s in same:
            if s.type_only == typed and s.named is None and s.default and not s.namespace:
                return [(s.default_end, s.default_end, f", {{ {name} }}")]
    what = name if flags & DEFAULT_EXPORT else f"{{ {name} }}"
    return [(place, place, f"import {'type ' if typed else ''}{what} from '{module}';\n")]


# -- Python -----------------------------------------------------------------------------------------


@dataclass
class PythonImport:
    start: int
    stop: int
    module: str | None  # None: a plain import
    items: list[tuple[str, str]]  # imported, local
    names: tuple[int, int] = (0, 0)
    parens: tuple[int, int] | None = None

    def locals(self) -> list[str]:
        return [local for _, local in self.items]


_GAP = re.compile(r"(?:\s+|\#[^\n]*|;|(?P<doc>[rRuU]?(?:\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')))*", re.S)
_WS = r"(?:[ \t]|\\\r?\n)"
_FROM = re.compile(rf"from\b{_WS}*([.\w]+){_WS}+import{_WS}*")
_PLAIN = re.compile(rf"import{_WS}+((?:\\\r?\n|[^\n\;#])*)")


def _items(text: str) -> list[tuple[str, str]]:
    clean = re.sub(r"\\\r?\n", " ", "\n".join(code_part(line) for line in text.split("\n")))
    out = []
    for part in clean.split(","):
        words = part.split()
        if words:
            plain = words[0]
            out.append((plain, words[2] if len(words) >= 3 and words[1] == "as" else plain))
    return out


def python_imports(source: str) -> list[PythonImport]:
    """The imports at the top, below docstring and comments; the first other statement ends them."""
    out, i = [], 1 if source.startswith("﻿") else 0
    while True:
        i = _GAP.match(source, i).end()
        line = source[source.rfind("\n", 0, i) + 1 : i]
        if i >= len(source) or (line.strip("﻿").strip() and not line.rstrip().endswith(";")) or (line and line.isspace()):
            return out
        m = _FROM.match(source, i)
        if m and source[m.end() : m.end() + 1] == "(":
            close = m.end() + 1
            depth_text = re.compile(r"(?:[^)#]|\#[^\n]*)*").match(source, close)
            close = depth_text.end()
            if close >= len(source):
                return out
            out.append(PythonImport(i, close + 1, m[1], _items(source[m.end() + 1 : close]), parens=(m.end() + 1, close)))
            i = close + 1
        elif m:
            rest = re.compile(r"(?:\\\r?\n|[^\n\;#])*").match(source, m.end())
            stop = m.end() + len(rest[0].rstrip())
            out.append(PythonImport(i, stop, m[1], _items(rest[0]), names=(m.end(), stop)))
            i = rest.end()
        else:
            m = _PLAIN.match(source, i)
            if not m:
                return out
            items = [(n, local if local != n else n.split(".")[0]) for n, local in _items(m[1])]
            out.append(PythonImport(i, i + len(m[0].rstrip()), None, items))
            i = m.end()


def _with_name(inner: str, name: str) -> str:
    """The inside of parentheses with one more name, in the layout it has."""
    if "\n" not in inner:
        have = inner.strip().removesuffix(",").rstrip()
        return f"{have}, {name}" if have else name
    lines = inner.split("\n")
    indent = next((m[1] for x in lines if (m := re.match(r"([ \t]+)\S", x))), "    ")
    last = max((i for i, x in enumerate(lines) if code_part(x).strip()), default=None)
    if last is None:
        tail = lines[-1] if not lines[-1].strip() else ""
        return f"\n{indent}{name},\n{tail}"
    code = code_part(lines[last]).rstrip()
    comma = code.endswith(",")
    if not comma:  # before a comment, not inside it
        lines[last] = code + "," + lines[last][len(code) :].rstrip()
    lines.insert(last + 1, f"{indent}{name}{',' if comma else ''}")
    return "\n".join(lines)


def python_insert_at(source: str, imports: list[PythonImport]) -> int:
    """Behind the last import's line, or below docstring and comments."""
    if imports:
        return re.compile(r"[ \t]*(?:\#[^\n]*)?\r?\n?").match(source, imports[-1].stop).end()
    block = re.compile(r"(?:[^\S\n]*(?:\#[^\n]*)?\n|[ \t]*(?:\"\"\".*?\"\"\"|'''.*?''')[^\n]*(?:\n|\Z))*", re.S)
    return block.match(source).end()


def python_edits(source: str, name: str, module: str | None, flags: int = 0) -> list[Edit]:
    """Add ``import module`` for a module symbol, else ``from module import name``."""
    if not module:
        return []
    imports = python_imports(source)
    place = python_insert_at(source, imports)
    if flags & MODULE_IMPORT:
        taken = any(s.module is None and name in s.locals() for s in imports)
        return [] if taken else [(place, place, f"import {module}\n")]
    for s in imports:
        if s.module == module:
            if name in s.locals():
                return []
            if s.parens:
                text = "(" + _with_name(source[s.parens[0] : s.parens[1]], name) + ")"
            else:
                have = re.sub(r"[\s\\]+\Z", "", source[s.names[0] : s.names[1]]).removesuffix(",").rstrip()
                text = f"{have}, {name}" if have else name
            return [(s.start, s.stop, f"from {module} import {text}")]
    return [(place, place, f"from {module} import {name}\n")]


# -- Java ---------------------------------------------------------------------------------------------

#: How far the imports of a Java file are looked for, in lines.
JAVA_LINES = 300
_JAVA_IMPORT = re.compile(r"(?m)^[\t ]*import\s+(static\s+)?([^;]+);")


def java_imported(source: str) -> list[str]:
    return [n for m in _JAVA_IMPORT.finditer(source) if (n := m[2].strip().rpartition(".")[2]) != "*"]


def java_edits(source: str, name: str, package: str | None, parent: str | None = None) -> list[Edit]:
    """Add the import of a type by its full name, unless it or its whole package is imported."""
    if not package and not parent:
        return []
    full = ".".join(x for x in (package, parent, name) if x)
    for m in _JAVA_IMPORT.finditer(source):
        if m[2] == full or (package and not m[1] and m[2] == f"{package}.*"):
            return []
    place, blank, offset = 0, False, 0
    after_import = False
    for line in source.split("\n")[:JAVA_LINES]:
        text = line.strip()
        offset += len(line) + 1
        if text.startswith("import "):
            place, blank, after_import = offset, False, True
        elif text.startswith("package "):
            if not after_import:
                following = source[offset:].split("\n", 1)[0].strip()
                place, blank = offset, following != ""
        elif text and not text.startswith(("//", "/*", "*")):
            break
    place = min(place, len(source))
    return [(place, place, f"{chr(10) if blank else ''}import {full};\n")]


# -- any language -------------------------------------------------------------------------------------


def imported_names(lang: str, source: str) -> list[str]:
    """Names that a file's imports bring into it."""
    if lang == "java":
        found = java_imported(source)
    else:
        statements = python_imports(source) if lang == "python" else script_imports(source)
        found = [n for s in statements for n in s.locals()]
    return list(dict.fromkeys(found))


def edits(lang: str, source: str, name: str, specifier: str | None, qualifier: str | None, parent: str | None, flags: int, type_imports: str = "auto") -> list[Edit]:
    if lang == "python":
        return python_edits(source, name, qualifier, flags)
    if lang == "java":
        return java_edits(source, name, qualifier, parent)
    return script_edits(source, name, specifier or "", flags, type_imports)


def applied(source: str, changes: list[Edit]) -> str:
    for start, stop, text in sorted(changes, reverse=True):
        source = source[:start] + text + source[stop:]
    return source
