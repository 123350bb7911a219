"""Extractors, import parsers and edits over inline sources."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symbolgrid.parsing import extract as x
from symbolgrid.parsing import imports as m


def names(found):
    return [(e["name"], e["kind"], e["flags"]) for e in found.exports]


SCRIPT = """
export class User { export = 1 }
export abstract class Abs<T> extends B<T> {}
export function getUser(): User { return `a${`}`}` }
export type UserId = string;
export const a = 1, b: Map<string, number> = new Map<string, C>(), {c} = x
export const re = /[/"]}/g;
export default foo
export { x as y, type z } from './z'
export * from './user'
export * as NS from "./ns";
export { q, r as s }
export type { T1 }
export declare function fake(): void;
export default class Foo {}
export const enum CE { A }
export namespace N { export const inner = 1 }
export interface I { a: string }
// export class Commented {}
const s = "export class InString {}"
"""


def test_script_symbols():
    found = x.script_symbols(SCRIPT)
    assert names(found) == [
        ("User", 2, 0), ("Abs", 2, 0), ("getUser", 1, 0), ("UserId", 4, 2), ("a", 0, 0), ("b", 0, 0), ("re", 0, 0), ("foo", 0, 1),
        ("q", 0, 0), ("s", 0, 0), ("T1", 0, 2), ("fake", 1, 0), ("Foo", 2, 1), ("CE", 5, 0), ("N", 6, 0), ("I", 3, 2),
    ]
    assert [(r["from_path"], r["names"] and [(n["exported_name"], n["source_name"]) for n in r["names"]]) for r in found.re_exports] == [
        ("./z", [("y", "x"), ("z", None)]), ("./user", None), ("./ns", [("NS", None)]),
    ]


def test_python_symbols():
    source = "from .models import Account as B, C\nfrom x import *\nclass A: pass\n@d\ndef f(): pass\nG = 1\n_h = 2\nif G:\n    K = 1\nT: int = 3\n"
    found = x.python_symbols(source)
    assert names(found) == [("A", 2, 0), ("f", 1, 0), ("G", 0, 0), ("T", 0, 0)]
    assert [r["from_path"] for r in found.re_exports] == [".models", "x"]
    assert names(x.python_symbols("__all__ = ['_h']\nA = 1\n_h = 2\n")) == [("_h", 0, 0)]
    assert names(x.python_symbols("__all__ = ['_h']\nA = 1\n_h = 2\n", respect_all=False)) == [("A", 0, 0)]


BROKEN = '"""doc\nclass No: pass\n"""\nclass A(:\n  def no(self): pass\nasync def f(: pass\nx: int = 1  # c\nif = 3\nreturn = 1\n_p = 2\ny == 1\n'


def test_python_lines():
    found = x.python_symbols(BROKEN)
    assert found.status == "fallback"
    assert names(found) == [("A", 2, 0), ("f", 1, 0), ("x", 0, 0), ("y", 0, 0)]


def test_java_symbols():
    source = (
        'package com.example; import x.Y; @Ann(a="}") public class Foo<T> { private int a = 1; public static class Inner { public static enum E {A} }'
        " public class NonStatic {} static class NP{} void f(){ class L{} } public static record R(int a) {} } interface Hidden{} public @interface An {}"
    )
    found = x.java_symbols(source)
    assert found.file_qualifier == "com.example"
    assert [(e["name"], e["kind"], e["flags"], e["parent_qualifier"]) for e in found.exports] == [
        ("Foo", 2, 0, None), ("Inner", 2, 16, "Foo"), ("E", 5, 16, "Foo.Inner"), ("R", 2, 16, "Foo"), ("An", 3, 0, None),
    ]
    assert [e["name"] for e in x.java_symbols(source, include_inner=False).exports] == ["Foo", "An"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["python", "typescript", "java"]), st.text(alphabet="ab{}()'\"`/\\*\n ;:=<>,.@export classimportfrom_#", max_size=80))
def test_any_text_is_survived(lang, source):
    assert x.extract(lang, source).status in ("parsed", "fallback")
    m.imported_names(lang, source)
    changes = m.edits(lang, source, "Name", "./m", "pkg.m", None, 0)
    assert len(m.applied(source, changes)) >= len(source) - sum(b - a for a, b, _ in changes)


def only(changes):
    assert len(changes) == 1
    return changes[0][2]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("import { getUser } from './user';", "import { getUser, User } from './user';"),
        ("import { getUser, } from './user';", "import { getUser, User } from './user';"),
        ("import {\n  getUser,\n} from './user';", "import {\n  getUser,\n  User,\n} from './user';"),
        ("import {\n  getUser\n} from './user';", "import {\n  getUser,\n  User\n} from './user';"),
        ("import {\n\tgetUser,\n} from './user';", "import {\n\tgetUser,\n\tUser,\n} from './user';"),
        ("import {\n    type UserId,\n    a,\n} from './user';", "import {\n    type UserId,\n    a,\n    User,\n} from './user';"),
        ("import {\n  a // keep\n} from './user';", "import {\n  a, // keep\n  User\n} from './user';"),
    ],
)
def test_script_merge(source, want):
    assert only(m.script_edits(source + "\n\nx();\n", "User", "./user")) == want


def test_script_other_edits():
    assert only(m.script_edits("import { User } from './user';\n", "UserId", "./user", 2)) == "import type { UserId } from './user';\n"
    assert m.script_edits("import d from './user';\n", "User", "./user") == [(8, 8, ", { User }")]
    assert m.script_edits("import { a } from './user';\n", "D", "./user", 1) == [(6, 6, " D,")]
    assert m.script_edits("import { User } from './user';\n", "User", "./user") == []
    assert m.script_edits("#!/bin/node\n// c\n'use strict';\nfoo();\n", "User", "./user") == [(31, 31, "import { User } from './user';\n")]
    assert only(m.script_edits("", "fs", "node:fs", 32)) == "import * as fs from 'node:fs';\n"
    assert m.script_edits("import * as fs from 'node:fs';\n", "fs", "node:fs", 32) == []


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("from pkg.models import Account", "from pkg.models import Account, Invoice"),
        ("from pkg.models import (Account)", "from pkg.models import (Account, Invoice)"),
        ("from pkg.models import (\n    Account,\n)", "from pkg.models import (\n    Account,\n    Invoice,\n)"),
        ("from pkg.models import (\n    Account  # keep, this\n)", "from pkg.models import (\n    Account,  # keep, this\n    Invoice\n)"),
    ],
)
def test_python_merge(source, want):
    assert only(m.python_edits(source + "\n\nx = 1\n", "Invoice", "pkg.models")) == want


def test_python_other_edits():
    source = '"""doc\nx"""\n# c\nimport os\n\nclass A: pass\n'
    assert m.python_edits(source, "Path", "pathlib") == [(26, 26, "from pathlib import Path\n")]
    assert only(m.python_edits(source, "json", "json", 32)) == "import json\n"
    assert m.python_edits(source, "os", "os", 32) == []
    assert m.python_edits(source, "x", None) == []
    continued = "from f import g, \\\n   h as i  # z\nimport a.b, c as d; import e\nx = 1\nimport no\n"
    assert m.imported_names("python", continued) == ["g", "i", "a", "d", "e"]


def test_java_edits():
    assert m.java_edits("package com.example;\n\nimport java.util.List;\n\nclass A {}", "Foo", "com.x") == [(45, 45, "import com.x.Foo;\n")]
    assert m.java_edits("package com.example;\nclass A {}", "Foo", "com.x", "Out") == [(21, 21, "\nimport com.x.Out.Foo;\n")]
    assert m.java_edits("import com.x.*;", "Foo", "com.x") == []
    assert m.java_edits("import com.x.Foo;", "Foo", "com.x") == []
    assert m.java_edits("", "Foo", None) == []


def test_script_import_names():
    source = "import 'x';\nimport a, * as b from 'c';\nimport type D from 'e'; import {f as g, type H} from \"i\"\nfoo()\nimport z from 'z'"
    assert m.imported_names("typescript", source) == ["a", "b", "D", "g", "H"]
