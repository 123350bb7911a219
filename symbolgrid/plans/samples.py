"""Queries over inline sources: extraction, resolution and edits, with the rows they must give.

The driver's tables hold no source code, so these carry their own; the SQL beside each states the
expected rows, worked out by hand from the rules of the extractors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid import model
from symbolgrid.functions import names, paths
from symbolgrid.model import DEFAULT_EXCLUDES, MODULE_IMPORT, Settings
from symbolgrid.operators import edits, extract, reexport
from symbolgrid.sources import npm, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FILES = {
    "/w/src/user.ts": "export class User {}\nexport function getCurrentUser() {}\nexport type UserId = string;\nexport default User;\n",
    "/w/src/order.ts": "export abstract class Order<T> {}\nexport const a = 1, b: Map<string, number> = f(), {c} = d;\nexport interface I {}\nexport enum E { X }\n",
    "/w/src/barrel.ts": "export * from './user';\nexport { Order as Ordered, I } from './order';\nexport { local };\nexport type { T };\n",
    "/w/src/top.ts": "export * from './barrel';\nexport * from 'package';\n",
    "/w/pkg/__init__.py": "from .models import Account as Acc, Invoice\nfrom .query import *\n__all__ = ['Acc']\n",
    "/w/pkg/models.py": "class Account: pass\nclass Invoice: pass\n_hidden = 1\nLIMIT: int = 3\nif LIMIT:\n    Nested = 1\n",
    "/w/pkg/query.py": "@decorated\nasync def run(): pass\nQ = 1\n",
    "/w/pkg/broken.py": '"""doc\nclass No: pass\n"""\nclass Yes(:\n  def no(self): pass\nx = 1  # c\nif = 2\n',
    "/w/com/example/Foo.java": "package com.example;\npublic class Foo {\n  public static class Inner { public static enum Deep { A } }\n  public class Not {}\n}\n@interface Hidden {}\n",
}


def _query(columns: str, rows: list[tuple]):
    def register(f):
        lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
        values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
        QUERIES[f.__name__], SQL[f.__name__] = f, f"SELECT * FROM (VALUES {values}) AS v({columns})"
        return f

    return register


def _extracted(spark: SparkSession, suffix: str) -> DataFrame:
    files = tree.from_memory(spark, [(p, s) for p, s in FILES.items() if p.endswith(suffix)])
    return extract.extract_files(files, Settings("/w"))


def _symbols(spark: SparkSession, suffix: str) -> DataFrame:
    return extract.exports_of(_extracted(spark, suffix)).select("path", "ord", "name", "kind", "flags", "parent_qualifier")


@_query(
    "path, ord, name, kind, flags",
    [
        ("/w/src/user.ts", 0, "User", 2, 0), ("/w/src/user.ts", 1, "getCurrentUser", 1, 0), ("/w/src/user.ts", 2, "UserId", 4, 2), ("/w/src/user.ts", 3, "User", 0, 1),
        ("/w/src/order.ts", 0, "Order", 2, 0), ("/w/src/order.ts", 1, "a", 0, 0), ("/w/src/order.ts", 2, "b", 0, 0), ("/w/src/order.ts", 3, "I", 3, 2), ("/w/src/order.ts", 4, "E", 5, 0),
        ("/w/src/barrel.ts", 0, "local", 0, 0), ("/w/src/barrel.ts", 1, "T", 0, 2),
    ],
)
def ts_extract(spark, sf_dir):
    return _symbols(spark, ".ts").drop("parent_qualifier")


@_query(
    "path, ord, name, kind, status",
    [
        ("/w/pkg/models.py", 0, "Account", 2, "parsed"), ("/w/pkg/models.py", 1, "Invoice", 2, "parsed"), ("/w/pkg/models.py", 2, "LIMIT", 0, "parsed"),
        ("/w/pkg/query.py", 0, "run", 1, "parsed"), ("/w/pkg/query.py", 1, "Q", 0, "parsed"), ("/w/pkg/broken.py", 0, "Yes", 2, "fallback"), ("/w/pkg/broken.py", 1, "x", 0, "fallback"),
    ],
)
def py_extract(spark, sf_dir):
    found = _extracted(spark, ".py")
    return extract.exports_of(found).join(found.select("path", "status"), "path").select("path", "ord", "name", "kind", "status")


@_query("path, line, name, kind", [("/w/pkg/broken.py", 3, "Yes", 2), ("/w/pkg/broken.py", 5, "x", 0)])
def py_regex_extract(spark, sf_dir):
    return extract.python_line_symbols(tree.from_memory(spark, [(p, s) for p, s in FILES.items() if "broken" in p]))


@_query(
    "name, kind, flags, parent_qualifier, file_qualifier",
    [("Foo", 2, 0, None, "com.example"), ("Inner", 2, 16, "Foo", "com.example"), ("Deep", 5, 16, "Foo.Inner", "com.example")],
)
def java_extract(spark, sf_dir):
    return extract.exports_of(_extracted(spark, ".java")).select("name", "kind", "flags", "parent_qualifier", "file_qualifier")


@_query(
    "path, from_path, names",
    [
        ("/w/src/barrel.ts", "./user", "*"), ("/w/src/barrel.ts", "./order", "Order>Ordered,I"), ("/w/src/top.ts", "./barrel", "*"), ("/w/src/top.ts", "package", "*"),
        ("/w/pkg/__init__.py", ".models", "Account>Acc,Invoice"), ("/w/pkg/__init__.py", ".query", "*"),
    ],
)
def re_export_rows(spark, sf_dir):
    rows = extract.re_exports_of(_extracted(spark, ""))
    listed = F.array_join(F.transform("names", lambda n: F.concat_ws(">", n["source_name"], n["exported_name"])), ",")
    return rows.select("path", "from_path", F.coalesce(listed, F.lit("*")).alias("names"))


@_query(
    "path, name, flags",
    [
        ("/w/src/barrel.ts", "User", 4), ("/w/src/barrel.ts", "getCurrentUser", 4), ("/w/src/barrel.ts", "UserId", 6), ("/w/src/barrel.ts", "Ordered", 4), ("/w/src/barrel.ts", "I", 6),
        ("/w/src/top.ts", "User", 4), ("/w/src/top.ts", "getCurrentUser", 4), ("/w/src/top.ts", "UserId", 6), ("/w/src/top.ts", "Ordered", 4), ("/w/src/top.ts", "I", 6),
        ("/w/src/top.ts", "local", 4), ("/w/src/top.ts", "T", 6), ("/w/pkg/__init__.py", "Acc", 4), ("/w/pkg/__init__.py", "Invoice", 4), ("/w/pkg/__init__.py", "run", 4), ("/w/pkg/__init__.py", "Q", 4),
    ],
)
def resolved_symbols(spark, sf_dir):
    found = _extracted(spark, "")
    edges = reexport.barrel_edges(extract.re_exports_of(found), extract.files_of(found))
    rows = reexport.flatten_fixpoint(spark, extract.exports_of(found), edges)
    return rows.filter(F.col("flags").bitwiseAND(F.lit(model.RE_EXPORT)) != 0).select("path", "name", "flags")


_EDITS = [
    ("/w/a.ts", "import { getUser } from './user';\n", "User", "/w/user.ts", None, None, 0),
    ("/w/b.ts", "import {\n  getUser,\n} from './user';\n", "User", "/w/user.ts", None, None, 0),
    ("/w/c.ts", "import { User } from './user';\n", "UserId", "/w/user.ts", None, None, 2),
    ("/w/d.ts", "import d from './user';\n", "User", "/w/user.ts", None, None, 0),
    ("/w/e.ts", "// top\nx()\n", "fs", "$stdlib/node/node_fs.ts", "node:fs", None, MODULE_IMPORT),
    ("/w/f.ts", "import { User } from './user';\n", "User", "/w/user.ts", None, None, 0),
    ("/w/g.py", "from pkg.models import (\n    Account  # keep\n)\n", "Invoice", "/w/pkg/models.py", "pkg.models", None, 0),
    ("/w/h.py", '"""doc"""\nx = 1\n', "Path", "$stdlib/python/pathlib.py", "pathlib", None, 0),
    ("/w/I.java", "package com.x;\nimport java.util.List;\nclass I {}\n", "Inner", "/w/com/example/Foo.java", "com.example", "Foo", 16),
]


@_query(
    "current_path, start, stop, edit",
    [
        ("/w/a.ts", 0, 33, "import { getUser, User } from './user';"), ("/w/b.ts", 0, 36, "import {\n  getUser,\n  User,\n} from './user';"),
        ("/w/c.ts", 31, 31, "import type { UserId } from './user';\n"), ("/w/d.ts", 8, 8, ", { User }"), ("/w/e.ts", 7, 7, "import * as fs from 'node:fs';\n"),
        ("/w/g.py", 0, 46, "from pkg.models import (\n    Account,  # keep\n    Invoice\n)"), ("/w/h.py", 10, 10, "from pathlib import Path\n"), ("/w/I.java", 38, 38, "import com.example.Foo.Inner;\n"),
    ],
)
def import_edits(spark, sf_dir):
    rows = [(i, 1, name, 2, flags, target, qualifier, parent, 0) for i, (_, _, name, target, qualifier, parent, flags) in enumerate(_EDITS)]
    found = spark.createDataFrame(rows, model.SUGGESTIONS)
    lang = paths.language_of(F.col("current_path"))
    asked = spark.createDataFrame([(i, e[0]) for i, e in enumerate(_EDITS)], "query_id long, current_path string").withColumn("language", lang)
    made = edits.render(found, asked, spark.createDataFrame([e[:2] for e in _EDITS], "path string, source string"))
    return made.select("current_path", F.explode("edits").alias("e")).select("current_path", "e.start", "e.stop", F.col("e.text").alias("edit"))


@_query(
    "path, imported",
    [("/w/a.py", "g,i,a,d"), ("/w/b.ts", "a,b,D,g,H"), ("/w/C.java", "B,e")],
)
def imported_names(spark, sf_dir):
    sources = [
        ("/w/a.py", "from f import g, \\\n   h as i  # z\nimport a.b, c as d\nx = 1\nimport no\n"),
        ("/w/b.ts", "import 'x';\nimport a, * as b from 'c';\nimport type D from 'e'; import {f as g, type H} from \"i\"\nfoo()\nimport z from 'z'"),
        ("/w/C.java", "import a.B;\nimport static c.D.e;\nimport f.*;\n"),
    ]
    found = edits.with_imported_names(tree.from_memory(spark, sources))
    return found.select("path", F.array_join("already_imported", ",").alias("imported"))


@_query("dep", [("@s/lib",), ("a",), ("b",), ("c",)])
def npm_dependencies(spark, sf_dir):
    manifest = '{"dependencies": {"b": "1", "a": "2"}, "devDependencies": {"a": "1", "@s/lib": "3"}, "optionalDependencies": {"c": "*"}, "scripts": {"no": "x"}}'
    return npm.dependency_names(spark.createDataFrame([(manifest,)], "source string"))


@_query(
    "dep, path",
    [("a", "/w/node_modules/a/t.d.ts"), ("b", "/w/node_modules/b/lib/main.d.ts"), ("c", "/w/node_modules/c/index.d.ts"), ("@s/d", "/w/node_modules/@s/d/index.ts"), ("@s/d", "/w/node_modules/@types/s__d/index.d.ts")],
)
def npm_entry_points(spark, sf_dir):
    at = "/w/node_modules/"
    manifests = [("a/package.json", '{"types": "./t.d.ts", "main": "m.js"}'), ("b/package.json", '{"exports": {".": {"import": "./lib/main.mjs"}}}'), ("c/package.json", "{}"),
                 ("@s/d/package.json", '{"main": "none.js"}'), ("@types/s__d/package.json", "{}"), ("@types/a/package.json", '{"types": "missing.d.ts"}')]
    files = ["a/t.d.ts", "a/m.d.ts", "b/lib/main.d.ts", "b/index.d.ts", "c/index.d.ts", "@s/d/index.ts", "@types/s__d/index.d.ts"]
    deps = spark.createDataFrame([(d,) for d in ("a", "b", "c", "@s/d", "gone")], "dep string")
    listing = spark.createDataFrame([(at + f,) for f in files], "path string")
    return npm.package_entries(spark.createDataFrame([(at + p, s) for p, s in manifests], "path string, source string"), deps, listing, "/w").select("dep", "path")


@_query("path, module", [("/w/src/pkg/__init__.py", "pkg"), ("/w/src/pkg/sub/m.py", "pkg.sub.m"), ("/w/src/tool.py", "src.tool"), ("/w/plain/gap/deep/x.py", "deep.x")])
def package_modules(spark, sf_dir):
    listing = ["/w/src/pkg/__init__.py", "/w/src/pkg/sub/__init__.py", "/w/src/pkg/sub/m.py", "/w/src/tool.py", "/w/plain/__init__.py", "/w/plain/gap/deep/__init__.py", "/w/plain/gap/deep/x.py"]
    files = tree.from_memory(spark, [(p, "") for p in listing])
    wanted = ["/w/src/pkg/__init__.py", "/w/src/pkg/sub/m.py", "/w/src/tool.py", "/w/plain/gap/deep/x.py"]
    return tree.with_python_modules(files, files, "/w").filter(F.col("path").isin(wanted)).select("path", F.col("file_qualifier").alias("module"))


@_query("path", [("src/a.ts",), ("distant/b.ts",), ("src/outer.ts",)])
def glob_exclusion(spark, sf_dir):
    listing = ["src/a.ts", "dist/a.ts", "x/node_modules/y/z.ts", "distant/b.ts", "src/out/c.ts", "src/outer.ts", ".venv/lib/a.py", ".git/x.ts"]
    return spark.createDataFrame([(p,) for p in listing], "path string").filter(~tree.excluded(F.col("path"), DEFAULT_EXCLUDES))


@_query("path, normal", [("/a/./b/../c", "/a/c"), ("/a//b/", "/a/b"), ("../x/./y", "../x/y"), ("a/../..", ".."), ("/", "/")])
def normalised_paths(spark, sf_dir):
    rows = spark.createDataFrame([(p,) for p in ("/a/./b/../c", "/a//b/", "../x/./y", "a/../..", "/")], "path string")
    return rows.select("path", paths.normalise(F.col("path")).alias("normal"))


@_query("path, specifier", [("/w/node_modules/lib/index.d.ts", "lib"), ("/w/node_modules/@s/lib/dist/x.js", "@s/lib/dist/x"), ("/w/src/ui/index.tsx", "./ui"), ("/w/lib/y.d.ts", "../lib/y")])
def module_specifiers(spark, sf_dir):
    from symbolgrid.operators import specifiers

    targets = ["/w/node_modules/lib/index.d.ts", "/w/node_modules/@s/lib/dist/x.js", "/w/src/ui/index.tsx", "/w/lib/y.d.ts"]
    rows = spark.createDataFrame([(p,) for p in targets], "path string")
    return rows.select("path", specifiers.module_specifier(F.lit("/w/src/a.ts"), F.col("path")).alias("specifier"))


@_query("quoted, bare", [("'x'", "x"), ('"y z"', "y z"), ("`t`", "t"), ("'a\"", "'a\""), ("plain", "plain")])
def unquoted_text(spark, sf_dir):
    rows = spark.createDataFrame([("'x'",), ('"y z"',), ("`t`",), ("'a\"",), ("plain",)], "quoted string")
    return rows.select("quoted", names.unquote(F.col("quoted")).alias("bare"))
