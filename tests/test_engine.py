"""A small workspace end to end: build, ask, edit, restart, stream."""

import json

import pytest
from pyspark.sql import functions as F

from symbolgrid import model
from symbolgrid.__main__ import main
from symbolgrid.model import Settings
from symbolgrid.operators import extract, reexport, specifiers
from symbolgrid.parsing.extract import python_lines
from symbolgrid.plans.engine import Engine, query_row
from symbolgrid.sources import npm, tree
from symbolgrid.streaming import ingest

FILES = {
    "src/user.ts": "export class User {}\nexport function getCurrentUser() {}\nexport type UserId = string;\n",
    "src/order.ts": "export class Order {}\nexport function createOrder() {}\n",
    "src/barrel.ts": "export * from './user';\nexport { Order } from './order';\n",
    "src/consumer.ts": "const a = Us;\n",
    "package.json": json.dumps({"name": "host", "dependencies": {"fake-lib": "*"}}),
    "node_modules/fake-lib/package.json": json.dumps({"name": "fake-lib", "types": "index.d.ts"}),
    "node_modules/fake-lib/index.d.ts": "export declare class FakeClient {}\nexport declare function fakeFn(): void;\n",
    "pkg/models.py": "class Account: pass\nclass Invoice: pass\n",
    "pkg/__init__.py": "from .models import Account\n__all__ = ['Account']\n",
    "pkg/consumer.py": "def main(): pass\n",
    "pkg/query.py": "class Q: pass\nclass F: pass\n",
    "com/example/Foo.java": "package com.example;\npublic class Foo { public static class Inner {} }\n",
    "com/example/Consumer.java": "package com.example;\npublic class Consumer {}\n",
    "dist/skip.ts": "export class Skipped {}\n",
    "src/binary.ts": b"export class Bad {}\xff\xfe",
}


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("workspace")
    for path, content in FILES.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content if isinstance(content, bytes) else content.encode())
    library = root / ".venv/lib/python3.13/site-packages/fakelib"
    library.mkdir(parents=True)
    (library / "__init__.py").write_text("class FakeLibCls: pass\ndef fake_util(): pass\n")
    (library / "_private.py").write_text("class No: pass\n")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, workspace, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    e = Engine.open(spark, Settings(workspace), folder)
    assert e.tables is None
    e.build()
    return e


def symbols(engine):
    root = engine.settings.root
    rows = engine.tables["symbols"].collect()
    return {(r.path.removeprefix(root + "/"), r.name, r.kind, r.flags, r.parent_qualifier, r.file_qualifier) for r in rows}


def test_symbols(engine):
    got = symbols(engine)
    assert {x[:4] for x in got if x[0] == "src/barrel.ts"} == {
        ("src/barrel.ts", "User", 2, 4), ("src/barrel.ts", "getCurrentUser", 1, 4), ("src/barrel.ts", "UserId", 4, 6), ("src/barrel.ts", "Order", 2, 4),
    }
    assert ("pkg/__init__.py", "Account", 2, 4, None, "pkg") in got
    assert ("pkg/models.py", "Invoice", 2, 0, None, "pkg.models") in got
    assert ("com/example/Foo.java", "Inner", 2, 16, "Foo", "com.example") in got
    assert ("node_modules/fake-lib/index.d.ts", "FakeClient", 2, 0, None, "fake-lib") in got
    assert (".venv/lib/python3.13/site-packages/fakelib/__init__.py", "FakeLibCls", 2, 0, None, "fakelib") in got
    assert not {x for x in got if x[1] in ("Skipped", "Bad", "No")}


CASES = [
    ("src/consumer.ts", "Us", "User", "import { User } from './user';\n"),
    ("src/consumer.ts", "User", "UserId", "import type { UserId } from './user';\n"),
    ("src/consumer.ts", "O", "Order", "import { Order } from './order';\n"),
    ("src/consumer.ts", "Fake", "FakeClient", "import { FakeClient } from 'fake-lib';\n"),
    ("src/consumer.ts", "readFi", "readFileSync", "import { readFileSync } from 'node:fs';\n"),
    ("src/consumer.ts", "fs", "fs", "import * as fs from 'node:fs';\n"),
    ("src/consumer.ts", "createRe", "createRequire", "import { createRequire } from 'node:module';\n"),
    ("pkg/consumer.py", "Acc", "Account", None),
    ("pkg/consumer.py", "Inv", "Invoice", "from pkg.models import Invoice\n"),
    ("pkg/consumer.py", "Q", "Q", "from pkg.query import Q\n"),
    ("pkg/consumer.py", "Fake", "FakeLibCls", "from fakelib import FakeLibCls\n"),
    ("pkg/consumer.py", "Pat", "Path", "from pathlib import Path\n"),
    ("pkg/consumer.py", "jso", "json", "import json\n"),
    ("pkg/consumer.py", "ThreadPo", "ThreadPoolExecutor", "from concurrent.futures import ThreadPoolExecutor\n"),
    ("com/example/Consumer.java", "Fo", "Foo", "\nimport com.example.Foo;\n"),
    ("com/example/Consumer.java", "Inne", "Inner", "\nimport com.example.Foo.Inner;\n"),
    ("com/example/Consumer.java", "Array", "ArrayList", "\nimport java.util.ArrayList;\n"),
    ("com/example/Consumer.java", "Reentran", "ReentrantLock", "\nimport java.util.concurrent.locks.ReentrantLock;\n"),
]


def test_suggestions_and_edits(spark, engine, workspace):
    rows = [query_row(i, prefix, f"{workspace}/{path}") for i, (path, prefix, _, _) in enumerate(CASES)]
    sources = [(f"{workspace}/{p}", FILES[p]) for p in {c[0] for c in CASES}]
    files = tree.from_memory(spark, sources)
    got = engine.query_edits(spark.createDataFrame(rows, model.QUERIES), files).collect()
    for i, (_, _, name, edit) in enumerate(CASES):
        found = [r for r in got if r.query_id == i and r.name == name]
        assert found, CASES[i]
        assert edit is None or edit in [r.edits[0]["text"] for r in found], CASES[i]
    # What the asking file itself exports is never suggested to it.
    assert not [r for r in got if r.target_path == r.current_path]


def test_imported_names_are_left_out(spark, engine, workspace):
    path = f"{workspace}/src/consumer.ts"
    files = tree.from_memory(spark, [(path, "import {\n  User,\n} from './user';\nUs\n")])
    got = engine.query_edits(spark.createDataFrame([query_row(0, "User", path)], model.QUERIES), files).collect()
    assert "User" not in {r.name for r in got}
    assert "UserId" in {r.name for r in got}


def test_restart_and_settings(spark, engine, workspace):
    again = Engine.open(spark, engine.settings, engine.store.folder)
    assert symbols(again) == symbols(engine)
    assert Engine.open(spark, Settings(workspace, respect_all=False), engine.store.folder).tables is None
    with pytest.raises(RuntimeError):
        Engine(spark, engine.settings, engine.store.folder).stats()


def test_incremental_equals_rebuild(spark, engine, workspace, tmp_path):
    other = Engine(spark, engine.settings, str(tmp_path / "store"))
    other.build()
    before = symbols(other)
    path = f"{workspace}/src/user.ts"
    assert other.upsert(tree.from_memory(spark, [(path, FILES["src/user.ts"])])) == 0
    assert other.upsert(tree.from_memory(spark, [(path, "export class Person {}\nexport type UserId = string;\n")])) == 1
    names = {x[1] for x in symbols(other) if x[0] == "src/barrel.ts"}
    assert names == {"Person", "UserId", "Order"}  # the barrel follows, stale names are gone
    # A file that makes an edge resolvable, then back to where it was.
    fresh = [(f"{workspace}/src/late.ts", "export * from './later'"), (f"{workspace}/src/later.ts", "export class Late {}")]
    other.upsert(tree.from_memory(spark, fresh[:1]))
    other.upsert(tree.from_memory(spark, fresh[1:]))
    assert "Late" in {x[1] for x in symbols(other) if x[0] == "src/late.ts"}
    other.remove(spark.createDataFrame([(p,) for p, _ in fresh], "path string"))
    other.upsert(tree.from_memory(spark, [(path, FILES["src/user.ts"])]))
    assert {x[:4] for x in symbols(other)} == {x[:4] for x in before}


def test_changes_up_a_long_chain_equal_a_rebuild(spark, tmp_path):
    """Only what depends on a change is resolved anew, and it comes out as a rebuild has it."""
    root = tmp_path / "tree"
    root.mkdir()
    for k in range(14):
        (root / f"b{k}.ts").write_text(f"export * from './b{k + 1}';\nexport class B{k} {{}}\n")
    (root / "b14.ts").write_text("export class Deep {}\n")
    (root / "apart.ts").write_text("export * from './other';\n")
    (root / "other.ts").write_text("export class Other {}\n")
    settings = Settings(str(root), standard_library=False, script_packages=False, python_packages=False)
    e = Engine(spark, settings, str(tmp_path / "store"))
    e.build()
    assert {x[1] for x in symbols(e) if x[0] == "b0.ts"} == {"Deep", *[f"B{k}" for k in range(14)]}
    (root / "b14.ts").write_text("export class Deeper {}\n")
    (root / "b7.ts").unlink()
    (root / "late.ts").write_text("export * from './b10';\n")
    assert e.refresh() == 2
    assert e.refresh() == 0
    again = Engine(spark, settings, str(tmp_path / "again"))
    again.build()
    assert symbols(e) == symbols(again)
    assert {x[1] for x in symbols(e) if x[0] == "b0.ts"} == {f"B{k}" for k in range(7)}
    assert {x[1] for x in symbols(e) if x[0] == "b8.ts"} == {"Deeper", *[f"B{k}" for k in range(8, 14)]}


def test_a_warm_start_opens_changed_files_only(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    root.mkdir()
    for k in range(3):
        (root / f"f{k}.ts").write_text(f"export class F{k} {{}}\n")
    settings = Settings(str(root), standard_library=False, script_packages=False, python_packages=False)
    Engine(spark, settings, str(tmp_path / "store")).build()
    e = Engine.open(spark, settings, str(tmp_path / "store"))
    opened = []
    plain = tree.with_content
    monkeypatch.setattr(tree, "with_content", lambda listing, base: (opened.extend(r.path for r in listing.collect()), plain(listing, base))[1])
    assert e.refresh() == 0 and not opened
    (root / "f1.ts").write_text("export class Other {}\n")
    assert e.refresh() == 1
    assert {x.rpartition("/")[2] for x in opened} == {"f1.ts"}


def test_a_prefix_reaches_the_scan_of_the_dictionary(engine):
    from symbolgrid.operators import lookup

    found = lookup.prefix_range(engine.tables["words"], "Us")
    assert {"User", "UserId"} <= {r.name for r in found.collect()}
    plan = found._jdf.queryExecution().toString()
    assert "StringStartsWith(name_lc,us)" in plan


def test_aliases_and_package_names_reach_the_edits(spark, tmp_path):
    root = tmp_path / "tree"
    files = {
        "tsconfig.json": '{ "extends": "./configs/base" }',
        "configs/base.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"@/*": ["src/*"]}}}',
        "src/deep/model/user.ts": "export class User {}\n",
        "src/app/main.ts": "Us\n",
        "package.json": json.dumps({"dependencies": {"alias-dir": "*"}}),
        "node_modules/alias-dir/package.json": json.dumps({"name": "real-name", "types": "index.d.ts"}),
        "node_modules/alias-dir/index.d.ts": "export declare class UsefulClient {}\n",
    }
    for path, content in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    e = Engine(spark, Settings(str(root), standard_library=False, python_packages=False), str(tmp_path / "store"))
    e.build()
    path = f"{root}/src/app/main.ts"
    got = e.query_edits(spark.createDataFrame([query_row(0, "Us", path)], model.QUERIES), tree.from_memory(spark, [(path, "Us\n")])).collect()
    assert "import { User } from '@/deep/model/user';\n" in [r.edits[0]["text"] for r in got if r.name == "User"]
    assert {r.name for r in e.tables["packages"].collect()} == {"real-name"}
    assert [r.specifier for r in got if r.name == "UsefulClient"] == ["alias-dir"]


def test_cycles_with_different_symbols_of_one_name_end(spark):
    own = spark.createDataFrame([("/c.ts", 0, "X", 2, 0), ("/d.ts", 0, "X", 1, 0)], "path string, ord int, name string, kind int, flags int")
    own = own.withColumns({c: F.lit(None).cast("string") for c in ("parent_qualifier", "source_path")}).withColumns({"line": F.lit(0), "col": F.lit(0)})
    links = [("/a.ts", 0, "/b.ts", None), ("/a.ts", 1, "/c.ts", None), ("/b.ts", 0, "/a.ts", None), ("/b.ts", 1, "/d.ts", None)]
    edges = spark.createDataFrame(links, f"barrel string, ord int, target string, names {model.RE_EXPORT_NAMES}")
    got = sorted((r.path, r.name) for r in reexport.flatten_fixpoint(spark, own, edges).collect())
    assert got == [("/a.ts", "X"), ("/b.ts", "X"), ("/c.ts", "X"), ("/d.ts", "X")]


def test_stream(spark, engine, workspace, tmp_path):
    e = Engine(spark, Settings(workspace, standard_library=False, script_packages=False, python_packages=False), str(tmp_path / "store"))
    e.build()
    feed, path = tmp_path / "feed", f"{workspace}/src/live.ts"
    feed.mkdir()
    rows = [
        {"path": path, "op": "upsert", "source": "export class One {}", "seq": 1, "ts": "2024-01-01T00:00:00.000Z"},
        {"path": path, "op": "upsert", "source": "export class Two {}", "seq": 2, "ts": "2024-01-01T00:00:00.100Z"},
        {"path": f"{workspace}/src/order.ts", "op": "delete", "source": None, "seq": 3, "ts": "2024-01-01T00:00:00.100Z"},
    ]
    (feed / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema(ingest.CHANGES).json(str(feed))
    ingest.follow(e, stream, str(tmp_path / "checkpoint"), once=True, gap=None).awaitTermination()
    names = {x[1] for x in symbols(e)}
    assert "Two" in names and "One" not in names and "createOrder" not in names
    # The debounce in batch form: two edits within the gap are one burst, and the last one counts.
    burst = spark.read.schema(ingest.CHANGES).json(str(feed))
    assert {(r.path.rpartition("/")[2], r.seq) for r in ingest.bursts(burst).collect()} == {("live.ts", 2), ("order.ts", 3)}


def test_stream_of_bursts(spark, workspace, tmp_path):
    """In a stream a burst counts by its last edit, once the watermark has passed it."""
    e = Engine(spark, Settings(workspace, standard_library=False, script_packages=False, python_packages=False), str(tmp_path / "store"))
    e.build()
    (tmp_path / "feed").mkdir()
    edit = lambda name, source, seq, ts: {"path": f"{workspace}/src/{name}.ts", "op": "upsert", "source": source, "seq": seq, "ts": ts}
    rows = [
        edit("live", "export class One {}", 1, "2024-01-01T00:00:00.000Z"),
        edit("live", "export class Two {}", 2, "2024-01-01T00:00:00.100Z"),
        edit("late", "export class Late {}", 3, "2024-01-01T00:01:00.000Z"),
        {**edit("user", None, 4, "2024-01-01T00:00:00.100Z"), "op": "delete"},
    ]
    (tmp_path / "feed" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream, heard = spark.readStream.schema(ingest.CHANGES).json(str(tmp_path / "feed")), []
    ingest.follow(e, stream, str(tmp_path / "checkpoint"), once=True, progress=lambda epoch, done: heard.append(done)).awaitTermination()
    names = {x[1] for x in symbols(e)}
    assert "Two" in names and not names & {"One", "Late", "getCurrentUser"}
    assert sum(heard) == 1


def test_command_line(spark, workspace, tmp_path):
    run = lambda verb, *more: main([verb, workspace, str(tmp_path / "store"), *more], spark)
    *steps, counts = map(json.loads, run("refresh"))  # there is no store yet
    assert [x["done"] for x in steps] == ["files", "edges", "symbols", "standard"] and all(x["rows"] for x in steps)
    assert json.loads(run("stats")[0]) == counts
    assert json.loads(run("refresh")[0]) == {"changed": 0}
    found = [json.loads(x) for x in run("query", "Us", f"{workspace}/src/consumer.ts", "--limit", "2")]
    assert [x["position"] for x in found] == [1, 2] and found[0]["name"] == "User"
    assert run("clear") == [] and json.loads(run("stats")[0]) == counts


def test_line_patterns_in_sql_equal_python(spark):
    sources = [
        ("a.py", '"""doc\nclass No: pass\n"""\nclass A(:\n  def no(self): pass\nasync def f(: pass\nx: int = 1  # c\nif = 3\n_p = 2\n'),
        ("b.py", "__all__ = ['A', \"_q\"]\nclass A: pass\n_q = 1\nz = 2\n"),
        ("c.py", "'''one line'''\n# no\nq = '#'\n\n'''open\nclass X: pass\n"),
        ("d.py", ""),
    ]
    got = extract.python_line_symbols(spark.createDataFrame(sources, "path string, source string")).collect()
    want = {(p, e["line"], e["name"], e["kind"]) for p, s in sources for e in python_lines(s).exports}
    assert {(r.path, r.line, r.name, r.kind) for r in got} == want


def test_cycles_end(spark):
    own = spark.createDataFrame([("/a.ts", 0, "A", 2, 0), ("/b.ts", 0, "B", 2, 0)], "path string, ord int, name string, kind int, flags int")
    own = own.withColumns({c: F.lit(None).cast("string") for c in ("parent_qualifier", "source_path")}).withColumns({"line": F.lit(0), "col": F.lit(0)})
    edges = spark.createDataFrame([("/a.ts", 0, "/b.ts", None), ("/b.ts", 0, "/a.ts", None), ("/c.ts", 0, "/b.ts", None)], f"barrel string, ord int, target string, names {model.RE_EXPORT_NAMES}")
    got = {(r.path, r.name) for r in reexport.flatten_fixpoint(spark, own, edges).collect()}
    assert got == {("/a.ts", "A"), ("/a.ts", "B"), ("/b.ts", "A"), ("/b.ts", "B"), ("/c.ts", "A"), ("/c.ts", "B")}


def test_first_existing_sends_neither_rows_nor_files_to_the_driver(spark, tmp_path):
    rows = [(1, "b", ["/a.ts", "/b.ts"]), (2, None, ["/x.ts", "/b.ts", "/a.ts"]), (3, "c", ["/x.ts"]), (4, "d", []), (5, "e", ["/a.ts", "/a.ts"])]
    spark.createDataFrame(rows, "row_id long, note string, tried array<string>").write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame([("/a.ts",), ("/b.ts",), ("/a.ts",), (None,)], "path string").write.parquet(str(tmp_path / "files"))
    rows, files = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "files"))
    for given in (rows.drop("note"), rows):
        found = reexport.first_existing(given, "tried", files)
        got = {tuple(r[c] for c in found.columns) for r in found.collect()}
        want = {(1, "b", "/a.ts"), (2, None, "/b.ts"), (5, "e", "/a.ts")}
        assert found.columns == [c for c in given.columns if c != "tried"] + ["target"]
        assert got == (want if "note" in given.columns else {(r[0], r[2]) for r in want})
        assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_package_files():
    assert npm.entry_points(json.dumps({"exports": {".": {"types": "./t.d.ts", "default": "./d.js"}}, "main": "m.js"})) == ["./t.d.ts", "./d.js", "m.js", "index.d.ts", "index.ts"]
    assert npm.entry_points("{broken") == ["index.d.ts", "index.ts"]
    assert npm.probes("lib/x.mjs")[0] == "lib/x.d.ts"
    configs = [("/r/tsconfig.json", '{ // c\n "extends": "./base", "compilerOptions": {"baseUrl": "."},}'), ("/r/base.json", '{"compilerOptions": {"paths": {"@/*": ["src/*"], "one": ["lib/one.ts"]}}}')]
    assert [r[2:] for r in npm.path_aliases(configs) if r[0] == "/r/tsconfig.json"] == [("@/*", "/r/src/*"), ("one", "/r/lib/one.ts")]
    assert npm.path_aliases([("/a.json", '{"extends": "./a"}')]) == []


def test_aliases(spark):
    rules = spark.createDataFrame([(0, "@/*", "/r/src/*"), (1, "@ui/*", "/r/src/ui/*"), (2, "one", "/r/lib/one.ts")], "ord int, pattern string, target string")
    rows = spark.createDataFrame([(1, "/r/src/a.ts"), (2, "/r/src/ui/b/c.tsx"), (3, "/r/lib/one.ts"), (4, "/r/lib/two.ts")], "row_id int, target_path string")
    assert {r.row_id: r.alias for r in specifiers.best_alias(rows, rules).collect()} == {1: "@/a", 2: "@ui/b/c", 3: "one"}


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [("**/dist/**", "dist/a.ts", True), ("**/dist/**", "x/dist/a/b.ts", True), ("*.ts", "a.ts", True), ("*.ts", "x/a.ts", False), ("src/{a,b}.ts", "src/b.ts", True), ("[", "[", False)],
)
def test_globs(spark, glob, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(tree.excluded(F.col("p"), (glob,)).alias("x")).first()["x"] is want
