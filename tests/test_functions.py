"""Scalar functions against values worked out by hand, and against plain Python versions."""

import random

import pytest
from pyspark.sql import functions as F

from symbolgrid.functions import context, names, paths, scoring, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("prefix", "name", "want"), [("User", "User", 994), ("Us", "UserService", 487), ("us", "UserService", 287), ("UIC", "UserInfoCard", 228), ("xyz", "UserService", -11)]
)
def test_score(spark, prefix, name, want):
    hint = {h: F.lit(False) for h in context.HINTS}
    got = scoring.score(F.col("p"), F.col("n"), F.lit(0), F.lit(0), F.lit(3), F.lit(0), hint)
    assert one(spark, got, p=prefix, n=name) == want


def plain_initials(name):
    out = ""
    for i, c in enumerate(name):
        p = name[i - 1] if i else ""
        lower = p.isascii() and (p.islower() or p.isdigit())
        if i == 0 or p in "_-.$" or (c.isascii() and c.isupper() and lower) or (c in "0123456789" and p not in "0123456789"):
            out += c.lower() if c.isascii() else c
    return out


def test_initials(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aBc_D9.$xYé-") for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["UserInfoCard", "create_user"]
    got = spark.createDataFrame([(w,) for w in words], "n string").select("n", names.initials(F.col("n")).alias("i")).collect()
    assert {r.n: r.i for r in got} == {w: plain_initials(w) for w in words}


@pytest.mark.parametrize(("q", "letters", "want"), [("uic", "uic", True), ("uc", "uic", True), ("cu", "uic", False), ("", "a", True), ("a", "", False)])
def test_subsequence(spark, q, letters, want):
    assert one(spark, names.is_subsequence(F.col("q"), F.col("l")), q=q, l=letters) is want


def hint_set(spark, language, before, after=""):
    h = context.hints(F.col("l"), F.col("b"), F.col("a"))
    row = one(spark, h, l=language, b=before, a=after)
    return {k for k in context.HINTS if row[k]}


@pytest.mark.parametrize(
    ("language", "before", "after", "want"),
    [
        ("typescript", "const user: ", "", {"type"}),
        ("typescript", "x = { key: ", "", set()),
        ("typescript", "function f(a: ", "", {"type"}),
        ("typescript", "new ", "(", {"construct", "call"}),
        ("typescript", "renew ", "", set()),
        ("typescript", "import ", "", {"module"}),
        ("javascript", "a as ", "", {"type"}),
        ("python", "def f(a: ", "", {"type"}),
        ("python", "d = {'k': ", "", set()),
        ("python", "{'k': ", "", set()),
        ("python", "x -> ", "", {"type"}),
        ("python", "@", "", {"annotation"}),
        ("java", "throws ", "", {"type"}),
        ("java", "f(a, ", ".x", {"type", "module"}),
        ("java", "new ", "", {"construct"}),
    ],
)
def test_hints(spark, language, before, after, want):
    assert hint_set(spark, language, before, after) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("/r/src/a.ts", "/r/src/b.ts", 80), ("/r/src/a.ts", "/r/src/x/b.ts", 55), ("/r/src/a.ts", "/r/lib/b.ts", 35),
        ("/r/src/components/a.ts", "/r/node_modules/lib/b.ts", -17), ("/a.ts", "/r/b.ts", 0), ("/r/a/b/c/x.ts", "/q/d/e/f/y.ts", 0),
    ],
)
def test_proximity(spark, a, b, want):
    assert one(spark, paths.proximity(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("path", "want"), [("/a/./b/../c", "/a/c"), ("/a//b/", "/a/b"), ("../x/./y", "../x/y"), ("a/../..", ".."), ("/", "/")])
def test_normalise(spark, path, want):
    assert one(spark, paths.normalise(F.col("p")), p=path) == want


@pytest.mark.parametrize(
    ("current", "target", "want"),
    [
        ("/r/src/a.ts", "/r/src/user.ts", "./user"), ("/r/src/a.ts", "/r/lib/x.d.ts", "../lib/x"), ("/r/src/a.ts", "/r/src/ui/index.tsx", "./ui"),
        ("/r/src/deep/a.ts", "/r/b.mjs", "../../b"),
    ],
)
def test_relative_specifier(spark, current, target, want):
    assert one(spark, paths.relative_specifier(F.col("c"), F.col("t")), c=current, t=target) == want


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("/r/node_modules/lib/index.d.ts", "lib"), ("/r/node_modules/@s/lib/dist/index.js", "@s/lib"), ("/r/node_modules/lib/dist/x.d.ts", "lib/dist/x"), ("/r/src/a.ts", None),
        ("/r/node_modules/a/node_modules/b/c.ts", "b/c"),
    ],
)
def test_node_specifier(spark, target, want):
    assert one(spark, paths.node_specifier(F.col("t")), t=target) == want


@pytest.mark.parametrize(
    ("path", "parent", "want"),
    [
        ("/r/pkg/models.py", "/r", "pkg.models"), ("/r/src/pkg/__init__.py", "/r/src", "pkg"), ("/r/tool.py", None, "tool"), ("/else/x.py", None, None),
        ("/r/.venv/lib/python3/site-packages/requests/api.py", None, "requests.api"),
    ],
)
def test_python_module(spark, path, parent, want):
    got = paths.python_module(F.col("p"), F.lit("/r"), F.lit(parent).cast("string"))
    assert one(spark, got, p=path) == want


@pytest.mark.parametrize(("line", "want"), [("a = 1 # c", "a = 1 "), ("s = '#' # x", "s = '#' "), ('t = "\\"#" #', 't = "\\"#" '), ("#all", ""), ("plain", "plain")])
def test_strip_comment(spark, line, want):
    assert one(spark, text.strip_comment(F.col("s")), s=line) == want


def test_small_text_functions(spark):
    assert one(spark, names.unquote(F.col("s")), s="'x'") == "x"
    assert one(spark, names.unquote(F.col("s")), s="'x\"") == "'x\""
    assert one(spark, text.java_name(F.col("p"), F.lit(""), F.lit("Foo")), p="com.x") == "com.x.Foo"
    assert one(spark, text.java_imported_names(F.col("s")), s="import a.B;\n import static c.D.e;\nimport f.*;") == ["B", "e"]
    assert one(spark, names.ascii_lower(F.col("s")), s="AÉz") == "aÉz"
    row = one(spark, context.line_around(F.col("s"), F.lit(8), F.lit(10)), s="ab\ncd = Us(x)\ne")
    assert (row["line_prefix"], row["line_suffix"]) == ("cd = ", "(x)")
