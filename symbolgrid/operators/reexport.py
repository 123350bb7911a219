"""Re-exports: resolving module specifiers to files and flattening barrels to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolgrid.functions import paths
from symbolgrid.functions.bind import let
from symbolgrid.model import DEFAULT_EXPORT, RE_EXPORT
from symbolgrid.sources.scratch import Scratch

#: What is appended to a relative specifier, in the order of trial.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
SCRIPT_INDEXES = ("/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")


def script_candidates(specifier: Column, importer: Column) -> Column:
    """Files that a script's specifier can mean, in order of trial; none for a package name."""
    base = paths.normalise(F.when(specifier.startswith("/"), specifier).otherwise(F.concat(paths.parent(importer), F.lit("/"), specifier)))
    suffixes = F.array(*[F.lit(s) for s in SCRIPT_SUFFIXES + SCRIPT_INDEXES])
    tried = let(base, lambda b: F.transform(suffixes, lambda s: F.concat(b, s)))
    return F.when(specifier.rlike(r"^[./]"), tried).otherwise(F.array().cast("array<string>"))


def python_candidates(specifier: Column, importer: Column) -> Column:
    """Files that a relative Python module can mean: the module, then the package."""
    dots = F.length(F.regexp_extract(specifier, r"^(\.*)", 1))
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/")
    below = F.replace(F.substr(specifier, dots + 1), F.lit("."), F.lit("/"))
    base = paths.normalise(F.concat_ws("/", paths.parent(importer), F.nullif(up, F.lit("")), F.nullif(below, F.lit(""))))
    tried = let(base, lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py"))))
    return F.when(specifier.startswith("."), tried).otherwise(F.array().cast("array<string>"))


def first_existing(rows: DataFrame, tried: str, files: DataFrame, out: str = "target") -> DataFrame:
    """Per row the first path of the array column ``tried`` that is in files(path).

    Rows need a unique ``row_id``; those without any existing candidate are left out. Both joins are
    merged: sizes of computed paths are guessed too low, and a broadcast of rows or files, which
    grow with the input, would have to fit the driver.
    """
    each = rows.select("row_id", F.posexplode(tried).alias("pos", "path"))
    found = each.join(files.select("path").distinct().hint("merge"), "path").groupBy("row_id").agg(F.min_by("path", "pos").alias(out))
    rest = rows.drop(tried)
    return found if rest.columns == ["row_id"] else rest.hint("merge").join(found, "row_id")


def _tried(re_exports: DataFrame) -> DataFrame:
    """re_exports with ``tried``, the files that each can mean."""
    lang = paths.language_of(F.col("path"))
    tried = F.when(lang.isin("typescript", "javascript"), script_candidates(F.col("from_path"), F.col("path"))).when(
        lang == "python", python_candidates(F.col("from_path"), F.col("path"))
    )
    return re_exports.withColumn("tried", F.coalesce(tried, F.array().cast("array<string>")))


def barrel_edges(re_exports: DataFrame, files: DataFrame) -> DataFrame:
    """(barrel, ord, target, names): every re-export that resolves to another file."""
    rows = _tried(re_exports).select(F.struct("path", "ord").alias("row_id"), "tried", "names")
    found = first_existing(rows, "tried", files)
    out = found.select(F.col("row_id.path").alias("barrel"), F.col("row_id.ord").alias("ord"), "target", "names")
    return out.filter("barrel != target")


def meaning_any(re_exports: DataFrame, touched: DataFrame) -> DataFrame:
    """re_exports of touched(path) files, and those that can mean one of them."""
    each = _tried(re_exports).select("path", "ord", F.explode(F.array_append("tried", F.col("path"))).alias("means"))
    hit = each.join(touched.select(F.col("path").alias("means")).distinct(), "means", "left_semi").select("path", "ord").distinct()
    return re_exports.join(hit, ["path", "ord"], "left_semi")


def flatten_all(edges: DataFrame, exports: DataFrame) -> DataFrame:
    """What star edges bring: every export of the target but its default."""
    star = edges.filter("names is null").select("barrel", F.col("ord").alias("edge"), "target")
    rows = star.join(exports.withColumnRenamed("path", "target"), "target").filter(F.col("flags").bitwiseAND(F.lit(DEFAULT_EXPORT)) == 0)
    return rows.select(
        F.col("barrel").alias("path"), "edge", F.col("ord").alias("item"), "name", "kind",
        F.col("flags").bitwiseOR(F.lit(RE_EXPORT)).alias("flags"), "parent_qualifier",
        F.coalesce("source_path", "target").alias("source_path"), "line", "col",
    )


def flatten_named(edges: DataFrame, exports: DataFrame) -> DataFrame:
    """What named edges bring; of equal names in a target the last one counts."""
    named = edges.filter("names is not null").select("barrel", F.col("ord").alias("edge"), "target", F.posexplode("names").alias("item", "n"))
    named = named.select("barrel", "edge", "target", "item", F.col("n.exported_name").alias("exported"), F.coalesce("n.source_name", "n.exported_name").alias("name"))
    last = exports.groupBy(F.col("path").alias("target"), "name").agg(F.max_by(F.struct("kind", "flags", "parent_qualifier"), "ord").alias("e"))
    rows = named.join(last, ["target", "name"])
    return rows.select(
        F.col("barrel").alias("path"), "edge", "item", F.col("exported").alias("name"), F.col("e.kind").alias("kind"),
        F.col("e.flags").bitwiseOR(F.lit(RE_EXPORT)).alias("flags"), F.col("e.parent_qualifier").alias("parent_qualifier"),
        F.col("target").alias("source_path"), F.lit(0).alias("line"), F.lit(0).alias("col"),
    )


def merge_priority(own: DataFrame, flattened: DataFrame) -> DataFrame:
    """Own exports, all of them, then flattened ones: per (path, parent, name) the first that the
    path does not own. ``ord`` continues behind the own exports."""
    key = ["path", "parent", "name"]
    f = flattened.withColumn("parent", F.coalesce("parent_qualifier", F.lit("")))
    mine = own.select("path", F.coalesce("parent_qualifier", F.lit("")).alias("parent"), "name").distinct()
    fresh = f.join(mine, key, "left_anti")
    first = F.row_number().over(Window.partitionBy(*key).orderBy("edge", "item"))
    fresh = fresh.withColumn("first", first).filter("first = 1")
    sizes = own.groupBy("path").agg((F.max("ord") + 1).alias("base"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("edge", "item"))
    added = fresh.join(sizes, "path", "left").withColumn("ord", (F.coalesce("base", F.lit(0)) + place - 1).cast("int"))
    columns = ["path", "ord", "name", "kind", "flags", "parent_qualifier", "source_path", "line", "col"]
    return own.select(*columns).unionByName(added.select(*columns))


COLUMNS = ["path", "ord", "name", "kind", "flags", "parent_qualifier", "source_path", "line", "col"]


def flatten_fixpoint(spark: SparkSession, own: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols of all files with their re-exports resolved through chains of barrels of any length.

    Every round flattens all edges against the last round's symbols, from the own exports anew, so
    a cycle cannot keep alive what nobody exports. The names of a file only ever become more, so
    their number stops rising. Then symbols may still settle along chains, for as many rounds as
    the names took; in a cycle of barrels that offer different symbols of one name they need not,
    and the round after those counts.
    """
    scratch = Scratch(spark, "flatten")
    now, edges = own.select(*COLUMNS), scratch.put("edges", edges)
    seen, rounds, grew = None, 0, 0
    while True:
        found = flatten_all(edges, now).unionByName(flatten_named(edges, now))
        now = scratch.put(f"symbols{rounds}", merge_priority(own, found))
        if rounds > 1:
            scratch.drop(f"symbols{rounds - 2}")
        count, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*COLUMNS).cast("decimal(38,0)"))).first()
        rounds += 1
        if (count, total) == seen:
            return now
        if seen is None or count != seen[0]:
            grew = rounds
        elif rounds > 2 * grew + 1:
            return now
        seen = count, total


def dependents(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Barrels one step above changed(path) files."""
    return edges.join(changed.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select(F.col("barrel").alias("path")).distinct()


def flatten_part(spark: SparkSession, own: DataFrame, settled: DataFrame, edges: DataFrame, part: DataFrame) -> DataFrame:
    """Symbols of the files part(path) alone; all others have those in ``settled``, which depend on
    none of the part."""
    mine = own.join(part, "path", "left_semi").select(*COLUMNS)
    inner = edges.join(part.select(F.col("path").alias("barrel")), "barrel", "left_semi")
    used = settled.join(inner.select(F.col("target").alias("path")).distinct(), "path", "left_semi").select(*COLUMNS)
    found = flatten_fixpoint(spark, mine.unionByName(used), inner)
    return found.join(part, "path", "left_semi")


def reachable(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(barrel, target): everything a barrel reaches over links(barrel, target). Every round doubles
    the length of the chains that are followed."""
    scratch = Scratch(spark, "reach")
    closure, count, rounds = links.select("barrel", "target").distinct(), -1, 0
    while True:
        step = closure.select("barrel", F.col("target").alias("via")).join(closure.select(F.col("barrel").alias("via"), "target"), "via")
        closure = scratch.put(f"closure{rounds}", closure.unionByName(step.select("barrel", "target")).distinct())
        if rounds:
            scratch.drop(f"closure{rounds - 1}")
        now, rounds = closure.count(), rounds + 1
        if now == count:
            return closure
        count = now


def dependents_of(spark: SparkSession, changed: DataFrame, edges: DataFrame) -> DataFrame:
    """changed(path) and every barrel above, over any number of edges."""
    scratch = Scratch(spark, "dependents")
    found = scratch.put("found0", changed.select("path").distinct())
    fresh, rounds = found, 0
    while not fresh.isEmpty():
        rounds += 1
        fresh = scratch.put(f"fresh{rounds}", dependents(fresh, edges).join(found, "path", "left_anti"))
        found = scratch.put(f"found{rounds}", found.unionByName(fresh))
    return found
