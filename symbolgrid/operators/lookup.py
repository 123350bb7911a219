"""Ranked lookup of symbols by typed prefix, for one query or very many in one job.

A query takes part of the name dictionary as candidates: names that start with the prefix in
dictionary order, then, if the budget is not used up, names whose initials contain it. Candidates
join the symbols, are filtered, scored, deduplicated and cut to the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolgrid.functions import context, names, paths, scoring
from symbolgrid.model import MODULE_IMPORT

#: Prefixes meet names on this many leading characters; what is longer is a residual condition.
KEY_CHARS = 3


def budget(limit: Column) -> Column:
    return F.greatest(limit * 10, F.lit(200))


def dictionary(symbols: DataFrame) -> DataFrame:
    """names(name, name_lc, bucket, initials): every string a symbol brings, qualifiers included."""
    strings = [symbols.select(F.col(c).alias("name")) for c in ("name", "file_qualifier", "parent_qualifier")]
    every = strings[0].unionByName(strings[1]).unionByName(strings[2]).filter("name is not null and name != ''").distinct()
    lc = names.ascii_lower(F.col("name"))
    return every.select("name", lc.alias("name_lc"), names.bucket(lc).alias("bucket"), names.initials(F.col("name")).alias("initials"))


def prefix_range(words: DataFrame, prefix: str) -> DataFrame:
    """Names that start with a prefix, in dictionary order; the condition reaches a Parquet scan."""
    return words.filter(F.col("name_lc").startswith(prefix.translate(str.maketrans(names.UPPER, names.LOWER))))


def prepared(queries: DataFrame) -> DataFrame:
    """Queries with their derived columns; an empty prefix or a limit of zero asks for nothing."""
    lc = names.ascii_lower(F.col("prefix"))
    hint = context.hints(F.col("language"), F.col("line_prefix"), F.col("line_suffix"))
    asked = queries.filter((F.length("prefix") > 0) & (F.col("limit") > 0))
    return asked.withColumns({"prefix_lc": lc, "budget": budget(F.col("limit")), "hint": hint, "query_group": paths.group_of(F.col("language"))})


def candidates(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, name, initials, stage, place): each query's names, ``place`` from 1 to its budget.

    Both stages are equi-joins: on the leading characters, and on the first letter with the
    prefix's second letter among the initials. The second stage sees only queries that the first
    left with budget to spare.
    """
    keys = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(KEY_CHARS)), lambda k: F.substring("name_lc", F.lit(1), k))))
    by_key = words.select("name", "name_lc", "initials", keys.alias("key"))
    q = asked.select("query_id", "prefix_lc", "budget", F.substring("prefix_lc", 1, KEY_CHARS).alias("key"))
    order = Window.partitionBy("query_id").orderBy("name_lc", "name")
    first = by_key.join(q, "key").filter(F.expr("startswith(name_lc, prefix_lc)"))
    first = first.withColumn("place", F.row_number().over(order)).filter("place <= budget")
    first = first.select("query_id", "name", "initials", "budget", F.lit(0).alias("stage"), "place")

    used = first.groupBy("query_id").agg(F.max("place").alias("used"))
    spare = asked.filter(F.octet_length("prefix") >= 2).join(used, "query_id", "left")
    spare = spare.withColumn("spare", F.col("budget") - F.coalesce("used", F.lit(0))).filter("spare > 0")
    letters = F.explode(F.array_distinct(F.split(F.substr("initials", F.lit(2)), "")))
    by_letter = words.filter(F.length("initials") > 1).select("name", "name_lc", "bucket", "initials", letters.alias("letter"))
    q = spare.select("query_id", "prefix_lc", "spare", F.coalesce("used", F.lit(0)).alias("used"), F.substring("prefix_lc", 1, 1).alias("bucket"), F.substring("prefix_lc", 2, 1).alias("letter"))
    second = by_letter.join(q, ["bucket", "letter"]).filter(~F.expr("startswith(name_lc, prefix_lc)"))
    second = second.filter(names.is_subsequence(F.col("prefix_lc"), F.col("initials")))
    second = second.withColumn("rank", F.row_number().over(order)).filter("rank <= spare")
    second = second.select("query_id", "name", "initials", F.lit(1).alias("stage"), (F.col("rank") + F.col("used")).alias("place"))
    return first.select("query_id", "name", "initials", "stage", "place").unionByName(second)


def without_imported(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Candidates whose name the query's file has not imported yet."""
    gone = asked.select("query_id", F.explode("already_imported").alias("name"))
    return found.join(gone, ["query_id", "name"], "left_anti")


def scored(found: DataFrame, asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidates joined to the symbols that can be imported where the query stands, with scores."""
    q = asked.select("query_id", "prefix", "current_path", "query_group", "hint", "limit")
    rows = found.join(q, "query_id").join(symbols.select("name", "path", "kind", "flags", "file_qualifier", "parent_qualifier"), "name")
    rows = rows.withColumn("target_group", paths.group_of(paths.language_of(F.col("path"))))
    rows = rows.filter((F.col("path") != F.coalesce("current_path", F.lit(""))) & (F.col("target_group") == F.col("query_group")))
    near = paths.proximity(F.coalesce("current_path", F.lit("")), F.col("path"))
    hint = {h: F.col("hint")[h] for h in context.HINTS}
    points = scoring.score(F.col("prefix"), F.col("name"), F.col("kind"), F.col("flags"), paths.depth(F.col("path")), near, hint, F.col("initials"))
    return rows.withColumn("score", points)


def best_first() -> list[Column]:
    """A total order: score, then dictionary place, then path, kind and flags."""
    return [F.desc("score"), F.col("place"), F.col("path"), F.col("kind"), F.col("flags")]


def best_per_key(rows: DataFrame) -> DataFrame:
    """The best row per query and (name, qualifier or path, parent, module import or not)."""
    key = ["query_id", "name", F.coalesce("file_qualifier", "path"), "parent_qualifier", scoring.has(F.col("flags"), MODULE_IMPORT)]
    best = F.row_number().over(Window.partitionBy(*key).orderBy(*best_first()))
    return rows.withColumn("best", best).filter("best = 1").drop("best")


def top(rows: DataFrame) -> DataFrame:
    """Each query's best rows up to its limit, ``position`` from 1."""
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first()))
    return rows.withColumn("position", position).filter(F.col("position") <= F.col("limit"))


def suggestions(symbols: DataFrame, queries: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(query_id, position, name, kind, flags, target_path, file_qualifier, parent_qualifier, score)."""
    asked = prepared(queries)
    found = without_imported(candidates(words if words is not None else dictionary(symbols), asked), asked)
    rows = top(best_per_key(scored(found, asked, symbols)))
    return rows.select("query_id", "position", "name", "kind", "flags", F.col("path").alias("target_path"), "file_qualifier", "parent_qualifier", "score")


def as_lines(found: DataFrame) -> DataFrame:
    """One JSON line per suggestion, camel-case keys, nulls left out."""
    camel = lambda c: "".join(p.capitalize() if i else p for i, p in enumerate(c.split("_")))
    row = F.struct(*[F.col(c).alias(camel(c)) for c in found.columns])
    return found.select(F.to_json(row, {"ignoreNullFields": "true"}).alias("value"))
