"""How one file imports from another: aliases, packages, relative paths, qualified names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolgrid.functions import paths, text


def ancestors(path: Column) -> Column:
    """All folders above a file, from the root down."""
    parts = F.split(paths.parent(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def nearest_config(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """rows(row_id, path) with the ``config`` file in the nearest folder above; others are left out."""
    at = rows.select("row_id", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder"))
    have = configs.select("config", paths.parent(F.col("config")).alias("folder"))
    return at.join(have, "folder").groupBy("row_id").agg(F.max_by("config", "depth").alias("config"))


def matched_alias(pattern: Column, target: Column, path: Column) -> Column:
    """The specifier that a path alias gives a file, null if it does not apply.

    With wildcards the target's star stands for the part of the file's path, without its
    extension, that goes where the pattern has its star; without, target and file must be equal.
    """
    bare = paths.strip_extension(path)
    at = F.instr(target, "*")
    head, tail = F.substr(target, F.lit(1), at - 1), F.substr(target, at + 1)
    fits = bare.startswith(head) & bare.endswith(tail) & (F.length(bare) >= F.length(head) + F.length(tail))
    middle = F.substr(bare, at, F.length(bare) - F.length(head) - F.length(tail))
    star = F.concat(F.substring_index(pattern, "*", 1), middle, F.substring_index(pattern, "*", -1))
    both, neither = pattern.contains("*") & (at > 0), ~pattern.contains("*") & (at == 0)
    return F.when(both & fits, star).when(neither & (paths.strip_extension(target) == bare), pattern)


def best_alias(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows(row_id, target_path[, config]) with ``alias``: the most specific applying rule's
    specifier, on ties the first. ``rules``(ord, pattern, target[, config]) have absolute targets;
    where both have a config, a row meets the rules of its own. Rules whose target has a fixed folder
    meet only files below that folder (an equi-join), not every file."""
    own = ["config"] if "config" in rows.columns and "config" in rules.columns else []
    folder = paths.parent(F.regexp_replace("target", r"\*.*$", ""))
    keyed = rules.select(*own, "ord", "pattern", "target", folder.alias("folder"))
    at = rows.select("row_id", *own, "target_path", F.explode(ancestors(F.col("target_path"))).alias("folder"))
    met = at.join(keyed, ["folder", *own]).withColumn("alias", matched_alias(F.col("pattern"), F.col("target"), F.col("target_path"))).filter("alias is not null")
    weight = F.length(F.replace(F.col("pattern"), F.lit("*"), F.lit("")))
    return met.groupBy("row_id").agg(F.max_by("alias", F.struct(weight, -F.col("ord"))).alias("alias"))


def aliases_of(suggestions: DataFrame, asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(row_id, alias) of suggestions(query_id, position, target_path), by the rules(config, ord,
    pattern, target) of the project file nearest above the file that asked."""
    rows = suggestions.join(asked.select("query_id", "current_path"), "query_id")
    rows = rows.select(F.struct("query_id", "position").alias("row_id"), F.col("current_path").alias("path"), "target_path")
    near = nearest_config(rows.select("row_id", "path"), rules.select("config").distinct())
    return best_alias(rows.join(near, "row_id").select("row_id", "target_path", "config"), rules)


def module_specifier(current: Column, target: Column, alias: Column | None = None, package: Column | None = None) -> Column:
    """Package, else alias, else relative path."""
    choices = [paths.node_specifier(target, package), *([alias] if alias is not None else []), paths.relative_specifier(current, target)]
    return F.coalesce(*choices)


def display(lang: Column, qualifier: Column, parent: Column, name: Column, specifier: Column, path: Column) -> Column:
    """What a suggestion shows as its origin."""
    java = text.java_name(qualifier, parent, name)
    return F.when(lang == "java", java).otherwise(F.coalesce(F.nullif(qualifier, F.lit("")), specifier, path))
