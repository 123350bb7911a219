"""Suggestions rendered as import edits of the files that asked."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolgrid.functions import paths, text
from symbolgrid.operators import specifiers
from symbolgrid.parsing.imports import edits, imported_names

EDITS = "array<struct<start:int,stop:int,text:string>>"


def with_imported_names(files: DataFrame) -> DataFrame:
    """files(path, lang, source) with ``already_imported``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [imported_names(a, s) for a, s in zip(batch["lang"], batch["source"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "already_imported": names})

    found = files.select("path", "lang", "source").mapInPandas(run, "path string, already_imported array<string>")
    return files.join(found, "path")


def render(suggestions: DataFrame, queries: DataFrame, sources: DataFrame, package_names: DataFrame | None = None, aliases: DataFrame | None = None, type_imports: str = "auto") -> DataFrame:
    """Suggestions with specifier, edits, detail and sort key; those without an edit are dropped.

    ``sources``(path, source) has the text of the asking files; ``package_names``(folder, name)
    manifests; ``aliases``(row_id struct of query_id and position, alias) chosen path aliases.
    """
    q = queries.select("query_id", "current_path", "language")
    rows = suggestions.join(q, "query_id").join(sources.select(F.col("path").alias("current_path"), "source"), "current_path")
    package = None
    if package_names is not None:
        folder = F.concat(F.substring_index("target_path", "/node_modules/", 1), F.lit("/node_modules/"), paths.node_package(F.col("target_path")))
        rows = rows.withColumn("folder", F.when(F.col("target_path").contains("/node_modules/"), folder))
        rows = rows.join(package_names.withColumnRenamed("name", "package_name"), "folder", "left")
        package = F.col("package_name")
    alias = None
    if aliases is not None:
        rows = rows.join(aliases.select("row_id.query_id", "row_id.position", "alias"), ["query_id", "position"], "left")
        alias = F.col("alias")
    own = specifiers.module_specifier(F.col("current_path"), F.col("target_path"), alias, package)
    rows = rows.withColumn("specifier", F.coalesce(F.nullif("file_qualifier", F.lit("")), own))
    keep = [*suggestions.columns, "language", "current_path", "specifier"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for r in batch.itertuples(index=False):
                found = edits(r.language, r.source, r.name, r.specifier, r.file_qualifier, r.parent_qualifier, r.flags, type_imports)
                made.append([{"start": a, "stop": b, "text": t} for a, b, t in found])
            yield batch[keep].assign(edits=made)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.select(*keep, "source").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + f", edits {EDITS}")
    shown = specifiers.display(F.col("language"), F.col("file_qualifier"), F.col("parent_qualifier"), F.col("name"), F.col("specifier"), F.col("target_path"))
    out = out.filter(F.size("edits") > 0)
    return out.withColumns({"description": shown, "detail": text.kind_label(F.col("kind")), "sort_key": F.lpad((F.col("position") - 1).cast("string"), 4, "0"), "preferred": F.col("position") == 1})
