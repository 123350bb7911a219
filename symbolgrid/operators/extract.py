"""Extraction as a table function: files with their text in, nested symbols and re-exports out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolgrid import model
from symbolgrid.functions import paths, text
from symbolgrid.model import Settings
from symbolgrid.parsing.extract import HEAD, KEYWORDS, UNIT, extract


def extract_files(files: DataFrame, settings: Settings) -> DataFrame:
    """files(path, lang, content_hash, mtime, source, file_qualifier) to model.EXTRACTED.

    A given qualifier wins over the parsed one. Source too long for a scan has status
    ``skipped_large`` and no symbols; a file that breaks its parser has status ``failed``.
    """
    respect_all, include_inner = settings.respect_all, settings.include_inner

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = extract(r.lang, r.source, respect_all, include_inner)
                rows.append((r.path, r.lang, r.content_hash, r.mtime, found.status, r.file_qualifier or found.file_qualifier, found.exports, found.re_exports))
            columns = ["path", "lang", "content_hash", "mtime", "status", "file_qualifier", "exports", "re_exports"]
            yield pd.DataFrame(rows, columns=columns)

    fits = F.octet_length("source") <= model.MAX_FILE_BYTES
    rows = files.select("path", "lang", "content_hash", "mtime", "source", "file_qualifier")
    parsed = rows.filter(fits).mapInPandas(run, model.EXTRACTED)
    types = dict(f.split(" ", 1) for f in ("exports " + model.EXTRACTED.split("exports ", 1)[1].split(", re_exports ")[0], "re_exports " + model.EXTRACTED.split(", re_exports ")[1]))
    large = rows.filter(~fits).select(
        "path", "lang", "content_hash", "mtime", F.lit("skipped_large").alias("status"), "file_qualifier",
        F.array().cast(types["exports"]).alias("exports"), F.array().cast(types["re_exports"]).alias("re_exports"),
    )
    return parsed.unionByName(large)


def exports_of(extracted: DataFrame) -> DataFrame:
    """One row per own export, ``ord`` in source order."""
    rows = extracted.select("path", "file_qualifier", F.posexplode("exports").alias("ord", "e"))
    none = F.lit(None).cast("string")
    return rows.select("path", "ord", "e.name", "e.kind", "e.flags", "e.parent_qualifier", none.alias("source_path"), "e.line", "e.col", "file_qualifier")


def re_exports_of(extracted: DataFrame) -> DataFrame:
    return extracted.select("path", F.posexplode("re_exports").alias("ord", "r")).select("path", "ord", "r.from_path", "r.names", "r.is_type_only")


def files_of(extracted: DataFrame) -> DataFrame:
    group = paths.group_of(F.col("lang")).alias("lang_group")
    return extracted.select("path", "lang", group, "file_qualifier", "content_hash", "mtime", F.size("exports").alias("n_exports"), "status")


def python_line_symbols(files: DataFrame) -> DataFrame:
    """The line scanner for Python as one relational plan: files(path, source) to (path, line, name,
    kind). A unit's line is the number of line ends in the units before it."""
    units = files.select("path", F.posexplode(F.regexp_extract_all("source", F.lit(UNIT.replace(r"\Z", r"\z")), F.lit(0))).alias("unit_at", "unit"))
    ends = F.length("unit") - F.length(F.replace("unit", F.lit("\n"), F.lit("")))
    before = Window.partitionBy("path").orderBy("unit_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("line", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("int"))
    open_ = placed.filter(F.col("unit").rlike("^[^ \t#\n'\"]"))
    code = F.regexp_replace(text.strip_comment(F.col("unit")), r"^\s+|\s+$", "")
    part = lambda k: F.regexp_extract("code", "^" + HEAD, k)
    heads = open_.select("path", "line", code.alias("code")).select("path", "line", part(1).alias("declares"), part(2).alias("name"), part(3).alias("rest")).filter("name != ''")
    value = F.ltrim(F.substr("rest", F.lit(2)))
    closed = F.regexp_extract(value, r"^[\[(]([^\])]*)[\])]", 0)
    is_list = (F.col("declares") == "") & (F.col("name") == "__all__") & F.col("rest").startswith("=") & (closed != "")
    whole = Window.partitionBy("path")
    last = F.max_by(closed, F.when(is_list, F.col("line"))).over(whole)
    allowed = F.regexp_extract_all(last, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    assigned = F.col("rest").startswith("=") | (F.col("rest").startswith(":") & F.col("rest").contains("="))
    counts = F.when(F.col("declares") != "", F.lit(True)).otherwise(assigned & ~F.col("name").isin(*KEYWORDS, "__all__"))
    kind = F.when(F.col("declares") == "class", model.CLASS).when(F.col("declares") != "", model.FUNCTION).otherwise(model.VARIABLE)
    named = heads.select("path", "line", "name", kind.alias("kind"), counts.alias("counts"), allowed.alias("allowed"))
    keep = F.when(F.col("allowed").isNull(), ~F.col("name").startswith("_")).otherwise(F.array_contains("allowed", F.col("name")))
    return named.filter(F.col("counts") & keep).select("path", "line", "name", "kind")
