"""Counts over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stats(symbols: DataFrame) -> DataFrame:
    """One row: files, names, paths and postings. Names count live strings, qualifiers included."""
    strings = F.explode(F.array_distinct(F.filter(F.array("name", "file_qualifier", "parent_qualifier"), lambda x: x.isNotNull() & (x != ""))))
    names = symbols.select(strings.alias("s")).agg(F.countDistinct("s").alias("names"))
    rest = symbols.agg(F.countDistinct("path").alias("files"), F.countDistinct("path").alias("paths"), F.count(F.lit(1)).alias("hot_entries"))
    return rest.join(F.broadcast(names))  # one row each


def indexer_counters(files: DataFrame) -> DataFrame:
    """One row of counters by the extraction status."""
    n = lambda *status: F.count(F.when(F.col("status").isin(*status), 1))
    return files.agg(
        n("parsed", "fallback").alias("parsed"), n("skipped_large").alias("skipped_large"),
        n("failed").alias("parse_failures"), n("fallback").alias("python_regex_fallbacks"),
    )


def posting_groups(symbols: DataFrame) -> DataFrame:
    """Per name its postings in a fixed order; for export and debugging."""
    entries = F.sort_array(F.collect_list(F.struct("path", "kind", "flags")))
    return symbols.groupBy("name").agg(entries.alias("postings"))
