"""Keyed upserts and deletes, suppression of unchanged files, and the cascade above changed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unread(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of listing(path, mtime) that the store has not at that very time of change: only these
    are opened."""
    return listing.join(stored.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti")


def changed(incoming: DataFrame, stored: DataFrame, *key: str) -> DataFrame:
    return incoming.join(stored.select(*key).distinct(), list(key), "left_anti")


def latest(edits: DataFrame, key: str = "path", *order: str) -> DataFrame:
    """Of each key the last edit; arrival order is truth, so ``order`` must be total."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return edits.withColumn("last", last).filter("last = 1").drop("last")


def debounced(edits: DataFrame, gap: str, key: str = "path", ts: str = "ts", order: str = "seq") -> DataFrame:
    """The last edit of every burst: an edit counts if none of its key follows within ``gap``."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, order))
    quiet = following.isNull() | (following > F.col(ts) + F.expr(f"interval {gap}"))
    return edits.withColumn("quiet", quiet).filter("quiet").drop("quiet")


def upsert(stored: DataFrame, rows: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """The store after all rows of the touched keys are replaced by ``rows``."""
    touched = rows.select(key).unionByName(removed.select(key)).distinct()
    return stored.join(touched, key, "left_anti").unionByName(rows)
