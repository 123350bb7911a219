"""Change feeds into the engine: debounce, last edit wins, unchanged content is no work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symbolgrid.functions import paths, text
from symbolgrid.operators import incremental
from symbolgrid.plans.engine import Engine

#: path, op (upsert or delete), source, seq (arrival order), ts.
CHANGES = "path string, op string, source string, seq long, ts timestamp"
DEBOUNCE, FLUSH = "200 milliseconds", "10 seconds"


def bursts(changes: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """The last edit of every burst of a path. In a stream a burst is final once the watermark,
    ``late`` behind the newest event, has passed it; it bounds the state that is kept."""
    rows = changes.withWatermark("ts", late) if changes.isStreaming else changes
    last = F.max_by(F.struct("op", "source", "seq"), "seq").alias("last")
    found = rows.groupBy("path", F.session_window("ts", gap).alias("burst")).agg(last)
    return found.select("path", "last.*", F.col("burst.end").alias("ts"))


def as_files(changes: DataFrame) -> DataFrame:
    lang = paths.language_of(F.col("path"))
    rows = changes.select(
        "path", lang.alias("lang"), text.content_hash(F.col("source")).alias("content_hash"),
        F.unix_millis("ts").alias("mtime"), "source", F.lit(None).cast("string").alias("file_qualifier"),
    )
    return rows.filter("lang is not null and source is not null")


def apply(engine: Engine, batch: DataFrame) -> int:
    """One micro-batch: of each path the last change by ``seq``; upserts and deletes make one new
    version. Applying a batch twice changes nothing, so a restart after a failure is safe."""
    last = incremental.latest(batch, "path", "seq")
    return engine.apply(as_files(last.filter("op = 'upsert'")), last.filter("op = 'delete'").select("path"))


def follow(engine: Engine, changes: DataFrame, checkpoint: str, every: str = FLUSH, once: bool = False, gap: str | None = DEBOUNCE, progress: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Keep the engine current from a stream of CHANGES; ``once`` drains what is there and stops.
    With ``gap`` None the feed is already debounced and every change counts."""

    def step(batch: DataFrame, epoch: int) -> None:
        done = apply(engine, batch)
        if progress:
            progress(epoch, done)

    feed = changes if gap is None else bursts(changes, gap)
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
