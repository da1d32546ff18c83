"""Structured Streaming: incremental indexing, debounced file events, completeness with a deadline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.chunking import chunk_files
from marlstone.operators.maintenance import KEY, event_kind, newest
from marlstone.sources.store import Table

EVENTS = "event_id BIGINT, project_id STRING, path STRING, kind STRING, detail STRING, at TIMESTAMP"


def file_events(spark: SparkSession, folder: str, schema: str = EVENTS, per_trigger: int = 100) -> DataFrame:
    """Events of a watched tree, as JSON lines dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def debounced(events: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """One row per path and burst: events less than ``gap`` apart are one, and the last of them counts.

    The same code serves a batch; in a stream a burst comes out once the watermark has passed it.
    """
    e = events.withColumn("operation", event_kind("kind", "detail")).filter("operation is not null")
    if e.isStreaming:
        e = e.withWatermark("at", late)
    return (e.groupBy("project_id", "path", F.session_window("at", gap).alias("w"))
            .agg(F.max_by("operation", F.struct("at", "event_id")).alias("operation"), F.count("*").alias("events"))
            .select("project_id", "path", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "operation", "events"))


def sessions(events: DataFrame, by: list[str], at: str, gap: str) -> DataFrame:
    return events.groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events")).select(*by, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "events")


def index_stream(files: DataFrame, documents: Table, chunks: Table, checkpoint: str, most: int = 1500, trigger: dict | None = None, split: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Stream of file rows (id, project_id, file_path, content, ...) into the two tables.

    A batch that is run again replaces the same files with the same rows, so a restart repeats nothing. Of several rows of a file the
    newest by ``indexed_at``, ``last_modified`` and ``id`` counts. Only the buckets of the batch's files are rewritten.
    """
    cut = split or (lambda d: chunk_files(d, most))

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = newest(rows, KEY, [c for c in ("indexed_at", "last_modified", "id") if c in rows.columns] or ["content"]).persist()
        try:
            pieces = cut(rows).withColumn("id", F.sha2(F.concat_ws("\x1f", "project_id", "file_path", F.col("ordinal").cast("string")), 256)).withColumn("chunk_hash", F.unhex(F.sha2("content", 256)))
            documents.upsert(rows)
            chunks.replace_files(pieces, rows)
        finally:
            rows.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def complete_files(parts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Stream of parts (project_id, file_path, expected_chunks or null, at) to completeness by file and time window.

    An end mark may come before its parts. A file that isn't complete when the watermark has passed its window comes
    out as such, which bounds the state that a lost part would hold forever.
    """
    p = parts.withWatermark("at", late) if parts.isStreaming else parts
    out = p.groupBy("project_id", "file_path", F.window("at", late).alias("w")).agg(F.sum(F.col("expected_chunks").isNull().cast("long")).alias("received"), F.max("expected_chunks").alias("expected"))
    return out.select("project_id", "file_path", F.col("w.start").alias("since"), "received", "expected", F.coalesce(F.col("received") == F.col("expected"), F.lit(False)).alias("complete"))


def stop(query: StreamingQuery, seconds: int = 30) -> None:
    query.stop()
    query.awaitTermination(seconds)
