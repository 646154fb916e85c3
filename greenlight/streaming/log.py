"""The log and the version table as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenlight.functions.text import filled, natural_key
from greenlight.operators.events import with_action_metadata
from greenlight.operators.versions import EDITOR
from greenlight.sources.readers import parse_log_lines


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New lines of a log folder, parsed as in batch; bad lines come through marked."""
    return parse_log_lines(spark.readStream.text(path))


def event_counts(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per window, category and status; state older than the watermark is dropped."""
    timed = with_action_metadata(events).withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("ts", delay)
        .groupBy(F.window("ts", size), "category", "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "category", "status", "n")
    )


def log_sessions(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Per actor sessions that end after ``gap`` without an event, repeated events counted once."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    once = timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])
    return (
        once.groupBy("actor", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("actor", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "n_events")
    )


def active_stream(versions: DataFrame) -> DataFrame:
    """The active version per record as rows arrive.

    The state of a record is one maximum, so an editor version that arrives late replaces
    the active one in the next update; the sink overwrites by record.
    """
    rank = F.struct(
        (F.col("origin") == EDITOR).alias("editor"), natural_key("version_id").alias("key"), F.col("created_at"),
        F.col("version_id"),
    )
    return (
        versions.filter(~F.col("discarded") & filled("record_id"))
        .groupBy("record_id")
        .agg(F.max(rank).alias("best"))
        .select("record_id", F.col("best.version_id").alias("version_id"))
    )


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for update mode: each batch is a new version of the changed keys."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The latest row per record over everything ``upsert_sink`` wrote."""
    rows = spark.read.parquet(path)
    return (
        rows.groupBy("record_id")
        .agg(F.max_by("version_id", "batch_id").alias("version_id"))
    )


def alert_stream(changes: DataFrame, alerts: Callable[[], DataFrame], path: str, interval: str = "5 seconds"):
    """Recount the header alerts whenever ``changes`` brings a batch, at most once per interval."""

    def write(batch: DataFrame, batch_id: int) -> None:
        alerts().withColumn("batch_id", F.lit(batch_id)).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(write).trigger(processingTime=interval)


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a memory table; for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    run = writer.start()
    run.awaitTermination()
    return stream.sparkSession.table(name)
