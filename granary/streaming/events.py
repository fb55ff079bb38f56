"""Structured Streaming: windows over events, duplicates within a watermark, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.sources.store import Folder


def read_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A table as a stream, be it one file of the folder or a folder in it."""
    at = Folder(spark, folder)
    whole = at.files.getFileStatus(at.path(at.at(name))).isDirectory()
    return read_stream(spark, at.at(name), "*", files_per_trigger) if whole else read_stream(spark, folder, name, files_per_trigger)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Event counts and value sums by window and type; the same on a table and on a stream."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user: a pause of the gap or more begins a new one."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("s.start").alias("session_start"), "n_events")


def unique_events(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives each micro-batch to ``upsert`` (such as a replace by URL) and stops when all is read."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
