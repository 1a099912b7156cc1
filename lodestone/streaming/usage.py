"""Streams of usage events. Every stream has a batch twin with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Events of a folder or file pattern as a stream, with a time stamp that watermarks can use."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a written table, and read that."""
    spark = stream.sparkSession
    out = folder(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls and value a day; a day is given out when the watermark has passed it."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("calls"), F.sum(F.floor("value")).alias("tokens")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "calls", "tokens")


def sliding_counts(events: DataFrame, width: str = "24 hours", slide: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events a user within a sliding window: the rate limit's count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "user_id").agg(F.count("*").alias("n")).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user, ended by a gap (an addition of ours)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


def once_each(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once within the watermark (an addition of ours)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def recent_values(events: DataFrame, keep: int = 8) -> DataFrame:
    """user_id, n, value: after each batch, how many events a user has had, and the latest `keep` values."""
    from .state import latest

    rows = latest(events, "user_id", ["ts", "event_id"], ["value"], keep)
    return rows.select("user_id", F.col("seen").alias("n"), F.col("value").cast("long").alias("value"))


def changes_since(rows: DataFrame, since) -> DataFrame:
    """Rows changed after a pull: created, updated or deleted."""
    kind = F.when(F.col("deleted_at") > since, "deleted").when(F.col("created_at") > since, "created").otherwise("updated")
    return rows.where((F.col("updated_at") > since) | (F.col("deleted_at") > since)).withColumn("change", kind)
