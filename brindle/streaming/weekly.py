"""Streams of events: weekly tumbling aggregates, and bitemporal appends where late rows are revisions, not losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def weekly_last(stream: DataFrame, late: str = "14 days") -> DataFrame:
    """Per event type and week the count and the last value; a week closes when the watermark passes it."""
    w = stream.withWatermark("ts", late).groupBy("event_type", F.window("ts", "7 days").alias("week"))
    return w.agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("value")).select("event_type", F.col("week.start").alias("week"), "n", "value")


def append_vintages(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Every arriving row appended as a vintage known from its arrival: no watermark, so a late row is a revision and kept."""
    rows = stream.select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("period_end"), F.current_date().alias("knowledge_date"), "value")
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
