"""An extension: the same parsing and classification over a stream of log lines, with windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, parse


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Lines of text files as they arrive, each an entry of its own."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.lit(0).alias("line_no"), F.col("value").alias("raw")).filter("trim(raw) <> ''")


def stream_events(lines: DataFrame, profile: dict | None = None) -> DataFrame:
    """Events of streamed lines, without state."""
    return events.events(parse.entries(lines), profile)


def windowed_counts(ev: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, type, n) by the entries' own time; a watermark bounds the state."""
    timed = ev.withColumn("ts", F.try_to_timestamp(F.substring(F.regexp_replace("timestamp", "[T,]", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))).filter("ts is not null")
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "type").agg(F.count(F.lit(1)).alias("n"))
