"""Streams of documents: routing as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import detect as D


def routed(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files that arrive under path, with their format (null: containers, which batch jobs open)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).options(**options).load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", "modificationTime", "length", "content", D.container(F.col("content")).alias("container"), D.route(F.col("content"), text, D.name_format(F.col("path"))).alias("format"))


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) by window and type; what comes later than `late` is left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
