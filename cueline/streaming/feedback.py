"""Streams, as an extension: feedback by windows of time, and lines as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.params import DEFAULT, Params

FEEDBACK = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def feedback_windows(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Feedback per window and action; rows later than the watermark are left out. stream: ts, event_type, value."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def first_sources(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each node, show and episode once, as far as the watermark remembers. stream: ts, node_id, show_name, episode."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["node_id", "show_name", "episode"])


def ingest_files(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, params: Params = DEFAULT):
    """Gate the lines of SRT files as they arrive, and give each batch of filtered lines to the sink. Returns the running query."""
    from cueline.operators.quality import filter_lines
    from cueline.sources.captions import parse_srt

    files = spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: sink(filter_lines(parse_srt(batch), params), n)).start()
