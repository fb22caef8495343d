"""Nodes of lines as they arrive, as an extension: each text that reads like no earlier one makes a node, and the node counts its lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions.text import for_duplicates
from cueline.params import DEFAULT, Params

#: What takes state of single keys with checkpoints that grow with what changed.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_nodes(lines: DataFrame) -> DataFrame:
    """Per batch and text that it has: x, the text as duplicates are compared, node_id, occurrence_count up to now, and is_new.

    The node is named by the lowest line of the batch that brought the text first. lines: a stream with line_id and en_text; lines without either are
    left out. Batches are told apart by their time, which the checkpoint keeps for those that run again. State grows with the number of distinct texts, and
    lives in the state store of the checkpoint; the session's is to be STATE_STORE when the query starts.
    """
    rows = lines.where("line_id IS NOT NULL AND en_text IS NOT NULL").select(for_duplicates(F.col("en_text")).alias("x"), F.col("line_id").cast("long").alias("line_id"), F.current_timestamp().alias("at"))
    counted = rows.groupBy("x").agg(F.min(F.struct("at", "line_id")).alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("occurrence_count"))
    return counted.select("x", F.col("first.line_id").alias("node_id"), "occurrence_count", (F.col("first.at") == F.col("last")).alias("is_new"))


def ingest_nodes(spark: SparkSession, path: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, params: Params = DEFAULT, files: int = 1000):
    """Gate the lines of Parquet files as they arrive, and give the nodes that each batch changes to the sink. Returns the running query.

    schema: with line_id, en_text and word_count. A sink may get a batch a second time after a failure: it is to write by the number of the batch, or by x.
    """
    from cueline.operators.quality import filter_lines

    lines = filter_lines(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path), params).where("filter_status = 'passed'")
    name, before = STATE_STORE[0], spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:  # the query has the session's settings of its start
        return stream_nodes(lines).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        spark.conf.set(name, before)
