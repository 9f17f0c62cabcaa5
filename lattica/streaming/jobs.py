"""Structured Streaming jobs: incremental extraction, session roll-up, bounded queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.state import sessions
from lattica.schema import FILES


def closed_sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """One row a session once the watermark has passed its end: event time, not the time of writing."""
    return sessions(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), gap)


def quiet_notifications(events: DataFrame, quiet: str = "300 milliseconds") -> DataFrame:
    """One notification a burst, when nothing has changed for the quiet time."""
    w = F.session_window("ts", quiet)
    return events.withWatermark("ts", quiet).groupBy("path", w.alias("w")).agg(F.count("*").alias("changes")).select("path", F.col("w.end").alias("fired"), "changes")


def upkeep(files: DataFrame, memo: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Extract what changed in each micro-batch of a file stream and append it to the memo table.

    Rows of a file are keyed by its path and hash, so replayed batches replace nothing and a reader
    takes each path's latest hash. One query a checkpoint folder is the only writer.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        latest = batch.dropDuplicates(["path", "hash"])
        extract(latest).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(memo)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark, folder: str) -> DataFrame:
    return spark.readStream.schema(FILES).parquet(folder)
