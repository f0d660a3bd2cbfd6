"""Incremental work on event streams: deduplication, flows by window, sessions, appends that may be replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import insert_new
from ..sources.shared import exists


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def flow_windows(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count and sum of each key per window; the same code for a batch and a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def since(df: DataFrame, time: str, watermark) -> DataFrame:
    """Rows after a high watermark; all of them without one."""
    return df if watermark is None else df.where(F.col(time) > watermark)


def append_new(path: str, keys: list[str], day: str | None = None):
    """A foreachBatch function that appends the rows whose key the table at path lacks: replays change nothing.

    With `day`, one of the keys, the table is partitioned by it and a batch is compared with its own days' partitions only.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if exists(spark, path):  # the first batch makes the table
            there = spark.read.schema(batch.schema).parquet(path)
            if day:
                there = there.join(F.broadcast(batch.select(day).distinct()), day, "left_semi")  # a batch has few days; they prune the partitions
        else:
            there = spark.createDataFrame([], batch.schema)
        new = insert_new(there, batch, keys).write.mode("append")
        (new.partitionBy(day) if day else new).parquet(path)

    return write
