"""The event log as a stream: daily counts with late data, deduplication, upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwork.operators.eventlog import latest

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(stream: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and values per window and type; rows later than the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def session_windows(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def keep_latest(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the latest row of every key in a table of versions: each batch writes the next one,
    so a reader never sees half of a version and a repeated batch writes the same."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = latest(batch, keys, order)
        if epoch:
            rows = latest(spark.read.parquet(f"{target}/v{epoch - 1}").unionByName(rows), keys, order)
        rows.write.mode("overwrite").parquet(f"{target}/v{epoch}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
