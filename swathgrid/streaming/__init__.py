"""Structured Streaming forms of the batch operators that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def scene_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream with a declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_counts(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Tumbling 1-hour counts per key; rows later than the watermark no longer count."""
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    counts = timed.groupBy(F.window("__at", "1 hour"), key).count()
    return counts.select(key, F.col("window.start").alias("hour"), F.col("count").alias("n"))


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str = "1 day") -> DataFrame:
    """Session per key: its first and last time and number of rows."""
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.session_window("__at", gap), key).agg(F.count("*").alias("n"), F.min("__at").alias("first"), F.max("__at").alias("last")).drop("session_window")


def ingest(stream: DataFrame, target: str, checkpoint: str, key: list[str], parts: list[str]) -> StreamingQuery:
    """Append what is new to a partitioned table and stop: resumable by the checkpoint, repeated ids dropped in a batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("append").partitionBy(*parts).parquet(target)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
