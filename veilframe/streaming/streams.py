"""Documents and events as streams (an extra; the batch operators do the same at rest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect


def event_windows(events: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; as a stream, events later than ``late`` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detect_stream(docs: DataFrame, **options) -> DataFrame:
    """Detection holds no state, so it runs on a stream as it is."""
    return detect(docs, **options)


def run_once(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Processes what is there and ends; a rerun goes on where the last one stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
