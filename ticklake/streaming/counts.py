"""Structured Streaming: windowed counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.sources.store import scratch


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of each event type and window; rows later than ``late`` are left out."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("at", late).groupBy(F.window("at", length).alias("w"), "event_type").agg(F.count("*").alias("n"))


def hourly_counts(spark: SparkSession, path: str, progress: str | None = None, timeout_s: int = 600) -> DataFrame:
    """Read ``path`` as a file stream to its end and return the hourly counts.

    Each batch writes the windows it changed to the folder ``progress`` (a fresh one if none
    is given), under its number, so a batch that is run again replaces itself; the last word
    on a window is that of the highest batch.  Given again, the folder lets the stream go on
    where it stopped."""
    progress = progress or scratch(spark, "counts")
    schema = spark.read.parquet(path).schema
    root, pattern = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 64).parquet(f"{root}/{pattern}*")

    def keep(changed: DataFrame, batch: int) -> None:
        changed.select("event_type", F.unix_micros("w.start").alias("start_us"), "n").write.mode("overwrite").parquet(f"{progress}/rows/batch={batch}")

    query = windowed(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{progress}/checkpoint").trigger(availableNow=True).start()
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError("the stream did not end")
    told = spark.read.schema("event_type string, start_us bigint, n bigint, batch bigint").parquet(f"{progress}/rows")
    return told.groupBy("event_type", "start_us").agg(F.max_by("n", "batch").alias("n"))


def matched(left: DataFrame, right: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Stream-stream join: rows of ``left`` (key, at) with those of ``right`` (key, at) that
    follow within ``within``; watermarks bound what is kept of either side."""
    a = left.select(F.col("key").alias("key_a"), F.col("id").alias("id_a"), F.col("at").alias("at_a")).withWatermark("at_a", within)
    b = right.select(F.col("key").alias("key_b"), F.col("id").alias("id_b"), F.col("at").alias("at_b")).withWatermark("at_b", within)
    return a.join(b, F.expr(f"key_a = key_b AND at_b BETWEEN at_a AND at_a + INTERVAL {within}"))
