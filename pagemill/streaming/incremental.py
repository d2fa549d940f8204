"""Structured Streaming forms of what is resumed or added to between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files that arrive at ``path``, so many at a time; the checkpoint keeps what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_scores(events: DataFrame) -> DataFrame:
    """Sums of score by page over a stream of (page, kind, score), with whether the page is real."""
    return events.groupBy("page").agg(F.sum("score").alias("score"), F.max((F.col("kind") == "R").cast("int")).alias("real"))


def new_values(stream: DataFrame, column: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each value once. With an event time, values are forgotten ``late`` after it, which bounds the state."""
    if time is None:
        return stream.select(column).dropDuplicates([column])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([column])


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows by time window and keys, late ones dropped after ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_once(stream: DataFrame, write, checkpoint: str) -> None:
    """Take in all that has arrived: ``write(batch, n)`` for each micro-batch, exactly once if it is idempotent by n."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All that has arrived, as a table in memory: for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)
