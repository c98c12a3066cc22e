"""Structured Streaming: an extension beyond the batch commands. Event rows become edges of a growing graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_links(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, source, target, n_events, weight): users linked to kinds of events in tumbling windows; later rows than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    ends = timed.select("ts", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source"), F.concat(F.lit("event:"), "event_type").alias("target"), "value")
    sums = ends.groupBy(F.window("ts", width), "source", "target").agg(F.count("*").alias("n_events"), F.sum("value").alias("weight"))
    return sums.select(F.col("window.start").alias("window_start"), "source", "target", "n_events", "weight")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that there is now, once, to a Parquet table; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def run_once(sums: DataFrame, path: str) -> None:
    """The whole state after all that there is now, windows that are still open included, as one Parquet table."""
    save = lambda df, _: df.write.mode("overwrite").parquet(path)
    query = sums.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
