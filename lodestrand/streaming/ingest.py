"""Tables that arrive piece by piece: record deliveries as a stream, with what was delivered again left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deliveries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def once(stream: DataFrame, keys: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """The first delivery of each key; a key is remembered for the delay, so the state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, width: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows for each window of time and value of by."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def land(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived so far to a Parquet table, exactly once, and ends; call again for what comes later."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
