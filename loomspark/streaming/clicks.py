"""A bonus beside the batch features: event counts in windows of a stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), window: str = "1 hour", late: str = "10 minutes", event_id: str | None = None) -> DataFrame:
    """(start, keys, n, value sum); with ``event_id``, repeats within the lateness count once."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    if event_id:
        stamped = stamped.dropDuplicatesWithinWatermark([event_id])
    return stamped.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")
