"""Extension (the dialect has no streams): event counts by window, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def source(spark: SparkSession, folder: str, name: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder)


def by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, total; the same for a batch and a stream."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", late)
    return e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")
