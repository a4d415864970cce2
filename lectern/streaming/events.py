"""The event log as a file stream: an extension, as the tools themselves know no event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame) -> DataFrame:
    """Events and their values by the hour."""
    return events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "n", "total")


def hourly_stream(spark: SparkSession, folder: str, schema, late: str = "10 minutes") -> DataFrame:
    """The same over files as they arrive; hours close when the watermark has passed them."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)
    return hourly(events)


def append_new(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Copy rows that have not been copied yet, once each, and stop: a resumable incremental write."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
