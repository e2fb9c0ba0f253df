"""Sources and daily series of Structured Streaming jobs; see ``pulls`` for ingest and ``alerts`` for monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_new_files(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Stream of the rows of new Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def daily_counts(
    events: DataFrame, time: str = "ts", metric: str = "event_type", value: str | None = None, late: str = "2 days", key: str | None = "event_id"
) -> DataFrame:
    """Value per metric and day; repeated events are dropped, days close after the lateness limit.

    Where days may be restated later than that, see :mod:`tidemark.streaming.pulls`.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    if key is not None:
        timed = timed.dropDuplicatesWithinWatermark([key])
    total = F.sum(value) if value else F.count(F.lit(1))
    grouped = timed.groupBy(F.window(time, "1 day").alias("day"), F.col(metric).alias("series")).agg(total.alias("value"))
    return grouped.select(F.to_date("day.start").alias("date"), "series", "value")
