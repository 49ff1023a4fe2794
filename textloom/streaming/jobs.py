"""Streams over files: appended rows are scored once, running means follow, repeated records go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def records(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """New JSON files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("lineSep", "\n").json(path)


def appended(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, written once; a restart goes on where it stopped."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_records(df: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first record of each key; with an event time, state is kept no longer than records may be late."""
    if time is None:
        return df.dropDuplicates([key])
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_means(df: DataFrame, by: list[str], *values: str) -> DataFrame:
    """For update or complete mode."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))
