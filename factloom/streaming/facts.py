"""Streaming forms: deliveries that come repeated and late, deduplicated and counted under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def deliveries(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is stated, not inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Each key once; the state of a key is dropped when the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts per window and key. Rows later than the watermark are left out, as in any windowed count of a stream."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: its rows with gaps below a limit."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def appended(frame: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows as parquet, exactly once, until its source is exhausted."""
    return frame.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
