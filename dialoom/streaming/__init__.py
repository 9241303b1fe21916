"""The turn table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_turns(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Turns from a folder that keeps growing; the schema is that of the files there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # watermarks need timestamps with a zone: those without are in the session's
    return reader.parquet(path).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "loaded_at")})


def first_deliveries(turns: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop repeated deliveries that arrive within ``delay``; the state is bounded by it."""
    return turns.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["conv_id", "turn"])


def turns_per_window(turns: DataFrame, width: str = "1 hour", delay: str = "7 days") -> DataFrame:
    """Turns per role and window of creation time; late rows count until the watermark passes."""
    counted = turns.withWatermark("created_at", delay).groupBy(F.window("created_at", width).alias("w"), "role").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "role", "n")
