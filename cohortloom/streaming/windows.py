"""Bucketing by time over streams, the counterpart of day and period offsets over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files that arrive in a folder, as a stream with a declared schema."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(folder)


def period_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """(keys, period_start, period_end, count) per tumbling or sliding period. State is dropped once a period is `late` old; later rows are ignored."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, late).groupBy(w.alias("_w"), *keys).agg(F.count("*").alias("count"))
    return out.select(*keys, F.col("_w.start").alias("period_start"), F.col("_w.end").alias("period_end"), "count")
