"""File stream sources.  The checkpoint, not the source, remembers the position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire import schemas


def flow_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.FLOW_EVENTS,
    max_files: int = 100,
) -> DataFrame:
    """Flow events from a folder; ``max_files`` per trigger is the back-pressure knob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def line_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Text lines (IDS or syslog) from a folder of rotated log files."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
