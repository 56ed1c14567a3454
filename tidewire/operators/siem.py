"""Lists over stored SIEM events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.codec import json_map


def list_siem_events(events: DataFrame, k: int = 50) -> DataFrame:
    ties = ["source_gateway", "client_ip", "summary"]
    return events.orderBy(F.desc("timestamp"), *ties).limit(k)


def siem_events_for_ip(events: DataFrame, address: str, k: int = 50) -> DataFrame:
    return list_siem_events(events.filter(F.col("client_ip") == address), k)


def decode_attributes(events: DataFrame) -> DataFrame:
    """Stored JSON attribute text to a map; corrupt text is an empty map."""
    return events.withColumn("attributes", json_map(F.col("attributes")))
