"""Decoded flow records to flow events, and the ingest counters over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import normalize_collector_id, normalize_collector_kind


def normalize_flows(decoded: DataFrame) -> DataFrame:
    """Drop rows without both addresses; time is flow start when set, else receive time.

    ``decoded`` carries ``flow_start`` and ``received`` as epoch seconds.
    """
    started = F.when(F.col("flow_start") > 0, F.col("flow_start")).otherwise(F.col("received"))
    return (
        decoded.dropna(subset=["src_ip", "dst_ip"])
        .filter((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
        .withColumn("event_ts", F.timestamp_seconds(started))
        .withColumn(
            "collector_id",
            normalize_collector_id(
                F.col("collector_id"), F.col("collector_kind"), F.col("exporter_ip")
            ),
        )
        .withColumn("collector_kind", normalize_collector_kind(F.col("collector_kind")))
        .drop("flow_start", "received")
    )


def exporter_registry(flows: DataFrame) -> DataFrame:
    """Last record time and record count per exporter."""
    return flows.groupBy("exporter_ip").agg(
        F.max("event_ts").alias("last_seen"), F.count(F.lit(1)).alias("records")
    )


def _quality(received_ok: str, decode_error: str) -> list:
    return [
        F.count(F.lit(1)).alias("received"),
        F.count_if(~F.expr(received_ok)).alias("rejected"),
        F.count_if(F.expr(decode_error)).alias("decode_errors"),
    ]


VALID_ADDRESSES = "coalesce(src_ip, '') <> '' AND coalesce(dst_ip, '') <> ''"


def ingest_quality(
    decoded: DataFrame, valid: str = VALID_ADDRESSES, decode_error: str = "false"
) -> DataFrame:
    """Received, rejected and undecodable record counts per source."""
    return decoded.groupBy("collector_kind", "collector_id").agg(*_quality(valid, decode_error))


def ingest_quality_series(
    decoded: DataFrame,
    seconds: int = 15,
    keep: int | None = None,
    ts: str = "event_ts",
    valid: str = VALID_ADDRESSES,
    decode_error: str = "false",
) -> DataFrame:
    """Counts per sample period, oldest first; ``keep`` asks for the newest samples only."""
    samples = (
        decoded.groupBy(F.window(ts, f"{seconds} seconds").alias("w"))
        .agg(*_quality(valid, decode_error))
        .select(F.col("w.start").alias("sample_ts"), "received", "rejected", "decode_errors")
    )
    if keep is not None:
        samples = samples.orderBy(F.desc("sample_ts")).limit(keep)
    return samples.orderBy("sample_ts")


def ingest_loss(samples: DataFrame) -> DataFrame:
    """Drop and error percent of received records in the latest sample."""
    latest = samples.agg(
        F.max_by(F.struct("sample_ts", "received", "rejected", "decode_errors"), "sample_ts").alias("s")
    ).select("s.*")

    def percent(part: str):
        return F.when(F.col("received") > 0, F.col(part) / F.col("received") * 100).otherwise(0.0)

    return latest.select(
        "sample_ts",
        percent("rejected").alias("drop_percent"),
        percent("decode_errors").alias("error_percent"),
    )
