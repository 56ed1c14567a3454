"""The device dimension."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import ip
from tidewire.functions.times import in_range, instant
from tidewire.operators.alerts import matches_tokens

MAX_LABEL = 100


def sightings(flows: DataFrame, cidrs: Sequence[str], ts: str = "event_ts") -> DataFrame:
    """First and last time of every local address on either side of a flow."""
    return (
        flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), F.col(ts).alias("_t"))
        .filter(ip.is_local("ip", cidrs))
        .groupBy("ip")
        .agg(F.min("_t").alias("first_seen"), F.max("_t").alias("last_seen"))
    )


def merge_devices(
    devices: DataFrame, seen: DataFrame, hostnames: DataFrame | None = None
) -> DataFrame:
    """Upsert sightings: first_seen stays, last_seen moves on, a blank hostname never overwrites."""
    n = seen.select("ip", F.col("first_seen").alias("_first"), F.col("last_seen").alias("_last"))
    if hostnames is not None:
        n = n.join(hostnames.select("ip", F.col("hostname").alias("_host")), "ip", "left")
    else:
        n = n.withColumn("_host", F.lit(None).cast("string"))
    blank = F.lit("")
    return (
        devices.join(n, "ip", "full_outer")
        .select(
            "ip",
            F.coalesce("label", blank).alias("label"),
            F.coalesce(F.nullif(F.col("_host"), blank), F.col("hostname"), blank).alias("hostname"),
            F.coalesce("vendor", blank).alias("vendor"),
            F.coalesce("first_seen", "_first").alias("first_seen"),
            F.greatest("last_seen", "_last").alias("last_seen"),
        )
    )


def discover_devices(
    flows: DataFrame,
    devices: DataFrame,
    cidrs: Sequence[str],
    hostnames: DataFrame | None = None,
    ts: str = "event_ts",
) -> DataFrame:
    return merge_devices(devices, sightings(flows, cidrs, ts), hostnames)


def reconcile_devices(
    aggregates: DataFrame, devices: DataFrame, cidrs: Sequence[str], now: datetime
) -> DataFrame:
    """Register every local source and destination of the last day."""
    seen = in_range(aggregates, now - timedelta(hours=24), now).select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    busy = (
        seen.filter(ip.is_local("ip", cidrs))
        .distinct()
        .select("ip", instant(now).alias("first_seen"), instant(now).alias("last_seen"))
    )
    return merge_devices(devices, busy)


def judged_labels(devices: DataFrame, log: DataFrame) -> DataFrame:
    """``log`` (ip, label, changed_at) with ``reject_reason``, null where the change is accepted."""
    return log.join(devices.select("ip", F.lit(True).alias("_known")), "ip", "left").withColumn(
        "reject_reason",
        F.when(~ip.is_ip("ip"), "not an address")
        .when(F.octet_length("label") > MAX_LABEL, "label is too long")
        .when(F.col("_known").isNull(), "device not found"),
    ).drop("_known")


def apply_labels(devices: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(devices with their latest label, rejected log rows with a reason)."""
    known = judged_labels(devices, log)
    latest = (
        known.filter("reject_reason is null")
        .groupBy("ip")
        .agg(F.max(F.struct("changed_at", "label")).alias("n"))
    )
    merged = (
        devices.join(latest, "ip", "left")
        .withColumn("label", F.coalesce("n.label", "label"))
        .drop("n")
    )
    return merged, known.filter("reject_reason is not null")


def list_devices(devices: DataFrame) -> DataFrame:
    return devices.orderBy(F.desc("last_seen"), "ip")


def search_devices(devices: DataFrame, q: str = "", subnet: str = "") -> DataFrame:
    rows = devices.filter(matches_tokens(q, ["ip", "hostname", "label"]))
    return rows.filter(ip.subnet24("ip") == subnet) if subnet else rows
