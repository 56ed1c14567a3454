"""Suppression and cooldown of alerts, alert lists and their status log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import ip
from tidewire.functions.labels import identity, display_name, type_listed
from tidewire.functions.times import instant
from tidewire.operators.ordered import keep_spaced
from tidewire.operators.traffic import tokens
from tidewire.params import STATUSES, Params


def muted(df: DataFrame, cidrs: Sequence[str], column: str = "ip") -> DataFrame:
    """Rows outside every muted network; text that is no address is kept."""
    return df.filter(~ip.in_cidr(column, list(cidrs)))


def allowed(df: DataFrame, cidrs: Sequence[str], column: str = "ip") -> DataFrame:
    """Rows inside a listed network; an empty list allows everything."""
    return df.filter(ip.in_cidr(column, list(cidrs))) if cidrs else df


def suppress_types_and_subnets(alerts: DataFrame, params: Params = Params()) -> DataFrame:
    return muted(
        alerts.filter(~type_listed(F.col("type"), params.disabled_types)), params.muted_cidrs
    )


def dedup_alerts(
    alerts: DataFrame,
    cooldown_seconds: int,
    keys: Sequence[str] = ("ip", "type"),
    carry: Sequence[str] = ("destination_ip", "severity", "description"),
) -> DataFrame:
    """Greedy cooldown per key: keep an alert once the last kept one is old enough.

    Times count in microseconds.  Alerts of one key and instant collapse to the smallest carried values.
    """
    keys, carry = list(keys), list(carry)
    instants = (
        alerts.groupBy(*keys, F.unix_micros("created_at").alias("us"))
        .agg(F.min(F.struct(*carry)).alias("c"))
        .select(*keys, "us", *[F.col(f"c.{c}").alias(c) for c in carry])
    )
    kept = keep_spaced(instants, keys, F.lit(cooldown_seconds * 1_000_000))
    return kept.withColumn("created_at", F.timestamp_micros("us")).drop("us")


# --- lists -------------------------------------------------------------------------------


def list_anomalies(anomalies: DataFrame, k: int = 50) -> DataFrame:
    return anomalies.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def active_anomalies(anomalies: DataFrame, since: datetime | str | Column) -> DataFrame:
    """Active alerts created strictly after ``since``."""
    return anomalies.filter((F.col("status") == "active") & (F.col("created_at") > instant(since)))


def anomalies_for_ip(anomalies: DataFrame, address: str, k: int = 50) -> DataFrame:
    return anomalies.filter(F.col("ip") == address).orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def has_recent_anomaly(
    anomalies: DataFrame, address: str, alert_type: str, since: datetime | str
) -> DataFrame:
    """One row: does any alert of the device and type exist since then, whatever its status."""
    return anomalies.filter(
        (F.col("ip") == address)
        & (F.col("type") == alert_type)
        & (F.col("created_at") >= instant(since))
    ).agg((F.count(F.lit(1)) > 0).alias("has_recent"))


def recent_high_alerts(active: DataFrame, k: int = 10) -> DataFrame:
    return (
        active.filter(F.col("severity").isin("critical", "high"))
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(k)
    )


def matches_tokens(q: str, columns: Sequence[str]) -> Column:
    """Every token occurs in some column, case-insensitive."""
    text = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    result = F.lit(True)
    for token in tokens(q):
        hit = F.lit(False)
        for t in text:
            hit = hit | t.contains(token)
        result = result & hit
    return result


def search_alerts(
    anomalies: DataFrame, q: str = "", status: str = "all", severity: str = "all"
) -> DataFrame:
    rows = anomalies.filter(
        matches_tokens(q, ["ip", "type", "description", "severity", "status"])
    )
    if status != "all":
        rows = rows.filter(F.col("status") == status)
    if severity != "all":
        rows = rows.filter(F.col("severity") == severity)
    return rows


def enrich_alerts(anomalies: DataFrame, devices: DataFrame) -> DataFrame:
    """Device name columns on each alert."""
    names = devices.select(
        "ip",
        F.col("label").alias("device_label"),
        F.col("hostname").alias("device_hostname"),
        display_name(F.col("label"), F.col("hostname")).alias("device_name"),
        identity(F.col("ip"), F.col("label"), F.col("hostname")).alias("device_identity"),
    )
    return (
        anomalies.join(names, "ip", "left")
        .fillna("", ["device_label", "device_hostname", "device_name"])
        .withColumn("device_identity", F.coalesce("device_identity", "ip"))
    )


def judged_status(anomalies: DataFrame, log: DataFrame) -> DataFrame:
    """``log`` (anomaly_id, status, changed_at) with ``reject_reason``, null where the change is accepted."""
    return log.join(
        anomalies.select(F.col("id").alias("anomaly_id"), F.lit(True).alias("_known")), "anomaly_id", "left"
    ).withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status").when(
            F.col("_known").isNull(), "anomaly not found"
        ),
    ).drop("_known")


def apply_status(anomalies: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with their latest status, rejected log rows with a reason)."""
    known = judged_status(anomalies, log)
    latest = (
        known.filter("reject_reason is null")
        .groupBy(F.col("anomaly_id").alias("id"))
        .agg(F.max(F.struct("changed_at", "status")).alias("s"))
    )
    merged = (
        anomalies.join(latest, "id", "left")
        .withColumn("status", F.coalesce("s.status", "status"))
        .withColumn("updated_at", F.coalesce("s.changed_at", "updated_at"))
        .drop("s")
    )
    return merged, known.filter("reject_reason is not null")
