"""Alert counts, timelines and the one-row summary."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import normalize_severity
from tidewire.functions.times import bucket_start, instant
from tidewire.operators.alerts import active_anomalies, recent_high_alerts
from tidewire.operators.risk import device_risk, ranked_risk, risk_distribution
from tidewire.params import SEVERITIES, Params


def _severity_counts() -> list[Column]:
    level = normalize_severity(F.col("severity"))
    return [F.count_if(level == s).alias(s) for s in SEVERITIES] + [F.count(F.lit(1)).alias("total")]


def alerts_by_severity(anomalies: DataFrame, since: datetime | str) -> DataFrame:
    """One row of active alert counts, zeros included."""
    return active_anomalies(anomalies, since).agg(*_severity_counts())


def security_timeline(
    anomalies: DataFrame, start: datetime | str, end: datetime | str, bucket_seconds: int = 3600
) -> DataFrame:
    """Active alerts per bucket and severity; ``start`` itself is excluded."""
    rows = active_anomalies(anomalies, start).filter(F.col("created_at") <= instant(end))
    return (
        rows.groupBy(bucket_start("created_at", bucket_seconds).alias("timestamp"))
        .agg(*_severity_counts())
        .orderBy("timestamp")
    )


def timeline_map(timeline: DataFrame) -> DataFrame:
    """The counts of a timeline as one map column."""
    pairs = [x for s in SEVERITIES for x in (F.lit(s), F.col(s))]
    return timeline.select("timestamp", F.create_map(*pairs).alias("counts"), "total")


def active_alert_gauges(anomalies: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    since = now - timedelta(days=days)
    return (
        active_anomalies(anomalies, since)
        .groupBy(F.lower("severity").alias("severity"), "type")
        .agg(F.count(F.lit(1)).alias("alerts"))
    )


def security_summary(
    devices: DataFrame, anomalies: DataFrame, now: datetime, params: Params = Params()
) -> DataFrame:
    """One row: counts, risk distribution, five riskiest devices, ten newest severe alerts.

    The parts are one-row aggregates combined as scalar subqueries.
    """
    since = now - timedelta(seconds=params.risk_window)
    active = active_anomalies(anomalies, since)
    risks = device_risk(devices, anomalies, now, params)
    ordered = lambda df, order: F.array_sort(F.collect_list(F.struct(*order)))

    top = ranked_risk(risks, 5).select((-F.col("risk_score")).alias("o"), "ip", "risk_score", "risk_level")
    recent = recent_high_alerts(active, 10).select(
        (-F.unix_micros("created_at")).alias("o"), (-F.col("id")).alias("p"), "id", "ip", "type", "severity"
    )
    # both lists are bounded by their limits
    top_list = top.agg(ordered(top, ["o", "ip", "risk_score", "risk_level"])).scalar()
    recent_list = recent.agg(ordered(recent, ["o", "p", "id", "ip", "type", "severity"])).scalar()
    spread = risk_distribution(devices, risks, params)
    # detector thresholds are parameters, repeated here for the reader of the row
    limits = [
        x for r in ("pps", "bps", "fps", "syn", "udp", "icmp")
        for x in (F.lit(r), F.lit(getattr(params, f"flood_{r}")))
    ]
    counts = alerts_by_severity(anomalies, since)
    totals = counts.agg(F.max(F.struct(*counts.columns))).scalar()
    return spread.select(
        *[F.col(c).alias(f"risk_{c}") for c in ("low", "medium", "high")],
        "max_risk_score",
        "elevated_devices",
        "total_devices",
        totals.alias("c"),
        top_list.alias("_top"),
        recent_list.alias("_recent"),
        F.create_map(*limits).alias("flood_limits"),
    ).select(
        "*",
        *[F.col(f"c.{s}").alias(f"active_{s}") for s in (*SEVERITIES, "total")],
        F.transform("_top", lambda s: s.dropFields("o")).alias("top_risk_devices"),
        F.transform("_recent", lambda s: s.dropFields("o", "p")).alias("recent_high_alerts"),
    ).drop("c", "_top", "_recent")
