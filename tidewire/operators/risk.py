"""Decaying risk scores."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.times import epoch, instant
from tidewire.operators.alerts import active_anomalies
from tidewire.params import Params

IDS_TYPE = "SURICATA_ALERT"


def _level(score: Column, params: Params) -> Column:
    return (
        F.when(score >= params.risk_high, "high")
        .when(score >= params.risk_medium, "medium")
        .otherwise("low")
    )


def alert_contribution(alerts: DataFrame, now: datetime, params: Params = Params()) -> DataFrame:
    """Age, weight, decay and contribution of each alert."""
    age = (F.unix_micros(instant(now)) - F.unix_micros("created_at")) / 3.6e9
    weight = F.when(F.col("severity") == "high", 40.0).when(F.col("severity") == "medium", 20.0)
    return (
        alerts.withColumn("age_hours", age)
        .withColumn("base_weight", weight.otherwise(10.0))
        .withColumn(
            "decay_factor",
            F.greatest(1 - F.col("age_hours") / params.risk_decay_hours, F.lit(params.risk_decay_floor)),
        )
        .withColumn("contribution", F.col("base_weight") * F.col("decay_factor"))
    )


def correlated_devices(alerts: DataFrame, params: Params = Params()) -> DataFrame:
    """Devices with an IDS alert and another alert at most the gap apart.

    Only the first and last alert of each class per slot of one gap length
    matter: two alerts in a slot are always close, and the closest pair across
    a slot border is (last of one class, first of the other).  So each device
    shrinks to one row per slot before anything is ordered.
    """
    gap = params.risk_boost_gap * 1_000_000
    us = F.unix_micros("created_at")
    ids = F.col("type") == IDS_TYPE
    slots = alerts.groupBy("ip", F.floor(epoch("created_at") / params.risk_boost_gap).alias("slot")).agg(
        F.min(F.when(ids, us)).alias("ids_first"),
        F.max(F.when(ids, us)).alias("ids_last"),
        F.min(F.when(~ids, us)).alias("other_first"),
        F.max(F.when(~ids, us)).alias("other_last"),
    )
    order = Window.partitionBy("ip").orderBy("slot")
    adjacent = F.lag("slot").over(order) == F.col("slot") - 1
    before = lambda c: F.when(adjacent, F.lag(c).over(order))
    close = (
        F.col("ids_first").isNotNull() & F.col("other_first").isNotNull()
        | (F.col("ids_first") - before("other_last") <= gap)
        | (F.col("other_first") - before("ids_last") <= gap)
    )
    return slots.withColumn("_close", close).filter("_close").select("ip").distinct()


def risk_contributors(anomalies: DataFrame, now: datetime, params: Params = Params()) -> DataFrame:
    """One row per active alert of the risk window: the evidence behind a score."""
    since = now - timedelta(seconds=params.risk_window)
    return alert_contribution(active_anomalies(anomalies, since), now, params)


def device_risk(
    devices: DataFrame, anomalies: DataFrame, now: datetime, params: Params = Params()
) -> DataFrame:
    """Score and level of each known device with active alerts."""
    rows = risk_contributors(anomalies, now, params)
    by_severity = lambda s: F.count_if(F.col("severity") == s)
    totals = rows.groupBy("ip").agg(
        F.sum("contribution").alias("base_score"),
        F.count(F.lit(1)).alias("active_alert_count"),
        by_severity("high").alias("high_alerts"),
        by_severity("medium").alias("medium_alerts"),
        by_severity("low").alias("low_alerts"),
    )
    boosted = correlated_devices(rows, params).withColumn("_boost", F.lit(params.risk_boost))
    scored = (
        totals.join(boosted, "ip", "left")
        .withColumn("correlation_boost", F.coalesce("_boost", F.lit(0.0)))
        .withColumn(
            "risk_score",
            F.greatest(
                F.least(F.round(F.col("base_score") + F.col("correlation_boost")), F.lit(100)), F.lit(0)
            ).cast("int"),
        )
        .filter("risk_score > 0")
        .withColumn("risk_level", _level(F.col("risk_score"), params))
        .drop("_boost")
    )
    return scored.join(devices.select("ip", "label", "hostname"), "ip")


def ranked_risk(risks: DataFrame, k: int | None = None) -> DataFrame:
    ordered = risks.orderBy(F.desc("risk_score"), "ip")
    return ordered if k is None else ordered.limit(k)


def top_actors(risks: DataFrame, k: int = 8) -> DataFrame:
    return ranked_risk(risks, k)


def risk_breakdown(
    devices: DataFrame, anomalies: DataFrame, now: datetime, params: Params = Params()
) -> DataFrame:
    """Score parts of a device next to each contributing alert, one row per alert.

    Kept flat: a device may own a large share of all alerts, and one row per
    contributor never gathers them in one place.
    """
    scores = device_risk(devices, anomalies, now, params).select(
        "ip", "risk_score", "risk_level", "base_score", "correlation_boost", "active_alert_count"
    )
    rows = risk_contributors(anomalies, now, params).select(
        "ip", "id", "type", "severity", "created_at", "age_hours", "base_weight", "decay_factor",
        "contribution", F.col("description").alias("message"),
    )
    return (
        rows.join(scores, "ip")
        .withColumn("low_threshold", F.lit(0))
        .withColumn("medium_threshold", F.lit(params.risk_medium))
        .withColumn("high_threshold", F.lit(params.risk_high))
    )


def risk_explanations(breakdown: DataFrame) -> DataFrame:
    """(ip, text): one line per contributor, and one for the correlation."""
    lines = breakdown.select("ip", F.col("message").alias("explanation"))
    boosted = (
        breakdown.filter("correlation_boost > 0")
        .select("ip", "correlation_boost")
        .distinct()
        .select(
            "ip",
            F.format_string(
                "an IDS alert and another alert lie within one hour (+%.0f)", "correlation_boost"
            ).alias("explanation"),
        )
    )
    return lines.unionByName(boosted)


def alert_mix(risks: DataFrame) -> DataFrame:
    """High, medium and low contributors per scored device."""
    return risks.select("ip", "high_alerts", "medium_alerts", "low_alerts")


def risk_distribution(devices: DataFrame, risks: DataFrame, params: Params = Params()) -> DataFrame:
    """One row: devices per level, highest score, elevated devices."""
    high = F.col("risk_score") >= params.risk_high
    medium = (F.col("risk_score") >= params.risk_medium) & ~high
    counted = risks.agg(
        F.count_if(high).alias("high"),
        F.count_if(medium).alias("medium"),
        F.coalesce(F.max("risk_score"), F.lit(0)).alias("max_risk_score"),
        F.count_if(high | medium).alias("elevated_devices"),
    )
    total = devices.agg(F.count(F.lit(1))).scalar()
    return counted.withColumn("total_devices", total).withColumn(
        "low", F.greatest(F.col("total_devices") - F.col("medium") - F.col("high"), F.lit(0))
    )


def block_rule_templates(addresses: DataFrame, column: str = "ip") -> DataFrame:
    """Firewall rule text per address for three vendors."""
    return addresses.select(
        F.col(column).alias("ip"),
        F.format_string(
            "UniFi: Firewall > WAN IN > new rule, action drop, source address group with %s", column
        ).alias("unifi"),
        F.format_string(
            "OPNsense: Firewall > Rules > WAN > add, action block, protocol any, source %s", column
        ).alias("opnsense"),
        F.format_string(
            "/ip firewall filter add action=drop chain=input src-address=%s comment=\"blocked source\"",
            column,
        ).alias("mikrotik"),
    )
