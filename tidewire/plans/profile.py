"""The device page: everything known about each device, for all devices at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import ip
from tidewire.operators.policies import device_policies
from tidewire.operators.risk import device_risk
from tidewire.params import Params


def device_profile(
    devices: DataFrame,
    anomalies: DataFrame,
    baselines: DataFrame,
    policies: DataFrame,
    now: datetime,
    params: Params = Params(),
    recent: int = 50,
    device: str | None = None,
) -> DataFrame:
    """Device, subnet, risk (low and 0 by default), baseline, last alerts and policies.

    The alert list is cut to ``recent`` by rank below the shuffle before it is
    collected.  Policy names are bounded by the policy table.
    """
    if device is not None:
        devices = devices.filter(F.col("ip") == device)
        anomalies = anomalies.filter(F.col("ip") == device)
    newest = Window.partitionBy("ip").orderBy(F.desc("created_at"), F.desc("id"))
    last = (
        anomalies.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= recent)
        .groupBy("ip")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("_n", "id", "type", "severity", "status", "created_at"))
            ).alias("anomalies")
        )
    )
    applied = device_policies(devices, policies).groupBy("ip").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("scope", "name"))), lambda s: s["name"]
        ).alias("applied_policies")
    )
    risk = device_risk(devices, anomalies, now, params).select(
        "ip", "risk_score", "risk_level", "active_alert_count"
    )
    empty_names = F.array().cast("array<string>")
    return (
        devices.join(risk, "ip", "left")
        .join(baselines.drop("samples"), "ip", "left")
        .join(last, "ip", "left")
        .join(applied, "ip", "left")
        .withColumn("subnet_vlan", ip.subnet_vlan("ip", params.local_cidrs))
        .fillna({"risk_score": 0, "risk_level": "low", "active_alert_count": 0})
        .withColumn("applied_policies", F.coalesce("applied_policies", empty_names))
        .withColumn(
            "policy_status",
            F.when(F.size("applied_policies") > 0, "active_policy").otherwise("no_policy"),
        )
    )
