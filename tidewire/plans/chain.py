"""From candidate alerts to stored alerts and planned notifications, for whole tables and for one batch of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.operators import alerts, notifications, policies
from tidewire.params import Params

ALERTS = schemas.ANOMALIES + ", policy_id bigint, silence_reason string"
SENT = "rule_id bigint, ip string, type string, dispatched_at timestamp"
KEY = ["ip", "type"]


def last_alerts(stored: DataFrame) -> DataFrame:
    """The newest stored alert of each device and type."""
    columns = schemas.ANOMALIES.replace(" bigint", "").replace(" string", "").replace(" timestamp", "").split(", ")
    newest = stored.groupBy(*KEY).agg(F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("a"))
    return newest.select("a.*")


def spaced_alerts(candidates: DataFrame, params: Params = Params(), earlier: DataFrame | None = None) -> DataFrame:
    """Candidates that pass suppression and cooldown, with ids that a rerun repeats.

    ``earlier`` has the newest alert that was kept before, per device and type (``last_alerts``).  All candidates have
    to be younger; cooldowns go on from there.
    """
    found = alerts.suppress_types_and_subnets(candidates, params).select(*schemas.ALERT_COLUMNS)
    carry = ["_new", "destination_ip", "severity", "description"]
    found = found.withColumn("_new", F.lit(True))
    if earlier is not None:
        found = found.unionByName(earlier.select(*schemas.ALERT_COLUMNS, F.lit(False).alias("_new")))
    kept = alerts.dedup_alerts(found, params.behaviour_cooldown, carry=carry).filter("_new")
    return kept.select(
        F.xxhash64("ip", "type", "created_at").alias("id"), "ip", "destination_ip", "type", "description", "severity",
        F.lit("active").alias("status"), "created_at", F.col("created_at").alias("updated_at"),
    )


def judged_alerts(
    kept: DataFrame, rules: DataFrame, params: Params = Params(), earlier: DataFrame | None = None
) -> DataFrame:
    """``spaced_alerts`` with the verdict of policies ``rules``; silenced alerts hold others back like active ones."""
    rows = kept.withColumn("_new", F.lit(True))
    if earlier is not None:
        rows = rows.unionByName(earlier.withColumn("_new", F.lit(False)))
    return policies.apply_policies(rows, rules, params.critical_rank).filter("_new").drop("_new")


def planned_notifications(
    stored: DataFrame, rules: DataFrame, configured: Sequence[str], params: Params = Params(), sent: DataFrame | None = None
) -> DataFrame:
    """Notification log rows of ``judged_alerts``; ``sent`` (``SENT``) has earlier dispatches of rules."""
    anomalies = stored.drop("policy_id", "silence_reason")
    return notifications.route_notifications(anomalies, rules, configured, critical_rank=params.critical_rank, sent=sent)
