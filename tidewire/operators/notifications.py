"""Notification rules: from alerts to planned dispatch rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import ip
from tidewire.functions.barrier import once
from tidewire.functions.labels import identity, known_channel, severity_rank, type_listed
from tidewire.functions.times import instant
from tidewire.operators.ordered import keep_spaced, one_value
from tidewire.operators.scopes import global_key, global_keys, network_keys, network_lengths, network_rule_key
from tidewire.params import CHANNELS


def validate_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rules with defaults filled, rejects with a reason)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    scope = F.when(text("scope") == "", "global").otherwise(F.col("scope"))
    minimum = F.when(text("severity_min") == "", "low").otherwise(F.col("severity_min"))
    channels = F.coalesce("channel_targets", F.array().cast("array<string>"))
    reason = (
        F.when(text("name") == "", "name is empty")
        .when(~F.lower(minimum).isin("low", "medium", "high"), "unknown severity")
        .when(F.size(channels) == 0, "no channel")
        .when(F.exists(channels, lambda c: ~F.coalesce(known_channel(c), F.lit(False))), "unknown channel")
        .when((scope == "ip") & ~ip.is_ip(text("target")), "target is not an address")
        .when((scope == "subnet") & ip.cidr_bits(text("target")).isNull(), "target is not a network")
        .when(~scope.isin("global", "ip", "subnet"), "unknown scope")
    )
    checked = (
        rules.withColumn("reject_reason", reason)
        .withColumn("scope", scope)
        .withColumn("severity_min", minimum)
        .withColumn("target", F.when(scope == "global", "").otherwise(text("target")))
        .withColumn("cooldown_seconds", F.greatest(F.coalesce("cooldown_seconds", F.lit(0)), F.lit(0)))
    )
    return (
        checked.filter("reject_reason is null").drop("reject_reason"),
        checked.filter("reject_reason is not null"),
    )


def match_rules(anomalies: DataFrame, rules: DataFrame, critical_rank: int = 0) -> DataFrame:
    """(alert columns, rule columns) for every enabled rule an alert meets.

    Scope and alert type are one composite equi-join key; severity is a
    residual filter.
    """
    enabled = rules.filter("enabled")
    scope, target = F.col("scope"), F.coalesce("target", F.lit(""))
    rule_scope = (
        F.when((scope == "ip") & (target != ""), F.array(F.concat(F.lit("ip:"), target)))
        .when((scope == "subnet") & (target != ""), F.array_compact(F.array(network_rule_key(target))))
        .otherwise(global_keys())
    )
    listed = F.coalesce("alert_types", F.array().cast("array<string>"))
    types = F.when(F.size(listed) == 0, F.array(F.lit("*"))).otherwise(
        F.array_distinct(F.transform(listed, F.lower))
    )
    keyed = enabled.select(
        F.col("id").alias("rule_id"),
        F.col("name").alias("rule_name"),
        "severity_min",
        "cooldown_seconds",
        "channel_targets",
        F.explode(rule_scope).alias("_scope"),
        types.alias("_types"),
    ).withColumn("_type", F.explode("_types")).drop("_types")
    scopes = F.concat(
        F.array(global_key("id"), F.concat(F.lit("ip:"), F.col("ip"))),
        network_keys(F.col("_hex"), F.col("_len")),
    )
    keys = (
        once(anomalies, _hex=ip.ip_hex("ip"))
        .withColumn("_len", network_lengths(enabled))
        .withColumn("_scope", F.explode(scopes))
        .withColumn("_type", F.explode(F.array(F.lit("*"), F.lower("type"))))
        .drop("_hex", "_len")
    )
    return (
        keys.join(keyed, ["_scope", "_type"])
        .filter(
            severity_rank(F.col("severity"), critical_rank)
            >= severity_rank(F.col("severity_min"))
        )
        .drop("_scope", "_type")
    )


def recent_notifications(
    logs: DataFrame, anomalies: DataFrame, rule_id: int, address: str, alert_type: str, since: datetime | str
) -> DataFrame:
    """Count of sent notifications of a rule for one device and alert type."""
    sent = logs.filter(
        (F.col("rule_id") == rule_id)
        & (F.col("status") == "sent")
        & (F.col("dispatched_at") >= instant(since))
    ).select("anomaly_id")
    mine = anomalies.filter((F.col("ip") == address) & (F.col("type") == alert_type)).select(
        F.col("id").alias("anomaly_id")
    )
    return sent.join(mine, "anomaly_id").agg(F.count(F.lit(1)).alias("recent"))


def _action(channel: Column | str, status: Column | str, reason: Column | str) -> Column:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        col(channel).alias("channel"), col(status).alias("status"), col(reason).alias("error_message")
    )


def _log_rows(df: DataFrame, rule: Column, actions: Column) -> DataFrame:
    """One log row per action of a row."""
    return df.select(
        F.col("id").alias("anomaly_id"),
        rule.cast("long").alias("rule_id"),
        F.col("created_at").alias("dispatched_at"),
        F.inline(actions),
    ).select("anomaly_id", "rule_id", "channel", "status", "error_message", "dispatched_at")


def _passing(matched: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """(rule_id, id) of the rows that pass their rule's cooldown.

    A row is held back while at most ``cooldown_seconds`` have passed, to the microsecond, since the last dispatch of
    the rule for that device and type.  ``sent`` has dispatches (rule_id, ip, type, dispatched_at) before all rows.
    """
    key = ["rule_id", "ip", "type"]
    instants = matched.groupBy(*key, F.unix_micros("created_at").alias("us")).agg(
        F.min("id").alias("id"), F.max("cooldown_seconds").alias("cooldown_seconds")
    )
    if sent is not None:
        waits = matched.groupBy(*key).agg(F.max("cooldown_seconds").alias("cooldown_seconds"))
        last = sent.groupBy(*key).agg(F.max(F.unix_micros("dispatched_at")).alias("us"))
        instants = instants.unionByName(last.join(waits, key), allowMissingColumns=True)
    kept = keep_spaced(instants, key, F.col("cooldown_seconds").cast("long") * 1_000_000 + 1)
    return kept.filter("id is not null").select("rule_id", "id")


def route_notifications(
    anomalies: DataFrame,
    rules: DataFrame,
    configured: Sequence[str],
    suppressed_types: Sequence[str] = (),
    allowed_cidrs: Sequence[str] = (),
    critical_rank: int = 0,
    sent: DataFrame | None = None,
) -> DataFrame:
    """Planned notification log rows of each alert.

    Status is ``suppressed``, ``deduplicated``, ``failed`` (channel not
    configured) or ``dispatch``.  With no enabled rule at all, every configured
    channel gets a row without rule.  ``sent`` (rule_id, ip, type, dispatched_at) names dispatches before all alerts,
    from which cooldowns go on.
    """
    outside = (
        ip.is_ip("ip") & ~ip.in_cidr("ip", list(allowed_cidrs)) if allowed_cidrs else F.lit(False)
    )
    gated = once(
        anomalies,
        _gate=F.when(F.col("status") == "silenced", "silenced by policy")
        .when(type_listed(F.col("type"), suppressed_types), "alert type is suppressed")
        .when(outside, "source is outside the notification networks"),
    )
    no_rules = one_value(rules.filter("enabled").limit(1), F.count(F.lit(1))) == 0
    none = F.array().cast("array<struct<channel:string,status:string,error_message:string>>")
    every = F.array(*[_action(c, "dispatch", "") for c in CHANNELS if c in configured])
    unruled = _log_rows(
        gated,
        F.lit(None),
        F.when(F.col("_gate").isNotNull(), F.array(_action("all", "suppressed", F.col("_gate"))))
        .when(no_rules, every if configured else none)
        .otherwise(none),
    )

    usable = lambda c: c.isin(*configured) if configured else F.lit(False)
    matched = match_rules(gated.filter("_gate is null").drop("_gate"), rules, critical_rank)
    # only a real dispatch starts a cooldown, so rules without a usable channel never hold back
    matched = matched.withColumn(
        "_cooled", (F.col("cooldown_seconds") > 0) & F.exists("channel_targets", usable)
    )
    passing = _passing(matched.filter("_cooled"), sent).withColumn("_first", F.lit(True))
    channels = F.filter("channel_targets", lambda c: c.isin(*CHANNELS))
    sent = F.transform(
        channels,
        lambda c: _action(
            c,
            F.when(usable(c), "dispatch").otherwise("failed"),
            F.when(usable(c), "").otherwise("channel is not configured"),
        ),
    )
    held = F.array(_action("all", "deduplicated", "held back by rule cooldown"))
    ruled = _log_rows(
        matched.join(passing, ["rule_id", "id"], "left"),
        F.col("rule_id"),
        F.when(F.col("_cooled") & F.col("_first").isNull(), held).otherwise(sent),
    )
    return unruled.unionByName(ruled)


def notification_message(anomalies: DataFrame, devices: DataFrame) -> DataFrame:
    """Channel text and JSON payload of each alert."""
    names = devices.select("ip", "label", "hostname")
    rows = anomalies.join(names, "ip", "left")
    who = identity(F.col("ip"), F.col("label"), F.col("hostname"))
    when = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.format_string(
        "Alert %s (%s)\nDevice: %s\nTime: %s\n%s",
        "type", "severity", who, when, F.coalesce("description", F.lit("")),
    )
    payload = F.to_json(
        F.struct(
            "id", "ip", "destination_ip", "type", "description", "severity", "status",
            when.alias("created_at"),
        )
    )
    return rows.select("id", text.alias("text"), payload.alias("payload"))


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("name", "id")


def list_notification_logs(logs: DataFrame, k: int = 50) -> DataFrame:
    ties = ["anomaly_id", "rule_id", "channel"]
    return logs.orderBy(F.desc("dispatched_at"), *ties).limit(k)
