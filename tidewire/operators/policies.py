"""Suppression policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import ip
from tidewire.functions.labels import severity_rank
from tidewire.functions.times import HHMM, in_quiet_hours
from tidewire.operators.ordered import with_previous
from tidewire.operators.scopes import global_key, global_keys, network_keys, network_lengths, network_rule_key

# fixed values: a narrower scope wins
SCOPE_PRIORITY = {"ip": 4, "subnet": 3, "alert_type": 2, "global": 1}
MAX_NAME = 100
MAX_COOLDOWN = 2_592_000


def validate_policies(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid policies, rejects with a reason)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    scope, target = F.col("scope"), text("target")
    start, end = text("quiet_hours_start"), text("quiet_hours_end")
    bad_time = lambda t: (t != "") & ~t.rlike(HHMM)
    reason = (
        F.when(text("name") == "", "name is empty")
        .when(F.octet_length("name") > MAX_NAME, "name is too long")
        .when((scope == "global") & (target != ""), "global policy has a target")
        .when((scope == "ip") & ~ip.is_ip(target), "target is not an address")
        .when((scope == "subnet") & ip.cidr_bits(target).isNull(), "target is not a network")
        .when((scope == "alert_type") & (target == ""), "target is empty")
        .when((scope == "alert_type") & (F.octet_length(target) > MAX_NAME), "target is too long")
        .when(~F.coalesce(scope.isin(*SCOPE_PRIORITY), F.lit(False)), "unknown scope")
        .when(~text("severity_threshold").isin("", "low", "medium", "high"), "unknown severity")
        .when(~F.col("cooldown_seconds").between(0, MAX_COOLDOWN), "cooldown out of range")
        .when(bad_time(start) | bad_time(end), "quiet hours are not HH:MM")
        .when((start == "") != (end == ""), "quiet hours need both ends")
    )
    checked = policies.withColumn("reject_reason", reason)
    return (
        checked.filter("reject_reason is null").drop("reject_reason"),
        checked.filter("reject_reason is not null"),
    )


def _policy_keys(exact_ip: Column | None = None) -> Column:
    """Keys of a policy, none for one that can match nothing."""
    scope, target = F.col("scope"), F.col("target")
    one = (
        F.when(scope == "ip", F.concat(F.lit("ip:"), ip.ip_hex(target) if exact_ip is None else exact_ip))
        .when(scope == "subnet", network_rule_key(target))
        .when(scope == "alert_type", F.concat(F.lit("type:"), target))
    )
    return F.when(scope == "global", global_keys()).otherwise(F.array_compact(F.array(one)))


def _alert_keys(anomalies: DataFrame, policies: DataFrame) -> DataFrame:
    """(id, key): every key a policy could carry to match the alert."""
    lengths = network_lengths(policies)
    hexed = anomalies.select(
        "id",
        "type",
        ip.ip_hex("ip").alias("_src"),
        ip.ip_hex("destination_ip").alias("_dst"),
        lengths.alias("_len"),
    )
    named = F.array_compact(
        F.array(
            global_key("id"),
            F.concat(F.lit("type:"), F.col("type")),
            F.concat(F.lit("ip:"), F.col("_src")),
            F.concat(F.lit("ip:"), F.col("_dst")),
        )
    )
    nets = F.concat(
        network_keys(F.col("_src"), F.col("_len")), network_keys(F.col("_dst"), F.col("_len"))
    )
    return hexed.select("id", F.explode(F.array_distinct(F.concat(named, nets))).alias("_key"))


def match_policies(anomalies: DataFrame, policies: DataFrame) -> DataFrame:
    """(anomaly id, policy columns) for every matching pair."""
    keyed = policies.withColumnRenamed("id", "policy_id").withColumn("_key", F.explode(_policy_keys()))
    return (
        _alert_keys(anomalies, policies)
        .join(keyed, "_key")
        .drop("_key")
        .withColumnRenamed("id", "anomaly_id")
    )


def policy_match(anomalies: DataFrame, policies: DataFrame) -> DataFrame:
    """The deciding policy per alert: narrowest scope, then newest id.

    Policies with one key are reduced to the newest first, so an alert meets
    at most one policy per key.
    """
    priority = F.create_map(*[F.lit(x) for kv in SCOPE_PRIORITY.items() for x in kv])
    payload = [
        "name", "scope", "suppressed", "severity_threshold", "cooldown_seconds",
        "quiet_hours_start", "quiet_hours_end",
    ]
    ranked = F.struct(
        F.try_element_at(priority, F.col("scope")).alias("priority"),
        F.col("id").alias("policy_id"),
        *payload,
    )
    newest = (
        policies.withColumn("_key", F.explode(_policy_keys()))
        .groupBy("_key")
        .agg(F.max(ranked).alias("p"))
    )
    return (
        _alert_keys(anomalies, policies)
        .join(newest, "_key")
        .groupBy(F.col("id").alias("anomaly_id"))
        .agg(F.max("p").alias("p"))
        .select("anomaly_id", "p.*")
    )


def policies_for_ip(policies: DataFrame, address: str) -> DataFrame:
    """Global, equal-text and containing-network policies, ordered by (scope, name)."""
    scope, target = F.col("scope"), F.col("target")
    digits = ip.address_hex(address)
    if digits is None:
        in_net = F.lit(False)
    else:
        in_net = ip.cidr_key(target) == ip.network_key(F.lit(digits), ip.cidr_bits(target))
    hit = (
        (scope == "global")
        | ((scope == "ip") & (target == address))
        | ((scope == "subnet") & F.coalesce(in_net, F.lit(False)))
    )
    return policies.filter(hit).orderBy("scope", "name")


def device_policies(devices: DataFrame, policies: DataFrame) -> DataFrame:
    """The same for every device at once: (ip, policy id, scope, name)."""
    keyed = policies.filter(F.col("scope").isin("global", "ip", "subnet")).select(
        F.explode(_policy_keys(F.col("target"))).alias("_key"), F.col("id").alias("policy_id"), "scope", "name"
    )
    rows = devices.select("ip", ip.ip_hex("ip").alias("_hex"), network_lengths(policies).alias("_len"))
    keys = F.concat(
        F.array(global_key("ip"), F.concat(F.lit("ip:"), F.col("ip"))),
        network_keys(F.col("_hex"), F.col("_len")),
    )
    return rows.select("ip", F.explode(keys).alias("_key")).join(keyed, "_key").drop("_key")


def apply_policies(anomalies: DataFrame, policies: DataFrame, critical_rank: int = 0) -> DataFrame:
    """Set status ``silenced`` where the deciding policy says so; rows are kept.

    In order: suppressed, severity below threshold, quiet hours, an earlier
    alert of the same device and type (any status) within the cooldown.
    """
    decided = policy_match(anomalies, policies).withColumnRenamed("anomaly_id", "id")
    rows = with_previous(anomalies, ["ip", "type"], "created_at", "id", "_prev").join(
        decided.withColumnRenamed("name", "policy_name").withColumnRenamed("scope", "policy_scope"),
        "id",
        "left",
    )
    threshold = F.coalesce("severity_threshold", F.lit(""))
    recent = (F.col("cooldown_seconds") > 0) & (
        F.unix_micros("_prev") >= F.unix_micros("created_at") - F.col("cooldown_seconds").cast("long") * 1_000_000
    )
    reason = (
        F.when(F.col("policy_id").isNull(), F.lit(None))
        .when(F.col("suppressed"), "suppressed")
        .when(
            (threshold != "")
            & (severity_rank(F.col("severity"), critical_rank) < severity_rank(threshold)),
            "below_threshold",
        )
        .when(
            in_quiet_hours(F.col("created_at"), F.col("quiet_hours_start"), F.col("quiet_hours_end")),
            "quiet_hours",
        )
        .when(F.coalesce(recent, F.lit(False)), "cooldown")
    )
    return (
        rows.withColumn("silence_reason", reason)
        .withColumn(
            "status", F.when(F.col("silence_reason").isNotNull(), "silenced").otherwise(F.col("status"))
        )
        .select(*anomalies.columns, "policy_id", "silence_reason")
    )


def list_policies(policies: DataFrame) -> DataFrame:
    return policies.orderBy("scope", "name", "id")

