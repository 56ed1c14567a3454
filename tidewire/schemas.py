"""Schemas of the tables the operators read and write."""

from __future__ import annotations

FLOW_EVENTS = (
    "event_ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
    "bytes bigint, packets bigint, collector_kind string, collector_id string, exporter_ip string, "
    "tcp_flags smallint"
)

FLOW_AGGREGATES = (
    "bucket_ts timestamp, collector_kind string, collector_id string, src_ip string, dst_ip string, "
    "dst_port int, protocol int, bytes bigint, packets bigint, flows bigint, bucket_date date"
)

AGGREGATE_KEY = (
    "bucket_ts",
    "collector_kind",
    "collector_id",
    "src_ip",
    "dst_ip",
    "dst_port",
    "protocol",
)

DEVICES = (
    "ip string, label string, hostname string, vendor string, first_seen timestamp, last_seen timestamp"
)

BASELINES = (
    "ip string, mean_bytes double, stddev_bytes double, mean_packets double, stddev_packets double, "
    "mean_peers double, stddev_peers double, samples bigint"
)

ANOMALIES = (
    "id bigint, ip string, destination_ip string, type string, description string, severity string, "
    "status string, created_at timestamp, updated_at timestamp"
)

# columns every detector returns before an id is assigned
ALERT_COLUMNS = (
    "ip",
    "destination_ip",
    "type",
    "description",
    "severity",
    "status",
    "created_at",
)

POLICIES = (
    "id bigint, name string, scope string, target string, severity_threshold string, suppressed boolean, "
    "cooldown_seconds int, quiet_hours_start string, quiet_hours_end string"
)

RULES = (
    "id bigint, name string, enabled boolean, severity_min string, alert_types array<string>, scope string, "
    "target string, cooldown_seconds int, channel_targets array<string>"
)

NOTIFICATION_LOGS = (
    "anomaly_id bigint, rule_id bigint, channel string, status string, error_message string, "
    "dispatched_at timestamp"
)

EVE = (
    "timestamp string, event_type string, src_ip string, dest_ip string, "
    "alert struct<signature_id: bigint, signature: string, category: string, severity: int>"
)
