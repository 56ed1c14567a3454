"""Enumerations, thresholds and query-parameter checks.

The numbers in this module are fixed values: results only agree with the
documented behaviour if they are exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: enumerations -------------------------------------------
COLLECTOR_KINDS = ("netflow", "sflow", "pcap", "suricata", "unifi_syslog", "snmp")
UNKNOWN = "unknown"

SEVERITIES = ("critical", "high", "medium", "low")
STATUSES = ("active", "acknowledged", "silenced")
POLICY_SCOPES = ("global", "ip", "subnet", "alert_type")
RULE_SCOPES = ("global", "ip", "subnet")
CHANNELS = ("webhook", "slack", "telegram")

ALERT_TYPES = (
    "TRAFFIC_SPIKE",
    "NEW_DESTINATION",
    "NEW_PORT",
    "DESTINATION_FANOUT",
    "PORT_FANOUT",
    "BEACONING",
    "NIGHTTIME_TRAFFIC",
    "DEVICE_PROFILE_CHANGE",
    "NEW_INTERNAL_COMMUNICATION",
    "DDOS_ATTACK",
    "DDOS_FLOW_FLOOD",
    "DDOS_SYN_FLOOD",
    "DDOS_UDP_FLOOD",
    "DDOS_ICMP_FLOOD",
    "SURICATA_ALERT",
    "UNIFI_SECURITY",
    "UNIFI_CRITICAL",
    "test_alert",
)

DAY = 86_400
WEEK = 7 * DAY
FORTNIGHT = 14 * DAY


@dataclass(frozen=True)
class Params:
    """All thresholds of the detectors and of risk scoring, in one place."""

    local_cidrs: tuple[str, ...] = ("192.168.0.0/16", "10.0.0.0/8", "172.16.0.0/12")
    window_seconds: int = 60
    timezone: str = "UTC"

    # learned baselines
    baseline_min_samples: int = 5
    spike_min_bytes: int = 1024 * 1024
    spike_min_packets: int = 2500
    spike_min_peers: int = 25
    sigma: float = 3.0

    # fan-out
    fanout_min_destinations: int = 32
    fanout_min_ports: int = 16
    fanout_packets_per_target: int = 12

    # beaconing
    beacon_observations: int = 12
    beacon_min_interval: int = 90
    beacon_max_interval: int = 30 * 60
    beacon_jitter_ratio: float = 0.20
    beacon_jitter_floor: float = 20.0
    beacon_max_packets: int = 20
    beacon_max_bytes: int = 64 * 1024
    beacon_retention: int = 2 * 3600

    # night activity
    night_start: int = 0
    night_end: int = 5
    day_start: int = 7
    day_end: int = 23
    night_day_windows: int = 12
    night_known_windows: int = 3
    night_min_bytes: int = 128 * 1024
    night_min_packets: int = 100
    night_min_destinations: int = 5
    night_retention: int = FORTNIGHT

    # behaviour profile
    profile_learning: int = 12
    profile_dominance: int = 9
    profile_confirm: int = 3
    profile_retention: int = FORTNIGHT

    # internal peers
    peer_learning: int = 12
    peer_confirm: int = 2
    peer_retention: int = FORTNIGHT

    # novelty
    novelty_lookback: int = WEEK
    novelty_min_history: int = 12

    # floods, per second over a five second window
    flood_window: int = 5
    flood_pps: int = 5000
    flood_bps: int = 10 * 1024 * 1024
    flood_fps: int = 1000
    flood_syn: int = 1000
    flood_udp: int = 3000
    flood_icmp: int = 500

    # alert cooldowns
    behaviour_cooldown: int = 15 * 60
    flood_cooldown: int = 10 * 60
    ids_cooldown: int = 15 * 60

    # risk
    risk_window: int = WEEK
    risk_decay_hours: float = 24.0
    risk_decay_floor: float = 0.15
    risk_boost: float = 20.0
    risk_boost_gap: int = 3600
    risk_medium: int = 30
    risk_high: int = 70

    # suppression
    disabled_types: tuple[str, ...] = ()
    muted_cidrs: tuple[str, ...] = ()

    # critical is not in the rank tables (it ranks below low) unless lifted here
    critical_rank: int = 0


# --- query parameters, checked before a plan is built -----------------------
BUCKET_SECONDS = (60, 300, 900, 3600)
RETENTION_DAYS = (1, 60)


def check_bucket(seconds: int | None = None) -> int:
    seconds = 300 if seconds is None else seconds
    if seconds not in BUCKET_SECONDS:
        raise ValueError(f"bucket seconds must be one of {BUCKET_SECONDS}")
    return seconds


def check_retention(days: int) -> int:
    low, high = RETENTION_DAYS
    if not low <= days <= high:
        raise ValueError(f"retention must be {low}..{high} days")
    return days
