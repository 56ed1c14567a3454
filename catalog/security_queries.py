"""Detectors, alerts, policies, risk, notifications and change logs."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from catalog.registry import ORACLES, query
from catalog.traffic_queries import BASE_PARTS, aggregates, baselines, daily
from catalog.views import CONFIGURED, DEVICE, LOCAL, NOW, Tables, with_views
from tidewire.functions import codec, labels
from tidewire.operators import (
    alerts, changes, detectors, devices, notifications, policies, profiles, risk, rollup, security, traffic,
)
from tidewire.plans.detect import detect_all
from tidewire.plans.profile import device_profile
from tidewire.params import Params

# The events are sparse, so thresholds are lowered until each detector fires.
P = replace(
    Params(),
    local_cidrs=LOCAL,
    spike_min_bytes=1000,
    spike_min_packets=5,
    sigma=1.5,
    fanout_min_destinations=5,
    fanout_min_ports=3,
    beacon_observations=3,
    beacon_min_interval=0,
    beacon_max_interval=30 * 86400,
    beacon_jitter_floor=0.0,
    night_min_bytes=20_000,
    night_min_packets=10,
    night_day_windows=4,
    novelty_min_history=4,
    profile_learning=4,
    profile_dominance=2,
    profile_confirm=1,
    peer_learning=4,
    peer_confirm=1,
    flood_pps=2,
    flood_bps=10_000,
    flood_fps=0,
    flood_syn=2,
    flood_udp=2,
    flood_icmp=2,
)

SINCE = "TIMESTAMP '2024-01-24 00:00:00'"


def _evidence(df):
    """Alert text is for display; the typed columns are compared."""
    return df.drop("description")


# --- metrics and fan-out -----------------------------------------------------------------------------

_LOCAL_SRC = "src_ip LIKE '192.168.%'"
_METRICS = f"""met AS (SELECT src_ip, bucket_ts, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets,
    count(DISTINCT dst_ip) AS dst_count, count(DISTINCT dst_port) AS port_count,
    count(DISTINCT CASE WHEN dst_ip LIKE '192.168.%' AND dst_ip <> src_ip THEN dst_ip END) AS internal_peers
  FROM aday WHERE {_LOCAL_SRC} GROUP BY 1, 2)"""
_BEST = f"""best AS (SELECT src_ip, bucket_ts, dst_ip, port_count, packets FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, bucket_ts ORDER BY port_count DESC, dst_ip) AS rn
  FROM (SELECT src_ip, bucket_ts, dst_ip, count(DISTINCT dst_port) AS port_count, CAST(sum(packets) AS BIGINT) AS packets
    FROM aday WHERE {_LOCAL_SRC} GROUP BY 1, 2, 3) g) r WHERE rn = 1)"""


@query("device_window_metrics", with_views("aday", "SELECT * FROM met", _METRICS))
def _metrics(t: Tables):
    return rollup.device_window_metrics(daily(t), P)


@query("port_fanout_best", with_views("aday", "SELECT * FROM best", _BEST))
def _best(t: Tables):
    return rollup.port_fanout_best(daily(t), P)


@query(
    "traffic_spike",
    with_views(
        "aday agg dev",
        """SELECT src_ip AS ip, '' AS destination_ip, 'TRAFFIC_SPIKE' AS type, 'high' AS severity, 'active' AS status, bucket_ts AS created_at,
  metric, CASE WHEN metric = 'bytes' THEN bytes ELSE packets END AS observed,
  round(CASE WHEN metric = 'bytes' THEN mean_bytes + 1.5 * stddev_bytes ELSE mean_packets + 1.5 * stddev_packets END, 4) AS limit_value
FROM (SELECT m.*, b.*, CASE WHEN bytes > 1000 AND bytes > mean_bytes + 1.5 * stddev_bytes THEN 'bytes'
    WHEN packets > 5 AND packets > mean_packets + 1.5 * stddev_packets THEN 'packets' END AS metric
  FROM met m JOIN basel b ON m.src_ip = b.ip) x WHERE metric IS NOT NULL""",
        _METRICS,
        *BASE_PARTS,
    ),
)
def _spike(t: Tables):
    metrics = rollup.device_window_metrics(daily(t), P)
    found = _evidence(detectors.traffic_spike(metrics, baselines(t), P))
    return found.withColumn("limit_value", F.round("limit_value", 4))


def _fanout_sql(limit: str, join: str) -> str:
    return f"""SELECT src_ip AS ip, '' AS destination_ip, 'DESTINATION_FANOUT' AS type, 'high' AS severity, 'active' AS status, bucket_ts AS created_at,
  dst_count, packets, limit_value FROM (SELECT m.*, {limit} AS limit_value FROM met m {join}) x
WHERE dst_count >= limit_value AND packets <= dst_count * 12"""


@query("destination_fanout_fixed", with_views("aday", _fanout_sql("CAST(5 AS BIGINT)", ""), _METRICS))
def _fanout_fixed(t: Tables):
    metrics = rollup.device_window_metrics(daily(t), P)
    return _evidence(detectors.destination_fanout(metrics, None, P))


@query(
    "destination_fanout",
    with_views(
        "aday agg dev",
        _fanout_sql(
            "CASE WHEN b.ip IS NULL THEN 2 ELSE greatest(2, CAST(ceil(mean_peers + 1.5 * stddev_peers) AS BIGINT)) END",
            "LEFT JOIN basel b ON m.src_ip = b.ip",
        ),
        _METRICS,
        *BASE_PARTS,
    ),
)
def _fanout(t: Tables):
    p = replace(P, fanout_min_destinations=2)
    metrics = rollup.device_window_metrics(daily(t), p)
    return _evidence(detectors.destination_fanout(metrics, baselines(t), p))


def _port_fanout_sql(ports: int) -> str:
    return with_views(
        "aday",
        f"""SELECT src_ip AS ip, '' AS destination_ip, 'PORT_FANOUT' AS type, 'high' AS severity, 'active' AS status, bucket_ts AS created_at,
  dst_ip AS target, port_count, packets FROM best WHERE port_count >= {ports} AND packets <= port_count * 12""",
        _BEST,
    )


@query("port_fanout", _port_fanout_sql(1))
def _port_fanout(t: Tables):
    p = replace(P, fanout_min_ports=1)
    return _evidence(detectors.port_fanout(rollup.port_fanout_best(daily(t), p), p))


# --- beacon, night, novelty ----------------------------------------------------------------------------


@query(
    "beaconing",
    with_views(
        "agg",
        """SELECT src_ip AS ip, '' AS destination_ip, 'BEACONING' AS type, 'medium' AS severity, 'active' AS status, bucket_ts AS created_at,
  dst_port, protocol, 3 AS observations, round(mean, 4) AS interval_seconds, round(dev / mean, 6) AS jitter, dst_ip AS target
FROM (SELECT *, (g1 + g2) / 2.0 AS mean, greatest(greatest(g1, g2) - (g1 + g2) / 2.0, (g1 + g2) / 2.0 - least(g1, g2)) AS dev FROM gaps WHERE g2 IS NOT NULL) x
WHERE greatest(g1, g2) <= 30 * 86400 AND dev <= 0.2 * mean""",
        """obs AS (SELECT DISTINCT src_ip, dst_ip, dst_port, protocol, bucket_ts FROM agg WHERE src_ip LIKE '192.168.%'
  AND dst_ip NOT LIKE '192.168.%' AND packets BETWEEN 1 AND 20 AND bytes <= 65536)""",
        """gaps AS (SELECT *, g1p AS g1, lag(g1p) OVER w AS g2 FROM (SELECT *, CAST((epoch_us(bucket_ts) - epoch_us(lag(bucket_ts) OVER w0)) // 1000000 AS DOUBLE) AS g1p FROM obs
    WINDOW w0 AS (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY bucket_ts)) y
  WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY bucket_ts))""",
    ),
)
def _beaconing(t: Tables):
    found = _evidence(detectors.beaconing(aggregates(t), P))
    return found.withColumn("interval_seconds", F.round("interval_seconds", 4)).withColumn(
        "jitter", F.round("jitter", 6)
    )


@query(
    "nighttime",
    with_views(
        "agg",
        """SELECT src_ip AS ip, '' AS destination_ip, 'NIGHTTIME_TRAFFIC' AS type, 'medium' AS severity, 'active' AS status, bucket_ts AS created_at,
  CAST(h AS INT) AS local_hour, CAST(day_windows AS BIGINT) AS day_windows, CAST(night_windows AS BIGINT) AS night_windows, bytes, packets, dst_count
FROM (SELECT *, coalesce(sum(is_day) OVER b, 0) AS day_windows, coalesce(sum(is_night) OVER b, 0) AS night_windows FROM ep
  WINDOW b AS (PARTITION BY src_ip, e ORDER BY bucket_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x
WHERE is_night = 1 AND day_windows >= 4 AND night_windows < 3""",
        """sig AS (SELECT *, hour(bucket_ts) AS h, CAST(hour(bucket_ts) < 5 AS INT) AS is_night, CAST(hour(bucket_ts) BETWEEN 7 AND 22 AS INT) AS is_day
  FROM (SELECT src_ip, bucket_ts, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, count(DISTINCT dst_ip) AS dst_count
    FROM agg WHERE src_ip LIKE '192.168.%' GROUP BY 1, 2) m
  WHERE (bytes >= 20000 OR packets >= 10 OR dst_count >= 5) AND (hour(bucket_ts) < 5 OR hour(bucket_ts) BETWEEN 7 AND 22))""",
        """ep AS (SELECT *, sum(CASE WHEN gap > 14 * 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY bucket_ts) AS e
  FROM (SELECT *, (epoch_us(bucket_ts) - epoch_us(lag(bucket_ts) OVER (PARTITION BY src_ip ORDER BY bucket_ts))) // 1000000 AS gap FROM sig) g)""",
    ),
)
def _night(t: Tables):
    return _evidence(detectors.nighttime(rollup.device_window_metrics(aggregates(t), P), P))


_HIST = """locl AS (SELECT * FROM agg WHERE src_ip LIKE '192.168.%'),
 srcb AS (SELECT DISTINCT src_ip, bucket_ts FROM locl),
 mat AS (SELECT a.src_ip, a.bucket_ts FROM srcb a JOIN srcb b ON a.src_ip = b.src_ip
   AND b.bucket_ts BETWEEN a.bucket_ts - INTERVAL 604801 SECOND AND a.bucket_ts - INTERVAL 1 SECOND GROUP BY 1, 2 HAVING count(*) >= 4)"""


def _novel_sql(kind: str, severity: str, item: str, dst: str, extra: str, rows: str) -> str:
    return with_views(
        "agg",
        f"""SELECT n.src_ip AS ip, {dst} AS destination_ip, '{kind}' AS type, '{severity}' AS severity, 'active' AS status, n.bucket_ts AS created_at{extra}, bytes
FROM cand n JOIN mat m ON m.src_ip = n.src_ip AND m.bucket_ts = n.bucket_ts
WHERE NOT EXISTS (SELECT 1 FROM cand h WHERE h.src_ip = n.src_ip AND h.{item} = n.{item}
  AND h.bucket_ts BETWEEN n.bucket_ts - INTERVAL 604801 SECOND AND n.bucket_ts - INTERVAL 1 SECOND)""",
        _HIST,
        rows,
    )


@query(
    "new_destination",
    _novel_sql(
        "NEW_DESTINATION", "medium", "dst_ip", "n.dst_ip", "",
        "cand AS (SELECT src_ip, dst_ip, bucket_ts, CAST(sum(bytes) AS BIGINT) AS bytes FROM locl WHERE dst_ip NOT LIKE '192.168.%' GROUP BY 1, 2, 3)",
    ),
)
def _new_destination(t: Tables):
    return _evidence(detectors.new_destination(aggregates(t), P))


@query(
    "new_port",
    _novel_sql(
        "NEW_PORT", "low", "dst_port", "n.dst_ip", ", n.dst_port",
        "cand AS (SELECT src_ip, dst_port, bucket_ts, CAST(sum(bytes) AS BIGINT) AS bytes, min(dst_ip) AS dst_ip FROM locl GROUP BY 1, 2, 3)",
    ),
)
def _new_port(t: Tables):
    return _evidence(detectors.new_port(aggregates(t), P))


@query(
    "source_history",
    with_views(
        "agg",
        f"""SELECT src_ip, count(DISTINCT bucket_ts) AS source_buckets, min(bucket_ts) AS source_first_seen, true AS observed
FROM agg WHERE bucket_ts BETWEEN {SINCE} AND TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1""",
    ),
)
def _history(t: Tables):
    return detectors.source_history(aggregates(t), NOW - timedelta(days=7), NOW)


# --- floods ---------------------------------------------------------------------------------------------

_RATES = """rates AS (SELECT dst_ip, make_timestamp(w * 5000000) AS window_start, make_timestamp(w * 5000000 + 5000000) AS window_end,
    CAST(sum(packets) AS BIGINT) // 5 AS pps, CAST(sum(bytes) AS BIGINT) // 5 AS bps, count(*) // 5 AS fps,
    CAST(coalesce(sum(packets) FILTER (protocol = 6 AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0), 0) AS BIGINT) // 5 AS syn,
    CAST(coalesce(sum(packets) FILTER (protocol = 17), 0) AS BIGINT) // 5 AS udp,
    CAST(coalesce(sum(packets) FILTER (protocol IN (1, 58)), 0) AS BIGINT) // 5 AS icmp
  FROM (SELECT *, epoch_us(event_ts) // 5000000 AS w FROM src WHERE dst_ip LIKE '192.168.%') x GROUP BY dst_ip, w)"""
_FROM_FLOWS = "src AS (SELECT * FROM f)"
_FROM_PACKETS = "src AS (SELECT *, CAST(1 AS BIGINT) AS packets FROM pk)"


@query("victim_rates", with_views("f", "SELECT * FROM rates", _FROM_FLOWS, _RATES))
def _rates(t: Tables):
    return detectors.victim_rates(t.flows, P)


def _flood_sql(rate: str, kind: str, limit: int) -> str:
    return f"""SELECT dst_ip AS ip, '' AS destination_ip, '{kind}' AS type, 'high' AS severity, 'active' AS status, window_start AS created_at,
  '{rate}' AS rate, {rate} AS observed, CAST({limit} AS BIGINT) AS limit_value FROM rates WHERE {rate} > {limit}"""


def _register_floods() -> None:
    for rate, kind in detectors.FLOOD_TYPES.items():
        limit = getattr(P, f"flood_{rate}")
        # single events never reach a flow rate of one per second; packet records do
        dense = rate == "fps"
        sql = with_views(
            "pk" if dense else "f", _flood_sql(rate, kind, limit), _FROM_PACKETS if dense else _FROM_FLOWS, _RATES
        )

        def build(t: Tables, rate=rate, dense=dense):
            rows = t.packets.withColumn("packets", F.lit(1).cast("long")) if dense else t.flows
            return _evidence(detectors.floods(detectors.victim_rates(rows, P), P, only=rate))

        query(f"flood_{rate}", sql)(build)


_register_floods()


@query(
    "floods",
    with_views(
        "f",
        " UNION ALL ".join(
            _flood_sql(r, k, getattr(P, f"flood_{r}")) for r, k in detectors.FLOOD_TYPES.items()
        ),
        _FROM_FLOWS,
        _RATES,
    ),
)
def _floods(t: Tables):
    return _evidence(detectors.floods(detectors.victim_rates(t.flows, P), P))


# --- learned profiles: the checking SQL walks the windows of a device one by one ----------------------------


def _service_sql(port: str) -> str:
    named = " ".join(f"WHEN {port} IN {ports if len(ports) > 1 else f'({ports[0]})'} THEN '{name}'" for name, ports in labels.SERVICE_PORTS.items())
    return f"CASE {named} WHEN {port} BETWEEN 1 AND 1023 THEN 'other-system' WHEN {port} BETWEEN 1024 AND 65535 THEN 'high-port' END"


def _joined(items: str) -> str:
    return f"coalesce(nullif(array_to_string({items}, ','), ''), 'none')"


_SIGNATURES = f"""sigs AS (SELECT src_ip, bucket_ts, epoch_us(bucket_ts) // 1000000 AS sec, row_number() OVER (PARTITION BY src_ip ORDER BY bucket_ts) AS rn,
    concat('protocols=', {_joined("list_transform(list_sort(list(DISTINCT protocol)), lambda x: CASE x WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE concat('ip-', x) END)")},
      ' services=', {_joined(f"list_sort(list(DISTINCT {_service_sql('dst_port')}))")},
      ' peers=', CASE WHEN count(DISTINCT dst_ip) <= 0 THEN '0' WHEN count(DISTINCT dst_ip) <= 4 THEN '1-4' WHEN count(DISTINCT dst_ip) <= 15 THEN '5-15' ELSE '16+' END) AS sig
  FROM aday WHERE {_LOCAL_SRC} GROUP BY src_ip, bucket_ts)"""

_PROFILE_WALK = """walk AS (
  SELECT src_ip, rn, sec, bucket_ts, sig, CAST(NULL AS VARCHAR) AS usual, [sig] AS votes, CAST(NULL AS VARCHAR) AS old FROM sigs WHERE rn = 1
  UNION ALL
  SELECT src_ip, rn, sec, bucket_ts, sig, CASE WHEN was IS NOT NULL THEN sig WHEN len(heard) = 4 AND top.n <= -2 THEN top.x END,
    CASE WHEN was IS NOT NULL OR len(heard) = 4 THEN CAST([] AS VARCHAR[]) ELSE heard END, CASE WHEN was <> sig THEN was END
  FROM (SELECT *, list_sort(list_transform(list_distinct(heard), lambda x: {'n': -len(list_filter(heard, lambda y: y = x)), 'x': x}))[1] AS top
    FROM (SELECT s.*, CASE WHEN s.sec - w.sec > 14 * 86400 THEN NULL ELSE w.usual END AS was,
        list_append(CASE WHEN s.sec - w.sec > 14 * 86400 THEN CAST([] AS VARCHAR[]) ELSE w.votes END, s.sig) AS heard
      FROM walk w JOIN sigs s ON s.src_ip = w.src_ip AND s.rn = w.rn + 1) a) b)"""

_PROFILE_SQL = with_views(
    "aday",
    """SELECT src_ip AS ip, '' AS destination_ip, 'DEVICE_PROFILE_CHANGE' AS type, 'high' AS severity, 'active' AS status, bucket_ts AS created_at,
  old AS old_profile, sig AS new_profile FROM walk WHERE old IS NOT NULL""",
    _SIGNATURES, _PROFILE_WALK,
)

_PEER_SQL = with_views(
    "aday",
    """SELECT src_ip AS ip, hit AS destination_ip, 'NEW_INTERNAL_COMMUNICATION' AS type, 'medium' AS severity, 'active' AS status, bucket_ts AS created_at
FROM met_peers WHERE hit IS NOT NULL""",
    """wins AS (SELECT src_ip, bucket_ts, epoch_us(bucket_ts) // 1000000 AS sec, list_sort(list(DISTINCT dst_ip)) AS peers,
    row_number() OVER (PARTITION BY src_ip ORDER BY bucket_ts) AS rn
  FROM aday WHERE src_ip LIKE '192.168.%' AND dst_ip LIKE '192.168.%' AND src_ip <> dst_ip GROUP BY src_ip, bucket_ts)""",
    """met_peers AS (
  SELECT src_ip, rn, sec, bucket_ts, 1 AS seen, peers AS known, CAST(NULL AS VARCHAR) AS hit FROM wins WHERE rn = 1
  UNION ALL
  SELECT src_ip, rn, sec, bucket_ts, CAST(before + 1 AS INTEGER),
    CASE WHEN before < 4 THEN list_distinct(list_concat(had, peers)) WHEN first IS NULL THEN had ELSE list_append(had, first) END,
    CASE WHEN before >= 4 THEN first END
  FROM (SELECT *, list_filter(peers, lambda x: NOT list_contains(had, x))[1] AS first
    FROM (SELECT w.*, CASE WHEN w.sec - m.sec > 14 * 86400 THEN 0 ELSE m.seen END AS before,
        CASE WHEN w.sec - m.sec > 14 * 86400 THEN CAST([] AS VARCHAR[]) ELSE m.known END AS had
      FROM met_peers m JOIN wins w ON w.src_ip = m.src_ip AND w.rn = m.rn + 1) a) b)""",
)


@query("device_profile_change", _PROFILE_SQL)
def _profiles(t: Tables):
    metrics = rollup.device_window_metrics(daily(t), P, with_profile=True)
    return _evidence(profiles.device_profile_change(metrics, P))


@query("new_internal_communication", _PEER_SQL)
def _peers(t: Tables):
    return _evidence(profiles.new_internal_communication(daily(t), P))


def _detect_sql() -> str:
    """All detectors' own SQL over daily aggregates (the learned baselines stay those of the minutes)."""
    by_day = [ORACLES[n].replace("date_trunc('minute', event_ts)", "date_trunc('day', event_ts)") for n in ("beaconing", "nighttime", "new_destination", "new_port")]
    fanout = with_views(
        "aday agg dev",
        _fanout_sql(
            "CASE WHEN b.ip IS NULL THEN 5 ELSE greatest(5, CAST(ceil(mean_peers + 1.5 * stddev_peers) AS BIGINT)) END",
            "LEFT JOIN basel b ON m.src_ip = b.ip",
        ),
        _METRICS,
        *BASE_PARTS,
    )
    parts = [ORACLES["traffic_spike"], fanout, _port_fanout_sql(3), _PROFILE_SQL, _PEER_SQL, *by_day]
    return "\nUNION ALL\n".join(f"SELECT ip, destination_ip, type, severity, status, created_at FROM ({x}) p{i}" for i, x in enumerate(parts))


@query("detect_all", _detect_sql())
def _detect_all(t: Tables):
    return _evidence(detect_all(daily(t), baselines(t), P))


# --- cooldown and suppression ----------------------------------------------------------------------------------


def _greedy(keys: str, slots: str, gap: str) -> tuple[str, str, str]:
    """Slots, next slot after the cooldown, and the chain of kept slots."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return (
        slots,
        f"""nxt AS (SELECT a.*, (SELECT min(b.us) FROM slots b WHERE {same} AND b.us >= a.us + {gap}) AS nx FROM slots a)""",
        f"""chain AS (SELECT {keys}, min(us) AS us FROM slots GROUP BY {keys}
  UNION ALL SELECT {', '.join('b.' + k for k in keys.split(', '))}, b.nx FROM chain a JOIN nxt b ON {same} AND a.us = b.us WHERE b.nx IS NOT NULL)""",
    )


@query(
    "dedup_alerts",
    with_views(
        "anom",
        """SELECT c.ip, c.type, make_timestamp(c.us) AS created_at, s.c.destination_ip AS destination_ip, s.c.severity AS severity, s.c.description AS description
FROM chain c JOIN slots s ON c.ip = s.ip AND c.type = s.type AND c.us = s.us""",
        *_greedy(
            "ip, type",
            "slots AS (SELECT ip, type, epoch_us(created_at) AS us, min({'destination_ip': destination_ip, 'severity': severity, 'description': description}) AS c FROM anom GROUP BY ALL)",
            "432000000000",
        ),
    ),
)
def _dedup(t: Tables):
    return alerts.dedup_alerts(t.anomalies, 5 * 86400)


@query(
    "dedup_sources",
    with_views(
        "f",
        "SELECT ip, make_timestamp(us) AS created_at FROM chain",
        *_greedy(
            "ip",
            "slots AS (SELECT DISTINCT src_ip AS ip, epoch_us(event_ts) AS us FROM f WHERE src_ip LIKE '192.168.%')",
            "86400000000",
        ),
    ),
)
def _dedup_sources(t: Tables):
    rows = t.flows.filter("src_ip LIKE '192.168.%'").select(
        F.col("src_ip").alias("ip"), F.col("event_ts").alias("created_at"), F.lit("").alias("note")
    )
    return alerts.dedup_alerts(rows, 86400, keys=["ip"], carry=["note"]).drop("note")


@query(
    "suppress_types_and_subnets",
    with_views(
        "anom",
        "SELECT id, ip, type FROM anom WHERE type NOT IN ('BEACONING') AND NOT (ip LIKE '192.168.10.%' AND CAST(split_part(ip, '.', 4) AS INT) BETWEEN 64 AND 127)",
    ),
)
def _suppress(t: Tables):
    p = replace(P, disabled_types=(" beaconing",), muted_cidrs=("192.168.10.64/26",))
    return alerts.suppress_types_and_subnets(t.anomalies, p).select("id", "ip", "type")


# --- alert lists ------------------------------------------------------------------------------------------------

_ANOM = "id, ip, destination_ip, type, description, severity, status, created_at, updated_at"


@query("list_anomalies", with_views("anom", "SELECT * FROM anom ORDER BY created_at DESC, id DESC LIMIT 50"))
def _list(t: Tables):
    return alerts.list_anomalies(t.anomalies)


@query("active_anomalies", with_views("anom", f"SELECT * FROM anom WHERE status = 'active' AND created_at > {SINCE}"))
def _active(t: Tables):
    return alerts.active_anomalies(t.anomalies, NOW - timedelta(days=7))


@query(
    "anomalies_for_ip",
    with_views("anom", f"SELECT * FROM anom WHERE ip = '{DEVICE}' ORDER BY created_at DESC, id DESC LIMIT 50"),
)
def _for_ip(t: Tables):
    return alerts.anomalies_for_ip(t.anomalies, DEVICE)


@query(
    "has_recent_anomaly",
    with_views("anom", f"SELECT count(*) > 0 AS has_recent FROM anom WHERE ip = '{DEVICE}' AND type = 'BEACONING' AND created_at >= TIMESTAMP '2024-01-05 00:00:00'"),
)
def _recent(t: Tables):
    return alerts.has_recent_anomaly(t.anomalies, DEVICE, "BEACONING", "2024-01-05 00:00:00")


@query(
    "recent_high_alerts",
    with_views(
        "anom",
        f"SELECT * FROM anom WHERE status = 'active' AND created_at > {SINCE} AND severity IN ('critical', 'high') ORDER BY created_at DESC, id DESC LIMIT 10",
    ),
)
def _high(t: Tables):
    return alerts.recent_high_alerts(alerts.active_anomalies(t.anomalies, NOW - timedelta(days=7)))


@query(
    "search_alerts",
    with_views(
        "anom",
        """SELECT * FROM anom WHERE status = 'active' AND severity = 'high'
  AND contains(lower(concat_ws('|', ip, type, description, severity, status)), 'beacon') AND contains(lower(concat_ws('|', ip, type, description, severity, status)), '10.1')""",
    ),
)
def _search(t: Tables):
    return alerts.search_alerts(t.anomalies, "Beacon 10.1", "active", "high")


@query(
    "enrich_alerts",
    with_views(
        "anom dev",
        f"""SELECT {', '.join('a.' + c for c in _ANOM.split(', '))}, coalesce(label, '') AS device_label, coalesce(hostname, '') AS device_hostname,
  coalesce(nullif(label, ''), nullif(hostname, ''), '') AS device_name,
  CASE WHEN coalesce(nullif(label, ''), nullif(hostname, '')) IS NULL THEN a.ip ELSE concat(coalesce(nullif(label, ''), hostname), ' (', a.ip, ')') END AS device_identity
FROM anom a LEFT JOIN dev d ON a.ip = d.ip""",
    ),
)
def _enrich(t: Tables):
    return alerts.enrich_alerts(t.anomalies, t.devices)


@query(
    "apply_status",
    with_views(
        "anom slog",
        """SELECT a.id, ip, destination_ip, type, description, severity, coalesce(l.s.status, a.status) AS status, created_at, coalesce(l.s.changed_at, updated_at) AS updated_at
FROM anom a LEFT JOIN (SELECT anomaly_id, max({'changed_at': changed_at, 'status': status}) AS s FROM slog
  WHERE status IN ('active', 'acknowledged', 'silenced') GROUP BY 1) l ON a.id = l.anomaly_id""",
    ),
)
def _status(t: Tables):
    return alerts.apply_status(t.anomalies, t.status_log)[0]


# --- policies -----------------------------------------------------------------------------------------------------


def _in_net(addr: str, target: str) -> str:
    number = lambda x: "(" + " + ".join(
        f"CAST(split_part({x}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)
    ) + ")"
    width = f"CAST(pow(2, 32 - CAST(split_part({target}, '/', 2) AS INT)) AS BIGINT)"
    net = number(f"split_part({target}, '/', 1)")
    return f"({number(addr)} // {width} = {net} // {width})"


_MATCH = f"""pmatch AS (SELECT a.id AS anomaly_id, p.id AS policy_id, p.name, p.scope, p.target, p.severity_threshold, p.suppressed, p.cooldown_seconds,
    p.quiet_hours_start, p.quiet_hours_end, CASE p.scope WHEN 'ip' THEN 4 WHEN 'subnet' THEN 3 WHEN 'alert_type' THEN 2 ELSE 1 END AS priority,
    row_number() OVER (PARTITION BY a.id ORDER BY CASE p.scope WHEN 'ip' THEN 4 WHEN 'subnet' THEN 3 WHEN 'alert_type' THEN 2 ELSE 1 END DESC, p.id DESC) AS rn
  FROM anom a JOIN pol p ON CASE p.scope WHEN 'global' THEN true WHEN 'alert_type' THEN p.target = a.type
    WHEN 'ip' THEN p.target IN (a.ip, a.destination_ip)
    ELSE {_in_net('a.ip', 'p.target')} OR (a.destination_ip <> '' AND {_in_net("coalesce(nullif(a.destination_ip, ''), '0.0.0.0')", 'p.target')}) END)"""


@query("match_policies", with_views("anom pol", "SELECT anomaly_id, policy_id, scope FROM pmatch", _MATCH))
def _match(t: Tables):
    return policies.match_policies(t.anomalies, t.policies).select("anomaly_id", "policy_id", "scope")


@query(
    "policy_match",
    with_views("anom pol", "SELECT anomaly_id, priority, policy_id, name, scope FROM pmatch WHERE rn = 1", _MATCH),
)
def _policy_match(t: Tables):
    found = policies.policy_match(t.anomalies, t.policies)
    return found.select("anomaly_id", "priority", "policy_id", "name", "scope")


_RANK = lambda c: f"(CASE lower({c}) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)"
_APPLIED = f"""applied AS (SELECT {', '.join('a.' + c for c in _ANOM.replace('status, ', '').split(', '))}, CASE WHEN reason IS NULL THEN a.status ELSE 'silenced' END AS status, a.policy_id, reason AS silence_reason
  FROM (SELECT x.*, m.policy_id, CASE WHEN m.policy_id IS NULL THEN NULL WHEN suppressed THEN 'suppressed'
      WHEN severity_threshold <> '' AND {_RANK('severity')} < {_RANK('severity_threshold')} THEN 'below_threshold'
      WHEN quiet_hours_start <> '' AND (hour(created_at) * 60 + minute(created_at) >= 1320 OR hour(created_at) * 60 + minute(created_at) <= 360) THEN 'quiet_hours'
      WHEN cooldown_seconds > 0 AND prev >= created_at - to_seconds(cooldown_seconds) THEN 'cooldown' END AS reason
    FROM (SELECT *, lag(created_at) OVER (PARTITION BY ip, type ORDER BY created_at, id) AS prev FROM anom) x
    LEFT JOIN (SELECT * FROM pmatch WHERE rn = 1) m ON x.id = m.anomaly_id) a)"""


@query("apply_policies", with_views("anom pol", "SELECT * FROM applied", _MATCH, _APPLIED))
def _apply(t: Tables):
    return policies.apply_policies(t.anomalies, t.policies)


@query(
    "device_policies",
    with_views(
        "dev pol",
        f"""SELECT d.ip, p.id AS policy_id, p.scope, p.name FROM dev d JOIN pol p
  ON p.scope = 'global' OR (p.scope = 'ip' AND p.target = d.ip) OR (p.scope = 'subnet' AND {_in_net('d.ip', 'CASE WHEN p.scope = \'subnet\' THEN p.target ELSE \'0.0.0.0/0\' END')})""",
    ),
)
def _device_policies(t: Tables):
    return policies.device_policies(t.devices, t.policies)


_PLOG_REASON = rf"""plr AS (SELECT *, CASE WHEN op = 'delete' THEN NULL WHEN name = '' THEN 'name is empty'
    WHEN scope = 'subnet' AND TRY_CAST(split_part(target, '/', 2) AS INT) > 32 THEN 'target is not a network'
    WHEN scope = 'other' THEN 'unknown scope'
    WHEN severity_threshold NOT IN ('', 'low', 'medium', 'high') THEN 'unknown severity'
    WHEN cooldown_seconds NOT BETWEEN 0 AND 2592000 THEN 'cooldown out of range'
    WHEN (quiet_hours_start = '') <> (quiet_hours_end = '') THEN 'quiet hours need both ends' END AS reject_reason FROM plog)"""


# accepted entries: an id is there if the last insert or delete before says so, else if the table holds it
_PLOG_DONE = """done AS (SELECT * FROM (SELECT *, (SELECT arg_max(y.op, (y.changed_at, y.op, y.name, y.scope, y.target)) FROM plr y
      WHERE y.id = plr.id AND y.reject_reason IS NULL AND y.op <> 'update'
        AND (y.changed_at, y.op, y.name, y.scope, y.target) < (plr.changed_at, plr.op, plr.name, plr.scope, plr.target)) AS before
    FROM plr WHERE reject_reason IS NULL) z
  WHERE op = 'insert' OR coalesce(before = 'insert', id IN (SELECT id FROM pol)))"""


@query(
    "validate_policies",
    with_views("plog", "SELECT id, name, scope, target, reject_reason FROM plr WHERE reject_reason IS NOT NULL", _PLOG_REASON),
)
def _validate(t: Tables):
    log = t.policy_log.filter("op <> 'delete'")
    return policies.validate_policies(log)[1].select("id", "name", "scope", "target", "reject_reason")


@query(
    "apply_rule_changes",
    with_views(
        "plog pol",
        """SELECT id, name, scope, target, severity_threshold, suppressed, cooldown_seconds, quiet_hours_start, quiet_hours_end FROM pol WHERE id NOT IN (SELECT id FROM fin)
UNION ALL SELECT id, name, scope, target, severity_threshold, suppressed, cooldown_seconds, quiet_hours_start, quiet_hours_end FROM fin WHERE op <> 'delete'""",
        _PLOG_REASON,
        _PLOG_DONE,
        """fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, op DESC, name DESC, scope DESC, target DESC) AS rn FROM done) x
  WHERE rn = 1)""",
    ),
)
def _rule_changes(t: Tables):
    return changes.apply_rule_changes(_policy_table(t), t.policy_log, policies.validate_policies)[0]


def _policy_table(t: Tables):
    return t.policies.withColumn("id", F.col("id").cast("long"))


_AUDIT = f"""{_PLOG_REASON}, {_PLOG_DONE},
 aud AS (SELECT changed_at AS timestamp, 'update_device_label' AS action, concat('label of ', ip, ' is now "', label, '"') AS details
    FROM llog WHERE ip IN (SELECT ip FROM dev)
  UNION ALL SELECT changed_at, 'update_anomaly_status', concat('alert ', anomaly_id, ' is now "', status, '"')
    FROM slog WHERE status IN ('active', 'acknowledged', 'silenced') AND anomaly_id IN (SELECT id FROM anom)
  UNION ALL SELECT changed_at, CASE WHEN op = 'delete' THEN 'delete_policy' ELSE 'save_policy' END, concat('id ', id, ', name ', name, ', scope ', scope, ', target ', target) FROM done)"""


def _audit(t: Tables):
    return changes.audit_log(
        changes.audit_labels(changes.accepted(devices.judged_labels(t.devices, t.label_log))),
        changes.audit_status(changes.accepted(alerts.judged_status(t.anomalies, t.status_log))),
        changes.audit_rule_changes(
            changes.accepted(changes.judged_changes(_policy_table(t), t.policy_log, policies.validate_policies)), "policy"
        ),
    )


@query("audit_log", with_views("llog slog plog dev anom pol", "SELECT * FROM aud", _AUDIT))
def _audit_log(t: Tables):
    return _audit(t)


@query(
    "list_audit",
    with_views("llog slog plog dev anom pol", "SELECT * FROM aud ORDER BY timestamp DESC, action, details LIMIT 50", _AUDIT),
)
def _list_audit(t: Tables):
    return changes.list_audit(_audit(t))


@query(
    "search_audit",
    with_views(
        "llog slog plog dev anom pol",
        """SELECT * FROM aud WHERE timestamp < TIMESTAMP '2024-01-20' AND (contains(lower(action), 'policy') OR contains(lower(details), 'policy')) AND (contains(lower(action), 'subnet') OR contains(lower(details), 'subnet'))
ORDER BY timestamp DESC, action, details LIMIT 25""",
        _AUDIT,
    ),
)
def _search_audit(t: Tables):
    return changes.search_audit(_audit(t), "Policy subnet", after=(F.to_timestamp(F.lit("2024-01-20")), "", ""), size=25)


@query(
    "search_audit_repeats",
    with_views(
        "daud",
        """SELECT * FROM daud WHERE contains(action, 'c') AND (timestamp < TIMESTAMP '2024-01-20' OR (timestamp = TIMESTAMP '2024-01-20'
  AND (action > 'click' OR (action = 'click' AND details >= 'even')))) ORDER BY timestamp DESC, action, details LIMIT 40 OFFSET 3""",
    ),
)
def _search_audit_repeats(t: Tables):
    """A page that begins behind three of several equal rows."""
    after = (F.to_timestamp(F.lit("2024-01-20")), "click", "even", 3)
    return changes.search_audit(t.day_audit, "c", after=after, size=40)


_ODD_OPS = "CASE id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'upsert' WHEN 2 THEN 'DELETE' ELSE op END"


@query(
    "judged_changes",
    with_views(
        "plog",
        """SELECT id, op, changed_at, count(*) AS entries, bool_and(op IS NULL OR op NOT IN ('insert', 'update', 'delete')) AS unknown_op FROM
  (SELECT id, changed_at, """ + _ODD_OPS + """ AS op FROM plog) x GROUP BY id, op, changed_at""",
    ),
)
def _judged_changes(t: Tables):
    """Every entry of the log is judged, those of a null or unknown op too."""
    log = t.policy_log.withColumn("op", F.expr(_ODD_OPS))
    judged = changes.judged_changes(_policy_table(t), log, policies.validate_policies)
    unknown = F.bool_and(F.coalesce(F.col("reject_reason") == "unknown op", F.lit(False)))
    return judged.groupBy("id", "op", "changed_at").agg(F.count(F.lit(1)).alias("entries"), unknown.alias("unknown_op"))


# --- risk -------------------------------------------------------------------------------------------------------------

_CONTRIB = f"""contrib AS (SELECT *, base_weight * decay_factor AS contribution FROM (SELECT *, greatest(1 - age_hours / 24.0, 0.15)::DOUBLE AS decay_factor
  FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(created_at)) / 3600000000.0 AS age_hours,
    CASE severity WHEN 'high' THEN 40.0 WHEN 'medium' THEN 20.0 ELSE 10.0 END::DOUBLE AS base_weight
    FROM anom WHERE status = 'active' AND created_at > {SINCE}) x) y)"""
_RISK = """risk AS (SELECT t.ip, base_score, active_alert_count, high_alerts, medium_alerts, low_alerts, boost AS correlation_boost,
    CAST(least(round(base_score + boost), 100) AS INT) AS risk_score,
    CASE WHEN least(round(base_score + boost), 100) >= 70 THEN 'high' WHEN least(round(base_score + boost), 100) >= 30 THEN 'medium' ELSE 'low' END AS risk_level, label, hostname
  FROM (SELECT ip, sum(contribution) AS base_score, count(*) AS active_alert_count, count(*) FILTER (severity = 'high') AS high_alerts,
      count(*) FILTER (severity = 'medium') AS medium_alerts, count(*) FILTER (severity = 'low') AS low_alerts,
      CASE WHEN ip IN (SELECT a.ip FROM contrib a JOIN contrib b ON a.ip = b.ip AND a.type = 'SURICATA_ALERT' AND b.type <> 'SURICATA_ALERT'
        AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 3600000000) THEN 20.0 ELSE 0.0 END::DOUBLE AS boost
    FROM contrib GROUP BY ip) t JOIN dev d ON t.ip = d.ip WHERE round(base_score + boost) > 0)"""


def risks(t: Tables):
    return risk.device_risk(t.devices, t.anomalies, NOW, P)


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 4))
    return df


@query(
    "alert_contribution",
    with_views(
        "anom",
        "SELECT id, ip, severity, round(age_hours, 4) AS age_hours, base_weight, round(decay_factor, 4) AS decay_factor, round(contribution, 4) AS contribution FROM contrib",
        _CONTRIB,
    ),
)
def _contribution(t: Tables):
    rows = _round(risk.risk_contributors(t.anomalies, NOW, P), "age_hours", "decay_factor", "contribution")
    return rows.select("id", "ip", "severity", "age_hours", "base_weight", "decay_factor", "contribution")


@query(
    "correlated_devices",
    with_views(
        "anom",
        """SELECT DISTINCT a.ip FROM contrib a JOIN contrib b ON a.ip = b.ip AND a.type = 'SURICATA_ALERT' AND b.type <> 'SURICATA_ALERT'
  AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 21600000000""",
        _CONTRIB,
    ),
)
def _correlated(t: Tables):
    p = replace(P, risk_boost_gap=6 * 3600)
    return risk.correlated_devices(risk.risk_contributors(t.anomalies, NOW, p), p)


@query(
    "device_risk",
    with_views("anom dev", "SELECT * REPLACE (round(base_score, 4) AS base_score) FROM risk", _CONTRIB, _RISK),
)
def _device_risk(t: Tables):
    return _round(risks(t), "base_score")


@query(
    "top_risk",
    with_views("anom dev", "SELECT ip, risk_score, risk_level FROM risk ORDER BY risk_score DESC, ip LIMIT 8", _CONTRIB, _RISK),
)
def _top_risk(t: Tables):
    return risk.top_actors(risks(t)).select("ip", "risk_score", "risk_level")


@query(
    "risk_breakdown",
    with_views(
        "anom dev",
        """SELECT c.ip, id, type, severity, created_at, round(contribution, 4) AS contribution, description AS message, risk_score, risk_level, correlation_boost, active_alert_count
FROM contrib c JOIN risk r ON c.ip = r.ip""",
        _CONTRIB,
        _RISK,
    ),
)
def _breakdown(t: Tables):
    rows = _round(risk.risk_breakdown(t.devices, t.anomalies, NOW, P), "contribution")
    return rows.select(
        "ip", "id", "type", "severity", "created_at", "contribution", "message", "risk_score", "risk_level",
        "correlation_boost", "active_alert_count",
    )


@query(
    "risk_explanations",
    with_views(
        "anom dev",
        """SELECT c.ip, description AS explanation FROM contrib c JOIN risk r ON c.ip = r.ip
UNION ALL SELECT DISTINCT r.ip, printf('an IDS alert and another alert lie within one hour (+%.0f)', CAST(correlation_boost AS DOUBLE))
  FROM risk r WHERE correlation_boost > 0 AND ip IN (SELECT ip FROM contrib)""",
        _CONTRIB,
        _RISK,
    ),
)
def _explanations(t: Tables):
    return risk.risk_explanations(risk.risk_breakdown(t.devices, t.anomalies, NOW, P))


@query("alert_mix", with_views("anom dev", "SELECT ip, high_alerts, medium_alerts, low_alerts FROM risk", _CONTRIB, _RISK))
def _mix(t: Tables):
    return risk.alert_mix(risks(t))


_DIST = """dist AS (SELECT *, greatest(total_devices - high - medium, 0) AS low FROM (SELECT count(*) FILTER (risk_score >= 70) AS high,
    count(*) FILTER (risk_score BETWEEN 30 AND 69) AS medium, coalesce(max(risk_score), 0) AS max_risk_score,
    count(*) FILTER (risk_score >= 30) AS elevated_devices, (SELECT count(*) FROM dev) AS total_devices FROM risk) x)"""


@query("risk_distribution", with_views("anom dev", "SELECT * FROM dist", _CONTRIB, _RISK, _DIST))
def _distribution(t: Tables):
    return risk.risk_distribution(t.devices, risks(t), P)


@query(
    "subnet_summary",
    with_views(
        "anom dev",
        """SELECT coalesce(a.subnet, b.subnet) AS subnet, coalesce(devices, 0) AS devices, coalesce(risky, 0) AS risky FROM
  (SELECT concat(regexp_extract(ip, '^([0-9]+\\.[0-9]+\\.[0-9]+)', 1), '.0/24') AS subnet, count(*) AS devices FROM dev GROUP BY 1) a
  FULL JOIN (SELECT concat(regexp_extract(ip, '^([0-9]+\\.[0-9]+\\.[0-9]+)', 1), '.0/24') AS subnet, count(*) AS risky FROM risk GROUP BY 1) b ON a.subnet = b.subnet""".replace("\\\\", "\\"),
        _CONTRIB,
        _RISK,
    ),
)
def _subnets(t: Tables):
    return traffic.subnet_summary(t.devices, risks(t))


@query(
    "block_rule_templates",
    with_views(
        "anom dev",
        """SELECT ip, concat('UniFi: Firewall > WAN IN > new rule, action drop, source address group with ', ip) AS unifi,
  concat('OPNsense: Firewall > Rules > WAN > add, action block, protocol any, source ', ip) AS opnsense,
  concat('/ip firewall filter add action=drop chain=input src-address=', ip, ' comment="blocked source"') AS mikrotik FROM risk""",
        _CONTRIB,
        _RISK,
    ),
)
def _blocks(t: Tables):
    return risk.block_rule_templates(risks(t))


# --- security views ------------------------------------------------------------------------------------------------------

_SEV = "count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total"
_ACT = f"act AS (SELECT * FROM anom WHERE status = 'active' AND created_at > {SINCE})"


@query("alerts_by_severity", with_views("anom", f"SELECT {_SEV} FROM act", _ACT))
def _by_severity(t: Tables):
    return security.alerts_by_severity(t.anomalies, NOW - timedelta(days=7))


_TIMELINE = f"tl AS (SELECT make_timestamp((epoch_us(created_at) // 3600000000) * 3600000000) AS timestamp, {_SEV} FROM act GROUP BY 1)"


@query("security_timeline", with_views("anom", "SELECT * FROM tl", _ACT, _TIMELINE))
def _timeline(t: Tables):
    return security.security_timeline(t.anomalies, NOW - timedelta(days=7), NOW, 3600)


@query(
    "fill_slots",
    with_views(
        "anom",
        f"""SELECT s.slot, {SINCE} + to_hours(CAST(s.slot * 7 AS INT)) AS timestamp, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(total, 0) AS total
FROM (SELECT CAST(range AS BIGINT) AS slot FROM range(24)) s LEFT JOIN (SELECT least(23, (epoch_us(timestamp) - epoch_us({SINCE})) // 25200000000) AS slot,
  CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low, CAST(sum(total) AS BIGINT) AS total FROM tl GROUP BY 1) x ON s.slot = x.slot""",
        _ACT,
        _TIMELINE,
    ),
)
def _slots(t: Tables):
    start = NOW - timedelta(days=7)
    found = security.security_timeline(t.anomalies, start, NOW, 3600)
    return traffic.fill_slots(found, start, NOW, 24, ["critical", "high", "medium", "low", "total"])


@query(
    "active_alert_gauges",
    with_views("anom", "SELECT lower(severity) AS severity, type, count(*) AS alerts FROM anom WHERE status = 'active' AND created_at > TIMESTAMP '2024-01-01 00:00:00' GROUP BY ALL"),
)
def _gauges(t: Tables):
    return security.active_alert_gauges(t.anomalies, NOW)


@query(
    "security_summary",
    with_views(
        "anom dev",
        f"""SELECT d.low AS risk_low, d.medium AS risk_medium, d.high AS risk_high, max_risk_score, elevated_devices, total_devices,
  c.critical AS active_critical, c.high AS active_high, c.medium AS active_medium, c.low AS active_low, c.total AS active_total,
  (SELECT string_agg(concat(ip, ':', risk_score), ',' ORDER BY risk_score DESC, ip) FROM (SELECT * FROM risk ORDER BY risk_score DESC, ip LIMIT 5) x) AS top_risk,
  (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) FROM (SELECT * FROM act WHERE severity IN ('critical', 'high') ORDER BY created_at DESC, id DESC LIMIT 10) y) AS recent_high
FROM dist d, (SELECT {_SEV} FROM act) c""",
        _CONTRIB, _RISK, _DIST, _ACT,
    ),
)
def _summary(t: Tables):
    row = security.security_summary(t.devices, t.anomalies, NOW, P)
    top = F.transform("top_risk_devices", lambda s: F.concat_ws(":", s["ip"], s["risk_score"].cast("string")))
    recent = F.transform("recent_high_alerts", lambda s: s["id"].cast("string"))
    return (
        row.withColumn("top_risk", F.array_join(top, ","))
        .withColumn("recent_high", F.array_join(recent, ","))
        .drop("top_risk_devices", "recent_high_alerts", "flood_limits")
    )


@query(
    "device_profile",
    with_views(
        "anom dev pol agg",
        f"""SELECT d.ip, d.label, d.hostname, d.vendor, d.first_seen, d.last_seen, '192.168.0.0/16' AS subnet_vlan, coalesce(r.risk_score, 0) AS risk_score,
  coalesce(r.risk_level, 'low') AS risk_level, coalesce(r.active_alert_count, 0) AS active_alert_count, round(b.mean_bytes, 4) AS mean_bytes,
  coalesce(l.last_alerts, '') AS last_alerts, coalesce(p.names, '') AS applied_policies, CASE WHEN p.names IS NULL THEN 'no_policy' ELSE 'active_policy' END AS policy_status
FROM dev d LEFT JOIN risk r ON d.ip = r.ip LEFT JOIN basel b ON d.ip = b.ip
LEFT JOIN (SELECT ip, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) AS last_alerts FROM
  (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY created_at DESC, id DESC) AS rn FROM anom) x WHERE rn <= 50 GROUP BY ip) l ON d.ip = l.ip
LEFT JOIN (SELECT d.ip, string_agg(p.name, ',' ORDER BY p.scope, p.name) AS names FROM dev d JOIN pol p
  ON p.scope = 'global' OR (p.scope = 'ip' AND p.target = d.ip) OR (p.scope = 'subnet' AND {_in_net('d.ip', 'CASE WHEN p.scope = \'subnet\' THEN p.target ELSE \'0.0.0.0/0\' END')}) GROUP BY d.ip) p ON d.ip = p.ip""",
        _CONTRIB, _RISK, *BASE_PARTS,
    ),
)
def _profile(t: Tables):
    page = device_profile(t.devices, t.anomalies, baselines(t), t.policies, NOW, P)
    ids_text = F.array_join(F.transform("anomalies", lambda a: a["id"].cast("string")), ",")
    return page.select(
        "ip", "label", "hostname", "vendor", "first_seen", "last_seen", "subnet_vlan", "risk_score", "risk_level",
        "active_alert_count", F.round("mean_bytes", 4).alias("mean_bytes"),
        F.coalesce(ids_text, F.lit("")).alias("last_alerts"),
        F.array_join("applied_policies", ",").alias("applied_policies"), "policy_status",
    )


# --- notifications --------------------------------------------------------------------------------------------------------

_RMATCH = f"""rmatch AS (SELECT a.*, r.id AS rule_id, r.cooldown_seconds, r.channel_targets FROM gate a JOIN rul r ON r.enabled
    AND {_RANK('a.severity')} >= {_RANK('r.severity_min')}
    AND (len(r.alert_types) = 0 OR list_contains(list_transform(r.alert_types, lambda x: lower(x)), lower(a.type)))
    AND CASE WHEN r.scope = 'global' OR r.target = '' THEN true WHEN r.scope = 'ip' THEN a.ip = r.target
      ELSE {_in_net('a.ip', 'CASE WHEN r.scope = \'subnet\' THEN r.target ELSE \'0.0.0.0/0\' END')} END)"""


@query(
    "match_rules",
    with_views("anom rul", "SELECT id AS anomaly_id, rule_id FROM rmatch", "gate AS (SELECT * FROM anom)", _RMATCH),
)
def _match_rules(t: Tables):
    return notifications.match_rules(t.anomalies, t.rules).select(F.col("id").alias("anomaly_id"), "rule_id")


@query(
    "route_notifications",
    with_views(
        "anom rul",
        """SELECT id AS anomaly_id, CAST(0 AS BIGINT) AS rule_id, 'all' AS channel, 'suppressed' AS status,
  CASE WHEN status = 'silenced' THEN 'silenced by policy' WHEN type = 'TRAFFIC_SPIKE' THEN 'alert type is suppressed' ELSE 'source is outside the notification networks' END AS error_message,
  created_at AS dispatched_at FROM anom WHERE status = 'silenced' OR type = 'TRAFFIC_SPIKE' OR ip LIKE '192.168.12.%'
UNION ALL SELECT id, rule_id, 'all', 'deduplicated', 'held back by rule cooldown', created_at FROM lim WHERE NOT first_one
UNION ALL SELECT id, rule_id, ch, CASE WHEN ch IN ('slack', 'webhook') THEN 'dispatch' ELSE 'failed' END, CASE WHEN ch IN ('slack', 'webhook') THEN '' ELSE 'channel is not configured' END, created_at
FROM (SELECT id, rule_id, unnest(channel_targets) AS ch, created_at FROM rmatch WHERE NOT (cooldown_seconds > 0 AND (list_contains(channel_targets, 'slack') OR list_contains(channel_targets, 'webhook')))
  UNION ALL SELECT id, rule_id, unnest(channel_targets), created_at FROM lim WHERE first_one) g""",
        "gate AS (SELECT * FROM anom WHERE NOT (status = 'silenced' OR type = 'TRAFFIC_SPIKE' OR ip LIKE '192.168.12.%'))",
        _RMATCH,
        "cooled AS (SELECT * FROM rmatch WHERE cooldown_seconds > 0 AND (list_contains(channel_targets, 'slack') OR list_contains(channel_targets, 'webhook')))",
        *_greedy(
            "rule_id, ip, type",
            "slots AS (SELECT rule_id, ip, type, cooldown_seconds, epoch_us(created_at) AS us, min(id) AS first_id FROM cooled GROUP BY ALL)",
            "CAST(a.cooldown_seconds AS BIGINT) * 1000000 + 1",
        ),
        """lim AS (SELECT c.*, k.first_id IS NOT NULL AS first_one FROM cooled c LEFT JOIN
  (SELECT s.rule_id, s.first_id FROM chain h JOIN slots s ON h.rule_id = s.rule_id AND h.ip = s.ip AND h.type = s.type AND h.us = s.us) k
  ON c.rule_id = k.rule_id AND c.id = k.first_id)""",
    ),
)
def _route(t: Tables):
    planned = notifications.route_notifications(
        t.anomalies, t.rules, CONFIGURED, suppressed_types=["traffic_spike"],
        allowed_cidrs=["192.168.0.0/21", "192.168.8.0/22", "192.168.13.0/24", "192.168.14.0/23", "192.168.16.0/20"],
    )
    # rows without a rule print as rule 0
    return planned.fillna(0, ["rule_id"])


@query(
    "recent_notifications",
    with_views(
        "anom nlog",
        f"""SELECT count(*) AS recent FROM nlog n JOIN anom a ON n.anomaly_id = a.id WHERE n.rule_id = 1 AND n.status = 'sent' AND a.ip = '{DEVICE}'
  AND a.type = 'BEACONING' AND n.dispatched_at >= TIMESTAMP '2024-01-05 00:00:00'""",
    ),
)
def _recent_notifications(t: Tables):
    return notifications.recent_notifications(t.logs, t.anomalies, 1, DEVICE, "BEACONING", "2024-01-05 00:00:00")


@query(
    "list_notification_logs",
    with_views("nlog", "SELECT * FROM nlog ORDER BY dispatched_at DESC, anomaly_id, rule_id, channel LIMIT 50"),
)
def _logs(t: Tables):
    return notifications.list_notification_logs(t.logs)


@query(
    "notification_message",
    with_views(
        "anom dev",
        """SELECT a.id, concat('Alert ', type, ' (', severity, ')', chr(10), 'Device: ',
  CASE WHEN coalesce(nullif(label, ''), nullif(hostname, '')) IS NULL THEN a.ip ELSE concat(coalesce(nullif(label, ''), hostname), ' (', a.ip, ')') END,
  chr(10), 'Time: ', strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'), chr(10), description) AS text,
  concat('{"id":', a.id, ',"ip":"', a.ip, '","destination_ip":"', destination_ip, '","type":"', type, '","description":"', description, '","severity":"', severity,
    '","status":"', status, '","created_at":"', strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'), '"}') AS payload
FROM anom a LEFT JOIN dev d ON a.ip = d.ip""",
    ),
)
def _messages(t: Tables):
    return notifications.notification_message(t.anomalies, t.devices)


@query(
    "label_rejects",
    with_views("dev llog", "SELECT ip, label, changed_at, 'not an address' AS reject_reason FROM llog WHERE ip = 'nowhere'"),
)
def _label_rejects(t: Tables):
    return devices.apply_labels(t.devices, t.label_log)[1].select("ip", "label", "changed_at", "reject_reason")


# --- rules and policies as sent in -----------------------------------------------------------------------------------

_RULES_IN = r"""parsed AS (SELECT *, CASE WHEN channels IS NULL OR trim(channels) IN ('', 'null') THEN [] ELSE json_extract_string(channels, '$[*]') END AS ch FROM rlog),
filled AS (SELECT id, name, CASE WHEN coalesce(scope, '') = '' THEN 'global' ELSE scope END AS scope, coalesce(target, '') AS target,
    CASE WHEN coalesce(severity_min, '') = '' THEN 'low' ELSE severity_min END AS severity_min,
    greatest(coalesce(cooldown_seconds, 0), 0) AS cooldown_seconds, enabled, ch, split_part(coalesce(target, ''), '/', 1) AS host,
    TRY_CAST(split_part(coalesce(target, ''), '/', 2) AS INT) AS bits FROM parsed),
judged AS (SELECT id, name, scope, CASE WHEN scope = 'global' THEN '' ELSE target END AS target, severity_min, cooldown_seconds, enabled,
    CAST(len(ch) AS INT) AS n_channels, array_to_string(ch, ',') AS channels,
    CASE WHEN coalesce(name, '') = '' THEN 'name is empty' WHEN lower(severity_min) NOT IN ('low', 'medium', 'high') THEN 'unknown severity'
      WHEN len(ch) = 0 THEN 'no channel'
      WHEN len(list_filter(ch, lambda c: coalesce(lower(c) IN ('webhook', 'slack', 'telegram'), false))) < len(ch) THEN 'unknown channel'
      WHEN scope = 'ip' AND NOT regexp_full_match(target, '([0-9]{1,3}\.){3}[0-9]{1,3}|[0-9a-f]{1,4}::[0-9a-f]{1,4}') THEN 'target is not an address'
      WHEN scope = 'subnet' AND coalesce(bits > CASE WHEN contains(host, ':') THEN 128 ELSE 32 END, true) THEN 'target is not a network'
      WHEN scope NOT IN ('global', 'ip', 'subnet') THEN 'unknown scope' END AS reject_reason FROM filled)"""


def _rules_in(t: Tables):
    return t.rule_log.withColumn("channel_targets", codec.json_list(F.col("channels"))).drop("channels")


def _rule_row(df):
    return df.withColumn("n_channels", F.size("channel_targets")).withColumn("channels", F.array_join("channel_targets", ",")).drop("channel_targets")


@query("json_list", with_views("rlog", "SELECT id, CAST(len(ch) AS INT) AS n, ch[1] AS first, array_to_string(ch, ',') AS entries FROM parsed", _RULES_IN))
def _json_list(t: Tables):
    entries = F.col("channel_targets")
    return _rules_in(t).select("id", F.size(entries).alias("n"), F.get(entries, 0).alias("first"), F.array_join(entries, ",").alias("entries"))


@query("validate_rules", with_views("rlog", "SELECT * FROM judged", _RULES_IN))
def _validate_rules(t: Tables):
    """Valid rules and rejects together; a valid rule has no reason."""
    valid, rejects = notifications.validate_rules(_rules_in(t))
    return _rule_row(valid.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects))


@query(
    "list_rules",
    with_views(
        "rlog",
        "SELECT id, name, scope, target, severity_min, cooldown_seconds, enabled, n_channels, channels FROM judged WHERE reject_reason IS NULL ORDER BY name, id",
        _RULES_IN,
    ),
)
def _list_rules(t: Tables):
    return _rule_row(notifications.list_rules(notifications.validate_rules(_rules_in(t))[0]))


@query(
    "list_policies",
    with_views("plog", "SELECT id, name, scope, target, severity_threshold, suppressed, cooldown_seconds FROM plog WHERE op <> 'delete' ORDER BY scope, name, id"),
)
def _list_policies(t: Tables):
    """All policies ever sent in, as the page lists them."""
    kept = t.policy_log.filter("op <> 'delete'")
    return policies.list_policies(kept).select("id", "name", "scope", "target", "severity_threshold", "suppressed", "cooldown_seconds")
