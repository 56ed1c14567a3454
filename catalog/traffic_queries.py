"""Ingest, rollup, traffic views, lists and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import DEVICE, END, LOCAL, NOW, START, Tables, with_views
from tidewire.functions import codec, ip, labels
from tidewire.operators import baseline, devices, rollup, siem, traffic
from tidewire.sources import flows as flow_src
from tidewire.sources import ids, packets, store, syslog

SUMS = "CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(flows) AS BIGINT) AS flows"
RANGE = f"bucket_ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
LOCAL_SRC = "src_ip LIKE '192.168.%'"
V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def aggregates(t: Tables):
    return rollup.minute_rollup(t.flows)


def daily(t: Tables):
    return rollup.minute_rollup(t.flows, seconds=86400)


# --- ingest -------------------------------------------------------------------------------------


@query(
    "normalize_flows",
    with_views(
        "dec",
        """SELECT event_id, make_timestamp(CAST(CASE WHEN flow_start > 0 THEN flow_start ELSE received END AS BIGINT) * 1000000) AS event_ts,
  src_ip, dst_ip, dst_port, protocol, bytes, packets,
  CASE WHEN lower(trim(collector_kind)) IN ('netflow','sflow','pcap') THEN lower(trim(collector_kind)) ELSE 'unknown' END AS collector_kind,
  coalesce(nullif(trim(collector_id), ''), nullif(trim(exporter_ip), ''),
    CASE WHEN lower(trim(collector_kind)) IN ('netflow','sflow','pcap') THEN lower(trim(collector_kind)) ELSE 'unknown' END) AS collector_id,
  exporter_ip
FROM dec WHERE coalesce(src_ip, '') <> '' AND coalesce(dst_ip, '') <> ''""",
    ),
)
def _normalize(t: Tables):
    # the decoded table still has its own event time; the operator derives it
    return flow_src.normalize_flows(t.decoded.drop("event_ts"))


@query(
    "exporter_registry",
    with_views("f", "SELECT exporter_ip, max(event_ts) AS last_seen, count(*) AS records FROM f GROUP BY exporter_ip"),
)
def _exporters(t: Tables):
    return flow_src.exporter_registry(t.flows)


_QUALITY = """count(*) AS received,
  count(*) FILTER (NOT (coalesce(src_ip, '') <> '' AND coalesce(dst_ip, '') <> '')) AS rejected,
  count(*) FILTER (protocol = 1) AS decode_errors"""


@query(
    "ingest_quality",
    with_views("dec", f"SELECT collector_kind, collector_id, {_QUALITY} FROM dec GROUP BY ALL"),
)
def _quality(t: Tables):
    return flow_src.ingest_quality(t.decoded, decode_error="protocol = 1")


_SERIES = f"""ser AS (SELECT make_timestamp((epoch_us(event_ts) // 15000000) * 15000000) AS sample_ts, {_QUALITY}
  FROM dec GROUP BY ALL)"""


@query("ingest_quality_series", with_views("dec", "SELECT * FROM ser ORDER BY sample_ts", _SERIES))
def _quality_series(t: Tables):
    return flow_src.ingest_quality_series(t.decoded, decode_error="protocol = 1")


@query(
    "ingest_loss",
    with_views(
        "dec",
        """SELECT sample_ts, CASE WHEN received > 0 THEN rejected * 100.0 / received ELSE 0 END::DOUBLE AS drop_percent,
  CASE WHEN received > 0 THEN decode_errors * 100.0 / received ELSE 0 END::DOUBLE AS error_percent
FROM ser ORDER BY sample_ts DESC LIMIT 1""",
        _SERIES,
    ),
)
def _loss(t: Tables):
    return flow_src.ingest_loss(flow_src.ingest_quality_series(t.decoded, decode_error="protocol = 1"))


@query(
    "tcp_flags_from_bits",
    with_views(
        "f",
        """SELECT event_id, CAST((k % 2) + 2 * (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) + 16 * (CASE WHEN k % 5 > 1 THEN 1 ELSE 0 END)
  + 128 * (CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END) AS INT) AS flags FROM f""",
    ),
)
def _flags(t: Tables):
    bits = {
        "fin": F.expr("k % 2 = 1"),
        "syn": F.expr("k % 3 = 0"),
        "ack": F.expr("k % 5 > 1"),
        "cwr": F.expr("user_id % 4 = 0"),
    }
    return t.flows.select("event_id", labels.tcp_flags_from_bits(bits).cast("int").alias("flags"))


_PACKET_SLOTS = """slots AS (SELECT src_ip, dst_ip, src_port, dst_port, protocol, epoch_us(event_ts) // 1000000 AS slot,
    CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS packets, bit_or(CAST(tcp_flags AS INT)) AS tcp_flags,
    min(epoch_us(event_ts)) AS first_us, max(epoch_us(event_ts)) AS last_us
  FROM pk WHERE protocol IN (6, 17) GROUP BY ALL)"""
_TUPLE = "src_ip, dst_ip, src_port, dst_port, protocol"


@query(
    "packets_to_flows",
    with_views(
        "pk",
        f"""SELECT make_timestamp(min(first_us)) AS event_ts, {_TUPLE}, CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(sum(packets) AS BIGINT) AS packets, bit_or(tcp_flags) AS tcp_flags, make_timestamp(max(last_us)) AS last_ts
FROM walk GROUP BY {_TUPLE}, start_us""",
        _PACKET_SLOTS,
        f"""num AS (SELECT *, row_number() OVER (PARTITION BY {_TUPLE} ORDER BY slot) AS rn,
    lag(last_us) OVER (PARTITION BY {_TUPLE} ORDER BY slot) AS prev_us FROM slots)""",
        # one step per slot row: keep the flow's start, or begin a new flow
        f"""walk AS (SELECT *, first_us AS start_us FROM num WHERE rn = 1
  UNION ALL
  SELECT n.*, CASE WHEN n.slot * 1000000 - n.prev_us >= 15000000 OR n.slot * 1000000 - w.start_us >= 30000000
      THEN n.first_us ELSE w.start_us END
  FROM walk w JOIN num n ON n.rn = w.rn + 1 AND n.src_ip = w.src_ip AND n.dst_ip = w.dst_ip
    AND n.src_port = w.src_port AND n.dst_port = w.dst_port AND n.protocol = w.protocol)""",
    ),
)
def _packets(t: Tables):
    found = packets.packets_to_flows(t.packets)
    return found.withColumn("tcp_flags", F.col("tcp_flags").cast("int")).drop(
        "collector_kind", "collector_id", "exporter_ip"
    )


_EVE = """al AS (SELECT CASE WHEN d LIKE '192.168.%' THEN d WHEN s LIKE '192.168.%' THEN s END AS ip, *
  FROM (SELECT json_extract_string(value, '$.src_ip') AS s, json_extract_string(value, '$.dest_ip') AS d,
      CAST(json_extract_string(value, '$.alert.signature_id') AS BIGINT) AS signature_id,
      json_extract_string(value, '$.alert.signature') AS sig, json_extract_string(value, '$.alert.category') AS cat,
      CAST(json_extract_string(value, '$.alert.severity') AS INT) AS sev,
      CAST(left(json_extract_string(value, '$.timestamp'), 19) AS TIMESTAMP) AS created_at
    FROM eve WHERE json_valid(value) AND json_extract_string(value, '$.event_type') = 'alert') x)"""


@query(
    "ids_alerts",
    with_views(
        "eve",
        """SELECT ip, '' AS destination_ip, 'SURICATA_ALERT' AS type,
  concat('IDS Alert: ', sig, ' (Category: ', cat, ', Signature ID: ', signature_id, ')') AS description,
  CASE sev WHEN 1 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END AS severity, 'active' AS status, created_at, signature_id
FROM al WHERE ip IS NOT NULL""",
        _EVE,
    ),
)
def _ids(t: Tables):
    return ids.ids_alerts(t.eve.select("value"), LOCAL)


# The checking SQL reads the lines with its own, simpler patterns: the view only
# writes well-formed stamps, so field order is all that has to be found.
_SYSLOG = r"""ln AS (SELECT *, TRY_CAST(regexp_extract(value, '^<([0-9]{1,3})>', 1) AS INT) AS pri,
    regexp_replace(value, '^<[0-9]+>', '') AS rest FROM sysl),
 ok AS (SELECT *, string_split(rest, ' ') AS w, rest LIKE '1 %' AS modern FROM ln WHERE pri BETWEEN 0 AND 191),
 old AS (SELECT event_id, regexp_extract(rest, '^.{15} ([^ ]+) ', 1) AS host, regexp_replace(rest, '^.{15} [^ ]+ ', '') AS body FROM ok WHERE NOT modern),
 parsed AS (
  SELECT event_id, sender_ip, CASE WHEN w[2] LIKE '%Z' THEN CAST(left(w[2], 19) AS TIMESTAMP)
      ELSE CAST(left(w[2], 22) AS TIMESTAMP) - INTERVAL 2 HOUR END AS timestamp,
    CASE WHEN w[3] = '-' THEN '' ELSE w[3] END AS host, CASE WHEN w[4] = '-' THEN '' ELSE w[4] END AS app_name,
    CASE WHEN w[5] = '-' THEN '' ELSE w[5] END AS proc_id, CASE WHEN w[6] = '-' THEN '' ELSE w[6] END AS msg_id,
    pri // 8 AS facility, pri % 8 AS severity,
    regexp_replace(regexp_replace(rest, '^1 [^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+ ', ''), '^(- |\[[^\]]*\] )', '') AS message
  FROM ok WHERE modern
  UNION ALL
  SELECT ok.event_id, sender_ip,
    CAST(concat('2024-01-', lpad(trim(substr(rest, 5, 2)), 2, '0'), ' ', substr(rest, 8, 8)) AS TIMESTAMP) AS timestamp,
    old.host, CASE WHEN body LIKE 'kernel: %' THEN 'kernel' WHEN body LIKE 'daemon[%' THEN 'daemon' ELSE '' END AS app_name,
    regexp_extract(body, '^daemon\[([0-9]+)\]', 1) AS proc_id, '' AS msg_id, pri // 8, pri % 8,
    regexp_replace(body, '^(kernel: |daemon\[[0-9]+\]: )', '') AS message
  FROM ok JOIN old USING (event_id) WHERE NOT modern),
 cat AS (SELECT *, lower(message) AS m, CASE
    WHEN contains(lower(message), 'netconsole') THEN 'Netconsole'
    WHEN regexp_matches(lower(message), 'security detection|ips|ids|threat|blocked') THEN 'Security Detections'
    WHEN regexp_matches(lower(message), 'admin|login') THEN 'Admin Activity'
    WHEN contains(lower(message), 'vpn') THEN 'VPN'
    WHEN regexp_matches(lower(message), 'update|upgrade') THEN 'Updates'
    WHEN contains(lower(message), 'critical') OR severity <= 2 THEN 'Critical'
    WHEN contains(lower(message), 'device') THEN 'Devices'
    WHEN contains(lower(message), 'client') THEN 'Clients'
    WHEN contains(lower(message), 'trigger') THEN 'Triggers' ELSE 'Other' END AS category FROM parsed),
 siem AS (SELECT event_id, timestamp, CASE WHEN host = '' THEN sender_ip ELSE host END AS source_gateway, category,
    CASE WHEN category = 'Security Detections' THEN CASE WHEN severity <= 3 THEN 'critical' ELSE 'high' END
      WHEN severity <= 2 THEN 'critical' WHEN severity = 3 THEN 'high' WHEN severity = 4 THEN 'medium' ELSE 'low' END AS severity,
    regexp_extract(message, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS client_ip, message AS summary, sender_ip FROM cat)"""


def _siem(t: Tables):
    parsed, _ = syslog.parse_syslog(t.syslog, NOW)
    return syslog.siem_events(parsed)


@query("syslog_parse", with_views("sysl", "SELECT * FROM parsed", _SYSLOG))
def _syslog_parse(t: Tables):
    return syslog.parse_syslog(t.syslog, NOW)[0]


@query(
    "syslog_rejects",
    with_views(
        "sysl",
        r"""SELECT event_id, CASE WHEN value NOT LIKE '<%' THEN 'priority missing' ELSE 'invalid priority value' END AS reject_reason
FROM sysl WHERE NOT coalesce(TRY_CAST(regexp_extract(value, '^<([0-9]{1,3})>', 1) AS INT) BETWEEN 0 AND 191, false)""",
    ),
)
def _syslog_rejects(t: Tables):
    return syslog.parse_syslog(t.syslog, NOW)[1].select("event_id", "reject_reason")


@query(
    "siem_events",
    with_views("sysl", "SELECT timestamp, source_gateway, category, severity, client_ip, summary, sender_ip FROM siem", _SYSLOG),
)
def _siem_events(t: Tables):
    return _siem(t).drop("attributes")


@query(
    "syslog_category",
    with_views("sysl", "SELECT category, severity, count(*) AS events FROM siem GROUP BY ALL", _SYSLOG),
)
def _categories(t: Tables):
    return _siem(t).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("events"))


@query(
    "siem_anomalies",
    with_views(
        "sysl",
        """SELECT CASE WHEN client_ip = '' THEN sender_ip ELSE client_ip END AS ip, '' AS destination_ip,
  CASE WHEN category = 'Security Detections' THEN 'UNIFI_SECURITY' ELSE 'UNIFI_CRITICAL' END AS type,
  summary AS description, severity, 'active' AS status, timestamp AS created_at
FROM siem WHERE category = 'Security Detections' OR severity = 'critical'""",
        _SYSLOG,
    ),
)
def _siem_anomalies(t: Tables):
    return syslog.siem_anomalies(_siem(t))


@query(
    "siem_events_for_ip",
    with_views(
        "sysl",
        f"""SELECT timestamp, source_gateway, category, severity, client_ip, summary, sender_ip FROM siem
WHERE client_ip = '{DEVICE}' ORDER BY timestamp DESC, source_gateway, client_ip, summary LIMIT 50""",
        _SYSLOG,
    ),
)
def _siem_for_ip(t: Tables):
    return siem.siem_events_for_ip(_siem(t), DEVICE).drop("attributes")


@query(
    "list_siem_events",
    with_views(
        "sysl",
        """SELECT timestamp, source_gateway, category, severity, client_ip, summary, sender_ip FROM siem
ORDER BY timestamp DESC, source_gateway, client_ip, summary LIMIT 50""",
        _SYSLOG,
    ),
)
def _list_siem(t: Tables):
    return siem.list_siem_events(_siem(t)).drop("attributes")


@query(
    "filter_allowed_senders",
    with_views("sysl", "SELECT event_id, sender_ip FROM sysl WHERE sender_ip IN ('10.254.0.0','10.254.0.1','10.254.0.4')"),
)
def _senders(t: Tables):
    rows = syslog.filter_allowed_senders(t.syslog, ["10.254.0.0/31", "10.254.0.4"])
    return rows.select("event_id", "sender_ip")


@query(
    "first_ip",
    rf"""SELECT doc_id, coalesce(list_filter(list_transform(
    regexp_extract_all(text, '(?:[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}})|(?:[0-9a-fA-F]{{1,4}}:[0-9a-fA-F:]+)|(?:::[0-9a-fA-F:]+)'),
    lambda x: trim(x, '.:')), lambda x: regexp_matches(x, '{V4}')
      OR regexp_matches(x, '^([0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}$')
      OR (regexp_matches(x, '^([0-9a-fA-F]{{1,4}}(:[0-9a-fA-F]{{1,4}})*)?::([0-9a-fA-F]{{1,4}}(:[0-9a-fA-F]{{1,4}})*)?$')
          AND len(list_filter(string_split(x, ':'), lambda g: g <> '')) <= 7))[1], '') AS ip
FROM documents""",
)
def _first_ip(t: Tables):
    return t.table("documents").select("doc_id", syslog.first_ip(F.col("text")).alias("ip"))


@query("json_codec", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _json(t: Tables):
    return t.table("events").select("event_id", F.try_element_at(codec.json_map(F.col("props")), F.lit("k")).alias("k"))


@query(
    "apply_retention",
    with_views("agg", "SELECT * FROM agg WHERE bucket_ts >= TIMESTAMP '2024-01-24 00:00:00'"),
)
def _retention(t: Tables):
    return store.apply_retention(aggregates(t), NOW, 7).drop("bucket_date")


@query(
    "upgrade_aggregates",
    with_views(
        "agg",
        """SELECT bucket_ts, collector_kind, collector_id, src_ip, dst_ip, dst_port, protocol, bytes, packets, flows FROM agg WHERE bucket_ts >= TIMESTAMP '2024-01-15'
UNION ALL SELECT bucket_ts, 'unknown', 'unknown', src_ip, dst_ip, dst_port, protocol, bytes, packets, flows FROM agg WHERE bucket_ts < TIMESTAMP '2024-01-15'""",
    ),
)
def _upgrade(t: Tables):
    rows = aggregates(t).drop("tcp_flags", "bucket_date")
    old = rows.filter("bucket_ts < TIMESTAMP '2024-01-15 00:00:00'").drop("collector_kind", "collector_id")
    return store.upgrade_aggregates(old, rows.filter("bucket_ts >= TIMESTAMP '2024-01-15 00:00:00'"))


@query(
    "merge_aggregate_deltas",
    with_views("agg", "SELECT bucket_ts, collector_kind, collector_id, src_ip, dst_ip, dst_port, protocol, bytes, packets, flows FROM agg"),
)
def _merge_deltas(t: Tables):
    """Two partial rollups of the same minutes add up to the whole one."""
    rows = t.flows
    parts = [rollup.minute_rollup(rows.filter(F.col("event_type").isin("error", "view"))),
             rollup.minute_rollup(rows.filter(~F.col("event_type").isin("error", "view")))]
    return store.merge_key(parts[0].unionByName(parts[1])).drop("bucket_date")


# --- rollup and ranked views ------------------------------------------------------------------------


@query("minute_rollup", with_views("agg", "SELECT * FROM agg"))
def _rollup(t: Tables):
    return aggregates(t).drop("bucket_date")


def _top_sql(expr: str) -> str:
    return with_views(
        "agg",
        f"SELECT {expr} AS key, {SUMS} FROM agg WHERE {RANGE} GROUP BY 1 ORDER BY bytes DESC, key LIMIT 10",
    )


@query("top_sources", _top_sql("src_ip"))
def _top_sources(t: Tables):
    return traffic.top_sources(aggregates(t), START, END)


@query("top_destinations", _top_sql("dst_ip"))
def _top_destinations(t: Tables):
    return traffic.top_destinations(aggregates(t), START, END)


@query("top_ports", _top_sql("CAST(dst_port AS VARCHAR)"))
def _top_ports(t: Tables):
    return traffic.top_ports(aggregates(t), START, END)


@query("top_protocols", _top_sql("CAST(protocol AS VARCHAR)"))
def _top_protocols(t: Tables):
    return traffic.top_protocols(aggregates(t), START, END)


_BOTH = "both_sides AS (SELECT src_ip AS ip, * FROM agg UNION ALL SELECT dst_ip AS ip, * FROM agg)"
_VOLUMES = f"""vol AS (SELECT ip AS key, {SUMS} FROM both_sides WHERE {RANGE} AND ip IN (SELECT ip FROM dev) GROUP BY ip)"""
_TOPDEV = "topdev AS (SELECT * FROM vol ORDER BY bytes DESC, key LIMIT 20)"
_HEAT = f"""heat AS (SELECT ip, CAST(hour(bucket_ts) AS INT) AS hour, {SUMS} FROM both_sides WHERE {RANGE}
  AND ip IN (SELECT key FROM topdev) GROUP BY ALL)"""


@query(
    "top_devices_by_volume",
    with_views("agg dev", "SELECT * FROM vol ORDER BY bytes DESC, key LIMIT 10", _BOTH, _VOLUMES),
)
def _top_devices(t: Tables):
    return traffic.top_devices_by_volume(aggregates(t), t.devices, START, END)


@query("activity_heatmap", with_views("agg dev", "SELECT * FROM heat", _BOTH, _VOLUMES, _TOPDEV, _HEAT))
def _heatmap(t: Tables):
    return traffic.activity_heatmap(aggregates(t), t.devices, START, END, 20)


@query(
    "subnet_activity",
    with_views(
        "agg dev",
        "SELECT concat(split_part(ip,'.',1),'.',split_part(ip,'.',2),'.',split_part(ip,'.',3),'.0/24') AS subnet, "
        + ", ".join(f"CAST(coalesce(sum(bytes) FILTER (hour = {h}), 0) AS BIGINT) AS h{h:02d}" for h in range(24))
        + " FROM heat GROUP BY 1",
        _BOTH, f"heat AS (SELECT ip, hour(bucket_ts) AS hour, {SUMS} FROM both_sides WHERE {RANGE} GROUP BY ALL)",
    ),
)
def _subnet_activity(t: Tables):
    return traffic.subnet_activity(traffic.activity_cells(aggregates(t), START, END))


_PEERS = "peers AS (SELECT src_ip AS ip, dst_ip AS key, bytes, packets, flows, bucket_ts FROM agg UNION ALL SELECT dst_ip, src_ip, bytes, packets, flows, bucket_ts FROM agg)"


@query(
    "device_top_peers",
    with_views("agg", f"SELECT key, {SUMS} FROM peers WHERE {RANGE} AND ip = '{DEVICE}' GROUP BY key ORDER BY bytes DESC, key LIMIT 10", _PEERS),
)
def _device_peers(t: Tables):
    return traffic.device_top_peers(aggregates(t), DEVICE, START, END)


@query(
    "device_top_ports",
    with_views(
        "agg",
        f"SELECT CAST(dst_port AS VARCHAR) AS key, {SUMS} FROM agg WHERE {RANGE} AND (src_ip = '{DEVICE}' OR dst_ip = '{DEVICE}') GROUP BY 1 ORDER BY bytes DESC, key LIMIT 10",
    ),
)
def _device_ports(t: Tables):
    return traffic.device_top_ports(aggregates(t), DEVICE, START, END)


def _rank_sql(source: str) -> str:
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ip ORDER BY bytes DESC, key) AS INT) AS rank
  FROM (SELECT ip, key, {SUMS} FROM {source} WHERE {RANGE} GROUP BY ip, key) g) r WHERE rank <= 5"""


@query("all_device_top_peers", with_views("agg", _rank_sql("peers"), _PEERS))
def _all_peers(t: Tables):
    return traffic.all_device_top_peers(aggregates(t), START, END, 5)


@query(
    "all_device_top_ports",
    with_views(
        "agg",
        _rank_sql("ports"),
        """ports AS (SELECT src_ip AS ip, CAST(dst_port AS VARCHAR) AS key, bytes, packets, flows, bucket_ts FROM agg
  UNION ALL SELECT dst_ip, CAST(dst_port AS VARCHAR), bytes, packets, flows, bucket_ts FROM agg WHERE dst_ip <> src_ip)""",
    ),
)
def _all_ports(t: Tables):
    return traffic.all_device_top_ports(aggregates(t), START, END, 5)


def _series_sql(where: str, seconds: int) -> str:
    return f"ts_series AS (SELECT make_timestamp((epoch_us(bucket_ts) // {seconds}000000) * {seconds}000000) AS timestamp, {SUMS} FROM agg WHERE {RANGE} AND {where} GROUP BY 1)"


@query("traffic_timeseries", with_views("agg", "SELECT * FROM ts_series", _series_sql("true", 3600)))
def _timeseries(t: Tables):
    return traffic.traffic_timeseries(aggregates(t), START, END, 3600)


@query(
    "device_timeseries",
    with_views("agg", "SELECT * FROM ts_series", _series_sql(f"(src_ip = '{DEVICE}' OR dst_ip = '{DEVICE}')", 300)),
)
def _device_series(t: Tables):
    return traffic.device_timeseries(aggregates(t), DEVICE, START, END, 300)


@query(
    "rates",
    with_views(
        "agg",
        "SELECT timestamp, round(bytes / 3600.0, 4)::DOUBLE AS bytes_per_second, round(packets / 3600.0, 4)::DOUBLE AS packets_per_second, round(flows / 3600.0, 4)::DOUBLE AS flows_per_second FROM ts_series",
        _series_sql("true", 3600),
    ),
)
def _rates(t: Tables):
    found = traffic.rates(traffic.traffic_timeseries(aggregates(t), START, END, 3600), 3600)
    return found.select("timestamp", *[F.round(c, 4).alias(c) for c in found.columns[1:]])


@query("window_totals", with_views("agg", f"SELECT {SUMS} FROM ts_series", _series_sql("true", 3600)))
def _totals(t: Tables):
    return traffic.window_totals(traffic.traffic_timeseries(aggregates(t), START, END, 3600))


@query(
    "share",
    with_views(
        "agg",
        f"""SELECT key, bytes, packets, flows, protocol_label, round(bytes * 100.0 / (SELECT sum(bytes) FROM pt), 4)::DOUBLE AS percent
FROM (SELECT *, CASE key WHEN '1' THEN 'ICMP' WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' ELSE 'other' END AS protocol_label FROM pt) p""",
        f"pt AS (SELECT CAST(protocol AS VARCHAR) AS key, {SUMS} FROM agg WHERE {RANGE} GROUP BY 1)",
    ),
)
def _share(t: Tables):
    found = traffic.share(traffic.totals_by(aggregates(t), "protocol", START, END))
    return found.withColumn("percent", F.round("percent", 4)).withColumn(
        "protocol_label", labels.protocol_name(F.col("key"))
    )


@query(
    "search_top",
    with_views(
        "agg",
        "SELECT key, bytes, packets, flows, round(bytes * 100.0 / (SELECT max(bytes) FROM hit), 4)::DOUBLE AS percent FROM hit",
        f"tt AS (SELECT src_ip AS key, {SUMS} FROM agg WHERE {RANGE} GROUP BY 1)",
        "hit AS (SELECT * FROM tt WHERE contains(key, '168.10.1'))",
    ),
)
def _search_top(t: Tables):
    found = traffic.search_top(traffic.totals_by(aggregates(t), "src_ip", START, END), "168.10.1")
    return found.withColumn("percent", F.round("percent", 4))


@query(
    "search_flows",
    with_views(
        "agg",
        f"""SELECT * EXCLUDE (tcp_flags) FROM agg WHERE {RANGE} AND (src_ip LIKE '%192.168%1%' OR dst_ip LIKE '%192.168%1%')
  AND (src_ip LIKE '%203.%' OR dst_ip LIKE '%203.%') AND protocol = 6
ORDER BY bucket_ts DESC, bytes DESC, src_ip, dst_ip, dst_port, protocol, collector_kind, collector_id LIMIT 500""",
    ),
)
def _search(t: Tables):
    found = traffic.search_flows(aggregates(t), START, END, "192.168%1 203.", protocol=6, limit=500)
    return found.drop("tcp_flags", "bucket_date")


@query("distinct_collectors", with_views("agg", "SELECT DISTINCT collector_id FROM agg"))
def _collectors(t: Tables):
    return traffic.distinct_collectors(aggregates(t))


@query(
    "filter_by_collector",
    with_views("agg", "SELECT * EXCLUDE (tcp_flags) FROM agg WHERE collector_id = 'pcap:eth0'"),
)
def _by_collector(t: Tables):
    return traffic.filter_by_collector(aggregates(t), "pcap:eth0").drop("tcp_flags", "bucket_date")


@query(
    "service_profile",
    with_views(
        "agg",
        f"""SELECT service, protocol_label, subnet, {SUMS} FROM (SELECT *,
    CASE WHEN dst_port = 53 THEN 'dns' WHEN dst_port IN (80,443,8080,8443) THEN 'web' WHEN dst_port IN (22,23,3389,5900) THEN 'remote-admin'
      WHEN dst_port IN (25,110,143,465,587,993,995) THEN 'mail' WHEN dst_port IN (139,445,2049) THEN 'file-sharing'
      WHEN dst_port IN (1433,1521,3306,5432,6379,27017) THEN 'database' WHEN dst_port BETWEEN 1 AND 1023 THEN 'other-system' ELSE 'high-port' END AS service,
    CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'other' END AS protocol_label,
    CASE WHEN dst_ip LIKE '192.168.%' THEN '192.168.0.0/16' ELSE concat(split_part(dst_ip,'.',1),'.',split_part(dst_ip,'.',2),'.',split_part(dst_ip,'.',3),'.0/24') END AS subnet
  FROM agg) x GROUP BY ALL""",
    ),
)
def _services(t: Tables):
    """Port categories, protocol names and subnet labels over all aggregates."""
    return (
        aggregates(t)
        .groupBy(
            labels.service_category(F.col("dst_port")).alias("service"),
            labels.protocol_name(F.col("protocol")).alias("protocol_label"),
            ip.subnet_vlan("dst_ip", LOCAL).alias("subnet"),
        )
        .agg(*[F.sum(c).alias(c) for c in traffic.COUNTERS])
    )


@query(
    "ip_keys",
    rf"""SELECT DISTINCT src_ip AS ip, concat('00000000000000000000ffff', lower(concat(
    lpad(to_hex(CAST(split_part(src_ip,'.',1) AS INT)), 2, '0'), lpad(to_hex(CAST(split_part(src_ip,'.',2) AS INT)), 2, '0'),
    lpad(to_hex(CAST(split_part(src_ip,'.',3) AS INT)), 2, '0'), lpad(to_hex(CAST(split_part(src_ip,'.',4) AS INT)), 2, '0')))) AS digits,
  src_ip LIKE '192.168.%' AS local, true AS unicast
FROM ({with_views("f", "SELECT * FROM f")}) q""",
)
def _ip_keys(t: Tables):
    return t.flows.select(F.col("src_ip").alias("ip")).distinct().select(
        "ip", ip.ip_hex("ip").alias("digits"), ip.is_local("ip", LOCAL).alias("local"), ip.is_unicast("ip").alias("unicast")
    )


# --- baselines and devices -----------------------------------------------------------------------------


_SAMPLES = """samples AS (SELECT src_ip AS ip, date_trunc('day', bucket_ts) AS bucket_ts, CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(sum(packets) AS BIGINT) AS packets, count(DISTINCT dst_ip) AS peers FROM agg GROUP BY 1, 2)"""
BASE_SQL = """basel AS (SELECT ip, avg(bytes) AS mean_bytes, stddev_pop(bytes) AS stddev_bytes, avg(packets) AS mean_packets,
  stddev_pop(packets) AS stddev_packets, avg(peers) AS mean_peers, stddev_pop(peers) AS stddev_peers, count(*) AS samples
  FROM samples WHERE ip IN (SELECT ip FROM dev) GROUP BY ip HAVING count(*) >= 5)"""
BASE_PARTS = (_SAMPLES, BASE_SQL)


def samples(t: Tables):
    return baseline.baseline_samples(aggregates(t), START, END, 86400)


def baselines(t: Tables):
    return baseline.device_baselines(samples(t), t.devices)


def _rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_ROUNDED = "SELECT ip, samples, " + ", ".join(
    f"round({f}_{m}, 4) AS {f}_{m}" for m in ("bytes", "packets", "peers") for f in ("mean", "stddev")
)


@query("baseline_samples", with_views("agg", "SELECT * FROM samples", _SAMPLES))
def _baseline_samples(t: Tables):
    return samples(t)


@query("device_baselines", with_views("agg dev", f"{_ROUNDED} FROM basel", *BASE_PARTS))
def _device_baselines(t: Tables):
    return _rounded(baselines(t))


_MERGED = """oldb AS (SELECT ip, avg(bytes) AS mean_bytes, count(*) AS samples FROM samples WHERE bucket_ts < TIMESTAMP '2024-01-18' GROUP BY ip HAVING count(*) >= 5),
newb AS (SELECT ip, avg(bytes) AS mean_bytes, count(*) AS samples FROM samples WHERE bucket_ts >= TIMESTAMP '2024-01-18' GROUP BY ip HAVING count(*) >= 5)"""


@query(
    "merge_baselines",
    with_views(
        "agg",
        "SELECT ip, round(coalesce(n.mean_bytes, o.mean_bytes), 4) AS mean_bytes, coalesce(n.samples, o.samples) AS samples FROM oldb o FULL JOIN newb n USING (ip)",
        _SAMPLES, _MERGED,
    ),
)
def _merge_baselines(t: Tables):
    cut = F.col("bucket_ts") < F.lit("2024-01-18").cast("timestamp")
    old = baseline.device_baselines(samples(t).filter(cut))
    new = baseline.device_baselines(samples(t).filter(~cut))
    return _rounded(baseline.merge_baselines(old, new).select("ip", "mean_bytes", "samples"))


@query(
    "discover_devices",
    with_views(
        "f dev",
        """SELECT coalesce(o.ip, n.ip) AS ip, coalesce(o.label, '') AS label, coalesce(o.hostname, '') AS hostname, '' AS vendor,
  coalesce(o.first_seen, n.first_seen) AS first_seen, greatest(coalesce(o.last_seen, n.last_seen), coalesce(n.last_seen, o.last_seen)) AS last_seen
FROM (SELECT * FROM dev WHERE first_seen < TIMESTAMP '2024-01-02') o FULL JOIN dev n ON o.ip = n.ip""",
    ),
)
def _discover(t: Tables):
    known = t.devices.filter("first_seen < TIMESTAMP '2024-01-02 00:00:00'")
    return devices.discover_devices(t.flows, known, LOCAL)


@query(
    "reconcile_devices",
    with_views(
        "agg dev",
        f"""SELECT coalesce(d.ip, b.ip) AS ip, coalesce(label, '') AS label, coalesce(hostname, '') AS hostname, '' AS vendor,
  coalesce(first_seen, TIMESTAMP '2024-01-30 23:59:59') AS first_seen, CASE WHEN b.ip IS NULL THEN last_seen ELSE TIMESTAMP '2024-01-30 23:59:59' END AS last_seen
FROM dev d FULL JOIN busy b ON d.ip = b.ip""",
        """busy AS (SELECT DISTINCT ip FROM (
  SELECT src_ip AS ip FROM agg WHERE bucket_ts BETWEEN TIMESTAMP '2024-01-29 23:59:59' AND TIMESTAMP '2024-01-30 23:59:59'
  UNION ALL SELECT dst_ip FROM agg WHERE bucket_ts BETWEEN TIMESTAMP '2024-01-29 23:59:59' AND TIMESTAMP '2024-01-30 23:59:59') u
  WHERE ip LIKE '192.168.%')""",
    ),
)
def _reconcile(t: Tables):
    from datetime import datetime

    return devices.reconcile_devices(aggregates(t), t.devices, LOCAL, datetime(2024, 1, 30, 23, 59, 59))


@query(
    "apply_labels",
    with_views(
        "dev llog",
        """SELECT d.ip, coalesce(l.label, d.label) AS label, hostname, vendor, first_seen, last_seen FROM dev d
LEFT JOIN (SELECT ip, arg_max(label, (changed_at, label)) AS label FROM llog WHERE ip <> 'nowhere' GROUP BY ip) l ON d.ip = l.ip""",
    ),
)
def _labels(t: Tables):
    return devices.apply_labels(t.devices, t.label_log)[0]


@query("list_devices", with_views("dev", "SELECT * FROM dev"))
def _list_devices(t: Tables):
    return devices.list_devices(t.devices)


@query(
    "search_devices",
    with_views(
        "dev",
        "SELECT * FROM dev WHERE (contains(ip,'dev-1') OR contains(hostname,'dev-1') OR contains(label,'dev-1')) AND (contains(ip,'10') OR contains(hostname,'10') OR contains(label,'10')) AND ip LIKE '192.168.10.%'",
    ),
)
def _search_devices(t: Tables):
    return devices.search_devices(t.devices, "DEV-1 10", "192.168.10.0/24")
