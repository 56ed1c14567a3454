from datetime import datetime

from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.sources import flows as flow_src
from tidewire.sources import ids, packets, syslog

NOW = datetime(2026, 7, 12, 10, 0, 0)


def parse(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    ok, bad = syslog.parse_syslog(df, NOW)
    return ok.collect(), bad.collect()


def test_rfc5424(spark):
    ok, bad = parse(
        spark,
        [
            "<30>1 2026-03-01T00:00:00Z edge7 pppd - link - carrier is up",
            '<30>1 2026-03-01T02:30:00.125+02:30 edge7 pppd 881 - [a@1 k="[v]"][b] line speed 100',
            "<30>1 2026-03-01T00:00:00Z edge7 pppd 881 - [open element",
            "<30>1 2026-13-01T00:00:00Z edge7 pppd 881 - - text",
        ],
    )
    first, second = ok
    assert (first.facility, first.severity, first.host) == (3, 6, "edge7")
    assert (first.app_name, first.proc_id, first.msg_id) == ("pppd", "", "link")
    assert (first.timestamp, first.message) == (datetime(2026, 3, 1), "carrier is up")
    assert (second.proc_id, second.message) == ("881", "[b] line speed 100")
    assert second.timestamp == datetime(2026, 3, 1, 0, 0, 0, 125000)
    assert [b.reject_reason for b in bad] == ["empty body", "invalid RFC5424 timestamp"]


def test_rfc3164(spark):
    ok, bad = parse(
        spark,
        [
            "<4>Mar  9 23:59:59 rack-2 ntpd[77]: offset 12 ms",
            "<191>Apr 10 07:08:09 rack-2 plain words",
            "<4>Apr 31 01:00:00 rack-2 ntpd: step",
            "<4>Feb 29 01:00:00 rack-2 ntpd: leap\r\n",
        ],
    )
    tagged, plain, rolled = ok
    assert (tagged.facility, tagged.severity, tagged.host) == (0, 4, "rack-2")
    assert (tagged.app_name, tagged.proc_id, tagged.message) == ("ntpd", "77", "offset 12 ms")
    assert tagged.timestamp == datetime(2026, 3, 9, 23, 59, 59)
    assert (plain.facility, plain.severity, plain.app_name, plain.message) == (23, 7, "", "plain words")
    # 29 February exists in leap years only and rolls over in this one; 31 April never exists
    assert (rolled.timestamp, rolled.message) == (datetime(2026, 3, 1, 1), "leap")
    assert [b.reject_reason for b in bad] == ["invalid RFC3164 timestamp"]


REJECTED = {
    "Mar  9 23:59:59 rack-2 ntpd: x": "priority missing",
    "<192>Mar  9 23:59:59 rack-2 ntpd: x": "invalid priority value",
    "<x>Mar  9 23:59:59 rack-2 ntpd: x": "invalid priority value",
    "<>Mar  9 23:59:59 rack-2 ntpd: x": "invalid priority prefix",
    "<1000>Mar  9 23:59:59 rack-2 ntpd: x": "invalid priority prefix",
    "<4>Mar  9": "message too short",
    "<4>Mar  9 23:59:59 rack-2": "host or message missing",
    "<4>": "no body",
    "": "empty message",
    " \t ": "blank message",
}


def test_syslog_rejects(spark):
    ok, bad = parse(spark, list(REJECTED))
    assert not ok and {b.value: b.reject_reason for b in bad} == REJECTED


def test_long_lines_are_parsed_unless_a_limit_is_given(spark):
    df = spark.createDataFrame([("<4>Mar  9 23:59:59 rack-2 ntpd: " + "y" * 9000,)], "value string")
    assert syslog.parse_syslog(df, NOW)[0].first().message == "y" * 9000
    assert syslog.parse_syslog(df, NOW, max_bytes=8000)[1].first().reject_reason == "message exceeds size limit"


def test_categories_by_keyword_and_order(spark):
    """Every keyword alone names its category; of two, the category listed first wins."""
    listed = [(word, name) for name, words in syslog.CATEGORY_KEYWORDS for word in words]
    cases = [(f"zz {word.upper()} zz", 6, name) for word, name in listed if name not in ("Devices",)]
    cases += [(f"{b[0]} zz {a[0]}", 6, a[1]) for a, b in zip(listed, listed[3:], strict=False)]
    cases += [("zz", 2, "Critical"), ("zz", 3, "Other"), ("a device and a trigger", 6, "Devices")]
    df = spark.createDataFrame([c[:2] for c in cases], "m string, s int")
    got = [r[0] for r in df.select(syslog.syslog_category(F.col("m"), F.col("s"))).collect()]
    order = [name for name, _ in syslog.CATEGORY_KEYWORDS]

    def want(text):
        hits = [name for name, words in syslog.CATEGORY_KEYWORDS if any(w in text.lower() for w in words)]
        return min(hits, key=order.index, default="Other")

    assert got == [want(m) if s > 2 else c for m, s, c in cases]


def test_severity_by_number_and_category(spark):
    rows = [(s, c) for s in range(8) for c in ("Security Detections", "Clients")]
    got = spark.createDataFrame(rows, "s int, c string").select("s", "c", syslog.syslog_severity(F.col("s"), F.col("c")).alias("v")).collect()
    plain = {0: "critical", 1: "critical", 2: "critical", 3: "high", 4: "medium"}
    for r in got:
        assert r.v == (("critical" if r.s <= 3 else "high") if r.c == "Security Detections" else plain.get(r.s, "low"))


def test_first_ip(spark):
    cases = [
        ("lease 10.20.30.40 renewed", "10.20.30.40"),
        ("from=fe80::aa:1, to=10.0.0.1", "fe80::aa:1"),
        ("version 1.2.3 on port 80", ""),
        ("300.1.1.1 is none but 172.20.0.9: is", "172.20.0.9"),
        ("10.1.1.1/24 and 10.1.1.2", "10.1.1.1"),
        ("", ""),
    ]
    df = spark.createDataFrame([(m,) for m, _ in cases], "m string")
    assert [r[0] for r in df.select(syslog.first_ip(F.col("m"))).collect()] == [c for _, c in cases]


def test_siem_events_and_alerts(spark):
    df = spark.createDataFrame(
        [
            ("<131>1 2026-07-12T09:59:58Z - ips - - - threat from 10.0.0.9 blocked", "10.9.9.9"),
            ("<129>Jul 12 09:58:01 gw kernel: out of memory", "10.9.9.9"),
            ("<134>Jul 12 09:58:01 gw app: client joined", "172.99.0.1"),
        ],
        "value string, sender_ip string",
    )
    ok, _ = syslog.parse_syslog(syslog.filter_allowed_senders(df, ["10.9.9.0/24"]), NOW)
    events = syslog.siem_events(ok)
    rows = events.collect()
    assert [(r.source_gateway, r.category, r.severity, r.client_ip) for r in rows] == [
        ("10.9.9.9", "Security Detections", "critical", "10.0.0.9"),
        ("gw", "Critical", "critical", ""),
    ]
    assert rows[1].attributes == {
        "app_name": "kernel", "proc_id": "", "msg_id": "", "facility": "16", "severity": "1",
    }
    alerts = syslog.siem_anomalies(events).collect()
    assert [(a.ip, a.type) for a in alerts] == [
        ("10.0.0.9", "UNIFI_SECURITY"),
        ("10.9.9.9", "UNIFI_CRITICAL"),
    ]


def test_ids_alerts(spark):
    lines = [
        '{"timestamp":"2026-07-12T09:59:58.000001+0200","event_type":"dns","src_ip":"192.168.1.5"}',
        '{"timestamp":"2026-07-12T09:59:58.000001+0200","event_type":"alert","src_ip":"8.8.8.8",'
        '"dest_ip":"192.168.1.5","alert":{"signature_id":2018,"signature":"ET SCAN","category":"Scan","severity":2}}',
        '{"event_type":"alert","src_ip":"8.8.8.8","dest_ip":"9.9.9.9","alert":{"signature_id":1}}',
        '{"event_type":"alert","src_ip":"192.168.1.7","dest_ip":"9.9.9.9","alert":{"signature_id":1,"severity":1}}',
        "{broken",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = ids.ids_alerts(df, ["192.168.0.0/16"]).collect()
    assert [(r.ip, r.severity, r.signature_id) for r in rows] == [
        ("192.168.1.5", "medium", 2018),
        ("192.168.1.7", "high", 1),
    ]
    assert rows[0].description == "IDS Alert: ET SCAN (Category: Scan, Signature ID: 2018)"
    assert rows[0].created_at == datetime(2026, 7, 12, 7, 59, 58, 1)


def _packet(second, port=1000, length=100, flags=0, protocol=17, src="10.0.0.2"):
    return (
        datetime.fromtimestamp(1_700_000_000 + second), src, "1.1.1.1", port, 53, protocol, length, flags,
    )


PACKET = (
    "event_ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
    "bytes bigint, tcp_flags smallint"
)


def brute_flows(rows, active=30, idle=15):
    flows, open_flows = [], {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[5] not in (6, 17):
            continue
        key = r[1:6]
        t = r[0].timestamp()
        tick = int(t)
        f = open_flows.get(key)
        if f and (tick - f["first"] >= active or tick - f["last"] >= idle):
            flows.append(f)
            f = None
        if f is None:
            f = open_flows[key] = {"key": key, "first": t, "last": t, "bytes": 0, "packets": 0, "flags": 0}
        f["last"] = t
        f["bytes"] += r[6]
        f["packets"] += 1
        f["flags"] |= r[7]
    flows += open_flows.values()
    return sorted((f["key"], round(f["first"], 6), f["bytes"], f["packets"], f["flags"]) for f in flows)


def test_packets_to_flows(spark):
    import random

    rng = random.Random(7)
    rows = [_packet(0), _packet(1, length=50), _packet(40, flags=2)]
    t = 0.0
    for _ in range(400):
        t += rng.choice([0.2, 0.9, 1.5, 6.0, 14.6, 15.0, 16.0])
        rows.append(_packet(t, port=2000, length=rng.randint(40, 1500), flags=rng.choice([0, 2, 16]), protocol=6))
    rows.append(_packet(5, protocol=1))
    df = spark.createDataFrame(rows, PACKET)
    got = sorted(
        (
            (r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol),
            round(r.event_ts.timestamp(), 6), r.bytes, r.packets, r.tcp_flags,
        )
        for r in packets.packets_to_flows(df).collect()
    )
    assert got == brute_flows(rows)
    assert any(k[2] == 1000 and p == 2 and b == 150 for k, _, b, p, _ in got)


def test_packets_to_flows_shuffles_twice_and_folds_no_rows(spark):
    """Slots are dealt once to be summed and once by 5-tuple; flows are finished in that order."""
    found = packets.packets_to_flows(spark.createDataFrame([_packet(0)], PACKET))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "MapInPandas" not in plan


def test_packet_flows_go_on_over_batches_and_under_null_ports(spark):
    rows = [_packet(t * 0.7, port=p, flags=1 << t % 5) for t in range(200) for p in (2000, 2001)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, PACKET)
        nulls = df.filter("src_port = 2000").withColumn("src_port", F.lit(None).cast("int"))
        untimed = df.limit(3).withColumn("event_ts", F.lit(None).cast("timestamp"))
        unsized = df.limit(1).withColumns({"src_port": F.lit(3000), "bytes": F.lit(None).cast(df.schema["bytes"].dataType)})
        got = packets.packets_to_flows(df.unionByName(nulls).unionByName(untimed).unionByName(unsized)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = brute_flows(rows)
    flows = {p: sorted((round(r.event_ts.timestamp(), 6), r.bytes, r.packets, r.tcp_flags) for r in got if r.src_port == p) for p in (2000, 2001, None, 3000)}
    assert len(flows[2000]) > 2 and flows[None] == flows[2000] == [x[1:] for x in want if x[0][2] == 2000]
    assert flows[2001] == [x[1:] for x in want if x[0][2] == 2001]
    assert [x[1:3] for x in flows[3000]] == [(None, 1)] and sum(len(x) for x in flows.values()) == len(got)


def test_normalize_flows(spark):
    df = spark.createDataFrame(
        [
            (100, 200, "1.1.1.1", "2.2.2.2", "NetFlow ", "", "9.9.9.9"),
            (0, 200, "1.1.1.1", "2.2.2.2", "x", None, None),
            (0, 200, None, "2.2.2.2", "x", None, None),
        ],
        "flow_start bigint, received bigint, src_ip string, dst_ip string, collector_kind string, "
        "collector_id string, exporter_ip string",
    )
    rows = flow_src.normalize_flows(df).select(F.unix_seconds("event_ts").alias("t"), "collector_kind", "collector_id")
    assert [tuple(r) for r in rows.collect()] == [(100, "netflow", "9.9.9.9"), (200, "unknown", "unknown")]
    q = flow_src.ingest_quality(df.fillna("", ["collector_kind"])).collect()
    assert sum(r.rejected for r in q) == 1 and sum(r.received for r in q) == 3
    assert "event_ts" in schemas.FLOW_EVENTS
