import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.operators import (
    alerts, changes, devices, notifications, policies, risk, security,
)
from tidewire.plans.profile import device_profile

NOW = datetime(2026, 7, 9, 12, 0, 0)


def hours(h):
    return NOW - timedelta(hours=h)


def anomaly(i, ip="192.168.1.10", kind="TRAFFIC_SPIKE", severity="high", age=1.0, status="active", dst=""):
    return (i, ip, dst, kind, f"text {i}", severity, status, hours(age), hours(age))


def anomalies(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ANOMALIES)


def device_table(spark, *ips):
    return spark.createDataFrame([(i, "lab", "", "", hours(99), hours(1)) for i in ips], schemas.DEVICES)


def score(spark, *rows):
    d = device_table(spark, "192.168.1.10", "192.168.1.20")
    return {r.ip: (r.risk_score, r.risk_level) for r in risk.device_risk(d, anomalies(spark, *rows), NOW).collect()}


def test_risk_decay_and_boost(spark):
    got = score(spark, anomaly(1, age=6), anomaly(2, ip="192.168.1.20", age=30), anomaly(3, ip="10.0.0.1"))
    assert got == {"192.168.1.10": (30, "medium"), "192.168.1.20": (6, "low")}
    near = (anomaly(1, kind="SURICATA_ALERT", severity="low", age=1), anomaly(2, severity="low", age=1 + 1 / 6))
    far = (anomaly(1, kind="SURICATA_ALERT", severity="low", age=0.5), anomaly(2, severity="low", age=3.5))
    assert score(spark, *near)["192.168.1.10"][0] == 39 or score(spark, *near)["192.168.1.10"][0] == 40
    assert score(spark, *far)["192.168.1.10"][0] < 20
    assert score(spark, anomaly(1, status="silenced"), anomaly(2, age=24 * 8)) == {}
    capped = score(spark, *[anomaly(i, age=0.1) for i in range(5)])
    assert capped == {"192.168.1.10": (100, "high")}


def test_correlation_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for d in range(60):
        for _ in range(4):
            kind = rng.choice(["SURICATA_ALERT", "BEACONING", "NEW_PORT"])
            rows.append(anomaly(len(rows), ip=f"10.0.0.{d}", kind=kind, age=rng.choice([1, 2, 3, 4, 5]) + rng.random() / 3))
    rows += [anomaly(900, ip="10.1.0.1", kind="SURICATA_ALERT", age=1), anomaly(901, ip="10.1.0.1", age=2)]
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[3] == "SURICATA_ALERT" and b[3] != "SURICATA_ALERT":
                if abs((a[7] - b[7]).total_seconds()) <= 3600:
                    want.add(a[1])
    got = {r.ip for r in risk.correlated_devices(anomalies(spark, *rows)).collect()}
    assert got == want and "10.1.0.1" in got and len(want) < 61


def test_breakdown_is_flat_and_complete(spark):
    d = device_table(spark, "192.168.1.10")
    a = anomalies(spark, anomaly(1, kind="SURICATA_ALERT", age=2), anomaly(2, severity="low", age=2.5))
    rows = risk.risk_breakdown(d, a, NOW).orderBy("id").collect()
    assert [(r.id, r.base_weight, r.correlation_boost) for r in rows] == [(1, 40.0, 20.0), (2, 10.0, 20.0)]
    assert risk.risk_explanations(risk.risk_breakdown(d, a, NOW)).count() == 3
    assert tuple(risk.alert_mix(risk.device_risk(d, a, NOW)).first()) == ("192.168.1.10", 1, 0, 1)


def policy(i, scope, target="", threshold="", suppressed=False, cooldown=0, quiet=("", "")):
    return (i, f"p{i}", scope, target, threshold, suppressed, cooldown, *quiet)


def policy_table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.POLICIES)


def statuses(spark, rows, pols):
    out = policies.apply_policies(anomalies(spark, *rows), policy_table(spark, *pols))
    return {r.id: (r.status, r.silence_reason) for r in out.collect()}


def test_policy_precedence(spark):
    rows = [anomaly(1, ip="2001:db8::1"), anomaly(2, ip="10.0.0.5", dst="203.0.113.7"), anomaly(3, ip="10.0.0.6", severity="low")]
    pols = [policy(1, "ip", "2001:0db8:0:0:0:0:0:1", suppressed=True), policy(2, "ip", "203.0.113.7", suppressed=True)]
    assert statuses(spark, rows, pols) == {1: ("silenced", "suppressed"), 2: ("silenced", "suppressed"), 3: ("active", None)}
    newer = pols + [policy(9, "ip", "2001:db8::1")]
    assert statuses(spark, rows, newer)[1] == ("active", None)
    wide = [policy(1, "global", suppressed=True), policy(2, "subnet", "10.0.0.0/8", threshold="medium"),
            policy(3, "alert_type", "TRAFFIC_SPIKE")]
    assert statuses(spark, rows, wide) == {1: ("active", None), 2: ("active", None), 3: ("silenced", "below_threshold")}
    # critical ranks below low unless lifted
    crit = [anomaly(1, severity="critical")]
    p = [policy(1, "global", threshold="low")]
    assert statuses(spark, crit, p)[1][0] == "silenced"
    lifted = policies.apply_policies(anomalies(spark, *crit), policy_table(spark, *p), critical_rank=4)
    assert lifted.first().status == "active"


def test_policy_quiet_hours_and_cooldown(spark):
    rows = [anomaly(1, age=3), anomaly(2, age=2), anomaly(3, age=1.5, status="acknowledged"), anomaly(4, age=0.4), anomaly(5, kind="X")]
    got = statuses(spark, rows, [policy(1, "global", cooldown=3600)])
    assert [got[i][1] for i in range(1, 6)] == [None, "cooldown", "cooldown", None, None]
    quiet = statuses(spark, rows[:2], [policy(1, "global", quiet=("09:30", "10:00"))])
    assert [quiet[i][1] for i in (1, 2)] == [None, "quiet_hours"]


def test_policy_cooldown_against_brute_force(spark):
    rng = random.Random(2)
    rows = [anomaly(i, ip=f"10.0.0.{rng.randrange(3)}", kind=rng.choice("AB"), age=rng.randrange(0, 40 * 60) / 60)
            for i in range(200)]
    got = statuses(spark, rows, [policy(1, "global", cooldown=1800)])
    for r in rows:
        earlier = [o for o in rows if o[1] == r[1] and o[3] == r[3] and (o[7], o[0]) < (r[7], r[0])]
        want = any(o[7] >= r[7] - timedelta(seconds=1800) for o in earlier)
        assert (got[r[0]][1] == "cooldown") == want


def test_match_and_list_policies(spark):
    pols = policy_table(spark, policy(1, "global"), policy(2, "subnet", "10.0.0.0/8"), policy(3, "ip", "10.0.0.5"),
                        policy(4, "alert_type", "X"), policy(5, "subnet", "10.0.0.4/30"), policy(6, "subnet", "bad"))
    a = anomalies(spark, anomaly(1, ip="10.0.0.5", dst="10.0.0.6", kind="X"), anomaly(2, ip="8.8.8.8"))
    got = sorted((r.anomaly_id, r.policy_id) for r in policies.match_policies(a, pols).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1)]
    best = {r.anomaly_id: r.policy_id for r in policies.policy_match(a, pols).collect()}
    assert best == {1: 3, 2: 1}
    assert [r.id for r in policies.policies_for_ip(pols, "10.0.0.5").collect()] == [1, 3, 2, 5]
    assert [r.id for r in policies.policies_for_ip(pols, "2001:db8::1").collect()] == [1]


def test_validate_policies(spark):
    good = [policy(1, "global"), policy(2, "ip", "::1", "low", quiet=("22:00", "06:00")), policy(3, "subnet", "fe80::/10")]
    bad = [policy(4, "global", "x"), policy(5, "ip", "1.2.3"), policy(6, "subnet", "1.2.3.4"), policy(7, "alert_type"),
           policy(8, "other"), policy(9, "global", threshold="critical"), policy(10, "global", cooldown=2_592_001),
           policy(11, "global", quiet=("24:00", "06:00")), policy(12, "global", quiet=("22:00", ""))]
    ok, rejected = policies.validate_policies(policy_table(spark, *good, *bad))
    assert sorted(r.id for r in ok.collect()) == [1, 2, 3]
    assert rejected.count() == 9 and rejected.filter("reject_reason is null").count() == 0


def rule(i, enabled=True, minimum="low", types=(), scope="global", target="", cooldown=0, channels=("slack",)):
    return (i, f"r{i}", enabled, minimum, list(types), scope, target, cooldown, list(channels))


def rule_table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RULES)


def routed(spark, rows, rules, configured=("slack", "webhook"), **kw):
    out = notifications.route_notifications(anomalies(spark, *rows), rule_table(spark, *rules), configured, **kw)
    return sorted((r.anomaly_id, r.rule_id or 0, r.channel, r.status) for r in out.collect())


def test_routing(spark):
    rows = [anomaly(1), anomaly(2, status="silenced"), anomaly(3, kind="new_port", severity="low", ip="10.0.0.1")]
    assert routed(spark, rows, [rule(1, enabled=False)]) == [
        (1, 0, "slack", "dispatch"), (1, 0, "webhook", "dispatch"), (2, 0, "all", "suppressed"),
        (3, 0, "slack", "dispatch"), (3, 0, "webhook", "dispatch"),
    ]
    rules = [rule(1, minimum="high", channels=("slack", "telegram")), rule(2, types=("NEW_PORT",)),
             rule(3, scope="subnet", target="10.0.0.0/8", channels=("webhook",)), rule(4, scope="ip", target="9.9.9.9"),
             rule(5, scope="subnet", target="bad")]
    assert routed(spark, rows, rules) == [
        (1, 1, "slack", "dispatch"), (1, 1, "telegram", "failed"), (2, 0, "all", "suppressed"),
        (3, 2, "slack", "dispatch"), (3, 3, "webhook", "dispatch"),
    ]
    gated = routed(spark, rows, rules, suppressed_types=["traffic_spike"], allowed_cidrs=["192.168.0.0/16"])
    assert [g[3] for g in gated] == ["suppressed"] * 3


def test_routing_cooldown_is_greedy(spark):
    rng = random.Random(4)
    rows = [anomaly(i, ip=f"10.0.0.{rng.randrange(2)}", age=rng.randrange(0, 300) / 60) for i in range(80)]
    got = routed(spark, rows, [rule(1, cooldown=1200)])
    last, want = {}, []
    for r in sorted(rows, key=lambda r: (r[7], r[0])):
        if r[1] in last and (r[7] - last[r[1]]).total_seconds() <= 1200:
            want.append((r[0], 1, "all", "deduplicated"))
        else:
            last[r[1]] = r[7]
            want.append((r[0], 1, "slack", "dispatch"))
    assert got == sorted(want)
    # failed channels never start a cooldown
    assert {g[3] for g in routed(spark, rows, [rule(1, cooldown=1200, channels=("telegram",))])} == {"failed"}


def test_validate_rules(spark):
    rows = [rule(1, scope=""), rule(2, minimum="", cooldown=-5), rule(3, channels=()), rule(4, channels=("sms",)),
            rule(5, scope="ip", target="x"), rule(6, scope="team"), rule(7, minimum="critical")]
    ok, bad = notifications.validate_rules(rule_table(spark, *rows))
    got = {r.id: (r.scope, r.severity_min, r.cooldown_seconds) for r in ok.collect()}
    assert got == {1: ("global", "low", 0), 2: ("global", "low", 0)} and bad.count() == 5


def test_messages_and_recent(spark):
    a = anomalies(spark, anomaly(1), anomaly(2, ip="10.0.0.9"))
    d = device_table(spark, "192.168.1.10")
    rows = {r.id: r for r in notifications.notification_message(a, d).collect()}
    assert "lab (192.168.1.10)" in rows[1].text and "Device: 10.0.0.9" in rows[2].text
    assert '"id":1' in rows[1].payload
    logs = spark.createDataFrame([(1, 7, "slack", "sent", "", hours(1)), (1, 7, "slack", "failed", "", hours(1)),
                                  (1, 7, "slack", "sent", "", hours(9))], schemas.NOTIFICATION_LOGS)
    assert notifications.recent_notifications(logs, a, 7, "192.168.1.10", "TRAFFIC_SPIKE", hours(2)).first().recent == 1
    assert notifications.list_notification_logs(logs, 2).count() == 2


def test_security_views(spark):
    a = anomalies(spark, anomaly(1), anomaly(2, severity="odd"), anomaly(3, severity="critical", age=30), anomaly(4, status="silenced"))
    d = device_table(spark, "192.168.1.10", "192.168.1.20")
    r = security.alerts_by_severity(a, hours(24 * 7)).first()
    assert (r.critical, r.high, r.medium, r.low, r.total) == (1, 1, 0, 1, 3)
    t = security.security_timeline(a, hours(5), NOW).collect()
    assert [(x.high, x.low, x.total) for x in t] == [(1, 1, 2)]
    assert security.timeline_map(security.security_timeline(a, hours(5), NOW)).first().counts["high"] == 1
    s = security.security_summary(d, a, NOW).first()
    assert (s.active_total, s.active_critical, s.total_devices, s.risk_low + s.risk_medium + s.risk_high) == (3, 1, 2, 2)
    assert [x.id for x in s.recent_high_alerts] == [1, 3] and s.top_risk_devices[0].ip == "192.168.1.10"
    assert s.flood_limits["pps"] == 5000
    assert security.active_alert_gauges(a, NOW).count() == 3
    empty = security.security_summary(d, a.limit(0), NOW).first()
    assert (empty.max_risk_score, empty.risk_low, empty.active_total) == (0, 2, 0)


def test_status_labels_and_rule_changes(spark):
    a = anomalies(spark, anomaly(1), anomaly(2))
    log = spark.createDataFrame([(1, "acknowledged", hours(3)), (1, "silenced", hours(1)), (9, "active", hours(1)), (2, "gone", hours(1))],
                                "anomaly_id bigint, status string, changed_at timestamp")
    new, rejected = alerts.apply_status(a, log)
    assert {r.id: r.status for r in new.collect()} == {1: "silenced", 2: "active"}
    assert sorted(r.reject_reason for r in rejected.collect()) == ["anomaly not found", "unknown status"]

    d = device_table(spark, "192.168.1.10")
    labels = spark.createDataFrame([("192.168.1.10", "new", hours(2)), ("192.168.1.10", "x" * 101, hours(1)), ("10.9.9.9", "y", hours(1))],
                                   "ip string, label string, changed_at timestamp")
    merged, bad = devices.apply_labels(d, labels)
    assert merged.first().label == "new" and bad.count() == 2

    table = policy_table(spark, policy(1, "global"), policy(2, "global"))
    cols = schemas.POLICIES + ", op string, changed_at timestamp"
    log = spark.createDataFrame(
        [(*policy(1, "global", cooldown=5), "update", hours(2)), (*policy(2, "global"), "delete", hours(2)),
         (*policy(3, "ip", "1.1.1.1"), "insert", hours(2)), (*policy(4, "global"), "update", hours(2)),
         (*policy(5, "ip", "bad"), "insert", hours(2))], cols)
    after, bad = changes.apply_rule_changes(table, log, policies.validate_policies)
    assert {r.id: r.cooldown_seconds for r in after.collect()} == {1: 5, 3: 0}
    assert sorted(r.id for r in bad.collect()) == [4, 5]
    done = changes.accepted(changes.judged_changes(table, log, policies.validate_policies))
    named = changes.accepted(devices.judged_labels(d, labels))
    audit = changes.audit_log(changes.audit_rule_changes(done, "policy"), changes.audit_labels(named))
    assert audit.count() == 4
    assert changes.search_audit(audit, "delete POLICY").count() == 1
    first = changes.search_audit(audit, size=3).collect()
    rest = changes.search_audit(audit, after=tuple(first[-1]), size=3).collect()
    assert first + rest == changes.list_audit(audit, 300).collect() and len(rest) == 1


def test_repeated_audit_rows_are_on_one_page_each(spark):
    rows = [(hours(5), "save", "x")] * 5 + [(hours(5), "save", "y"), (hours(4), "drop", "x"), (hours(9), "save", "x")]
    audit = spark.createDataFrame(rows, "timestamp timestamp, action string, details string")
    for size in (1, 2, 3, 4, 8):
        seen, after = [], None
        while page := changes.search_audit(audit, after=after, size=size).collect():
            seen += page
            after = changes.page_end(page, after)
        assert seen == changes.list_audit(audit, 300).collect() and len(seen) == 8


def test_changes_of_unknown_kind_are_rejected(spark):
    cols = schemas.POLICIES + ", op string, changed_at timestamp"
    table = policy_table(spark, policy(1, "global"))
    log = spark.createDataFrame(
        [(*policy(1, "global", cooldown=9), op, hours(k)) for k, op in enumerate((None, "upsert", "DELETE", "update"), 2)], cols
    )
    judged = changes.judged_changes(table, log, policies.validate_policies)
    assert sorted((r.op or "", r.reject_reason or "") for r in judged.collect()) == [
        ("", "unknown op"), ("DELETE", "unknown op"), ("update", ""), ("upsert", "unknown op")]
    after, bad = changes.apply_rule_changes(table, log, policies.validate_policies)
    assert [r.cooldown_seconds for r in after.collect()] == [9] and bad.count() == 3


def test_cooldown_tells_null_from_the_text_null(spark):
    rows = [(ip, "a", hours(1), "d") for ip in (None, "null", "", "=", "{null}")]
    df = spark.createDataFrame(rows, "ip string, type string, created_at timestamp, note string")
    again = df.unionByName(df.withColumn("created_at", df.created_at + F.expr("interval 5 minutes")))
    kept = alerts.dedup_alerts(again, 900, carry=["note"]).collect()
    assert sorted(map(repr, (r.ip for r in kept))) == sorted(map(repr, (r[0] for r in rows)))


def test_change_log_is_taken_in_order(spark):
    cols = schemas.POLICIES + ", op string, changed_at timestamp"
    table = policy_table(spark, policy(1, "global"), policy(2, "global"))
    log = spark.createDataFrame(
        [(*policy(1, "global"), "delete", hours(9)), (*policy(1, "global", cooldown=7), "update", hours(8)),
         (*policy(3, "global"), "update", hours(9)), (*policy(3, "global", cooldown=1), "insert", hours(8)),
         (*policy(3, "global", cooldown=2), "update", hours(7)), (*policy(4, "global"), "delete", hours(5)),
         (*policy(2, "global"), "delete", hours(9)), (*policy(2, "global", cooldown=3), "insert", hours(8))], cols)
    after, bad = changes.apply_rule_changes(table, log, policies.validate_policies)
    assert {r.id: r.cooldown_seconds for r in after.collect()} == {2: 3, 3: 2}
    assert sorted((r.id, r.op) for r in bad.collect()) == [(1, "update"), (3, "update"), (4, "delete")]


def test_devices(spark):
    flows = spark.createDataFrame([(hours(5), "192.168.1.10", "8.8.8.8"), (hours(2), "8.8.8.8", "192.168.1.30"), (hours(1), "192.168.1.30", "192.168.1.10")],
                                  "event_ts timestamp, src_ip string, dst_ip string")
    hosts = spark.createDataFrame([("192.168.1.30", "printer"), ("192.168.1.10", "")], "ip string, hostname string")
    old = device_table(spark, "192.168.1.10", "192.168.1.99")
    got = {r.ip: r for r in devices.discover_devices(flows, old, ["192.168.0.0/16"], hosts).collect()}
    assert set(got) == {"192.168.1.10", "192.168.1.30", "192.168.1.99"}
    assert got["192.168.1.10"].first_seen == hours(99) and got["192.168.1.10"].last_seen == hours(1)
    assert (got["192.168.1.30"].hostname, got["192.168.1.30"].first_seen) == ("printer", hours(2))
    assert devices.search_devices(old, "LAB 1.99").count() == 1
    assert devices.search_devices(old, "", "192.168.1.0/24").count() == 2


@pytest.mark.parametrize("one", [None, "192.168.1.10"])
def test_device_profile(spark, one):
    d = device_table(spark, "192.168.1.10", "192.168.1.20")
    a = anomalies(spark, *[anomaly(i, age=i / 10) for i in range(60)])
    base = spark.createDataFrame([("192.168.1.10",) + (1.0,) * 6 + (9,)], schemas.BASELINES)
    pols = policy_table(spark, policy(1, "global"), policy(2, "subnet", "192.168.1.0/28"))
    got = {r.ip: r for r in device_profile(d, a, base, pols, NOW, device=one).collect()}
    r = got["192.168.1.10"]
    assert len(r.anomalies) == 50 and r.anomalies[0].id == 0 and r.mean_bytes == 1.0
    assert (r.subnet_vlan, r.risk_score, r.policy_status, r.applied_policies) == (
        "192.168.0.0/16", 100, "active_policy", ["p1", "p2"],
    )
    if one is None:
        other = got["192.168.1.20"]
        assert (other.risk_level, other.risk_score, other.applied_policies) == ("low", 0, ["p1"])
    assert F is not None


def test_global_rules_are_met_under_many_keys(spark):
    from tidewire.operators.scopes import SALTS, global_key, global_keys

    rows = spark.range(5000).select(global_key("id").alias("k"))
    assert rows.distinct().count() == SALTS
    assert {r.k for r in rows.collect()} == set(spark.range(1).select(global_keys().alias("g")).first().g)
    a = anomalies(spark, *[anomaly(i, age=i) for i in range(40)])
    pols = policy_table(spark, policy(1, "global"), policy(2, "global"), policy(3, "alert_type", "nothing"))
    assert policies.match_policies(a, pols).count() == 80
    assert {r.policy_id for r in policies.policy_match(a, pols).collect()} == {2}
