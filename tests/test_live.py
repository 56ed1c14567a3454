import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.operators import rollup
from tidewire.params import Params
from tidewire.plans import chain
from tidewire.plans.detect import detect_all
from tidewire.sources import store
from tidewire.streaming import live, sources

T0 = datetime(2026, 7, 9, 9, 0, 0)
FAR = T0 + timedelta(days=1, hours=12)
P = replace(
    Params(), beacon_observations=4, night_day_windows=3, night_min_bytes=20_000, profile_learning=4, profile_dominance=2,
    profile_confirm=2, peer_learning=4, novelty_min_history=3, novelty_lookback=6 * 3600, spike_min_bytes=30_000,
    fanout_min_ports=6, fanout_min_destinations=9, behaviour_cooldown=3600,
)
ALERT = ("id", "ip", "destination_ip", "type", "description", "status", "created_at", "policy_id", "silence_reason")
LOG = ("anomaly_id", "rule_id", "channel", "status", "dispatched_at")


def flow(ts, src, dst, port=443, proto=6, nbytes=100, packets=1):
    return (ts, src, dst, 50000, port, proto, nbytes, packets, "netflow", "r1", "r1", 0)


def traffic(seed=4):
    """A day and a night: everyday traffic, a beacon, scans, new peers, a changed device, night work."""
    rng = random.Random(seed)
    rows = []
    for k in range(110):
        ts = T0 + timedelta(minutes=12 * k, seconds=rng.randrange(50))
        late = k >= 60
        rows.append(flow(ts, "192.168.1.2", f"203.0.113.{rng.randrange(3)}", rng.choice([443, 80]), nbytes=25_000, packets=30))
        rows.append(flow(ts, "192.168.1.3", f"192.168.1.{rng.choice([20, 21, 22]) if late else 20}", 445))
        rows.append(flow(ts, "192.168.1.4", "203.0.113.9", 53 if late else 443, 17 if late else 6))
        rows.append(flow(ts, "192.168.1.4", f"203.0.113.{rng.randrange(60)}", 443, nbytes=rng.choice([90, 40_000])))
        if k % 20 == 15:
            rows += [flow(ts, "192.168.1.5", f"203.0.113.{i}", 443) for i in range(12)]
            rows += [flow(ts, "192.168.1.6", "203.0.113.77", 1000 + i) for i in range(9)]
        rows.append(flow(ts, rng.choice(["192.168.1.5", "192.168.1.6"]), "203.0.113.8", 443))
    rows += [flow(T0 + timedelta(minutes=5 * k), "192.168.1.7", "203.0.113.200", 8443) for k in range(60)]
    return sorted(rows + [flow(FAR, "10.9.9.9", "1.1.1.1")], key=lambda r: r[0])


def settings(spark):
    base = spark.createDataFrame([("192.168.1.4", 100.0, 50.0, 1.0, 0.5, 1.0, 0.5, 9)], schemas.BASELINES)
    policies = spark.createDataFrame(
        [(1, "quiet", "ip", "192.168.1.4", "", False, 7200, "", ""), (2, "off", "type", "NEW_PORT", "", True, 0, "", "")],
        schemas.POLICIES,
    )
    rules = spark.createDataFrame(
        [
            (1, "all", True, "low", [], "global", "", 5400, ["telegram", "webhook"]),
            (2, "spikes", True, "low", ["TRAFFIC_SPIKE"], "ip", "192.168.1.4", 0, ["telegram"]),
        ],
        schemas.RULES,
    )
    return base, policies, rules


def put(spark, rows, folder, parts):
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], schemas.FLOW_EVENTS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, source, tables, history=None):
    base, policies, rules = tables
    flows = sources.flow_stream(spark, source, max_files=1)
    live.start_live(
        spark, flows, folder, lambda: base, lambda: policies, lambda: rules, ["telegram"], P, history, once=True
    )


def results(spark, folder):
    alerts, logs = (spark.read.parquet(f"{folder}/{t}") for t in ("alerts", "notifications"))
    return sorted(map(str, alerts.select(*ALERT).collect())), sorted(map(str, logs.select(*LOG).collect()))


def whole(spark, rows, tables, since=T0):
    base, policies, rules = tables
    aggregates = rollup.minute_rollup(spark.createDataFrame(rows, schemas.FLOW_EVENTS))
    found = detect_all(aggregates, base, P).filter((F.col("created_at") < FAR) & (F.col("created_at") >= since))

    def cut(frame):
        return spark.createDataFrame(frame.collect(), frame.schema)

    stored = cut(chain.judged_alerts(cut(chain.spaced_alerts(cut(found), P)), policies, P))
    logs = chain.planned_notifications(stored, rules, ["telegram"], P)
    types = {r.type for r in stored.select("type").distinct().collect()}
    return sorted(map(str, stored.select(*ALERT).collect())), sorted(map(str, logs.select(*LOG).collect())), types


def test_live_equals_batch(spark, tmp_path):
    rows, tables = traffic(), settings(spark)
    rows = rows[:len(rows) // 2]
    source, folder = str(tmp_path / "in"), str(tmp_path / "live")
    put(spark, rows, source, 1)
    run(spark, folder, source, tables)
    alerts, logs, types = whole(spark, rows, tables)
    assert results(spark, folder) == (alerts, logs) and len(types) == 6


def test_live_starts_from_history(spark, tmp_path):
    rows, tables = traffic(), settings(spark)
    cut = T0 + timedelta(hours=11)
    path, source, folder = str(tmp_path / "agg"), str(tmp_path / "in"), str(tmp_path / "live")
    old = rollup.minute_rollup(spark.createDataFrame([r for r in rows if r[0] < cut], schemas.FLOW_EVENTS))
    store.write_aggregates(old, path, "old")
    put(spark, [r for r in rows if r[0] >= cut], source, 1)
    run(spark, folder, source, tables, store.read_aggregates(spark, path))
    want = whole(spark, rows, tables, since=cut)
    assert results(spark, folder) == want[:2]
    # without the history other things are new
    assert {"NIGHTTIME_TRAFFIC", "NEW_INTERNAL_COMMUNICATION", "NEW_DESTINATION"} <= want[2]


def test_rules_pass_over_repeated_rows():
    rule, items = live.RULES["novel"](P), live.Items()
    rows = [(60 * k, '{"src_ip": "a", "item": "w", "dst_ip": "x"}') for k in range(5)]
    memory, _ = live.judge(rule, None, items, rows)
    new = (600, '{"src_ip": "a", "item": "dy", "dst_ip": "y"}')
    memory, found = live.judge(rule, memory, items, [new])
    assert [f[0] for f in found] == [600]
    again, found = live.judge(rule, memory, items, [new, rows[0]])
    assert again == memory and found == []


@pytest.mark.parametrize("gap", [0, 1])
def test_old_items_are_swept_and_new_again(gap):
    rule, items = live.RULES["novel"](replace(P, novelty_min_history=0)), live.Items()
    item = '{"src_ip": "a", "item": "dy", "dst_ip": "y"}'
    memory, first = live.judge(rule, None, items, [(0, item)])
    at = P.novelty_lookback + 1 + gap
    memory, found = live.judge(rule, memory, items, [(at, item)])
    assert len(first) == 1 and len(found) == gap
    live.judge(rule, memory, items, [(at + 2 * live.DAY, '{"src_ip": "a", "item": "w", "dst_ip": "x"}')])
    assert items.all() == []
