import math
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.operators import alerts, detectors, profiles, rollup
from tidewire.params import Params

T0 = datetime(2026, 7, 9, 10, 0, 0)
AGG = (
    "bucket_ts timestamp, src_ip string, dst_ip string, dst_port int, protocol int, bytes bigint, packets bigint"
)
FLOW = "event_ts timestamp, dst_ip string, protocol int, bytes bigint, packets bigint, tcp_flags smallint"
PARTS = ["what happened: ", "; why unusual: ", "; baseline used: ", "; current value: ",
         "; expected value: ", "; confidence: ", "; recommended next check: "]


def minute(i):
    return T0 + timedelta(minutes=i)


def row(ts, src="192.168.1.10", dst="203.0.113.5", port=443, proto=6, nbytes=500, packets=2):
    return (ts, src, dst, port, proto, nbytes, packets)


def frame(spark, rows):
    return spark.createDataFrame(rows, AGG)


def baseline(spark, ip="192.168.1.10", b=(2000.0, 500.0), p=(20.0, 5.0), peers=(4.0, 1.0)):
    return spark.createDataFrame([(ip, *b, *p, *peers, 9)], schemas.BASELINES)


def test_traffic_spike(spark):
    rows = [row(minute(0), nbytes=2100, packets=3), row(minute(1), nbytes=2_000_000, packets=3),
            row(minute(2), nbytes=100, packets=2600)]
    m = rollup.device_window_metrics(frame(spark, rows))
    got = detectors.traffic_spike(m, baseline(spark)).orderBy("created_at").collect()
    assert [(r.created_at, r.metric, r.observed, r.limit_value) for r in got] == [
        (minute(1), "bytes", 2_000_000, 3500.0), (minute(2), "packets", 2600, 35.0),
    ]
    kept = alerts.dedup_alerts(detectors.traffic_spike(m, baseline(spark)), 900).collect()
    assert [(r.ip, r.created_at) for r in kept] == [("192.168.1.10", minute(1))]
    peers = m.withColumn("peers", F.lit(30).cast("long")).filter(F.col("bucket_ts") == minute(0))
    assert detectors.traffic_spike(peers, baseline(spark)).first().metric == "peers"


def scan(n, packets=1, dst=lambda i: f"203.0.113.{i}", port=lambda i: 443):
    return [row(minute(0), dst=dst(i), port=port(i), packets=packets) for i in range(n)]


def test_destination_fanout(spark):
    def run(rows, base=None):
        return detectors.destination_fanout(rollup.device_window_metrics(frame(spark, rows)), base).collect()

    assert not run(scan(31))
    (r,) = run(scan(32))
    assert (r.dst_count, r.limit_value) == (32, 32) and all(p in r.description for p in PARTS)
    assert not run(scan(32, packets=13))
    assert run(scan(40), baseline(spark, peers=(10.0, 5.0)))[0].limit_value == 32
    assert not run(scan(40), baseline(spark, peers=(30.0, 5.0)))
    assert run(scan(45), baseline(spark, peers=(30.0, 5.0)))[0].limit_value == 45


def test_port_fanout(spark):
    def run(rows):
        return detectors.port_fanout(rollup.port_fanout_best(frame(spark, rows))).collect()

    same = lambda i: "203.0.113.9"
    assert not run(scan(15, dst=same, port=lambda i: 1000 + i))
    (r,) = run(scan(16, dst=same, port=lambda i: 1000 + i))
    assert (r.target, r.port_count, r.packets) == ("203.0.113.9", 16, 16)
    assert not run(scan(16, packets=13, dst=same, port=lambda i: 1000 + i))


BEACON = [0, 121, 239, 361, 480, 602, 720, 839, 961, 1080, 1201, 1320]


def beacon_rows(offsets, **kw):
    return [row(T0 + timedelta(seconds=s), **kw) for s in offsets]


def test_beaconing(spark):
    (r,) = detectors.beaconing(frame(spark, beacon_rows(BEACON))).collect()
    assert (r.type, r.severity, r.observations, r.interval_seconds) == ("BEACONING", "medium", 12, 120.0)
    assert r.created_at == T0 + timedelta(seconds=1320) and all(p in r.description for p in PARTS)


@pytest.mark.parametrize(
    "offsets, kw",
    [
        (BEACON[:11], {}),
        ([0, 121, 400, 490, 900, 1000, 1300, 1420, 1900, 2000, 2500, 2600], {}),
        (BEACON, {"packets": 21}),
        (BEACON, {"dst": "192.168.1.77"}),
        ([60 * i for i in range(12)], {}),
        (BEACON, {"dst": "224.0.0.5"}),
        (BEACON, {"nbytes": 64 * 1024 + 1}),
        (BEACON, {"src": "203.0.113.1"}),
    ],
)
def test_beaconing_controls(spark, offsets, kw):
    assert detectors.beaconing(frame(spark, beacon_rows(offsets, **kw))).count() == 0


def test_beaconing_against_brute_force(spark):
    rng = random.Random(3)
    offsets, t = [], 0
    for _ in range(300):
        t += rng.choice([100, 110, 120, 130, 95, 400, 88])
        offsets.append(t)
    p = replace(Params(), beacon_observations=4)
    got = {r.created_at for r in detectors.beaconing(frame(spark, beacon_rows(offsets)), p).collect()}
    want = set()
    for i in range(3, len(offsets)):
        gaps = [offsets[j] - offsets[j - 1] for j in range(i - 2, i + 1)]
        mean = sum(gaps) / 3
        if min(gaps) >= 90 and max(gaps) <= 1800 and max(abs(g - mean) for g in gaps) <= max(0.2 * mean, 20):
            want.add(T0 + timedelta(seconds=offsets[i]))
    assert got == want and want


def night_rows(days=12, night="2026-07-09 23:30:00"):
    rows = [row(datetime(2026, 7, 9, 8, i), nbytes=200_000) for i in range(days)]
    return rows + [row(datetime.fromisoformat(night), nbytes=200_000)]


def test_nighttime(spark):
    p = replace(Params(), timezone="Europe/Berlin")
    m = rollup.device_window_metrics(frame(spark, night_rows()))
    (r,) = detectors.nighttime(m, p).collect()
    assert (r.local_hour, r.day_windows, r.night_windows) == (1, 12, 0)
    for rows in (night_rows(days=11), night_rows(night="2026-07-09 21:30:00"), night_rows(night="2026-08-09 23:30:00")):
        assert detectors.nighttime(rollup.device_window_metrics(frame(spark, rows)), p).count() == 0
    more = night_rows() + [row(datetime(2026, 7, 9, 23, 31 + i), nbytes=200_000) for i in range(5)]
    assert detectors.nighttime(rollup.device_window_metrics(frame(spark, more)), p).count() == 3


def test_novelty_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(500):
        rows.append(row(minute(rng.randrange(0, 60 * 24 * 20, 60)), src=f"192.168.1.{rng.randrange(3)}",
                        dst=f"203.0.113.{rng.randrange(12)}", port=rng.choice([0, 22, 53, 80, 443, 8080])))
    p = replace(Params(), novelty_min_history=4)
    a = frame(spark, rows).cache()
    for op, item, ok in (
        (detectors.new_destination, 2, lambda r: True),
        (detectors.new_port, 3, lambda r: r[3] > 0),
    ):
        want = set()
        for r in rows:
            if not ok(r):
                continue
            low, high = r[0] - timedelta(days=7, seconds=1), r[0] - timedelta(seconds=1)
            history = [h for h in rows if h[1] == r[1] and low <= h[0] <= high]
            if len({h[0] for h in history}) >= 4 and not any(h[item] == r[item] for h in history):
                want.add((r[1], r[0], r[item]))
        col = "destination_ip" if item == 2 else "dst_port"
        got = [(r.ip, r.created_at, r[col]) for r in op(a, p).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


FLOODS = [
    ("DDOS_ATTACK", "pps", [(6, 600, 600, 16)]),
    ("DDOS_ATTACK", "bps", [(6, 600_000, 10, 16)]),
    ("DDOS_FLOW_FLOOD", "fps", [(6, 1, 1, 16)] * 105),
    ("DDOS_UDP_FLOOD", "udp", [(17, 1, 300, 0)]),
    ("DDOS_ICMP_FLOOD", "icmp", [(1, 1, 100, 0)]),
    ("DDOS_SYN_FLOOD", "syn", [(6, 1, 300, 2)]),
]
LIMITS = replace(
    Params(), flood_pps=100, flood_bps=100_000, flood_fps=20, flood_syn=50, flood_udp=50, flood_icmp=10
)


@pytest.mark.parametrize("kind, rate, rows", FLOODS)
def test_floods(spark, kind, rate, rows):
    df = spark.createDataFrame(
        [(T0, ip, *r) for r in rows for ip in ("192.168.1.9", "203.0.113.1")], FLOW
    )
    (r,) = detectors.floods(detectors.victim_rates(df, LIMITS), LIMITS).collect()
    assert (r.ip, r.type, r.rate) == ("192.168.1.9", kind, rate)


def profile_frame(spark, windows):
    rows = [row(minute(i), port=port, proto=proto, dst=dst) for i, (proto, port, dst) in windows]
    return rollup.device_window_metrics(frame(spark, rows), with_profile=True)


WEB, DNS = (6, 443, "203.0.113.220"), (17, 53, "198.51.100.220")


def test_device_profile_change(spark):
    learn = [(i, WEB) for i in range(12)]
    changed = learn + [(12 + i, DNS) for i in range(3)]
    back = changed + [(15 + i, WEB) for i in range(3)]
    (r,) = profiles.device_profile_change(profile_frame(spark, changed)).collect()
    assert r.old_profile == "protocols=tcp services=web peers=1-4"
    assert r.new_profile == "protocols=udp services=dns peers=1-4"
    assert all(p in r.description for p in PARTS)
    both = profiles.device_profile_change(profile_frame(spark, back))
    assert both.count() == 2 and alerts.dedup_alerts(both, 900).count() == 1
    for windows in (
        learn[:11] + [(20 + i, DNS) for i in range(3)],
        [(i, WEB if i % 2 else DNS) for i in range(12)] + [(20 + i, DNS) for i in range(3)],
        learn + [(20, DNS), (21, WEB), (22, DNS), (23, DNS)],
    ):
        assert profiles.device_profile_change(profile_frame(spark, windows)).count() == 0


def test_new_internal_communication(spark):
    learn = [row(minute(i), dst="192.168.1.20") for i in range(12)]
    new = [row(minute(12 + i), dst="192.168.1.25") for i in range(2)]
    (r,) = profiles.new_internal_communication(frame(spark, learn + new)).collect()
    assert (r.ip, r.destination_ip, r.created_at) == ("192.168.1.10", "192.168.1.25", minute(13))
    again = learn + new + [row(minute(30 + i), dst="192.168.1.25") for i in range(4)]
    assert profiles.new_internal_communication(frame(spark, again)).count() == 1
    for rows in (
        learn[:11] + [row(minute(20 + i), dst="192.168.1.50") for i in range(2)][:1],
        learn + [row(minute(20), dst="192.168.1.60"), row(minute(21), dst="192.168.1.20")],
        learn + [row(minute(20 + i), dst="203.0.113.5") for i in range(2)],
    ):
        assert profiles.new_internal_communication(frame(spark, rows)).count() == 0


def test_wide_scans_and_many_peers_have_no_ceiling(spark):
    scan = [row(minute(0), dst=f"203.{i // 250}.{i % 250}.7", packets=11) for i in range(5000)]
    metrics = rollup.device_window_metrics(frame(spark, scan))
    (r,) = detectors.destination_fanout(metrics, None).collect()
    assert (r.dst_count, r.packets) == (5000, 55_000)
    learn = [row(minute(i), dst=f"192.168.{2 + k // 250}.{1 + k % 250}") for i in range(12) for k in range(300)]
    later = [row(minute(20 + i), dst="192.168.3.50") for i in range(20)]
    assert profiles.new_internal_communication(frame(spark, learn + later)).count() == 0


def test_profiles_equal_a_walk_over_the_windows(spark):
    rng = random.Random(2)
    p = replace(Params(), profile_learning=5, profile_dominance=3, profile_confirm=2, peer_learning=3, peer_confirm=2)
    signatures, pairs = [], []
    for d in range(8):
        t = 0
        for _ in range(150):
            t += 20 * 86_400 if rng.random() < 0.02 else 60
            signatures.append((f"d{d}", t, rng.choice(["A", "A", "B", "C", *"DEFGHIJKLM"][: 3 + d])))
            pairs += [(f"d{d}", t, x) for x in {f"p{rng.randrange(3 + d):02d}" for _ in range(2)}]
    want, peers = [], []
    for d in range(8):
        last = None
        for _, t, s in sorted(r for r in signatures if r[0] == f"d{d}"):
            here = {x for src, at, x in pairs if src == f"d{d}" and at == t}
            if last is None or t - last > 14 * 86_400:
                votes, usual, run, learned, windows, accepted, leads = [], None, [], set(), 0, set(), []
            last, windows = t, windows + 1
            if usual is None:
                votes.append(s)
                if len(votes) == 5:
                    best = min(set(votes), key=lambda x: (-votes.count(x), x))
                    usual, votes = best if votes.count(best) >= 3 else None, []
            else:
                run = [*run, s] if run and run[-1] == s else [s]
                if len(run) >= 2 and s != usual:
                    want.append((f"d{d}", t, usual, s))
                    usual = s
            if windows <= 3:
                learned |= here
                continue
            first = min(here - learned - accepted, default=None)
            leads = [*leads, first] if leads and leads[-1] == first else [first]
            if first is not None and len(leads) == 2:
                peers.append((f"d{d}", t, first))
                accepted.add(first)
                leads = []
    got = profiles.profile_changes(spark.createDataFrame(signatures, "src_ip string, at long, signature string"), p)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    got = profiles.new_peers(spark.createDataFrame(pairs, "src_ip string, at long, dst_ip string"), p)
    assert sorted(map(tuple, got.collect())) == sorted(peers) and peers


def test_dedup_is_greedy(spark):
    rng = random.Random(11)
    rows = []
    for key in range(4):
        t = 0
        for _ in range(200):
            t += rng.choice([rng.uniform(0, 400), rng.uniform(0, 2), 1500 * (key > 1)])
            rows.append((f"10.0.0.{key}" if key else None, "T", "", "low", "d", T0 + timedelta(seconds=t)))
    rows += [("x", "T", "", "low", "d", T0 + timedelta(seconds=s)) for s in (0.8, 900.0, 900.8)]
    df = spark.createDataFrame(
        rows, "ip string, type string, destination_ip string, severity string, description string, created_at timestamp"
    )
    want, last = set(), {}
    for r in sorted(rows, key=lambda r: r[5]):
        if r[0] not in last or (r[5] - last[r[0]]).total_seconds() >= 900:
            last[r[0]] = r[5]
            want.add((r[0], r[5]))
    got = {(r.ip, r.created_at) for r in alerts.dedup_alerts(df, 900).collect()}
    assert got == want and not math.isclose(len(got), 0)


def test_suppression(spark):
    df = spark.createDataFrame([("10.0.0.1", "A"), ("10.1.0.1", "B"), ("nonsense", "C")], "ip string, type string")
    p = replace(Params(), disabled_types=(" b ",), muted_cidrs=("10.0.0.0/16",))
    assert [r.ip for r in alerts.suppress_types_and_subnets(df, p).collect()] == ["nonsense"]
    assert alerts.allowed(df, []).count() == 3 and alerts.allowed(df, ["10.1.0.0/16"]).count() == 1


def test_combined_passes_equal_single_detectors(spark):
    rng = random.Random(21)
    rows = [
        row(minute(rng.randrange(0, 60 * 24 * 9, 30)), src=f"192.168.1.{rng.randrange(3)}", packets=rng.randrange(1, 9),
            dst=rng.choice(["192.168.1.9", "203.0.113.1"]) if rng.random() < 0.3 else f"203.0.113.{rng.randrange(40)}",
            port=rng.choice([0, 22, 53, 443, 8080]), nbytes=rng.randrange(1, 9000))
        for _ in range(900)
    ]
    p = replace(Params(), novelty_min_history=3, fanout_min_destinations=2, spike_min_bytes=100, sigma=1.0)
    a = frame(spark, rows).cache()
    base = baseline(spark, ip="192.168.1.1", peers=(1.0, 0.0))
    m = rollup.device_window_metrics(a, p)

    def both(*parts):
        return sorted(tuple(r) for d in parts for r in d.select(*schemas.ALERT_COLUMNS).collect())

    assert both(detectors.novelty(a, p)) == both(detectors.new_destination(a, p), detectors.new_port(a, p))
    got = both(detectors.metric_alerts(m, base, p))
    assert got == both(detectors.traffic_spike(m, base, p), detectors.destination_fanout(m, base, p))
    assert {g[2] for g in got} == {"TRAFFIC_SPIKE", "DESTINATION_FANOUT"}
