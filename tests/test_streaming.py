import os
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.times import epoch
from tidewire.operators import alerts, detectors, profiles, rollup
from tidewire.params import Params
from tidewire.plans.detect import alert_batch
from tidewire.sources import packets as packet_src
from tidewire.sources import store
from tidewire.streaming import jobs, sources, stateful

T0 = datetime(2026, 7, 9, 10, 0, 0)
FAR = datetime(2026, 12, 1)


def flow(ts, src, dst, port=443, proto=6, nbytes=100, packets=1, flags=0):
    return (ts, src, dst, 50000, port, proto, nbytes, packets, "netflow", "r1", "r1", flags)


def files(spark, tmp_path, rows, schema, parts=3, key=lambda r: r[0]):
    """Rows in time order over several files, read one per trigger."""
    rows = sorted(rows, key=key)
    size = -(-len(rows) // parts)
    folder = str(tmp_path / "in")
    for i in range(parts):
        chunk = rows[i * size:(i + 1) * size]
        if chunk:
            spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
    return sources.flow_stream(spark, folder, schema=schema, max_files=1)


def drain(spark, stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if os.path.exists(out) else spark.createDataFrame([], stream.schema)


def traffic(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        ts = T0 + timedelta(seconds=rng.randrange(0, 1800))
        rows.append(flow(ts, f"192.168.1.{rng.randrange(4)}", f"203.0.113.{rng.randrange(6)}", nbytes=rng.randrange(1, 9999)))
    return rows + [flow(FAR, "10.9.9.9", "1.1.1.1")]


def test_rollup_parity_and_replay(spark, tmp_path):
    rows = traffic()
    stream = files(spark, tmp_path, rows, schemas.FLOW_EVENTS)
    path = str(tmp_path / "agg")
    seen = []
    jobs.start_rollup(stream, path, str(tmp_path / "cp"), then=lambda b, i: seen.append(i), once=True).awaitTermination()
    batch = rollup.minute_rollup(spark.createDataFrame(rows, schemas.FLOW_EVENTS))
    cols = list(schemas.AGGREGATE_KEY) + ["bytes", "packets", "flows"]
    want = sorted(map(tuple, batch.select(*cols).collect()))
    got = sorted(map(tuple, store.read_aggregates(spark, path).select(*cols).collect()))
    assert got == want and seen
    # the same batch again replaces itself; another batch adds up
    again = spark.createDataFrame([r for r in rows if r[0] < FAR], schemas.FLOW_EVENTS)
    store.write_aggregates(rollup.minute_rollup(again), path, "extra")
    store.write_aggregates(rollup.minute_rollup(again), path, "extra")

    def total():
        return store.read_aggregates(spark, path).filter(F.col("bucket_ts") < FAR.replace(hour=0)).agg(F.sum("bytes")).first()[0]

    assert total() == 2 * sum(r[6] for r in rows if r[0] < FAR)
    keys = store.read_aggregates(spark, path, T0, T0 + timedelta(days=1)).count()
    store.compact(spark, path, T0, T0)
    assert store.read_aggregates(spark, path, T0, T0 + timedelta(days=1), merge=False).count() == keys
    assert total() == 2 * sum(r[6] for r in rows if r[0] < FAR)
    plan = store.read_aggregates(spark, path, T0, T0, merge=False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_date" in plan
    assert store.drop_expired(spark, path, FAR + timedelta(days=30), 7) == 2
    assert store.read_aggregates(spark, path).count() == 0


def test_compaction_may_stop_anywhere(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "agg")
    rows = rollup.minute_rollup(spark.createDataFrame([flow(T0, f"10.0.0.{i}", "b") for i in range(10)], schemas.FLOW_EVENTS))
    store.write_aggregates(rows, path, "one")
    store.write_aggregates(rows, path, "two")

    def flows():
        return store.read_aggregates(spark, path).agg(F.sum("flows")).first()[0]

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(store, "_put", stop)  # the base is written, its commit is not
        with pytest.raises(RuntimeError):
            store.compact(spark, path, T0, T0)
    assert flows() == 20
    real = store.write_aggregates

    def and_a_late_delta(*args):
        real(*args)
        real(rows, path, "three")

    with monkeypatch.context() as m:
        m.setattr(store, "write_aggregates", and_a_late_delta)
        store.compact(spark, path, T0, T0)
    assert flows() == 30  # committed; replaced deltas still lie there, the late one counts
    store.compact(spark, path, T0, T0)
    assert flows() == 30
    store.compact(spark, path, T0, T0)
    assert flows() == 30
    left = [n for n in os.listdir(f"{path}/bucket_date={T0:%Y-%m-%d}") if n.startswith("delta=")]
    assert len(left) == 2 and all(n.startswith("delta=base-") for n in left)


def test_two_streams_and_very_late_rows(spark, tmp_path):
    path = str(tmp_path / "agg")
    for name, rows in (("a", [flow(T0, "a", "b")] * 5), ("b", [flow(T0, "c", "d")] * 6 + [flow(T0 - timedelta(days=1), "c", "d")])):
        (tmp_path / name).mkdir()
        stream = files(spark, tmp_path / name, rows, schemas.FLOW_EVENTS, parts=2)
        jobs.start_rollup(stream, path, str(tmp_path / name / "cp"), once=True).awaitTermination()
    got = store.read_aggregates(spark, path)
    assert got.agg(F.sum("flows")).first()[0] == 12 and got.filter(F.col("bucket_ts") < T0).count() == 1
    written = [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(written) <= 5


def test_flood_parity(spark, tmp_path):
    p = replace(Params(), flood_pps=100, flood_udp=50)
    rows = [flow(T0 + timedelta(seconds=i % 7), "8.8.8.8", "192.168.1.9", proto=17, packets=40) for i in range(105)]
    rows.append(flow(FAR, "8.8.8.8", "192.168.1.9"))
    stream = jobs.stream_floods(files(spark, tmp_path, rows, schemas.FLOW_EVENTS), p)
    batch = detectors.floods(detectors.victim_rates(spark.createDataFrame(rows, schemas.FLOW_EVENTS), p), p)
    got = sorted((r.type, r.created_at, r.observed) for r in drain(spark, stream, tmp_path).collect())
    assert got == sorted((r.type, r.created_at, r.observed) for r in batch.collect()) and got


AT = "src_ip string, bucket_ts timestamp, at bigint"


def minute_rows(rows):
    return [(r[0], datetime.fromtimestamp(r[1]), *r[1:]) for r in rows]


def test_beacon_parity(spark, tmp_path):
    rng = random.Random(8)
    rows, t = [], int(T0.timestamp())
    for _ in range(120):
        t += rng.choice([100, 110, 120, 300])
        rows.append((datetime.fromtimestamp(t), "192.168.1.5", "203.0.113.9", 443, 6, 500, 2))
    p = replace(Params(), beacon_observations=4)
    schema = "bucket_ts timestamp, src_ip string, dst_ip string, dst_port int, protocol int, bytes bigint, packets bigint"
    batch = {int(r.created_at.timestamp()) for r in detectors.beaconing(spark.createDataFrame(rows, schema), p).collect()}
    stream = files(spark, tmp_path, rows, schema).withWatermark("bucket_ts", "1 hour").withColumn("at", epoch("bucket_ts"))
    got = {r["at"] for r in drain(spark, stateful.stream_beacons(stream, p), tmp_path).collect()}
    assert got == batch and batch


def test_nighttime_parity(spark, tmp_path):
    rng = random.Random(6)
    rows = [(T0 + timedelta(minutes=37 * i + rng.randrange(30)), f"192.168.1.{i % 3}", 200_000, 1, 1) for i in range(400)]
    schema = "bucket_ts timestamp, src_ip string, bytes bigint, packets bigint, dst_count bigint"
    p = replace(Params(), night_day_windows=3)
    batch = {(r.ip, r.created_at.timestamp()) for r in detectors.nighttime(spark.createDataFrame(rows, schema), p).collect()}
    stream = detectors.significant_windows(files(spark, tmp_path, rows, schema), p).withWatermark("bucket_ts", "1 hour")
    stream = stateful.stream_nighttime(stream.withColumn("at", epoch("bucket_ts")), p)
    got = {(r.src_ip, r["at"]) for r in drain(spark, stream, tmp_path).collect()}
    assert got == batch and batch


def test_profile_and_peer_parity(spark, tmp_path):
    rng = random.Random(5)
    p = replace(Params(), profile_learning=4, profile_dominance=2, profile_confirm=2, peer_learning=4)
    t = int(T0.timestamp())
    rows = [(f"d{i % 2}", datetime.fromtimestamp(t + 60 * i), t + 60 * i, rng.choice("AAB")) for i in range(120)]
    schema = AT + ", signature string"
    batch = profiles.profile_changes(spark.createDataFrame(rows, schema).drop("bucket_ts"), p)
    (tmp_path / "a").mkdir()
    stream = stateful.stream_profile_change(files(spark, tmp_path / "a", rows, schema, key=lambda r: r[1]).withWatermark("bucket_ts", "1 hour"), p)
    got = sorted(map(tuple, drain(spark, stream, tmp_path / "a").collect()))
    assert got == sorted(map(tuple, batch.collect())) and got

    rows = [(r[0], r[1], r[2], sorted({f"10.0.0.{rng.randrange(9)}" for _ in range(3)})) for r in rows]
    schema = AT + ", peers array<string>"
    pairs = spark.createDataFrame(rows, schema).select("src_ip", "at", F.explode("peers").alias("dst_ip"))
    batch = profiles.new_peers(pairs, p)
    (tmp_path / "b").mkdir()
    stream = stateful.stream_internal_peers(files(spark, tmp_path / "b", rows, schema, key=lambda r: r[1]).withWatermark("bucket_ts", "1 hour"), p)
    got = sorted(map(tuple, drain(spark, stream, tmp_path / "b").collect()))
    assert got == sorted(map(tuple, batch.collect())) and got


def test_dedup_parity(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"10.0.0.{rng.randrange(3)}", "T", T0 + timedelta(seconds=17 * i)) for i in range(300)]
    schema = "ip string, type string, created_at timestamp"
    df = spark.createDataFrame(rows, schema).withColumn("note", F.lit(""))
    batch = {(r.ip, r.created_at.timestamp()) for r in alerts.dedup_alerts(df, 600, carry=["note"]).collect()}
    stream = files(spark, tmp_path, rows, schema, key=lambda r: r[2]).withWatermark("created_at", "1 hour")
    stream = stateful.stream_dedup(stream.withColumn("at", epoch("created_at")), 600, ["ip", "type"], [], "ip string, type string, at bigint")
    got = {(r.ip, r["at"]) for r in drain(spark, stream, tmp_path).collect()}
    assert got == batch


def test_packet_flow_parity(spark, tmp_path):
    rng = random.Random(12)
    schema = "event_ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, bytes bigint, tcp_flags smallint"
    rows, t = [], T0.timestamp()
    for _ in range(200):
        t += rng.choice([0.3, 1.2, 5.0, 14.5, 17.0])
        rows.append((datetime.fromtimestamp(t), "10.0.0.1", "1.1.1.1", rng.choice([1, 2]), 53, 17, 100, 2))
    last = (FAR, "10.0.0.9", "1.1.1.1", 9, 53, 17, 1, 0)
    batch = packet_src.packets_to_flows(spark.createDataFrame(rows, schema))
    want = sorted((r.src_port, round(r.event_ts.timestamp(), 6), r.bytes, r.packets) for r in batch.collect())
    slots = jobs.packet_slot_stream(files(spark, tmp_path, [*rows, last, (FAR + timedelta(hours=1), *last[1:])], schema, parts=4))
    out = drain(spark, stateful.stream_packet_flows(slots), tmp_path).filter(F.col("src_port") != 9)
    got = sorted((r.src_port, r.first_us / 1e6, r.bytes, r.packets) for r in out.collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[2:] for g in got] == [w[2:] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-5 for g, w in zip(got, want))


def test_detection_callback(spark, tmp_path):
    p = replace(Params(), novelty_min_history=2, spike_min_bytes=1000)
    day = [flow(T0 - timedelta(minutes=30 + 10 * i), "192.168.1.2", "203.0.113.1", nbytes=10) for i in range(5)]
    new = [flow(T0, "192.168.1.2", "203.0.113.2", port=8443, nbytes=50_000)]
    path, out = str(tmp_path / "agg"), str(tmp_path / "alerts")
    store.write_aggregates(rollup.minute_rollup(spark.createDataFrame(day, schemas.FLOW_EVENTS)), path, "old")
    base = spark.createDataFrame([("192.168.1.2", 10.0, 1.0, 1.0, 0.0, 1.0, 0.0, 9)], schemas.BASELINES)
    callback = jobs.detection_callback(spark, path, lambda: base, out, p)
    sink = jobs.aggregate_sink(path, callback)
    batch = spark.createDataFrame(new, schemas.FLOW_EVENTS)
    sink(batch, 7)
    sink(batch, 7)
    got = sorted((r.type, r.destination_ip) for r in spark.read.parquet(out).collect())
    assert got == [("NEW_DESTINATION", "203.0.113.2"), ("NEW_PORT", "203.0.113.2"), ("TRAFFIC_SPIKE", "")]
    devices = spark.createDataFrame([("192.168.1.2", "", "", "", T0, T0)], schemas.DEVICES)
    fresh = jobs.refresh_baselines(spark, path, devices, base, T0 + timedelta(hours=1), str(tmp_path / "base")).first()
    assert fresh.samples == 6 and fresh.mean_peers == 1.0


def test_minutes_cut_by_batches_are_judged_whole(spark, tmp_path):
    p = replace(Params(), novelty_min_history=2, spike_min_bytes=1000)
    ports = [flow(T0, "192.168.1.3", "203.0.113.5", port=1000 + i, nbytes=10) for i in range(60)]
    peers = [flow(T0, "192.168.1.4", f"203.0.113.{i}", nbytes=10) for i in range(60)]
    spike = [flow(T0, "192.168.1.2", "203.0.113.1", nbytes=400) for _ in range(60)]
    # looks like a scan at first, and is ordinary traffic once the minute is whole
    first = [flow(T0, "192.168.1.6", "203.0.113.5", port=1000 + i, nbytes=10) for i in range(60)]
    later = [flow(T0, "192.168.1.6", "203.0.113.5", port=1000, nbytes=10, packets=9000)]
    base = spark.createDataFrame([("192.168.1.2", 1000.0, 1.0, 1.0, 0.0, 1.0, 0.0, 9)], schemas.BASELINES)
    batches = [[r for rows in (ports, peers, spike) for r in rows[k::6]] for k in range(6)]
    batches[0] += first
    batches[3] += later
    path, out = str(tmp_path / "agg"), str(tmp_path / "alerts")
    sink = jobs.aggregate_sink(path, jobs.detection_callback(spark, path, lambda: base, out, p))
    for k, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schemas.FLOW_EVENTS), k)
    every = spark.createDataFrame([r for rows in batches for r in rows], schemas.FLOW_EVENTS)
    key = ("ip", "type", "created_at", "description")
    want = sorted(tuple(r[c] for c in key) for r in alert_batch(rollup.minute_rollup(every), base, p).collect())
    got = sorted(tuple(r[c] for c in key) for r in jobs.current_candidates(spark, out).collect())
    assert got == want and {w[1] for w in want} == {"TRAFFIC_SPIKE", "DESTINATION_FANOUT", "PORT_FANOUT"}
