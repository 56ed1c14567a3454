from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire import params, schemas
from tidewire.operators import baseline, rollup, traffic

T0 = datetime(2026, 7, 9, 10, 0, 0)
FLOW = "event_ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, bytes bigint, packets bigint, collector_kind string, collector_id string, exporter_ip string, tcp_flags smallint"


def flow(ts, src, dst, port=443, proto=6, nbytes=100, packets=1, kind="netflow", cid="r1", flags=0):
    return (ts, src, dst, 50000, port, proto, nbytes, packets, kind, cid, cid, flags)


def at(seconds):
    return datetime.fromtimestamp(T0.timestamp() + seconds)


def test_rollup_sums_and_keeps_collectors_apart(spark):
    rows = [
        flow(at(1), "10.0.0.1", "8.8.8.8", nbytes=100, packets=1, flags=2),
        flow(at(6), "10.0.0.1", "8.8.8.8", nbytes=200, packets=2, flags=16),
        flow(at(6), "10.0.0.1", "8.8.4.4", nbytes=1000, packets=10),
        flow(at(6), "10.0.0.1", "8.8.4.4", nbytes=7, packets=1, kind="pcap", cid="eth0"),
    ]
    got = rollup.minute_rollup(spark.createDataFrame(rows, FLOW)).orderBy("bytes").collect()
    assert [(r.bytes, r.packets, r.flows, r.tcp_flags) for r in got] == [
        (7, 1, 1, 0), (300, 3, 2, 18), (1000, 10, 1, 0),
    ]
    assert {r.bucket_ts for r in got} == {T0}


@pytest.fixture(scope="module")
def aggs(spark):
    rows = [
        flow(at(0), "192.168.1.10", "8.8.8.8", nbytes=500, packets=5),
        flow(at(0), "192.168.1.10", "1.1.1.1", nbytes=1500, packets=15),
        flow(at(0), "192.168.1.20", "8.8.8.8", nbytes=10000, packets=20),
    ]
    return rollup.minute_rollup(spark.createDataFrame(rows, FLOW)).cache()


def test_top_views(spark, aggs):
    got = traffic.top_sources(aggs, T0, at(60)).collect()
    assert [(r.key, r.bytes) for r in got] == [("192.168.1.20", 10000), ("192.168.1.10", 2000)]
    assert traffic.top_destinations(aggs, T0, T0).first().bytes == 10500
    assert traffic.top_ports(aggs, T0, T0).first().key == "443"
    series = traffic.traffic_timeseries(aggs, T0, T0, 60).collect()
    assert [(r.bytes, r.packets) for r in series] == [(12000, 40)]
    assert traffic.window_totals(traffic.traffic_timeseries(aggs, at(100), at(200), 60)).first().bytes == 0


def test_known_devices_filter_is_skipped_when_empty(spark, aggs):
    empty = spark.createDataFrame([], schemas.DEVICES)
    some = spark.createDataFrame([("192.168.1.10",)], "ip string")
    assert traffic.top_devices_by_volume(aggs, empty, T0, T0).count() == 4
    assert [r.key for r in traffic.top_devices_by_volume(aggs, some, T0, T0).collect()] == ["192.168.1.10"]
    heat = traffic.activity_heatmap(aggs, some, T0, T0).collect()
    assert [(r.ip, r.hour, r.bytes) for r in heat] == [("192.168.1.10", 10, 2000)]


def test_self_traffic_counts(spark):
    a = rollup.minute_rollup(spark.createDataFrame([flow(at(0), "10.0.0.1", "10.0.0.1", nbytes=5)], FLOW))
    none = spark.createDataFrame([], schemas.DEVICES)
    assert traffic.top_devices_by_volume(a, none, T0, T0).first().bytes == 10
    assert traffic.device_top_peers(a, "10.0.0.1", T0, T0).first().bytes == 10
    assert traffic.device_timeseries(a, "10.0.0.1", T0, T0).first().bytes == 5
    assert traffic.all_device_top_ports(a, T0, T0).first().bytes == 5
    assert traffic.all_device_top_peers(a, T0, T0).first().bytes == 10


def test_search_wildcards_and_limits(spark, aggs):
    assert traffic.search_flows(aggs, T0, T0, "168.1.10 8.8").count() == 1
    assert traffic.search_flows(aggs, T0, T0, "192%20").count() == 1
    assert traffic.search_flows(aggs, T0, T0, protocol=17).count() == 0
    assert traffic.search_flows(aggs, T0, T0, limit=1000).count() == 3
    assert [r.percent for r in traffic.search_top(traffic.top_sources(aggs, T0, T0), "192").collect()] == [100.0, 20.0]
    assert [round(r.percent) for r in traffic.share(traffic.top_sources(aggs, T0, T0)).collect()] == [83, 17]


def test_fill_slots_clamps_the_end(spark):
    df = spark.createDataFrame([(T0, 1), (at(3599), 2), (at(3600), 4), (at(3601), 8)], "timestamp timestamp, total int")
    got = traffic.fill_slots(df, T0, at(3600), 12, ["total"]).collect()
    assert [r.total for r in got] == [1] + [0] * 10 + [6]
    assert got[1].timestamp == at(300)


def test_baselines(spark):
    samples = spark.createDataFrame(
        [("a", 10 * i, i, 2) for i in range(1, 6)] + [("b", 1, 1, 1)] * 4,
        "ip string, bytes bigint, packets bigint, peers bigint",
    )
    got = baseline.device_baselines(samples).collect()
    assert [r.ip for r in got] == ["a"]
    assert (got[0].mean_bytes, round(got[0].stddev_bytes, 4), got[0].stddev_peers) == (30.0, 14.1421, 0.0)
    old = spark.createDataFrame([("a",) + (1.0,) * 6 + (9,), ("z",) + (2.0,) * 6 + (9,)], schemas.BASELINES)
    merged = {r.ip: r.mean_bytes for r in baseline.merge_baselines(old, baseline.device_baselines(samples)).collect()}
    assert merged == {"a": 30.0, "z": 2.0}


def test_device_window_metrics(spark):
    rows = [flow(at(0), "10.0.0.1", f"203.0.113.{i}", port=1000 + i % 3) for i in range(10)]
    rows += [
        flow(at(0), "10.0.0.1", "224.0.0.1", port=0, proto=17),
        flow(at(0), "10.0.0.1", "10.0.0.9", port=445),
        flow(at(0), "10.0.0.1", "10.0.0.9", port=445, kind="pcap"),
        flow(at(0), "203.0.113.1", "10.0.0.1"),
    ]
    a = rollup.minute_rollup(spark.createDataFrame(rows, FLOW))
    r = rollup.device_window_metrics(a, with_profile=True).withColumn("plist", rollup.protocol_list()).collect()
    assert len(r) == 1
    m = r[0]
    assert (m.bytes, m.packets, m.dst_count, m.port_count, m.internal_peers) == (1300, 13, 11, 4, 1)
    assert m.plist == [6, 17]
    best = rollup.port_fanout_best(a).first()
    assert (best.dst_ip, best.port_count, best.packets) == ("10.0.0.9", 1, 2)


def test_query_parameters():
    for bad in (lambda: params.check_bucket(61), lambda: params.check_retention(61)):
        with pytest.raises(ValueError):
            bad()
    assert params.check_bucket() == 300
    assert F is not None
