import ipaddress

import pytest
from pyspark.sql import functions as F

from tidewire.functions import codec, ip, labels, times

ADDRESSES = [
    "192.168.1.1", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "01.2.3.4", "1.2.3.4.5",
    "", "abc", "::", "::1", "1::", "fe80::1", "2001:db8::1", "2001:DB8:0:0:0:0:0:1",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9",
    "1::2::3", ":::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "g::1",
    "::ffff:10.1.2.3", "::ffff:0a01:0203", "64:ff9b::192.0.2.33", "::1.2.3.256",
    "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "ff02::1", "fe80::1%eth0", "127.0.0.1",
    "224.0.0.1", "239.255.255.255", "::ffff:127.0.0.1", "::ffff:224.0.0.9", "10.0.0.5",
    "172.16.0.1", "172.31.255.255", "172.32.0.0", "::1:2:3:4:5:6:7:8",
]


def expected_hex(text):
    try:
        if "%" in text:
            return None
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    # a double colon must stand for at least one group
    if a.version == 6 and "::" in text:
        groups = [g for g in text.split(":") if g]
        width = sum(2 if "." in g else 1 for g in groups)
        if width > 7:
            return None
    if a.version == 4:
        return "0" * 20 + "ffff" + f"{int(a):08x}"
    return f"{int(a):032x}"


@pytest.fixture(scope="module")
def addresses(spark):
    return spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")


def test_ip_hex_matches_standard_library(addresses):
    got = {r.ip: r.h for r in addresses.select("ip", ip.ip_hex("ip").alias("h")).collect()}
    assert got == {a: expected_hex(a) for a in ADDRESSES}


def test_is_ip(addresses):
    got = {r.ip: r.v for r in addresses.select("ip", ip.is_ip("ip").alias("v")).collect()}
    assert got == {a: expected_hex(a) is not None for a in ADDRESSES}


def _plain(text):
    h = expected_hex(text)
    if h is None:
        return None
    a = ipaddress.ip_address(int(h, 16))
    if h.startswith("0" * 20 + "ffff"):
        return ipaddress.ip_address(int(h[24:], 16))
    return ipaddress.IPv6Address(int(h, 16)) if a.version == 4 else a


CIDRS = [
    ["192.168.0.0/16"],
    ["10.0.0.0/8", "172.16.0.0/12"],
    ["172.16.0.1/32", "0.0.0.0/0"],
    ["2001:db8::/32", "fe80::/10"],
    ["::/0"],
    ["::ffff:10.0.0.0/104"],
    ["bad", "1.2.3.4", "1.2.3.4/40"],
]


@pytest.mark.parametrize("cidrs", CIDRS)
def test_in_cidr(addresses, cidrs):
    got = {r.ip: r.v for r in addresses.select("ip", ip.in_cidr("ip", cidrs).alias("v")).collect()}
    nets = [n for n in map(ip.parse_cidr, cidrs) if n]
    for text in ADDRESSES:
        a = _plain(text)
        assert got[text] == (a is not None and any(a.version == n.version and a in n for n in nets)), text


@pytest.mark.parametrize("cidrs", CIDRS[:6])
def test_network_key_join_equals_membership(spark, addresses, cidrs):
    nets = spark.createDataFrame([(c,) for c in cidrs], "cidr string").select(
        "cidr", ip.cidr_key(F.col("cidr")).alias("key"), ip.cidr_bits(F.col("cidr")).alias("bits")
    )
    seen = addresses.select("ip", ip.ip_hex("ip").alias("h")).filter("h is not null")
    pairs = (
        seen.crossJoin(nets.select("bits").distinct())
        .select("ip", ip.network_key(F.col("h"), F.col("bits")).alias("key"))
        .join(nets, "key")
    )
    got = {(r.ip, r.cidr) for r in pairs.select("ip", "cidr").collect()}
    want = set()
    for text in ADDRESSES:
        a = _plain(text)
        for c in cidrs:
            n = ip.parse_cidr(c)
            # written in IPv6 spelling, a mapped network keeps its long form
            if n and a is not None and a.version == n.version and a in n:
                want.add((text, c))
    assert got == want


def test_unicast_and_local(addresses):
    rows = addresses.select(
        "ip",
        ip.is_unicast("ip").alias("u"),
        ip.is_local("ip", ["10.0.0.0/8", "127.0.0.0/8", "224.0.0.0/4", "fe80::/10"]).alias("l"),
    ).collect()
    for r in rows:
        a = _plain(r.ip)
        unicast = a is not None and not (a.is_loopback or a.is_multicast or a.is_unspecified)
        assert r.u == unicast, r.ip
        local = unicast and (
            (a.version == 4 and a in ipaddress.ip_network("10.0.0.0/8"))
            or (a.version == 6 and a in ipaddress.ip_network("fe80::/10"))
        )
        assert r.l == local, r.ip


def test_subnet_labels(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("fe80::1",), ("a.b",), ("192.168.4.9",)], "ip string")
    rows = df.select(
        ip.subnet24("ip").alias("s"), ip.subnet_vlan("ip", ["192.168.0.0/16", "fe80::/10"]).alias("v")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("10.1.2.0/24", "10.1.2.0/24"),
        ("Unknown", "fe80::/10"),
        ("Unknown", "Unknown"),
        ("192.168.4.0/24", "192.168.0.0/16"),
    ]


def test_labels(spark):
    df = spark.createDataFrame(
        [(6, 443, 0, "High"), (1, 53, 4, "critical"), (99, 900, 15, "odd"), (58, 40000, 16, "low")],
        "p int, port int, n int, sev string",
    )
    rows = df.select(
        labels.protocol_name(F.col("p")).alias("a"),
        labels.service_category(F.col("port")).alias("b"),
        labels.peer_band(F.col("n")).alias("c"),
        labels.severity_rank(F.col("sev")).alias("d"),
        labels.normalize_severity(F.col("sev")).alias("e"),
        labels.service_names(labels.service_bit(F.col("port"))).alias("f"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("TCP", "web", "0", 3, "low", ["web"]),
        ("ICMP", "dns", "1-4", 0, "critical", ["dns"]),
        ("IP 99", "other-system", "5-15", 0, "low", ["other-system"]),
        ("ICMPv6", "high-port", "16+", 1, "low", ["high-port"]),
    ]


def test_identity_flags_and_collectors(spark):
    df = spark.createDataFrame(
        [(" ", "host", "1.1.1.1", " NetFlow ", "", "9.9.9.9"), ("lab", "", "2.2.2.2", "x", " ", "")],
        "label string, host string, ip string, kind string, id string, exporter string",
    )
    rows = df.select(
        labels.identity(F.col("ip"), F.col("label"), F.col("host")),
        labels.normalize_collector_kind(F.col("kind")),
        labels.normalize_collector_id(F.col("id"), F.col("kind"), F.col("exporter")),
        labels.tcp_flags_from_bits({"syn": F.lit(True), "ack": F.lit(True), "cwr": F.lit(True)}),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("host (1.1.1.1)", "netflow", "9.9.9.9", 0x92),
        ("lab (2.2.2.2)", "unknown", "unknown", 0x92),
    ]


def test_quiet_hours(spark):
    df = spark.createDataFrame(
        [("22:00", "06:00", "23:10"), ("22:00", "06:00", "06:00"), ("22:00", "06:00", "06:01"),
         ("08:00", "17:00", "12:00"), ("", "06:00", "03:00")],
        "s string, e string, t string",
    )
    ts = F.concat(F.lit("2024-01-01 "), F.col("t"), F.lit(":59")).cast("timestamp")
    got = [r[0] for r in df.select(times.in_quiet_hours(ts, F.col("s"), F.col("e"))).collect()]
    assert got == [True, True, False, True, False]


def test_codec(spark):
    df = spark.createDataFrame([('["a","b"]', '{"x":"1"}'), ("", "not json"), (None, None)], "l string, m string")
    rows = df.select(codec.json_list(F.col("l")).alias("l"), codec.json_map(F.col("m")).alias("m")).collect()
    assert [(r.l, r.m) for r in rows] == [(["a", "b"], {"x": "1"}), ([], {}), ([], {})]
    with pytest.raises(Exception, match="corrupt JSON array"):
        spark.createDataFrame([("[oops",)], "l string").select(codec.json_list(F.col("l"))).collect()
