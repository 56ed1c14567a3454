"""Names, categories, ranks and display text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.params import CHANNELS, COLLECTOR_KINDS, SEVERITIES, UNKNOWN

# --- fixed values ---------------------------------------------------------------
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 58: "ICMPv6"}

SERVICE_PORTS = {
    "dns": (53,),
    "web": (80, 443, 8080, 8443),
    "remote-admin": (22, 23, 3389, 5900),
    "mail": (25, 110, 143, 465, 587, 993, 995),
    "file-sharing": (139, 445, 2049),
    "database": (1433, 1521, 3306, 5432, 6379, 27017),
}

# bit order of a service mask; alphabetical, so decoding yields sorted names
SERVICE_ORDER = (
    "database",
    "dns",
    "file-sharing",
    "high-port",
    "mail",
    "other-system",
    "remote-admin",
    "web",
)

TCP_FLAG_BITS = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")


def normalize_collector_kind(kind: Column) -> Column:
    name = F.lower(F.trim(kind))
    return F.when(name.isin(*COLLECTOR_KINDS), name).otherwise(UNKNOWN)


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_collector_id(ident: Column, kind: Column, exporter: Column) -> Column:
    """First non-blank of id, exporter address and collector kind."""
    return F.coalesce(_filled(ident), _filled(exporter), normalize_collector_kind(kind))


def tcp_flags_from_bits(bits: dict[str, Column] | None = None) -> Column:
    """Flag byte from eight boolean columns named after ``TCP_FLAG_BITS``."""
    bits = bits or {name: F.col(name) for name in TCP_FLAG_BITS}
    values = [
        F.when(bits[name], F.lit(1 << i)).otherwise(0)
        for i, name in enumerate(TCP_FLAG_BITS)
        if name in bits
    ]
    return reduce(lambda a, b: a + b, values).cast("short")


def protocol_name(protocol: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PROTOCOL_NAMES.items() for x in kv])
    return F.coalesce(
        F.try_element_at(table, protocol.cast("int")), F.concat(F.lit("IP "), protocol.cast("string"))
    )


def service_category(port: Column) -> Column:
    named = reduce(
        lambda acc, item: acc.when(port.isin(*item[1]), F.lit(item[0])),
        SERVICE_PORTS.items(),
        F.when(F.lit(False), F.lit("")),
    )
    return named.when((port > 0) & (port < 1024), "other-system").otherwise("high-port")


def service_bit(port: Column) -> Column:
    """The category as one bit of a mask, so sets of categories are ``bit_or``."""
    bit = {name: 1 << i for i, name in enumerate(SERVICE_ORDER)}
    named = reduce(
        lambda acc, item: acc.when(port.isin(*item[1]), F.lit(bit[item[0]])),
        SERVICE_PORTS.items(),
        F.when(F.lit(False), F.lit(0)),
    )
    return named.when((port > 0) & (port < 1024), bit["other-system"]).otherwise(bit["high-port"])


def service_names(mask: Column) -> Column:
    """Sorted category names of a mask."""
    names = F.array(
        *[
            F.when(mask.bitwiseAND(1 << i) > 0, F.lit(name))
            for i, name in enumerate(SERVICE_ORDER)
        ]
    )
    return F.array_compact(names)


def peer_band(peers: Column) -> Column:
    return (
        F.when(peers <= 0, "0").when(peers <= 4, "1-4").when(peers <= 15, "5-15").otherwise("16+")
    )


def normalize_severity(severity: Column) -> Column:
    return F.when(severity.isin(*SEVERITIES), severity).otherwise("low")


def severity_rank(severity: Column, critical_rank: int = 0) -> Column:
    """high 3, medium 2, low 1, anything else 0; critical only if lifted."""
    name = F.lower(severity)
    return (
        F.when(name == "high", 3)
        .when(name == "medium", 2)
        .when(name == "low", 1)
        .when(name == "critical", critical_rank)
        .otherwise(0)
    )


def type_listed(alert_type: Column, types: Sequence[str]) -> Column:
    """Trimmed, case-insensitive membership in a literal list."""
    names = sorted({t.strip().lower() for t in types})
    return F.lower(alert_type).isin(*names) if names else F.lit(False)


def display_name(label: Column, hostname: Column) -> Column:
    return F.coalesce(_filled(label), _filled(hostname), F.lit(""))


def identity(ip: Column, label: Column, hostname: Column) -> Column:
    name = F.coalesce(_filled(label), _filled(hostname))
    return F.when(name.isNotNull(), F.format_string("%s (%s)", name, ip)).otherwise(ip)


def known_channel(channel: Column) -> Column:
    return F.lower(channel).isin(*CHANNELS)


def explain(
    happened: Column,
    unusual: str,
    baseline: Column,
    current: Column,
    expected: Column,
    confidence: str | Column,
    check: str,
) -> Column:
    """Seven labelled parts of an alert text; the numbers are typed columns too."""
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    # fixed values: the labels of the parts
    return F.concat(
        F.lit("what happened: "), happened,
        F.lit("; why unusual: "), F.lit(unusual),
        F.lit("; baseline used: "), baseline,
        F.lit("; current value: "), current,
        F.lit("; expected value: "), expected,
        F.lit("; confidence: "), confidence,
        F.lit("; recommended next check: "), F.lit(check),
    )
