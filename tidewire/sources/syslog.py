"""Syslog lines to parsed messages, reduced events and alerts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.barrier import once
from tidewire.functions.ip import in_cidr, is_ip
from tidewire.functions.times import instant

# --- fixed values -----------------------------------------------------------------
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# first match wins; the severity rule of Critical sits between Updates and Devices
CATEGORY_KEYWORDS = (
    ("Netconsole", ("netconsole",)),
    ("Security Detections", ("security detection", "ips", "ids", "threat", "blocked")),
    ("Admin Activity", ("admin activity", "admin", "login")),
    ("VPN", ("vpn",)),
    ("Updates", ("update", "upgrade")),
    ("Critical", ("critical",)),
    ("Devices", ("device",)),
    ("Clients", ("client",)),
    ("Triggers", ("trigger",)),
)
CRITICAL_MAX_SEVERITY = 2

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
PARSED = ("timestamp", "host", "app_name", "proc_id", "msg_id", "facility", "severity", "message")

# a token starts where an address may start: the first token that is an address decides which one is found
IP_TOKEN = r"(?:[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})|(?:[0-9a-fA-F]{1,4}:[0-9a-fA-F:]+)|(?:::[0-9a-fA-F:]+)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def dash_to_empty(c: Column) -> Column:
    return F.when(c == "-", F.lit("")).otherwise(c)


def strip_structured_data(c: Column) -> Column:
    """Drop the leading bracketed element (or dash); unbalanced text is empty."""
    text = _strip(c)
    flat = F.regexp_extract(text, r"(?s)^\[[^\[\]]*\](.*)$", 1)

    def scan(state: Column, ch: Column) -> Column:
        depth = state["depth"] + F.when(ch == "[", 1).when(ch == "]", -1).otherwise(0)
        at = state["at"] + 1
        closed = F.when(
            (state["end"] == 0) & (ch == "]") & (depth == 0), at
        ).otherwise(state["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), closed.alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(text, ""), start, scan)["end"]
    nested = F.when(end > 0, _strip(text.substr(end + 1, F.length(text)))).otherwise(F.lit(""))
    return (
        F.when((text == "") | (text == "-"), F.lit(""))
        .when(text.startswith("- "), _strip(text.substr(F.lit(3), F.length(text))))
        .when(~text.startswith("["), text)
        .when(text.rlike(r"^\[[^\[\]]*\]"), _strip(flat))
        .otherwise(nested)
    )


def split_syslog_tag(message: Column) -> Column:
    """struct(app_name, proc_id, message) of ``app[pid]: message`` text."""
    text = _strip(message)
    tagged = text.rlike(r"^[^\s:]*:")
    tag = F.regexp_extract(text, r"^([^\s:]*):", 1)
    body = _strip(F.regexp_extract(text, r"(?s)^[^\s:]*:(.*)$", 1))
    with_pid = tag.rlike(r"^[^\[]*\[.*\]$")
    return F.struct(
        F.when(~tagged, F.lit(""))
        .when(with_pid, F.regexp_extract(tag, r"^([^\[]*)\[", 1))
        .otherwise(tag)
        .alias("app_name"),
        F.when(tagged & with_pid, F.regexp_extract(tag, r"^[^\[]*\[(.*)\]$", 1))
        .otherwise(F.lit(""))
        .alias("proc_id"),
        F.when(tagged, body).otherwise(text).alias("message"),
    )


def _rfc3164_time(stamp: Column, now: Column) -> Column:
    month = F.array_position(
        F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(stamp, 1, 3))
    ).cast("int")

    def part(pos: int, length: int) -> Column:
        return F.trim(F.substring(stamp, pos, length)).try_cast("int")

    day, hour, minute, second = part(5, 2), part(8, 2), part(11, 2), part(14, 2)
    # days are checked against a leap year, as the line carries no year
    in_month = day.between(1, F.dayofmonth(F.last_day(F.make_date(F.lit(2000), month, F.lit(1)))))
    usable = (
        stamp.rlike(r"^[A-Za-z]{3} [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2}$")
        & (month > 0)
        & in_month
        & (hour < 24)
        & (minute < 60)
        & (second < 60)
    )
    first = F.make_date(F.year(now), month, F.lit(1))
    seconds = F.unix_seconds(F.date_add(first, day - 1).cast("timestamp"))
    return F.when(usable, F.timestamp_seconds(seconds + hour * 3600 + minute * 60 + second))


def parse_syslog(
    lines: DataFrame, now: datetime | str | Column, text: str = "value", max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(parsed messages, rejects with a reason) of RFC5424 and RFC3164 lines.

    Both parts come from ``tagged_syslog``; a caller that needs both should store that and filter it.
    """
    tagged = tagged_syslog(lines, now, text, max_bytes)
    return (
        tagged.filter("reject_reason is null").drop("reject_reason", text),
        tagged.filter("reject_reason is not null").select(*lines.columns, "reject_reason"),
    )


def tagged_syslog(
    lines: DataFrame, now: datetime | str | Column, text: str = "value", max_bytes: int | None = None
) -> DataFrame:
    """Every line with its parts and ``reject_reason``; lines over ``max_bytes`` are rejected only where it is given."""
    now = instant(now)
    raw = F.coalesce(F.col(text), F.lit(""))
    d = once(lines, _line=F.regexp_replace(raw, r"[\x00\r\n]+$", ""))
    number = F.regexp_extract("_line", r"^<([+-]?[0-9]+)>", 1)
    d = once(
        d,
        _pri=F.when(F.length(number).between(1, 3), number.try_cast("int")),
        _shaped=F.length(F.regexp_extract("_line", r"^<([^>]*)>", 1)),
        _rest=_strip(F.regexp_extract("_line", r"(?s)^<[^>]*>(.*)$", 1)),
    )
    d = once(d, _f=F.split("_rest", " ", 7), _old_body=_strip(F.expr("substring(_rest, 16)")))
    new = F.col("_new")
    space = F.expr("instr(_old_body, ' ')")
    d = once(
        d,
        _new=(F.size("_f") == 7) & (F.get("_f", F.lit(0)) == "1"),
        _host=F.substring_index("_old_body", " ", 1),
        _after=F.when(space > 0, _strip(F.expr("substring(_old_body, instr(_old_body, ' ') + 1)"))).otherwise(""),
    )
    stamp = F.get("_f", F.lit(1))
    time5424 = F.when(stamp.rlike(RFC3339), stamp.try_cast("timestamp"))
    d = once(
        d,
        _t=F.when(new, time5424).otherwise(_rfc3164_time(F.substring("_rest", 1, 15), now)),
        _msg=F.when(new, _strip(strip_structured_data(F.get("_f", F.lit(6))))),
        _tag=F.when(~new, split_syslog_tag(F.col("_after"))),
    )
    size = F.octet_length(raw)
    reason = (
        F.when(size == 0, "empty message")
        .when(F.lit(max_bytes is not None) & (size > F.lit(max_bytes or 0)), "message exceeds size limit")
        .when(~F.col("_line").rlike(r"\S"), "blank message")
        .when(~F.col("_line").startswith("<"), "priority missing")
        .when(~F.col("_shaped").between(1, 3), "invalid priority prefix")
        .when(~F.coalesce(F.col("_pri").between(0, 191), F.lit(False)), "invalid priority value")
        .when(F.col("_rest") == "", "no body")
        .when(new & F.col("_t").isNull(), "invalid RFC5424 timestamp")
        .when(new & (F.col("_msg") == ""), "empty body")
        .when(~new & (F.octet_length("_rest") < 16), "message too short")
        .when(~new & F.col("_t").isNull(), "invalid RFC3164 timestamp")
        .when(~new & (F.col("_old_body") == ""), "empty body")
        .when(~new & (F.col("_after") == ""), "host or message missing")
        .when(~new & (F.col("_tag.message") == ""), "empty body")
    )
    field = lambda i: dash_to_empty(F.get("_f", F.lit(i)))
    either = lambda modern, old: F.when(new, modern).otherwise(old)
    return once(
        d,
        timestamp=F.col("_t"),
        host=either(field(2), F.col("_host")),
        app_name=either(field(3), F.col("_tag.app_name")),
        proc_id=either(field(4), F.col("_tag.proc_id")),
        msg_id=either(field(5), F.lit("")),
        facility=F.expr("cast(_pri div 8 as int)"),
        severity=F.col("_pri") % 8,
        message=either(F.col("_msg"), F.col("_tag.message")),
        reject_reason=reason,
    ).select(*lines.columns, *PARSED, "reject_reason")


def syslog_category(message: Column, severity: Column) -> Column:
    low = F.lower(message)
    rules = None
    for name, words in CATEGORY_KEYWORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        if name == "Critical":
            hit = hit | (severity <= CRITICAL_MAX_SEVERITY)
        rules = F.when(hit, name) if rules is None else rules.when(hit, name)
    return rules.otherwise("Other")


def first_ip(message: Column) -> Column:
    """First address-like token that really is an address, else empty."""
    tokens = F.regexp_extract_all(message, F.lit(IP_TOKEN), F.lit(0))
    trimmed = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.:]+|[.:]+$", ""))
    return F.coalesce(F.get(F.filter(trimmed, is_ip), F.lit(0)), F.lit(""))


def syslog_severity(severity: Column, category: Column) -> Column:
    detection = category == "Security Detections"
    return (
        F.when(detection & (severity <= 3), "critical")
        .when(detection, "high")
        .when(severity <= 2, "critical")
        .when(severity == 3, "high")
        .when(severity == 4, "medium")
        .otherwise("low")
    )


def filter_allowed_senders(
    df: DataFrame, allowlist: Sequence[str], sender: str = "sender_ip"
) -> DataFrame:
    """Keep rows of listed senders; an empty list allows everyone."""
    entries = [e.strip() for e in allowlist if e.strip()]
    if not entries:
        return df
    cidrs = [e if "/" in e else f"{e}/{128 if ':' in e else 32}" for e in entries]
    return df.filter(in_cidr(sender, cidrs))


def siem_events(parsed: DataFrame) -> DataFrame:
    """Reduced events of parsed messages; the gateway falls back to the sender."""
    category = syslog_category(F.col("message"), F.col("severity"))
    text = lambda c: F.col(c).cast("string")
    found = once(parsed, _cat=category, _ip=first_ip(F.col("message")))
    return found.select(
        "timestamp",
        F.coalesce(F.nullif("host", F.lit("")), "sender_ip").alias("source_gateway"),
        F.col("_cat").alias("category"),
        syslog_severity(F.col("severity"), F.col("_cat")).alias("severity"),
        F.col("_ip").alias("client_ip"),
        F.col("message").alias("summary"),
        F.create_map(
            *[
                x
                for name in ("app_name", "proc_id", "msg_id", "facility", "severity")
                for x in (F.lit(name), text(name))
            ]
        ).alias("attributes"),
        "sender_ip",
    )


def siem_anomalies(events: DataFrame) -> DataFrame:
    """Alerts from security detections and critical events."""
    detection = F.col("category") == "Security Detections"
    return events.filter(detection | (F.col("severity") == "critical")).select(
        F.coalesce(F.nullif("client_ip", F.lit("")), "sender_ip").alias("ip"),
        F.lit("").alias("destination_ip"),
        F.when(detection, "UNIFI_SECURITY").otherwise("UNIFI_CRITICAL").alias("type"),
        F.col("summary").alias("description"),
        "severity",
        F.lit("active").alias("status"),
        F.col("timestamp").alias("created_at"),
    )
