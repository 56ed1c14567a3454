"""Behavioural and volumetric detectors.

Each returns the alert columns of ``schemas.ALERT_COLUMNS`` plus typed evidence
columns.  Alert times are event times, so a rerun gives the same rows.
Detectors emit every candidate; cooldowns are applied afterwards by
``alerts.dedup_alerts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import ip
from tidewire.functions.labels import explain
from tidewire.functions.times import in_range
from tidewire.operators.baseline import with_baseline
from tidewire.params import Params


def alert(
    df: DataFrame,
    kind: str,
    severity: str,
    description: Column,
    evidence: list[str],
    at: str = "bucket_ts",
    source: str = "src_ip",
    destination: Column | None = None,
) -> DataFrame:
    return df.select(
        F.col(source).alias("ip"),
        (F.lit("") if destination is None else destination).alias("destination_ip"),
        F.lit(kind).alias("type"),
        description.alias("description"),
        F.lit(severity).alias("severity"),
        F.lit("active").alias("status"),
        F.col(at).alias("created_at"),
        *evidence,
    )


# --- volume and fan-out ------------------------------------------------------------


def _spike_hit(params: Params, peers: Column) -> Column:
    """First metric above its floor and its learned limit, else null."""

    def hit(metric: str, value: Column, floor: int) -> Column:
        limit = F.col(f"mean_{metric}") + params.sigma * F.col(f"stddev_{metric}")
        return F.when(
            (value > floor) & (value > limit),
            F.struct(
                F.lit(metric).alias("metric"),
                value.cast("long").alias("observed"),
                limit.alias("limit"),
                F.col(f"mean_{metric}").alias("mean"),
                F.col(f"stddev_{metric}").alias("stddev"),
            ),
        )

    return F.coalesce(
        hit("bytes", F.col("bytes"), params.spike_min_bytes),
        hit("packets", F.col("packets"), params.spike_min_packets),
        hit("peers", peers, params.spike_min_peers),
    )


def _spike_text() -> Column:
    return F.format_string(
        "%s in one window: %d, above the learned limit %.0f (mean %.0f, deviation %.0f)",
        "hit.metric", "hit.observed", "hit.limit", "hit.mean", "hit.stddev",
    )


def traffic_spike(metrics: DataFrame, baselines: DataFrame, params: Params = Params()) -> DataFrame:
    """Volume above an absolute floor and above mean + 3 deviations; first metric wins.

    ``metrics`` may carry ``peers``; the pipeline does not check it, because
    fan-out has its own detector.
    """
    peers = F.col("peers") if "peers" in metrics.columns else F.lit(0).cast("long")
    rows = with_baseline(metrics.withColumn("_peers", peers), baselines)
    rows = rows.withColumn("hit", _spike_hit(params, F.col("_peers"))).filter("hit is not null")
    return alert(
        rows, "TRAFFIC_SPIKE", "high", _spike_text(),
        ["hit.metric", "hit.observed", F.col("hit.limit").alias("limit_value")],
    )


def _with_fanout_limit(metrics: DataFrame, learned: bool, params: Params) -> DataFrame:
    floor = params.fanout_min_destinations
    if not learned:
        return metrics.withColumn("limit_value", F.lit(floor).cast("long")).withColumn(
            "_learned", F.lit(False)
        )
    statistical = F.ceil(F.col("mean_peers") + params.sigma * F.col("stddev_peers"))
    bounded = F.greatest(F.lit(floor), statistical)
    known = F.col("mean_peers").isNotNull()
    return metrics.withColumn(
        "limit_value", F.when(known, bounded).otherwise(floor).cast("long")
    ).withColumn("_learned", known)


def _is_fanout(params: Params) -> Column:
    return (F.col("dst_count") >= F.col("limit_value")) & (
        F.col("packets") <= F.col("dst_count") * params.fanout_packets_per_target
    )


def _fanout_text(params: Params) -> Column:
    count = F.concat(F.col("dst_count").cast("string"), F.lit(" destinations"))
    return explain(
        F.concat(F.lit("device reached "), count, F.lit(" in one window")),
        "wide contact with few packets per host looks like a horizontal scan",
        F.when(F.col("_learned"), "learned peer mean plus 3 deviations").otherwise(
            f"fixed minimum of {params.fanout_min_destinations} destinations"
        ),
        F.concat(count, F.lit(" and "), F.col("packets").cast("string"), F.lit(" packets")),
        F.format_string("fewer than %d destinations", "limit_value"),
        F.when(F.col("_learned"), "high").otherwise("medium"),
        "list the destinations and check for discovery or inventory tools",
    )


def destination_fanout(
    metrics: DataFrame, baselines: DataFrame | None, params: Params = Params()
) -> DataFrame:
    """Many distinct destinations with few packets each."""
    rows = metrics if baselines is None else with_baseline(metrics, baselines)
    rows = _with_fanout_limit(rows, baselines is not None, params).filter(_is_fanout(params))
    return alert(
        rows, "DESTINATION_FANOUT", "high", _fanout_text(params), ["dst_count", "packets", "limit_value"]
    )


def metric_alerts(metrics: DataFrame, baselines: DataFrame, params: Params = Params()) -> DataFrame:
    """Spikes and fan-outs in one pass over the metrics and one baseline join."""

    def made(kind: str, description: Column) -> Column:
        return F.struct(
            F.col("src_ip").alias("ip"), F.lit("").alias("destination_ip"), F.lit(kind).alias("type"),
            description.alias("description"), F.lit("high").alias("severity"),
            F.lit("active").alias("status"), F.col("bucket_ts").alias("created_at"),
        )

    rows = _with_fanout_limit(with_baseline(metrics, baselines), True, params).withColumn(
        "hit", _spike_hit(params, F.lit(0).cast("long"))
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("hit").isNotNull(), made("TRAFFIC_SPIKE", _spike_text())),
            F.when(_is_fanout(params), made("DESTINATION_FANOUT", _fanout_text(params))),
        )
    )
    return rows.select(F.inline(found))


def port_fanout(best: DataFrame, params: Params = Params()) -> DataFrame:
    """Many distinct ports on one destination with few packets each."""
    least = params.fanout_min_ports
    rows = best.filter(
        (F.col("port_count") >= least)
        & (F.col("packets") <= F.col("port_count") * params.fanout_packets_per_target)
    )
    text = explain(
        F.format_string("device reached %d ports of %s in one window", "port_count", "dst_ip"),
        "many ports with few packets each looks like a vertical scan",
        F.lit(f"fixed minimum of {least} ports on one destination"),
        F.format_string("%d ports and %d packets", "port_count", "packets"),
        F.lit(f"fewer than {least} ports"),
        "medium",
        "review the services of the target and ask for planned vulnerability scans",
    )
    return alert(
        rows, "PORT_FANOUT", "high", text, [F.col("dst_ip").alias("target"), "port_count", "packets"]
    )


# --- beaconing ------------------------------------------------------------------------

BEACON_KEY = ["src_ip", "dst_ip", "dst_port", "protocol"]


def beacon_candidates(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    """Low-volume local-to-external rows, one per series and bucket."""
    return (
        aggregates.filter(
            (F.col("dst_port") > 0)
            & F.col("packets").between(1, params.beacon_max_packets)
            & (F.col("bytes") <= params.beacon_max_bytes)
            & ip.is_local("src_ip", params.local_cidrs)
            & ip.is_unicast("dst_ip")
            & ~ip.is_local("dst_ip", params.local_cidrs)
        )
        .select(*BEACON_KEY, "bucket_ts")
        .distinct()
    )


def beaconing(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    """Regular contact: the last n observations have near-equal gaps.

    A series has at most one row per bucket, so even a series with a third of
    all traffic is short when it reaches the window.
    """
    n = params.beacon_observations
    series = Window.partitionBy(*BEACON_KEY).orderBy("_t")
    recent = series.rowsBetween(-(n - 2), 0)
    rows = (
        beacon_candidates(aggregates, params)
        .withColumn("_t", F.unix_micros("bucket_ts"))
        .withColumn("_gap", F.col("_t") - F.lag("_t").over(series))
        .withColumn("_mean", (F.col("_t") - F.lag("_t", n - 1).over(series)) / (n - 1))
        .withColumn("_min", F.min("_gap").over(recent))
        .withColumn("_max", F.max("_gap").over(recent))
    )
    spread = F.greatest(F.col("_max") - F.col("_mean"), F.col("_mean") - F.col("_min"))
    tolerance = F.greatest(
        F.col("_mean") * params.beacon_jitter_ratio, F.lit(params.beacon_jitter_floor * 1e6)
    )
    found = (
        rows.filter(
            F.col("_mean").isNotNull()
            & (F.col("_min") >= params.beacon_min_interval * 1_000_000)
            & (F.col("_max") <= params.beacon_max_interval * 1_000_000)
            & (spread <= tolerance)
        )
        .withColumn("interval_seconds", F.col("_mean") / 1e6)
        .withColumn("jitter", spread / F.col("_mean"))
    )
    return beacon_alerts(found, params)


def beacon_alerts(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Alerts of series with ``bucket_ts``, ``interval_seconds`` and ``jitter``."""
    rows = rows.withColumn("observations", F.lit(params.beacon_observations))
    return alert(
        rows, "BEACONING", "medium", beacon_text(params),
        ["dst_port", "protocol", "observations", "interval_seconds", "jitter", F.col("dst_ip").alias("target")],
    )


def beacon_text(params: Params) -> Column:
    return explain(
        F.format_string("device contacted %s:%d (protocol %d) on a schedule", "dst_ip", "dst_port", "protocol"),
        "small transfers at steady intervals can be command-and-control check-ins",
        F.lit(
            f"{params.beacon_observations} observations within {params.beacon_jitter_ratio:.0%} "
            f"or {params.beacon_jitter_floor:.0f}s"
        ),
        F.format_string(
            "%d observations, every %.0f s, jitter %.1f percent",
            "observations", "interval_seconds", F.col("jitter") * 100,
        ),
        F.lit("irregular timing or an approved scheduled service"),
        "high",
        "find the owning process and verify destination, certificate and scheduled tasks",
    )


# --- night activity ---------------------------------------------------------------------


def significant_windows(metrics: DataFrame, params: Params = Params()) -> DataFrame:
    """Significant windows that fall into the night or day hours of the time zone."""
    hour = F.hour(F.from_utc_timestamp("bucket_ts", params.timezone))
    return (
        metrics.filter(
            (F.col("bytes") >= params.night_min_bytes)
            | (F.col("packets") >= params.night_min_packets)
            | (F.col("dst_count") >= params.night_min_destinations)
        )
        .withColumn("local_hour", hour)
        .withColumn("is_night", F.col("local_hour").between(params.night_start, params.night_end - 1))
        .withColumn("is_day", F.col("local_hour").between(params.day_start, params.day_end - 1))
        .filter("is_night or is_day")
    )


def nighttime(metrics: DataFrame, params: Params = Params()) -> DataFrame:
    """Night activity of a device learned to be active by day.

    ``metrics`` has one row per device and window, which bounds the rows of a
    device by the length of the range.  Two weeks without significant activity
    forget the device.
    """
    device = Window.partitionBy("src_ip").orderBy("bucket_ts")
    so_far = device.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.unix_seconds("bucket_ts") - F.unix_seconds(F.lag("bucket_ts").over(device))
    epochs = significant_windows(metrics, params).withColumn(
        "_epoch", F.sum(F.when(gap > params.night_retention, 1).otherwise(0)).over(so_far)
    )
    within = Window.partitionBy("src_ip", "_epoch").orderBy("bucket_ts")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")).over(before), F.lit(0))
    rows = (
        epochs.withColumn("day_windows", count("is_day"))
        .withColumn("night_windows", count("is_night"))
        .filter(
            F.col("is_night")
            & (F.col("day_windows") >= params.night_day_windows)
            & (F.col("night_windows") < params.night_known_windows)
        )
    )
    return night_alerts(rows, params)


def night_alerts(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Alerts of significant windows with ``day_windows`` and ``night_windows`` counted before them."""
    return alert(
        rows, "NIGHTTIME_TRAFFIC", "medium", night_text(params),
        ["local_hour", "day_windows", "night_windows", "bytes", "packets", "dst_count"],
    )


def night_text(params: Params) -> Column:
    return explain(
        F.format_string(
            f"significant traffic at hour %02d, inside {params.night_start:02d}:00-{params.night_end:02d}:00",
            "local_hour",
        ),
        "the device was learned to be active by day",
        F.format_string("%d day windows and %d night windows", "day_windows", "night_windows"),
        F.format_string("%d bytes, %d packets, %d destinations", "bytes", "packets", "dst_count"),
        F.lit("no significant night activity or an approved schedule"),
        "medium",
        "verify owner, scheduled jobs, remote sessions and update tasks",
    )


# --- novelty --------------------------------------------------------------------------


def source_maturity(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    """(src, bucket, mature): enough distinct buckets in the lookback before it.

    "At least n of the preceding rows are recent" is the same as "the n-th
    preceding row is recent", so one ``lag`` replaces a sliding count.
    """
    device = Window.partitionBy("src_ip").orderBy("_t")
    n = params.novelty_min_history
    buckets = aggregates.select("src_ip", "bucket_ts").distinct().withColumn(
        "_t", F.unix_seconds("bucket_ts")
    )
    if n <= 0:
        return buckets.select("src_ip", "bucket_ts", F.lit(True).alias("mature"))
    nth = F.lag("_t", n).over(device)
    return buckets.select(
        "src_ip",
        "bucket_ts",
        F.coalesce(nth >= F.col("_t") - params.novelty_lookback - 1, F.lit(False)).alias("mature"),
    )


def unseen(aggregates: DataFrame, item: str, params: Params = Params(), extra: list | None = None) -> DataFrame:
    """(src, item, bucket) rows whose pair did not occur in the lookback before.

    Looking at the previous occurrence of the pair replaces an anti join of
    the table with itself.
    """
    pair = Window.partitionBy("src_ip", item).orderBy("_t")
    seen = aggregates.groupBy("src_ip", item, "bucket_ts").agg(
        F.sum("bytes").alias("bytes"), *(extra or [])
    )
    previous = F.lag("_t").over(pair)
    return (
        seen.withColumn("_t", F.unix_seconds("bucket_ts"))
        .withColumn("_prev", previous)
        .filter(F.col("_prev").isNull() | (F.col("_prev") < F.col("_t") - params.novelty_lookback - 1))
        .drop("_t", "_prev")
    )


def source_history(aggregates: DataFrame, start, end) -> DataFrame:
    """Distinct buckets, first sighting and observed flag per source."""
    return (
        in_range(aggregates, start, end)
        .groupBy("src_ip")
        .agg(
            F.count_distinct("bucket_ts").alias("source_buckets"),
            F.min("bucket_ts").alias("source_first_seen"),
            F.lit(True).alias("observed"),
        )
    )


def _only_mature(rows: DataFrame, local: DataFrame, params: Params) -> DataFrame:
    if params.novelty_min_history <= 0:
        return rows
    mature = source_maturity(local, params).filter("mature").drop("mature")
    return rows.join(mature, ["src_ip", "bucket_ts"], "left_semi")


def _destination_text(params: Params) -> Column:
    return explain(
        F.concat(F.lit("device contacted "), F.col("dst_ip"), F.lit(" for the first time in the lookback")),
        "the destination is absent from the retained history of the device",
        F.lit(f"{params.novelty_lookback // 86400} days of aggregates for this pair"),
        F.concat(F.col("dst_ip"), F.lit(" present in this window")),
        F.lit("a destination seen before or approved"),
        "medium",
        "verify DNS, certificate and owner of the destination",
    )


def _port_text(params: Params) -> Column:
    return explain(
        F.format_string("device used port %d on %s for the first time in the lookback", "dst_port", "dst_ip"),
        "the port is absent from the retained history of the device",
        F.lit(f"{params.novelty_lookback // 86400} days of aggregates for this source and port"),
        F.format_string("port %d present in this window", "dst_port"),
        F.lit("a port seen before or approved"),
        "low",
        "verify host, protocol and whether a new service or update introduced the port",
    )


def new_destination(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    """External destinations not contacted in the lookback, for mature sources."""
    local = aggregates.filter(ip.is_local("src_ip", params.local_cidrs))
    external = local.filter(
        ip.is_unicast("dst_ip") & ~ip.is_local("dst_ip", params.local_cidrs)
    )
    rows = _only_mature(unseen(external, "dst_ip", params), local, params)
    return alert(
        rows, "NEW_DESTINATION", "medium", _destination_text(params), ["bytes"], destination=F.col("dst_ip")
    )


def new_port(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    """Destination ports not used in the lookback, for mature sources."""
    local = aggregates.filter(ip.is_local("src_ip", params.local_cidrs))
    ported = local.filter(F.col("dst_port").between(1, 65535))
    rows = unseen(ported, "dst_port", params, [F.min("dst_ip").alias("dst_ip")])
    rows = _only_mature(rows, local, params)
    return alert(rows, "NEW_PORT", "low", _port_text(params), ["dst_port", "bytes"], destination=F.col("dst_ip"))


def novelty_items(local: DataFrame, params: Params = Params(), presence: bool = False) -> DataFrame:
    """(src_ip, bucket_ts, bytes, dst_ip, item) of local sources: external destinations (d...) and ports (p...).

    ``presence`` adds an item ``w`` to every row, so that a source's windows are known from the items alone.
    """
    external = ip.is_unicast("dst_ip") & ~ip.is_local("dst_ip", params.local_cidrs)
    items = [
        F.concat(F.lit("d"), F.when(external, F.col("dst_ip"))),
        F.concat(F.lit("p"), F.when(F.col("dst_port").between(1, 65535), F.col("dst_port").cast("string"))),
    ]
    items += [F.lit("w")] if presence else []
    item = F.explode(F.array_compact(F.array(*items)))
    return local.select("src_ip", "bucket_ts", "bytes", "dst_ip", item.alias("item"))


def novelty_alerts(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Alerts of (src_ip, bucket_ts, item, dst_ip)."""
    is_port = F.col("item").startswith("p")
    port = rows.withColumn("dst_port", F.expr("substring(item, 2)").try_cast("int"))
    kinds = F.when(is_port, F.lit("NEW_PORT")).otherwise("NEW_DESTINATION")
    return port.select(
        F.col("src_ip").alias("ip"),
        F.col("dst_ip").alias("destination_ip"),
        kinds.alias("type"),
        F.when(is_port, _port_text(params)).otherwise(_destination_text(params)).alias("description"),
        F.when(is_port, "low").otherwise("medium").alias("severity"),
        F.lit("active").alias("status"),
        F.col("bucket_ts").alias("created_at"),
    )


def novelty(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    """New destinations and new ports together: one grouping, one maturity check."""
    local = aggregates.filter(ip.is_local("src_ip", params.local_cidrs))
    rows = unseen(novelty_items(local, params), "item", params, [F.min("dst_ip").alias("dst_ip")])
    return novelty_alerts(_only_mature(rows, local, params), params)


# --- floods --------------------------------------------------------------------------------

RATES = ("pps", "bps", "fps", "syn", "udp", "icmp")


def victim_rates(flows: DataFrame, params: Params = Params()) -> DataFrame:
    """Per local destination and tumbling window: whole per-second rates."""
    seconds = params.flood_window
    flags = F.col("tcp_flags").cast("int")
    syn = (F.col("protocol") == 6) & (flags.bitwiseAND(0x02) != 0) & (flags.bitwiseAND(0x10) == 0)

    def packets_if(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("packets")).otherwise(F.lit(0)))

    sums = {
        "pps": F.sum("packets"),
        "bps": F.sum("bytes"),
        "fps": F.count(F.lit(1)),
        "syn": packets_if(syn),
        "udp": packets_if(F.col("protocol") == 17),
        "icmp": packets_if(F.col("protocol").isin(1, 58)),
    }
    return (
        flows.filter(ip.is_local("dst_ip", params.local_cidrs))
        .groupBy(F.window("event_ts", f"{seconds} seconds").alias("w"), "dst_ip")
        .agg(*[v.alias(k) for k, v in sums.items()])
        .select(
            "dst_ip",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *[F.expr(f"{k} div {seconds}").alias(k) for k in RATES],
        )
    )


# fixed values: alert type per rate
FLOOD_TYPES = {
    "pps": "DDOS_ATTACK",
    "bps": "DDOS_ATTACK",
    "fps": "DDOS_FLOW_FLOOD",
    "syn": "DDOS_SYN_FLOOD",
    "udp": "DDOS_UDP_FLOOD",
    "icmp": "DDOS_ICMP_FLOOD",
}
_FLOOD_UNITS = {
    "pps": "packets/s", "bps": "bytes/s", "fps": "flows/s",
    "syn": "SYN packets/s", "udp": "UDP packets/s", "icmp": "ICMP packets/s",
}


def floods(rates: DataFrame, params: Params = Params(), only: str | None = None) -> DataFrame:
    """One alert per rate above its threshold; all six rates in one pass."""
    limits = {r: getattr(params, f"flood_{r}") for r in RATES if only in (None, r)}
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(r) > limit,
                    F.struct(
                        F.lit(FLOOD_TYPES[r]).alias("type"),
                        F.lit(r).alias("rate"),
                        F.col(r).alias("observed"),
                        F.lit(limit).cast("long").alias("limit_value"),
                        F.lit(_FLOOD_UNITS[r]).alias("unit"),
                    ),
                )
                for r, limit in limits.items()
            ]
        )
    )
    rows = rates.select("dst_ip", "window_start", F.explode(hits).alias("h"))
    text = F.format_string(
        "device receives %d %s, above the limit of %d", "h.observed", "h.unit", "h.limit_value"
    )
    return rows.select(
        F.col("dst_ip").alias("ip"),
        F.lit("").alias("destination_ip"),
        F.col("h.type").alias("type"),
        text.alias("description"),
        F.lit("high").alias("severity"),
        F.lit("active").alias("status"),
        F.col("window_start").alias("created_at"),
        "h.rate",
        "h.observed",
        "h.limit_value",
    )
