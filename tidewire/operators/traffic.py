"""Ranked traffic views, time series, heatmap and record search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import ip
from tidewire.functions.times import bucket_start, epoch, in_range, instant
from tidewire.operators.ordered import one_value

COUNTERS = ("bytes", "packets", "flows")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTERS]


def top_k(df: DataFrame, k: int, key: str = "key") -> DataFrame:
    """Largest by bytes; equal volumes rank by key."""
    return df.orderBy(F.desc("bytes"), F.asc(key)).limit(k)


def totals_by(aggregates: DataFrame, column: str, start, end) -> DataFrame:
    return (
        in_range(aggregates, start, end)
        .groupBy(column)
        .agg(*_sums())
        .select(F.col(column).cast("string").alias("key"), *COUNTERS)
    )


def top_sources(aggregates: DataFrame, start, end, k: int = 10) -> DataFrame:
    return top_k(totals_by(aggregates, "src_ip", start, end), k)


def top_destinations(aggregates: DataFrame, start, end, k: int = 10) -> DataFrame:
    return top_k(totals_by(aggregates, "dst_ip", start, end), k)


def top_ports(aggregates: DataFrame, start, end, k: int = 10) -> DataFrame:
    return top_k(totals_by(aggregates, "dst_port", start, end), k)


def top_protocols(aggregates: DataFrame, start, end, k: int = 10) -> DataFrame:
    return top_k(totals_by(aggregates, "protocol", start, end), k)


def _either_side(aggregates: DataFrame, start, end, *keep: str) -> DataFrame:
    """Each row once per side; traffic of a host with itself counts twice."""
    return in_range(aggregates, start, end).select(
        F.explode(F.array("src_ip", "dst_ip")).alias("ip"), *keep, *COUNTERS
    )


def only_known_devices(df: DataFrame, devices: DataFrame, key: str = "key") -> DataFrame:
    """Keep keys in the device table; an empty table keeps everything."""
    known = devices.select(F.col("ip").alias(key), F.lit(True).alias("_known")).distinct()
    no_devices = one_value(devices.limit(1), F.count(F.lit(1))) == 0
    return (
        df.join(known, key, "left").filter(F.col("_known").isNotNull() | no_devices).drop("_known")
    )


def device_volumes(aggregates: DataFrame, devices: DataFrame, start, end) -> DataFrame:
    totals = (
        _either_side(aggregates, start, end)
        .groupBy("ip")
        .agg(*_sums())
        .select(F.col("ip").alias("key"), *COUNTERS)
    )
    return only_known_devices(totals, devices)


def top_devices_by_volume(
    aggregates: DataFrame, devices: DataFrame, start, end, k: int = 10
) -> DataFrame:
    return top_k(device_volumes(aggregates, devices, start, end), k)


def device_top_peers(aggregates: DataFrame, device: str, start, end, k: int = 10) -> DataFrame:
    """Peers of one device on either side."""
    mine = in_range(aggregates, start, end).filter(
        (F.col("src_ip") == device) | (F.col("dst_ip") == device)
    )
    peer = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("src_ip") == device, F.col("dst_ip")),
                F.when(F.col("dst_ip") == device, F.col("src_ip")),
            )
        )
    )
    return top_k(mine.select(peer.alias("key"), *COUNTERS).groupBy("key").agg(*_sums()), k)


def device_top_ports(aggregates: DataFrame, device: str, start, end, k: int = 10) -> DataFrame:
    mine = aggregates.filter((F.col("src_ip") == device) | (F.col("dst_ip") == device))
    return top_ports(mine, start, end, k)


def _ranked(df: DataFrame, group: str, k: int) -> DataFrame:
    # the rank filter is pushed below the shuffle, so a task sends at most k rows per group
    order = Window.partitionBy(group).orderBy(F.desc("bytes"), F.asc("key"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def all_device_top_peers(aggregates: DataFrame, start, end, k: int = 10) -> DataFrame:
    """Top peers of every device at once."""
    both = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip"), F.col("dst_ip").alias("key")),
            F.struct(F.col("dst_ip").alias("ip"), F.col("src_ip").alias("key")),
        )
    ).alias("x")
    totals = (
        in_range(aggregates, start, end)
        .select(both, *COUNTERS)
        .groupBy(F.col("x.ip").alias("ip"), F.col("x.key").alias("key"))
        .agg(*_sums())
    )
    return _ranked(totals, "ip", k)


def all_device_top_ports(aggregates: DataFrame, start, end, k: int = 10) -> DataFrame:
    """Top ports of every device at once; a row with itself counts once."""
    sides = F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip")
    totals = (
        in_range(aggregates, start, end)
        .select(sides, F.col("dst_port").cast("string").alias("key"), *COUNTERS)
        .groupBy("ip", "key")
        .agg(*_sums())
    )
    return _ranked(totals, "ip", k)


def traffic_timeseries(aggregates: DataFrame, start, end, bucket_seconds: int = 300) -> DataFrame:
    """Totals per bucket, ascending; empty buckets are absent."""
    return (
        in_range(aggregates, start, end)
        .groupBy(bucket_start("bucket_ts", bucket_seconds).alias("timestamp"))
        .agg(*_sums())
        .orderBy("timestamp")
    )


def device_timeseries(
    aggregates: DataFrame, device: str, start, end, bucket_seconds: int = 300
) -> DataFrame:
    mine = aggregates.filter((F.col("src_ip") == device) | (F.col("dst_ip") == device))
    return traffic_timeseries(mine, start, end, bucket_seconds)


def activity_cells(aggregates: DataFrame, start, end) -> DataFrame:
    """Totals per (address, UTC hour of day), each row counted on both sides."""
    hour = F.floor(F.pmod(epoch("bucket_ts"), F.lit(86400)) / 3600).cast("int")
    return _either_side(aggregates, start, end, "bucket_ts").groupBy("ip", hour.alias("hour")).agg(*_sums())


def activity_heatmap(
    aggregates: DataFrame, devices: DataFrame, start, end, k: int = 20
) -> DataFrame:
    """(device, UTC hour of day) totals of the k busiest devices.

    The busiest devices are ranked from the cells, so both parts share one
    shuffle.
    """
    cells = activity_cells(aggregates, start, end)
    volumes = cells.groupBy(F.col("ip").alias("key")).agg(*_sums())
    return heatmap_top(cells, top_k(only_known_devices(volumes, devices), k)).orderBy("ip", "hour")


def heatmap_top(cells: DataFrame, top: DataFrame) -> DataFrame:
    """Cells of the ranked devices."""
    return cells.join(top.select(F.col("key").alias("ip")), "ip", "left_semi")


# --- search --------------------------------------------------------------------


def tokens(query: str | None) -> list[str]:
    return (query or "").lower().split()


def search_flows(
    aggregates: DataFrame,
    start,
    end,
    q: str = "",
    protocol: int = 0,
    dst_port: int = 0,
    limit: int = 100,
) -> DataFrame:
    """Aggregate rows whose source or destination matches every token.

    Tokens are LIKE patterns, so ``%`` and ``_`` act as wildcards.  Protocol or
    port zero means any.
    """
    rows = in_range(aggregates, start, end)
    for token in tokens(q):
        like = f"%{token}%"
        rows = rows.filter(F.lower("src_ip").like(like) | F.lower("dst_ip").like(like))
    if protocol > 0:
        rows = rows.filter(F.col("protocol") == protocol)
    if dst_port > 0:
        rows = rows.filter(F.col("dst_port") == dst_port)
    ties = ["src_ip", "dst_ip", "dst_port", "protocol", "collector_kind", "collector_id"]
    return rows.orderBy(F.desc("bucket_ts"), F.desc("bytes"), *ties).limit(limit)


def filter_by_collector(rows: DataFrame, collector_id: str) -> DataFrame:
    return rows.filter(F.col("collector_id") == collector_id) if collector_id else rows


def distinct_collectors(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("collector_id") != "").select("collector_id").distinct().orderBy("collector_id")


def search_top(top: DataFrame, q: str = "") -> DataFrame:
    """Rows whose key contains the text, with percent of the largest volume."""
    found = top.filter(F.lower("key").contains((q or "").strip().lower()))
    largest = F.greatest(one_value(found, F.max("bytes")), F.lit(1))
    return found.withColumn("percent", F.col("bytes") / largest * 100)


# --- derived views ----------------------------------------------------------------


def rates(series: DataFrame, bucket_seconds: int) -> DataFrame:
    return series.select(
        "timestamp",
        *[(F.col(c) / bucket_seconds).alias(f"{c}_per_second") for c in COUNTERS],
    )


def window_totals(series: DataFrame) -> DataFrame:
    return series.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def share(df: DataFrame) -> DataFrame:
    """Percent of the total volume."""
    total = F.coalesce(F.nullif(one_value(df, F.sum("bytes")), F.lit(0)), F.lit(1))
    return df.withColumn("percent", F.col("bytes") / total * 100)


def subnet_activity(cells: DataFrame) -> DataFrame:
    """Bytes per /24 and hour of day, one column per hour."""
    hours = [
        F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("bytes"))), F.lit(0)).alias(f"h{h:02d}")
        for h in range(24)
    ]
    return cells.groupBy(ip.subnet24("ip").alias("subnet")).agg(*hours)


def subnet_summary(devices: DataFrame, risks: DataFrame) -> DataFrame:
    """Device and risky-device count per /24."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(ip.subnet24("ip").alias("subnet")).agg(F.count(F.lit(1)).alias(name))

    both = counted(devices, "devices").join(counted(risks, "risky"), "subnet", "full_outer")
    return both.fillna(0, ["devices", "risky"])


def fill_slots(timeline: DataFrame, start, end, slots: int, columns: Sequence[str]) -> DataFrame:
    """Equal slots over the range, zero filled; the end instant falls in the last slot."""
    low, high = F.unix_micros(instant(start)), F.unix_micros(instant(end))
    width = F.greatest((high - low) / slots, F.lit(1))
    at = F.unix_micros("timestamp")
    slot = F.least(F.lit(slots - 1), F.greatest(F.lit(0), F.floor((at - low) / width)))
    filled = (
        timeline.filter(at.between(low, high))
        .groupBy(slot.cast("long").alias("slot"))
        .agg(*[F.sum(c).alias(c) for c in columns])
    )
    frame = timeline.sparkSession.range(slots).withColumnRenamed("id", "slot")
    return (
        frame.join(filled, "slot", "left")
        .fillna(0, list(columns))
        .select(
            "slot",
            F.timestamp_micros((low + F.col("slot") * width).cast("long")).alias("timestamp"),
            *columns,
        )
        .orderBy("slot")
    )
