"""Minute rollup and the per-device, per-minute metrics behind the detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import ip, labels
from tidewire.params import Params


def minute_rollup(flows: DataFrame, seconds: int = 60) -> DataFrame:
    """Sum flows per (bucket, collector, source, destination, port, protocol).

    Works on batch and streaming frames alike: a stream only needs a watermark
    on ``event_ts`` before the call.
    """
    kind = labels.normalize_collector_kind(F.col("collector_kind"))
    exporter = F.col("exporter_ip") if "exporter_ip" in flows.columns else F.lit("")
    ident = labels.normalize_collector_id(F.col("collector_id"), kind, exporter)
    return (
        flows.groupBy(
            F.window("event_ts", f"{seconds} seconds").alias("w"),
            kind.alias("collector_kind"),
            ident.alias("collector_id"),
            "src_ip",
            "dst_ip",
            "dst_port",
            "protocol",
        )
        .agg(
            F.sum("bytes").alias("bytes"),
            F.sum("packets").alias("packets"),
            F.count(F.lit(1)).alias("flows"),
            F.bit_or(F.col("tcp_flags").cast("int")).alias("tcp_flags"),
        )
        .select(
            F.col("w.start").alias("bucket_ts"),
            "collector_kind",
            "collector_id",
            "src_ip",
            "dst_ip",
            "dst_port",
            "protocol",
            "bytes",
            "packets",
            "flows",
            "tcp_flags",
            F.to_date("w.start").alias("bucket_date"),
        )
    )


def _valid_port(port: str = "dst_port") -> Column:
    return F.col(port).between(1, 65535)


# protocol numbers 0..255 as four 64 bit words: a set union is bit_or, in codegen
_WORDS = range(4)


def _protocol_word(i: int) -> Column:
    low = 64 * i
    bit = F.expr(f"shiftleft(1L, cast(protocol - {low} as int))")
    return F.when(F.col("protocol").between(low, low + 63), bit).otherwise(F.lit(0).cast("long"))


def protocol_list(word: str = "protocols_") -> Column:
    """Sorted protocol numbers of the four words; empty words are skipped."""

    def decode(i: int) -> Column:
        low, value = 64 * i, F.col(f"{word}{i}")
        set_bit = lambda n: F.call_function("shiftright", value, n).bitwiseAND(1) == 1
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), set_bit)
        numbers = F.transform(bits, lambda n: n + low)
        return F.when(value == 0, F.array().cast("array<int>")).otherwise(numbers)

    return F.concat(*[decode(i) for i in _WORDS])


def device_window_metrics(
    aggregates: DataFrame, params: Params = Params(), with_profile: bool = False
) -> DataFrame:
    """Per local source and bucket: volumes, distinct peers and ports.

    Every row feeds two first-level groups, one by destination and one by port,
    in a single shuffle.  The second level only counts groups, so distinct
    counts need no per-source set in memory and a hot source spreads over all
    tasks until the small final step.
    """
    local = params.local_cidrs
    tagged = (
        aggregates.filter(ip.is_local("src_ip", local))
        .select(
            "src_ip",
            "bucket_ts",
            "protocol",
            "bytes",
            "packets",
            F.col("dst_port").alias("_port"),
            F.explode(
                F.array(
                    F.struct(F.lit("d").alias("tag"), F.col("dst_ip").alias("item")),
                    F.struct(
                        F.lit("p").alias("tag"),
                        F.when(_valid_port(), F.col("dst_port").cast("string")).alias("item"),
                    ),
                )
            ).alias("x"),
        )
        .filter("x.item is not null")
    )
    by_dst = F.col("x.tag") == "d"
    first = [
        F.sum(F.when(by_dst, F.col("bytes"))).alias("bytes"),
        F.sum(F.when(by_dst, F.col("packets"))).alias("packets"),
    ]
    profile = []
    if with_profile:
        first += [
            F.bit_or(
                F.when(
                    by_dst & F.col("_port").between(1, 65535), labels.service_bit(F.col("_port"))
                ).otherwise(0)
            ).alias("services")
        ]
        first += [F.bit_or(_protocol_word(i)).alias(f"protocols_{i}") for i in _WORDS]
        profile = [F.bit_or("services").alias("services")]
        profile += [F.bit_or(f"protocols_{i}").alias(f"protocols_{i}") for i in _WORDS]
    groups = tagged.groupBy(
        "src_ip", "bucket_ts", F.col("x.tag").alias("tag"), F.col("x.item").alias("item")
    ).agg(*first)
    dst = F.col("tag") == "d"
    internal = dst & (F.col("item") != F.col("src_ip")) & ip.is_local("item", local)
    return groups.groupBy("src_ip", "bucket_ts").agg(
        F.sum("bytes").alias("bytes"),
        F.sum("packets").alias("packets"),
        F.count_if(dst & ip.is_unicast("item")).alias("dst_count"),
        F.count_if(~dst).alias("port_count"),
        F.count_if(internal).alias("internal_peers"),
        *profile,
    )


def port_fanout_best(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    """Per local source and bucket: the destination with most distinct ports.

    Ties take the smallest destination.  Ports are counted per destination
    first, so the choice itself is a plain ``min`` over one struct.
    """
    ports = (
        aggregates.filter(_valid_port() & ip.is_local("src_ip", params.local_cidrs))
        .groupBy("src_ip", "bucket_ts", "dst_ip")
        .agg(F.count_distinct("dst_port").alias("port_count"), F.sum("packets").alias("packets"))
    )
    best = F.min(
        F.struct((-F.col("port_count")).alias("neg"), "dst_ip", "packets")
    ).alias("best")
    return ports.groupBy("src_ip", "bucket_ts").agg(best).select(
        "src_ip",
        "bucket_ts",
        F.col("best.dst_ip").alias("dst_ip"),
        (-F.col("best.neg")).alias("port_count"),
        F.col("best.packets").alias("packets"),
    )
