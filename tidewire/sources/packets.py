"""Packet records to 5-tuple flows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.times import epoch

TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def packet_slots(packets: DataFrame) -> DataFrame:
    """One row per 5-tuple and second.

    Expiry is checked once per second, so packets of one second share a flow
    and can be summed before any ordering; a busy 5-tuple shrinks map-side to
    at most one row per second.
    """
    return (
        packets.filter(F.col("protocol").isin(6, 17))
        .withColumn("_us", F.unix_micros("event_ts"))
        .groupBy(*TUPLE, epoch("event_ts").alias("slot"))
        .agg(
            F.sum("bytes").alias("bytes"),
            F.count(F.lit(1)).alias("packets"),
            F.bit_or(F.col("tcp_flags").cast("int")).alias("tcp_flags"),
            F.min("_us").alias("first_us"),
            F.max("_us").alias("last_us"),
        )
    )


def _sums(column: pa.Array, starts: np.ndarray, add: np.ufunc) -> pa.Array:
    """``add`` over the values from each start to the next; null where a flow has none."""
    held = add.reduceat(pc.fill_null(column, 0).to_numpy(zero_copy_only=False), starts)
    some = np.logical_or.reduceat(pc.is_valid(column).to_numpy(zero_copy_only=False), starts)
    return pa.array(held, mask=~some, type=column.type)


def _flow_starts(new: np.ndarray, slot: np.ndarray, first_us: np.ndarray, active_us: int) -> np.ndarray:
    """Rows that begin a flow: starts of runs, then in each run every first row of the active age since its last cut.

    Each round places the next cut of all runs together.
    """
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    ends = np.append(starts[1:], len(new))
    since = slot - slot[starts][run]
    # seconds of all runs laid end to end, so that one ascending array is searched
    spans = since[ends - 1] + 1
    place = since + (np.cumsum(spans) - spans)[run]
    cut, now = new.copy(), starts
    while len(now):
        due = -(-(first_us[now] + active_us) // 1_000_000) - slot[now]
        then = np.maximum(np.searchsorted(place, place[now] + due), now + 1)
        now = then[then < ends[run[now]]]
        cut[now] = True
    return np.flatnonzero(cut)


def packets_to_flows(
    packets: DataFrame, active_seconds: int = 30, idle_seconds: int = 15, collector: str = "pcap"
) -> DataFrame:
    """Sum bytes, count packets and OR flags per flow.

    A flow ends once it is idle for ``idle_seconds`` or ``active_seconds`` old.
    Idle gaps are found with a window.  The age cut depends on where the
    previous cut fell; rows are streamed to it in the window's own order, with
    no further shuffle, and only finished flows come back.  The memory of a task
    is one Arrow batch and one open flow.  Null addresses and ports are keys
    like others; packets without a time are in no flow.
    """
    active_us = int(active_seconds * 1_000_000)
    # the hash goes first, as texts of one network share the start by which a sort compares
    by_tuple = Window.partitionBy("_hash", *TUPLE).orderBy("slot")
    gap = F.col("slot") * 1_000_000 - F.lag("last_us").over(by_tuple) >= idle_seconds * 1_000_000
    sums = ["bytes", "packets", "tcp_flags"]
    runs = (
        packet_slots(packets.filter(F.col("event_ts").isNotNull()))
        .withColumn("_hash", F.xxhash64(*TUPLE))
        .withColumn("new", F.coalesce(gap, F.lit(True)))
        .select(*TUPLE, *sums, "first_us", "last_us", "slot", "new")
    )
    types = {f.name: f.dataType for f in runs.schema}
    schema = T.StructType([T.StructField(n, types[n]) for n in [*TUPLE, *sums, "first_us", "last_us"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_flow = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch) if open_flow is None else pa.concat_tables([open_flow, pa.table(batch)])
            rows = rows.combine_chunks()
            new, slot, first_us = (rows.column(c).to_numpy() for c in ("new", "slot", "first_us"))
            starts = _flow_starts(new, slot, first_us, active_us)
            begun = rows.take(pa.array(starts))
            last = pc.take(rows.column("last_us"), pa.array(np.append(starts[1:], len(new)) - 1))
            found = {c: begun.column(c) for c in rows.column_names} | {"last_us": last, "new": pa.array(np.ones(len(starts), dtype=bool))}
            for c, add in zip(sums, (np.add, np.add, np.bitwise_or), strict=True):
                found[c] = _sums(rows.column(c).combine_chunks(), starts, add)
            flows = pa.table(found, schema=rows.schema)
            # the last flow may go on in the next batch: its sums stand there as one row that begins a run
            open_flow = flows.slice(len(starts) - 1)
            yield from flows.slice(0, len(starts) - 1).select(schema.names).to_batches()
        if open_flow is not None:
            yield from open_flow.select(schema.names).to_batches()

    return runs.mapInArrow(cut, schema).select(
        F.timestamp_micros("first_us").alias("event_ts"),
        *TUPLE,
        "bytes",
        "packets",
        F.lit("pcap").alias("collector_kind"),
        F.lit(collector).alias("collector_id"),
        F.lit(collector).alias("exporter_ip"),
        F.col("tcp_flags").cast("smallint").alias("tcp_flags"),
        F.timestamp_micros("last_us").alias("last_ts"),
    )
