"""Wiring of streams: rollup to table, detection per micro-batch, floods, refresh."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.times import epoch, in_range
from tidewire.operators import alerts, baseline, detectors, profiles, rollup
from tidewire.params import Params
from tidewire.sources import store
from tidewire.sources.packets import TUPLE

TRIGGER = "15 seconds"


def _query_of(batch: DataFrame) -> str:
    """Id of the stream that the calling thread runs for; it lives as long as the stream's checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def aggregate_sink(path: str, then: Callable[[DataFrame, int], None] | None = None, seconds: int = 60):
    """``foreachBatch`` function over flows: roll the batch up, store it as a delta of its own, then run a callback.

    The sums of a batch are partial: rows of a minute may come in any later batch, however late, and add up on read.
    Streams and batches name the delta, so a replayed batch replaces itself and no two streams meet.
    """

    def write(flows: DataFrame, batch_id: int) -> None:
        batch = rollup.minute_rollup(flows, seconds).persist()
        try:
            store.write_aggregates(batch, path, f"{_query_of(flows)}-{batch_id}", store.files_for(batch))
            if then is not None:
                then(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def start_rollup(flows: DataFrame, path: str, checkpoint: str, then=None, once: bool = False, seconds: int = 60):
    writer = (
        flows.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(aggregate_sink(path, then, seconds))
    )
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=TRIGGER).start()


def novelty_of_batch(batch: DataFrame, history: DataFrame, params: Params = Params()) -> DataFrame:
    """New destinations and ports of a batch against the stored aggregates.

    Only the lookback before the batch and only the batch's sources are read;
    the batch's own rows are part of the table already.
    """
    bounds = batch.agg(F.min("bucket_ts").alias("low"), F.max("bucket_ts").alias("high"))
    low = bounds.select(F.expr(f"low - INTERVAL {params.novelty_lookback + 1} SECONDS")).scalar()
    high = bounds.select("high").scalar()
    sources = batch.select("src_ip").distinct()
    seen = in_range(history, low, high).join(sources, "src_ip", "left_semi")
    current = batch.select("src_ip", "bucket_ts").distinct()
    return detectors.novelty(seen, params).join(
        current.select(F.col("src_ip").alias("ip"), F.col("bucket_ts").alias("created_at")),
        ["ip", "created_at"],
        "left_semi",
    )


def window_alerts(batch: DataFrame, baselines: DataFrame, params: Params = Params()) -> DataFrame:
    """Alerts that need no history beyond the learned baselines."""
    metrics = rollup.device_window_metrics(batch, params)
    best = rollup.port_fanout_best(batch, params)
    found = detectors.port_fanout(best, params).select(*schemas.ALERT_COLUMNS)
    return detectors.metric_alerts(metrics, baselines, params).unionByName(found)


def whole_minutes(batch: DataFrame, history: DataFrame) -> DataFrame:
    """The stored rows, over all batches so far, of the sources and minutes that a batch touched."""
    bounds = batch.agg(F.min("bucket_ts").alias("low"), F.max("bucket_ts").alias("high"))
    stored = in_range(history, bounds.select("low").scalar(), bounds.select("high").scalar())
    touched = batch.select("src_ip", "bucket_ts").distinct()
    return store.merge_key(stored.join(touched, ["src_ip", "bucket_ts"], "left_semi"))


def current_candidates(spark: SparkSession, out: str) -> DataFrame:
    """Stored candidate alerts; of a source's minute only those of the last batch that touched it.

    A minute is judged again whenever rows of it come, so an earlier batch's verdict on a part of it is replaced.
    """
    last = spark.read.parquet(f"{out}-minutes").groupBy("src_ip", "bucket_ts").agg(F.max_by("batch", "written").alias("batch"))
    last = last.select(F.col("src_ip").alias("ip"), F.col("bucket_ts").alias("created_at"), "batch")
    return spark.read.parquet(out).join(last, ["ip", "created_at", "batch"], "left_semi")


def detection_callback(
    spark: SparkSession, path: str, baselines: Callable[[], DataFrame], out: str, params: Params = Params()
):
    """Callback for ``aggregate_sink``: detect on the minutes that a batch touched and store candidate alerts.

    Minutes are read back whole from the table, as a batch holds parts of them only.  ``<out>-minutes`` lists what each
    batch judged; read the alerts with ``current_candidates``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        history = store.read_aggregates(spark, path, merge=False)
        candidates = window_alerts(whole_minutes(batch, history), baselines(), params).unionByName(
            novelty_of_batch(batch, history, params)
        )
        name = f"{_query_of(batch)}-{batch_id}"
        kept = alerts.suppress_types_and_subnets(candidates, params)
        judged = batch.select("src_ip", "bucket_ts").distinct().withColumn("written", F.current_timestamp())
        for rows, to in ((kept, out), (judged, f"{out}-minutes")):
            (
                rows.withColumn("batch", F.lit(name))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch")
                .parquet(to)
            )

    return run


def stream_floods(flows: DataFrame, params: Params = Params(), delay: str = "10 seconds") -> DataFrame:
    """Flood alerts of a flow stream, one pass over five second windows."""
    return detectors.floods(
        detectors.victim_rates(flows.withWatermark("event_ts", delay), params), params
    )


def profile_stream_rows(metrics: DataFrame, params: Params = Params()) -> DataFrame:
    """Keeps the event-time column that the state timers need."""
    return metrics.select(
        "src_ip", "bucket_ts", epoch("bucket_ts").alias("at"),
        profiles.profile_signature(params).alias("signature"),
    )


def packet_slot_stream(packets: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Packets to one row per 5-tuple and second, with event time for the flow timers."""
    return (
        packets.filter(F.col("protocol").isin(6, 17))
        .withColumn("_us", F.unix_micros("event_ts"))
        .withWatermark("event_ts", delay)
        .groupBy(F.window("event_ts", "1 second").alias("slot_window"), *TUPLE)
        .agg(
            F.sum("bytes").alias("bytes"),
            F.count(F.lit(1)).alias("packets"),
            F.bit_or(F.col("tcp_flags").cast("int")).alias("tcp_flags"),
            F.min("_us").alias("first_us"),
            F.max("_us").alias("last_us"),
        )
        .withColumn("slot", epoch("slot_window.start"))
    )


def refresh_baselines(
    spark: SparkSession, path: str, devices: DataFrame, old: DataFrame, now: datetime, out: str, params: Params = Params()
) -> DataFrame:
    """Hourly job: learn from the last week, keep old values where samples are few, and write the table.

    Every run writes a folder of its own under ``out``, named by its time, so readers of the last one are not
    disturbed and a repeated run replaces itself.
    """
    recent = store.read_aggregates(spark, path, now - timedelta(days=7), now, merge=False)
    samples = baseline.baseline_samples(recent, now - timedelta(days=7), now)
    merged = baseline.merge_baselines(old, baseline.device_baselines(samples, devices, params))
    folder = f"{out}/at={now:%Y%m%dT%H%M%S}"
    merged.write.mode("overwrite").parquet(folder)
    return spark.read.schema(merged.schema).parquet(folder)

