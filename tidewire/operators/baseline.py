"""Learned per-device baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import bucket_start, in_range
from tidewire.params import Params

METRICS = ("bytes", "packets", "peers")


def baseline_samples(
    aggregates: DataFrame, start, end, bucket_seconds: int = 60, device: str | None = None
) -> DataFrame:
    """Per source and bucket: volumes and distinct destinations."""
    rows = in_range(aggregates, start, end)
    if device is not None:
        rows = rows.filter(F.col("src_ip") == device)
    bucket = F.col("bucket_ts") if bucket_seconds == 60 else bucket_start("bucket_ts", bucket_seconds)
    return rows.groupBy(F.col("src_ip").alias("ip"), bucket.alias("bucket_ts")).agg(
        F.sum("bytes").alias("bytes"),
        F.sum("packets").alias("packets"),
        F.count_distinct("dst_ip").alias("peers"),
    )


def device_baselines(
    samples: DataFrame, devices: DataFrame | None = None, params: Params = Params()
) -> DataFrame:
    """Mean and population deviation of each metric, for devices with enough samples."""
    stats = [
        f(F.col(m).cast("double")).alias(f"{name}_{m}")
        for m in METRICS
        for name, f in (("mean", F.avg), ("stddev", F.stddev_pop))
    ]
    learned = (
        samples.groupBy("ip")
        .agg(*stats, F.count(F.lit(1)).alias("samples"))
        .filter(F.col("samples") >= params.baseline_min_samples)
    )
    if devices is not None:
        learned = learned.join(devices.select("ip").distinct(), "ip", "left_semi")
    return learned


def merge_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values replace old ones per device; devices without new values keep theirs."""
    columns = [c for c in old.columns if c != "ip"]
    n = new.select("ip", F.struct(*columns).alias("n"))
    o = old.select("ip", F.struct(*columns).alias("o"))
    return o.join(n, "ip", "full_outer").select("ip", F.coalesce("n", "o").alias("b")).select("ip", "b.*")


def with_baseline(metrics: DataFrame, baselines: DataFrame, key: str = "src_ip") -> DataFrame:
    """Left join on device; the planner broadcasts the table when its size allows."""
    return metrics.join(baselines.withColumnRenamed("ip", key).drop("samples"), key, "left")
