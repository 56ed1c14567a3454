"""All behaviour detectors over one aggregate table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tidewire import schemas
from tidewire.functions import ip
from tidewire.operators import alerts, detectors, profiles
from tidewire.operators.rollup import device_window_metrics, port_fanout_best
from tidewire.params import Params


def held(rows: DataFrame) -> DataFrame:
    """Computed once for all that read it: a checkpoint in the cluster's shared folder, or kept where none is named."""
    if rows.sparkSession.conf.get("spark.checkpoint.dir", None):
        return rows.checkpoint()
    return rows.persist()


def detect_all(
    aggregates: DataFrame,
    baselines: DataFrame,
    params: Params = Params(),
    metrics: DataFrame | None = None,
) -> DataFrame:
    """Every candidate alert, spikes first and beaconing last.

    The aggregates are read once: local sources alone, and only the columns
    that detectors use.  ``metrics`` (``device_window_metrics(...,
    with_profile=True)``) may be passed in when the caller has stored it; three
    branches read it.  Spikes and fan-outs share one pass, and so do new
    destinations and ports.
    """
    columns = ["bucket_ts", "src_ip", "dst_ip", "dst_port", "protocol", "bytes", "packets"]
    aggregates = held(aggregates.filter(ip.is_local("src_ip", params.local_cidrs)).select(*columns))
    if metrics is None:
        metrics = held(device_window_metrics(aggregates, params, with_profile=True))
    found = [
        detectors.metric_alerts(metrics, baselines, params),
        detectors.port_fanout(port_fanout_best(aggregates, params), params),
        detectors.nighttime(metrics, params),
        profiles.device_profile_change(metrics, params),
        profiles.new_internal_communication(aggregates, params),
        detectors.novelty(aggregates, params),
        detectors.beaconing(aggregates, params),
    ]
    common = [d.select(*schemas.ALERT_COLUMNS) for d in found]
    return reduce(DataFrame.unionByName, common)


def alert_batch(
    aggregates: DataFrame, baselines: DataFrame, params: Params = Params()
) -> DataFrame:
    """Detected, suppressed and deduplicated alerts, ready for policies."""
    candidates = alerts.suppress_types_and_subnets(
        detect_all(aggregates, baselines, params), params
    )
    return alerts.dedup_alerts(candidates, params.behaviour_cooldown)
