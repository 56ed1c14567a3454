"""Learned behaviour: a device's usual signature, and its usual internal peers.

Both number the windows of a device within an activity epoch (a pause longer than the retention starts a new one).
The usual signature is a matter of windows over run lengths.  New internal peers first drop every learned pair by an
anti join; only pairs met after learning go through an ordered pass, as an accepted peer changes what comes later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import ip, labels
from tidewire.functions.labels import explain
from tidewire.operators.detectors import alert
from tidewire.operators.ordered import Step, fold
from tidewire.operators.rollup import protocol_list
from tidewire.params import Params

# fixed values: protocol names inside a signature
_SIGNATURE_NAMES = {1: "icmp", 6: "tcp", 17: "udp"}


def profile_signature(params: Params = Params()) -> Column:
    """Coarse behaviour text of one window from ``device_window_metrics``."""
    def name(p: Column) -> Column:
        named = F.when(F.lit(False), "")
        for number, text in _SIGNATURE_NAMES.items():
            named = named.when(p == number, text)
        return named.otherwise(F.concat(F.lit("ip-"), p.cast("string")))

    def joined(items: Column) -> Column:
        return F.coalesce(F.nullif(F.array_join(items, ","), F.lit("")), F.lit("none"))

    return F.format_string(
        "protocols=%s services=%s peers=%s",
        joined(F.transform(protocol_list(), name)),
        joined(labels.service_names(F.col("services"))),
        labels.peer_band(F.col("dst_count")),
    )


def profile_rows(metrics: DataFrame, params: Params = Params()) -> DataFrame:
    return metrics.select(
        "src_ip", F.unix_seconds("bucket_ts").alias("at"), profile_signature(params).alias("signature")
    )


def numbered_windows(rows: DataFrame, retention: int) -> DataFrame:
    """Add ``epoch`` and ``number`` (from 0 within the epoch) to rows with one row per source and ``at``.

    One row per device and window bounds a device's rows by the length of the range.
    """
    device = Window.partitionBy("src_ip").orderBy("at")
    pause = F.col("at") - F.lag("at").over(device) > retention
    epochs = rows.withColumn("epoch", F.sum(F.coalesce(pause.cast("int"), F.lit(0))).over(device))
    order = Window.partitionBy("src_ip", "epoch").orderBy("at")
    return epochs.withColumn("number", F.row_number().over(order) - 1)


def profile_changes(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """(src_ip, at, old_profile, new_profile) from ``profile_rows``.

    Learning goes in rounds of ``profile_learning`` windows; the first round with a dominant signature ends it.  Later
    windows form runs of equal signatures; only runs of ``profile_confirm`` windows count, and each that differs from
    the one before it (at first from what was learned) is a change at its confirming window.
    """
    e, n = ["src_ip", "epoch"], params.profile_learning
    windows = numbered_windows(rows, params.profile_retention)
    votes = windows.groupBy(*e, F.expr(f"number div {n}").alias("round"), "signature").agg(F.count(F.lit(1)).alias("votes"))
    rounds = votes.groupBy(*e, "round").agg(
        F.sum("votes").alias("seen"), F.min(F.struct((-F.col("votes")).alias("less"), "signature")).alias("top")
    )
    settled = rounds.filter((F.col("seen") == n) & (-F.col("top.less") >= params.profile_dominance))
    learned = settled.groupBy(*e).agg(F.min(F.struct("round", "top.signature")).alias("first"))
    later = windows.join(learned, e).filter(F.col("number") >= (F.col("first.round") + 1) * n)
    order = Window.partitionBy(*e).orderBy("number")
    fresh = F.lag("signature").over(order).isNull() | (F.lag("signature").over(order) != F.col("signature"))
    runs = later.withColumn("run", F.sum(fresh.cast("int")).over(order))
    within = Window.partitionBy(*e, "run").orderBy("number")
    strong = runs.withColumn("place", F.row_number().over(within)).filter(F.col("place") == params.profile_confirm)
    old = F.coalesce(F.lag("signature").over(order), F.col("first.signature"))
    return (
        strong.withColumn("old_profile", old)
        .filter("old_profile <> signature")
        .select("src_ip", "at", "old_profile", F.col("signature").alias("new_profile"))
    )


def profile_alerts(changes: DataFrame, params: Params = Params()) -> DataFrame:
    text = explain(
        F.concat(F.lit("behaviour moved from ["), F.col("old_profile"), F.lit("] to ["), F.col("new_profile"), F.lit("]")),
        f"the new pattern held for {params.profile_confirm} windows after a stable one was learned",
        F.lit(f"dominant in {params.profile_dominance} of {params.profile_learning} learning windows"),
        F.col("new_profile"),
        F.col("old_profile"),
        "high",
        "verify device role, software changes, exposed services and ownership",
    )
    rows = changes.withColumn("bucket_ts", F.timestamp_seconds("at"))
    return alert(rows, "DEVICE_PROFILE_CHANGE", "high", text, ["old_profile", "new_profile"])


def device_profile_change(metrics: DataFrame, params: Params = Params()) -> DataFrame:
    """``metrics`` comes from ``device_window_metrics(..., with_profile=True)``."""
    return profile_alerts(profile_changes(profile_rows(metrics, params), params), params)


# --- internal peers ---------------------------------------------------------------------


def peer_pairs(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    """(src_ip, at, dst_ip): each internal peer of a local source once per window."""
    local = params.local_cidrs
    return (
        aggregates.filter(
            (F.col("src_ip") != F.col("dst_ip"))
            & ip.is_local("src_ip", local)
            & ip.is_local("dst_ip", local)
        )
        .select("src_ip", F.unix_seconds("bucket_ts").alias("at"), "dst_ip")
        .distinct()
    )


PEER_OUT = "src_ip string, at bigint, dst_ip string"


def confirm_step(confirm: int) -> Step:
    """Smallest peer of a window that was not accepted yet; accepted when it leads ``confirm`` windows in a row.

    Rows come ordered by epoch, number and peer, without windows that hold learned peers only; a missing number breaks
    the row of windows.  State: what was accepted, the last deciding window, its leader and how long it leads.
    """

    def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
        here = (row["epoch"], row["number"])
        if state is None or state["window"][0] != here[0]:
            state = {"accepted": set(), "window": (here[0], -1), "leader": None, "streak": 0}
        if state["window"] == here or row["dst_ip"] in state["accepted"]:
            return state, []
        follows = state["window"][1] == here[1] - 1 and state["leader"] == row["dst_ip"]
        state["streak"] = state["streak"] + 1 if follows else 1
        state["window"], state["leader"] = here, row["dst_ip"]
        if state["streak"] < confirm:
            return state, []
        state["accepted"].add(row["dst_ip"])
        state["leader"] = None
        return state, [(row["src_ip"], row["at"], row["dst_ip"])]

    return step


def new_peers(pairs: DataFrame, params: Params = Params()) -> DataFrame:
    """(src_ip, at, dst_ip) of unknown internal peers that repeat, from ``peer_pairs``."""
    e = ["src_ip", "epoch"]
    windows = numbered_windows(pairs.select("src_ip", "at").distinct(), params.peer_retention)
    placed = pairs.join(windows, ["src_ip", "at"])
    learned = placed.filter(F.col("number") < params.peer_learning).select(*e, "dst_ip").distinct()
    unknown = placed.filter(F.col("number") >= params.peer_learning).join(learned, [*e, "dst_ip"], "left_anti")
    return fold(
        unknown.select("src_ip", "epoch", "number", "dst_ip", "at"), ["src_ip"], ["epoch", "number", "dst_ip"],
        confirm_step(params.peer_confirm), PEER_OUT,
    )


def peer_alerts(found: DataFrame, params: Params = Params()) -> DataFrame:
    text = explain(
        F.concat(F.lit("device contacted internal peer "), F.col("dst_ip")),
        f"the local path is new and repeated for {params.peer_confirm} windows",
        F.lit(f"internal peers of {params.peer_learning} learned windows"),
        F.concat(F.lit("new internal peer "), F.col("dst_ip")),
        F.lit("known internal peers or an approved local service"),
        "medium",
        "check for file sharing, admin access, discovery or lateral movement",
    )
    rows = found.withColumn("bucket_ts", F.timestamp_seconds("at"))
    return alert(rows, "NEW_INTERNAL_COMMUNICATION", "medium", text, [], destination=F.col("dst_ip"))


def new_internal_communication(aggregates: DataFrame, params: Params = Params()) -> DataFrame:
    return peer_alerts(new_peers(peer_pairs(aggregates, params), params), params)
